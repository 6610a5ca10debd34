"""Token ids of whole texts by the tokenizers library; words that came before are looked up.

The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``. For
byte-level BPE a worker's cache has the words that came before, and the library encodes the new
words of a text in one call.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: The Unicode white space that byte-level pre-tokenizers split at.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
RUNS = re.compile(f"([{WHITE}]+)")
OTHER_WHITE = re.compile(f"[{WHITE.replace(' ', '').replace(chr(10), '')}]")
#: Words of each of a worker's two caches; a full one is kept as the older half while the next one fills (about 200 MB).
CACHED_WORDS = 400_000
END_MARKS = frozenset(".,;:!?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Words:
    """Packed ids of ``prefix + word`` by word, for words without white space."""

    def __init__(self, owner: Encoder, prefix: str):
        self.owner, self.prefix = owner, prefix
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of each word; what is new goes to the library at once."""
        if new := set(words).difference(self.now):
            if len(self.now) + len(new) > CACHED_WORDS:
                self.old, self.now = self.now, {}
                new = set(words)
            self._learn(new)
        return list(map(self.now.__getitem__, words))

    def _learn(self, new: set[str]) -> None:
        """Adds new words; a mark after letters is a piece of its own."""
        ask, marked, now, old = [], [], self.now, self.old
        for w in new:
            ids = old.get(w)
            if ids is not None:
                now[w] = ids
            elif len(w) > 1 and w[-1] in END_MARKS and (head := w[:-1]).isalpha():
                marked.append(w)
                if head not in new and head not in now:
                    ids = old.get(head)
                    if ids is not None:
                        now[head] = ids
                    else:
                        ask.append(head)
            else:
                ask.append(w)
        ask = list(dict.fromkeys(ask))
        now.update(zip(ask, self.owner.each(ask, self.prefix)))
        for w in marked:
            now[w] = now[w[:-1]] + self.owner.marks[w[-1]]


class Encoder:
    """encode(text) gives the ids as packed unsigned integers of ``dtype``, the same as the tokenizer's own.

    For byte-level BPE a text falls into independent words at each single space and each line
    end, and a run of white space is one piece but for its last character. Other tokenizers and
    texts that may hold a special token go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.start, self.inner = _Words(self, ""), _Words(self, " ")
        self.line_end = self.plain("\n")
        self.marks = {m: self.plain(m) for m in END_MARKS}
        #: Which ids begin with a space, as the first piece of a word after a space does and no other.
        self.spaced = np.zeros(max(self.tok.get_vocab(with_added_tokens=True).values(), default=0) + 1, dtype=bool)
        self.spaced[[k for t, k in self.tok.get_vocab(with_added_tokens=True).items() if t.startswith("\u0120")]] = True

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def plain(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def ids_of(self, text: str) -> list[int]:
        """The library's ids, by the call that leaves out their places in the text where it has one (0.20 on)."""
        fast = getattr(self.tok, "encode_batch_fast", None)
        return (fast([text], add_special_tokens=False)[0] if fast else self.tok.encode(text, add_special_tokens=False)).ids

    def each(self, words: list[str], prefix: str) -> list[bytes]:
        """The packed ids of every ``prefix + word``, by one call where the prefix is a space and the ids tell words apart."""
        if prefix == " " and len(words) > 1:
            ids = np.array(self.ids_of(" " + " ".join(words)), dtype=self.dtype)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(words) and first[0] == 0:
                packed, at = ids.tobytes(), (first * ids.itemsize).tolist()
                return [packed[a:b] for a, b in zip(at, [*at[1:], len(packed)])]
        return [self.plain(prefix + w) for w in words]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(x in text for x in self.special):
            return self.plain(text)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or OTHER_WHITE.search(text):
            return self._uneven(text)
        lines = [line.split(" ") for line in text.split("\n")]
        heads = self.start.of([words[0] for words in lines])
        inner = self.inner.of([w for words in lines for w in words[1:]])
        if len(lines) == 1:
            return heads[0] + b"".join(inner)
        out, at = [], 0
        for head, words in zip(heads, lines):
            out.append(head)
            out += inner[at : (at := at + len(words) - 1)]
            out.append(self.line_end)
        out.pop()
        return b"".join(out)

    def _uneven(self, text: str) -> bytes:
        parts = RUNS.split(text)
        inner = [k >= 2 and parts[k - 1][-1] == " " for k in range(0, len(parts), 2)]
        ids = [iter(cache.of([w for w, x in zip(parts[::2], inner) if w and x == side])) for cache, side in ((self.start, False), (self.inner, True))]
        out = []
        for k, part in enumerate(parts):
            if k % 2 == 0:
                if part:
                    out.append(next(ids[inner[k // 2]]))
            elif k == len(parts) - 2 and not parts[-1]:
                out.append(self.white(part))
            else:
                if len(part) > 1:
                    out.append(self.white(part[:-1]))
                if part[-1] != " ":
                    out.append(self.white(part[-1]))
        return b"".join(out)

    def white(self, run: str) -> bytes:
        return self.start.of([run])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    return Encoder(path)
