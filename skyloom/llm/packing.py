"""Vector bin packing of examples into sequences of limited tokens, segments and loss tokens.

A piece is a vector (tokens, 1 segment, loss-bearing tokens). For the open sequence the next
piece is, among those that fit, the one with the largest dot product of its vector with the
sequence's free capacity, both in units of the limits. Where none fits, or only one segment is
left, a larger piece is cut so that it fills the sequence. Packing runs inside each partition
over windows of ``WINDOW`` pieces; what does not fill a sequence stays open for the next window,
so a partition has at most one sequence short of tokens for want of pieces. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .tokens import default_path, encoder

MAX_TOKENS, MAX_SEGMENTS = 1024, 64
WINDOW = 8192


class Piece:
    """Part of an example: its ids from ``start`` on; ``loss`` marks loss-bearing ids (None: all)."""

    __slots__ = ("example", "ids", "loss", "start")

    def __init__(self, example, start: int, ids: np.ndarray, loss: np.ndarray | None):
        self.example, self.start, self.ids, self.loss = example, start, ids, loss

    def key(self) -> tuple[int, int]:
        return len(self.ids), len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, at: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Piece(self.example, self.start, self.ids[:at], a), Piece(self.example, self.start + at, self.ids[at:], b)


class Pool:
    """Pieces waiting, by class of equal (tokens, loss)."""

    def __init__(self):
        self.at: dict[tuple[int, int], int] = {}
        self.stacks: list[list[Piece]] = []
        self.sizes = np.zeros((0, 2))
        self.counts = np.zeros(0, dtype=np.int64)
        self.tokens = self.pieces = 0

    def put(self, p: Piece) -> None:
        k = p.key()
        c = self.at.get(k)
        if c is None:
            c = self.at[k] = len(self.stacks)
            self.stacks.append([])
            if c == len(self.sizes):
                self.sizes = np.vstack([self.sizes, np.zeros((max(64, c), 2))])
                self.counts = np.concatenate([self.counts, np.zeros(max(64, c), dtype=np.int64)])
            self.sizes[c] = k
        self.stacks[c].append(p)
        self.counts[c] += 1
        self.tokens += k[0]
        self.pieces += 1

    def take(self, c: int) -> Piece:
        p = self.stacks[c].pop()
        self.counts[c] -= 1
        self.tokens -= len(p.ids)
        self.pieces -= 1
        return p

    def tidy(self) -> None:
        """Forgets classes without pieces."""
        rest = [p for s in self.stacks for p in s]
        self.__init__()
        for p in rest:
            self.put(p)


class PlainPool:
    """The same for pieces whose ids all bear loss, under a loss limit that is that of tokens: classes are lengths, a bit each."""

    def __init__(self):
        self.stacks: dict[int, list[Piece]] = {}
        self.bits = self.tokens = self.pieces = 0

    def put(self, p: Piece) -> None:
        n = len(p.ids)
        self.stacks.setdefault(n, []).append(p)
        self.bits |= 1 << n
        self.tokens += n
        self.pieces += 1

    def take(self, n: int) -> Piece:
        stack = self.stacks[n]
        p = stack.pop()
        if not stack:
            self.bits ^= 1 << n
        self.tokens -= n
        self.pieces -= 1
        return p

    def tidy(self) -> None:
        self.stacks = {n: stack for n, stack in self.stacks.items() if stack}

    def general(self) -> Pool:
        out = Pool()
        for p in (p for stack in self.stacks.values() for p in stack):
            out.put(p)
        return out


def fill_plain(pool: PlainPool, limits: tuple[int, int, int], cut: bool = True) -> list[Piece]:
    """``fill`` of a plain pool: vectors are multiples of one, so the largest dot product is that of the longest piece that fits."""
    t, s, _ = limits
    out: list[Piece] = []
    while t > 0 and s > 0 and pool.pieces:
        fits = pool.bits & ((1 << (t + 1)) - 1)
        if s == 1 and cut and t < limits[0]:
            fits &= 1 << t
        if fits:
            p = pool.take(fits.bit_length() - 1)
        elif cut and pool.bits > 1:
            p = pool.take(pool.bits.bit_length() - 1)
            if t < len(p.ids):
                p, rest = p.cut(t)
                pool.put(rest)
        elif s == 1 and cut:
            cut = False
            continue
        else:
            break
        t, s = t - len(p.ids), s - 1
        out.append(p)
    return out


def fill(pool: Pool | PlainPool, limits: tuple[int, int, int], cut: bool = True) -> list[Piece]:
    """The pieces of one sequence, taken from the pool."""
    if isinstance(pool, PlainPool):
        return fill_plain(pool, limits, cut)
    tokens, segments, loss = limits
    t, s, b = limits
    out: list[Piece] = []
    while t > 0 and s > 0 and pool.pieces:
        size, there = pool.sizes, pool.counts > 0
        fits = there & (size[:, 0] <= t) & (size[:, 1] <= b)
        if s == 1 and cut and t < tokens:
            fits &= size[:, 0] >= t
        if fits.any():
            dot = size[:, 0] * (t / tokens**2) + size[:, 1] * (b / loss**2) + s / segments**2
            p = pool.take(int(np.argmax(np.where(fits, dot, -1.0))))
        else:
            wider = there & (size[:, 0] > 0) if cut else np.zeros(len(there), dtype=bool)
            if not wider.any():
                if s == 1 and cut:
                    cut = False
                    continue
                break
            p = pool.take(int(np.argmax(np.where(wider, size[:, 0], -1.0))))
            n = min(t, len(p.ids))
            if p.loss is not None:
                n = min(n, int(np.searchsorted(np.cumsum(p.loss), b, side="right")))
            else:
                n = min(n, b)
            if n == 0:
                pool.put(p)
                break
            if n < len(p.ids):
                p, rest = p.cut(n)
                pool.put(rest)
        n, m = p.key()
        t, s, b = t - n, s - 1, b - m
        out.append(p)
    return out


def pack_stream(examples: Iterator[tuple[object, np.ndarray, np.ndarray | None]], limits: tuple[int, int, int], cut: bool = True) -> Iterator[list[Piece]]:
    """Sequences (lists of pieces) of a stream of (example, ids, loss marks)."""
    tokens, _, loss = limits
    pool = PlainPool() if loss == tokens else Pool()
    for example, ids, marks in examples:
        rest = Piece(example, 0, ids, marks)
        if marks is not None and isinstance(pool, PlainPool):
            pool = pool.general()
        if not cut and (len(ids) > tokens or rest.key()[1] > loss):
            raise ValueError("an example is above the limits and may not be cut")
        while len(rest.ids) > tokens or rest.key()[1] > loss:
            n = min(tokens, loss) if marks is None else min(tokens, int(np.searchsorted(np.cumsum(rest.loss), loss, side="right")))
            head, rest = rest.cut(n)
            if n == tokens:
                yield [head]
            else:
                pool.put(head)
        pool.put(rest)
        if pool.pieces >= WINDOW:
            while pool.pieces >= WINDOW // 8 and pool.tokens >= tokens:
                yield fill(pool, limits, cut)
            pool.tidy()
    while pool.pieces:
        yield fill(pool, limits, cut)


SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long"
)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, loss_col: str | None = None, parts_col: str | None = None, tokenizer: str | None = None, end_id: int = 0,
    max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, cut: bool = True, with_ids: bool = False,
) -> DataFrame:
    """One row a piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment, loss_tokens and, if asked, ids.

    A text is tokenized whole and ``end_id`` appended; a null text is empty. loss_col is a
    boolean column: whether the row's ids bear loss (null: they do not); without it all do.
    parts_col, in place of the text, is an array of structs (text, loss): the parts of one example
    in turn, each tokenized by itself and each with its own mark, as prompts and answers have; the
    end id has the last part's mark, a null array has no parts.
    Sequences hold at most max_tokens ids, max_segments pieces and max_loss loss-bearing ids
    (default: as many as tokens). Every id lies in exactly one piece. With cut=False an example
    above the limits is an error. sequence_id is unique, not gapless. Rows with null or repeated
    ids are packed as rows of their own. An empty table gives an empty result.
    """
    tokenizer = tokenizer or default_path()
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    kind = docs.schema[id_col].dataType.simpleString()
    name = id_col if id_col.lower() not in {x.split()[0] for x in SCHEMA.split(", ")} | {"ids"} else free_name(docs, "doc")
    if parts_col:
        text = F.transform(F.coalesce(parts_col, F.array().cast(docs.schema[parts_col].dataType)), lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["loss"], F.lit(False)).alias("loss")))
    else:
        text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("i"), text.alias("t"), F.coalesce(F.col(loss_col), F.lit(False)).alias("b") if loss_col else F.lit(True).alias("b"))

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        end = enc.pack([end_id])
        at = TaskContext.get().partitionId() << 33

        id_type = None

        def examples():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                # a few texts at a time, as they may be long
                for at in range(0, batch.num_rows, 256):
                    for i, t, b in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                        if parts_col:
                            yield of_parts(i, t)
                            continue
                        ids = np.frombuffer(enc.encode(t) + end, dtype=enc.dtype)
                        yield (i, len(ids)), ids, None if b else np.zeros(len(ids), dtype=bool)

        def of_parts(i, parts):
            ids = [np.frombuffer(enc.encode(p["text"]), dtype=enc.dtype) for p in parts] + [np.frombuffer(end, dtype=enc.dtype)]
            loss = [p["loss"] for p in parts]
            marks = np.concatenate([np.full(len(x), y) for x, y in zip(ids, [*loss, bool(loss) and loss[-1]])])
            ids = np.concatenate(ids)
            return (i, len(ids)), ids, marks

        def table(rows):
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], type=id_type)] + [pa.array(c, type=k) for c, k in zip(cols[1:9], [pa.int64()] * 6 + [pa.int32(), pa.int64()])]
            names = [name, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens"]
            if with_ids:
                arrays.append(pa.array(cols[9], type=pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        out = []
        for sequence in pack_stream(examples(), limits, cut):
            offset = 0
            for k, p in enumerate(sequence):
                n, m = p.key()
                row = (p.example[0], p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.example[1], at, offset, k, m)
                out.append((*row, p.ids.astype(np.int32)) if with_ids else row)
                offset += n
            at += 1
            if len(out) >= 4096:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return rows.mapInArrow(run, f"`{name}` {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else ""))


def pack_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, answer: str = "assistant", **limits,
) -> DataFrame:
    """``pack`` of conversations: one example each, its turns in order, with loss on the turns of the role ``answer``.

    Takes the limits and options of ``pack``. Turns that share a number follow by role and text;
    null texts are empty and null roles bear no loss. Turns of a null id are one example. An
    example is the unit that is packed, so its turns meet in one task.
    """
    part = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    whole = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(part)).alias("_turns"))
    parts = F.transform("_turns", lambda x: F.struct(x["text"].alias("text"), (x["role"] == answer).alias("loss")))
    return pack(whole.select(id_col, parts.alias("_parts")), id_col, parts_col="_parts", **limits)
