"""Token ids in Arrow files of equal-length sequences.

Each partition of the documents, in ascending order of ids, becomes one file in Arrow's
random-access (IPC file) format: record batches of fixed-size lists ``ids`` and of lists ``mask`` (bytes:
1 where an id is, 0 in the padding of the file's last sequence). Only a batch's first sequence and a
padded one have a mask of their own; the others, without padding, share the first one's. Any sequence and any mask is a
slice of a memory-mapped buffer. An index file beside it holds (doc_id, start, n_tokens) in batches
as they were written. Files are sized by the bytes of the texts.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import scratch, written
from .tokens import default_path, encoder

SEQUENCE = 1024
BATCH = 256
#: Bytes of text of one file, files that are made at least, and index rows of one batch.
FILE_BYTES, MIN_FILES, INDEX_ROWS = 256 << 20, 8, 65_536


def open_fs(uri: str):
    """(file system, path) of a URI or a local path, by pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class TokenFile:
    """Random access to one file: sequence(k), mask(k) and batch(k) are views of the mapped buffer."""

    def __init__(self, uri: str):
        import pyarrow as pa

        fs, path = open_fs(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.index_source = pa.memory_map(path + ".index") if fs.type_name == "local" else fs.open_input_file(path + ".index")
        self.index = pa.ipc.open_file(self.index_source)
        self.length = self.reader.schema.field("ids").type.list_size

    def batches(self) -> int:
        return self.reader.num_record_batches

    def batch(self, k: int) -> np.ndarray:
        return self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> np.ndarray:
        return self.batch(k // BATCH)[k % BATCH * self.length : (k % BATCH + 1) * self.length]

    def mask(self, k: int) -> np.ndarray:
        column = self.reader.get_batch(k // BATCH).column(1)
        at, stop = column.offsets.to_numpy()[k % BATCH :][:2]
        return column.values.to_numpy(zero_copy_only=True)[at:stop] if stop > at else column.values.to_numpy(zero_copy_only=True)[: self.length]

    def index_batches(self):
        """The index in turn: lists of doc_id, start and n_tokens."""
        for k in range(self.index.num_record_batches):
            yield [c.to_pylist() for c in self.index.get_batch(k).columns]

    def spans(self):
        """(doc_id, start, n_tokens, views) of each document in turn; the views together are its ids."""
        k, flat, base = -1, np.empty(0), 0
        step = BATCH * self.length
        for i, s, n in (row for part in self.index_batches() for row in zip(*part)):
            views, at = [], s
            while at < s + n:
                if at // step != k:
                    k = at // step
                    flat, base = self.batch(k), k * step
                upto = min(s + n, base + step)
                views.append(flat[at - base : upto - base])
                at = upto
            yield i, s, n, views

    def close(self) -> None:
        self.source.close()
        self.index_source.close()


class Writer:
    """Streams ids into one file and its index; holds a batch of each at most."""

    def __init__(self, uri: str, dtype: str, length: int, id_type):
        import pyarrow as pa

        self.fs, self.path = open_fs(uri)
        self.dtype, self.length = np.dtype(dtype), length
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8()))])
        self.out = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index_out = self.fs.open_output_stream(self.path + ".index")
        self.index_writer = pa.ipc.new_file(self.index_out, self.index)
        self.docs, self.parts, self.waiting, self.total = [], [], 0, 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.total, n))
        self.parts.append(ids)
        self.waiting += n
        self.total += n
        if self.waiting >= BATCH * self.length:
            self._flush(False)
        if len(self.docs) >= INDEX_ROWS:
            self._flush_index()

    def _flush_index(self) -> None:
        import pyarrow as pa

        cols = list(zip(*self.docs))
        self.index_writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(cols, self.index)], schema=self.index))
        self.docs = []

    def _flush(self, last: bool) -> None:
        import pyarrow as pa

        flat = np.frombuffer(b"".join(self.parts), dtype=self.dtype)
        step = BATCH * self.length
        upto = len(flat) if last else len(flat) // step * step
        for at in range(0, upto, step):
            ids = flat[at : min(at + step, upto)]
            rows, short = -(-len(ids) // self.length), -len(ids) % self.length
            if short:
                ids = np.concatenate([ids, np.zeros(short, dtype=self.dtype)])
            # the first sequence's mask and, if padded, the last one's
            own = np.zeros(rows, dtype=np.int32)
            own[0] = own[-1 if short else 0] = self.length
            mask = np.ones(own.sum(), dtype=np.uint8)
            mask[len(mask) - short :] = 0
            masks = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, own]), pa.int32()), pa.array(mask))
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), masks], schema=self.schema))
        self.parts, self.waiting = [flat[upto:].tobytes()], len(flat) - upto

    def close(self) -> None:
        self._flush(True)
        if self.docs:
            self._flush_index()
        for x in (self.writer, self.out, self.index_writer, self.index_out):
            x.close()


def write_token_files(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *,
    tokenizer: str | None = None, end_id: int = 0, length: int = SEQUENCE, files: int | None = None,
) -> DataFrame:
    """Writes the files and returns their manifest: part, file, n_docs, n_tokens, base (ids in the files before).

    Files hold ascending ranges of ids (nulls first), ``files`` of them (default: one for each
    FILE_BYTES of text, and no fewer than the session's default parallelism); rows that share an id stay together, in the
    order of their texts. A null text is empty, so it has the end id alone. A task that runs again
    writes another file, and only the file of the run that counts is in the manifest. An empty
    table gives no file. Texts are encoded where they are read and their packed ids cross the network
    once; texts themselves cross only where rows share an id. Ranges follow a sample of the ids.
    """
    spark = docs.sparkSession
    path, tokenizer = path or scratch(spark, "token-files"), tokenizer or default_path()
    if files is None:
        total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        files = max(MIN_FILES, math.ceil(total / FILE_BYTES), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    share = min(1.0, 100 * files / max(1, rows.count()))
    some = [x[0] for x in rows.select("i").dropna().sample(share, seed=1).orderBy("i").collect()]
    bounds = [some[len(some) * k // files] for k in range(1, files)] if some else []
    kind = docs.schema[id_col].dataType
    part = F.size(F.filter(F.array(*(F.lit(b).cast(kind) for b in bounds)), lambda b: b <= F.col("i"))) if bounds else F.lit(0)
    same = rows.groupBy("i").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("i").alias("same"), F.lit(True).alias("twice"))
    rows = rows.withColumn("b", F.coalesce(part, F.lit(0)))
    if same.isEmpty():
        rows = rows.withColumn("twice", F.lit(False))
    else:
        rows = rows.join(same, F.col("i").eqNullSafe(F.col("same")), "left").select("i", "t", "b", F.coalesce("twice", F.lit(False)).alias("twice"))

    def encoded(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        end = enc.pack([end_id])
        for batch in batches:
            i, t, b, twice = batch.columns
            texts = t.to_pylist()
            held = [x if y else None for x, y in zip(texts, twice.to_pylist())]
            yield pa.RecordBatch.from_arrays([i, pa.array(held, t.type), b, pa.array([enc.encode(x) + end for x in texts], pa.binary())], ["i", "t", "b", "ids"])

    rows = rows.mapInArrow(encoded, f"i {kind.simpleString()}, t string, b int, ids binary")
    rows = rows.repartitionById(files, "b").sortWithinPartitions("i", "t").select("i", "ids")

    def run(batches):
        import pyarrow as pa

        enc, out, n = encoder(tokenizer), None, 0
        part = TaskContext.get().partitionId()
        uri = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            if batch.num_rows and out is None:
                fs, folder = open_fs(path)
                fs.create_dir(folder, recursive=True)
                out = Writer(uri, enc.dtype, length, batch.column(0).type)
            for i, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.add(i, ids.as_py())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [uri], "n_docs": pa.array([n]), "n_tokens": pa.array([out.total])})

    made = written(rows.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row a document, read back from the files: doc_id, start, n_tokens, ids_crc32, file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(uri)
                kinds = [f.index.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
                rows = []

                def table(rows, kinds=kinds):
                    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

                for i, s, n, views in f.spans():
                    crc = 0
                    for v in views:
                        crc = zlib.crc32(v.astype("<u4").tobytes(), crc)
                    rows.append((i, base + s, n, crc, uri))
                    if len(rows) == 8192:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)
                f.close()

    n = max(1, manifest.count())
    return manifest.select("file", "base").repartition(n).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, file string")
