"""Token-id output as Arrow stream files with fixed-size-list batches.

Documents go to tasks by ranges of their id, in order.  Each task writes one Arrow IPC file (the random-access form of the
stream format) of equal-length sequences: ``input_ids`` fixed_size_list<uint16 or uint32>[L] and ``mask`` fixed_size_list<bool>[L].
Ids run on over sequence ends; only the last sequence of a file is padded, and its mask says so.  Batches are not compressed, so
a memory-mapped file gives views of any sequence without a copy.  A second file beside it is the index of its documents: id, start, length.

Files have names of their own for every task attempt, and the manifest, which Spark writes, names those of the attempts that
counted.  A lost executor or a repeated task therefore leaves at most files that no one reads.  Starts in a file are local; the
start in the whole stream adds the sizes of the files before it, known from the manifest (one row per file).

Defined results: a null or empty text is one end id.  Null ids come first.  Repeated rows are documents of their own, one after the other.
An empty table writes no file.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwright.llm.common import settle, ship, shuffle_partitions, text_of
from clickwright.llm.tokens import encoded, encoder
from clickwright.session import scratch_path

MANIFEST = "part int, path string, n_tokens long, n_docs long, n_sequences long"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


class Sequences:
    """Collects ids into equal-length sequences and writes a batch of them at a time."""

    def __init__(self, sink, length: int, dtype: np.dtype, per_batch: int) -> None:
        kind = pa.from_numpy_dtype(dtype)
        item = lambda t: pa.list_(pa.field("item", t, nullable=False), length)
        self.schema = pa.schema([pa.field("input_ids", item(kind)), pa.field("mask", item(pa.bool_()))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.length, self.block = length, np.zeros(length * per_batch, dtype)
        self.fill = self.total = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.block) - self.fill)
            self.block[self.fill : self.fill + n] = ids[at : at + n]
            self.fill, at, self.total = self.fill + n, at + n, self.total + n
            if self.fill == len(self.block):
                self._flush()

    def _flush(self) -> None:
        n = -(-self.fill // self.length)
        if n:
            self.block[self.fill :] = 0
            mask = np.arange(n * self.length) < self.fill
            cols = [pa.array(self.block[: n * self.length]), pa.array(mask)]
            lists = [pa.FixedSizeListArray.from_arrays(c, type=f.type) for c, f in zip(cols, self.schema)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.sequences, self.fill = self.sequences + n, 0

    def close(self) -> None:
        self._flush()
        self.writer.close()


class TokenFile:
    """Reads a token file at random.  Views, not copies, where the file can be mapped."""

    def __init__(self, uri: str) -> None:
        where, path = _place(uri)
        local = isinstance(where, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else where.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self._last: tuple[int, pa.RecordBatch | None] = (-1, None)

    def _batch(self, i: int) -> pa.RecordBatch:
        if self._last[0] != i:
            self._last = (i, self.reader.get_batch(i))
        return self._last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence k."""
        row = self._batch(k // self.per_batch)
        return row.column(0)[k % self.per_batch].values.to_numpy(), row.column(1)[k % self.per_batch].values

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids [start, start + n) of the file's stream."""
        per, parts = self.length * self.per_batch, []
        while n > 0:
            values = self._batch(start // per).column(0).flatten().to_numpy()
            got = values[start % per : start % per + n]
            parts.append(got)
            start, n = start + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def close(self) -> None:
        self._last = (-1, None)
        self.source.close()


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    sequence_length: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequences_per_batch: int = 256,
    files: int | None = None,
) -> DataFrame:
    """Write the files and return the manifest (a written table, one row per file).  ``folder``: a shared one."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "tokens")
    where, path = _place(folder)
    where.create_dir(path, recursive=True)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t"))
    rows = rows.repartitionByRange(files or shuffle_partitions(spark), "id").sortWithinPartitions("id", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        out = where_path = None
        n_docs = 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                where, base = _place(folder)
                where_path = f"{base}/{name}"
                sink, index_sink = where.open_output_stream(f"{where_path}.arrow"), where.open_output_stream(f"{where_path}.index.arrow")
                out = Sequences(sink, sequence_length, encoder(tokenizer).dtype, sequences_per_batch)
                schema = pa.schema([("doc_id", b.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(index_sink, schema)
            starts, sizes = [], []
            for ids in encoded(tokenizer, b.column(1).to_pylist()):
                starts.append(out.total)
                sizes.append(len(ids) + 1)
                out.add(ids)
                out.add(np.array([end_id], ids.dtype))
            index.write_batch(pa.record_batch([b.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            n_docs += b.num_rows
        if out is None:
            return
        out.close()
        index.close()
        sink.close()
        index_sink.close()
        row = [[part], [f"{folder}/{name}"], [out.total], [n_docs], [out.sequences]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["part", "path", "n_tokens", "n_docs", "n_sequences"])

    manifest = settle(rows.mapInArrow(write, MANIFEST), "token-manifest")
    manifest._id_type = id_type
    return manifest


def read_token_files(manifest: DataFrame, id_type: str | None = None) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, path, sequence (its first in the file)."""
    ship(manifest.sparkSession)
    kind = id_type or getattr(manifest, "_id_type", "bigint")
    before = Window.orderBy("part", "path").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))
    spread = based.repartition(max(1, shuffle_partitions(manifest.sparkSession)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, local = _place(f"{path}.index.arrow")
                tokens = TokenFile(f"{path}.arrow")
                with where.open_input_file(local) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        sums = [zlib.crc32(tokens.span(s, n).astype("<u4")) for s, n in zip(starts.tolist(), sizes.tolist())]
                        cols = [docs.column(0), pa.array(starts + base), docs.column(2), pa.array(sums, pa.int64())]
                        cols += [pa.array([path] * docs.num_rows, pa.string()), pa.array(starts // tokens.length)]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "path", "sequence"])
                tokens.close()

    return spread.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, path string, sequence long")
