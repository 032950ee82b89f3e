"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Every task reads its documents once, in order, and keeps a level array: how many windows are open at each fill level.  A piece goes to
the level (0 is a new window) that makes the sum of squares of these counts smallest, so that no level collects many windows that
nothing fits.  A window that is full leaves the task at once.  Documents longer than a window give full windows and one rest; the
rests and all shorter documents are placed whole.

Windows that are still open at the end of a task are few for most length distributions.  Their pieces, with their ids, are pooled in shards of
about ``shard_items`` and placed once more by the same rule.  What is open at the end of a shard is closed without padding: a fill that is a power of two stays
as it is, pieces of the emptiest windows are cut to fill the fullest ones, and the last window is cut into powers of two.  So the
only sequences shorter than ``size`` have a power of two of tokens, and a shard has at most a window of each power and the last one's parts.

A task holds its open windows and one batch of texts.  A shard holds ``shard_items`` pieces of less than ``size`` ids.  Pieces are written, so a
lost executor costs the tasks it ran; a repeated task gives the same sequences, named by its partition.

Defined results: a null or empty text is one end id.  Repeated rows and null ids are documents of their own.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwright.llm.common import settle, ship, text_of
from clickwright.llm.word_tokens import text_ids, word_encoder

PLACED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Levels:
    """Open windows by fill level and the rule that picks the level of the next piece."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size + 1)]

    def choose(self, n: int) -> int:
        """The level whose use gives the smallest sum of squares; of equals the fullest."""
        last = self.size - n
        change = 2 * (self.count[n : self.size + 1] - self.count[: last + 1]) + 2
        change[0] = 2 * self.count[n] + 1  # a new window: nothing leaves level 0
        change[last] = 1 - 2 * self.count[last] if last else 0  # a window that is full is not counted
        usable = self.count[: last + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(last - np.argmin(change[::-1]))

    def place(self, piece: tuple, n: int) -> list | None:
        """Put a piece of n ids; returns the pieces of the window if that fills it."""
        h = self.choose(n)
        window = []
        if h:
            self.count[h] -= 1
            window = self.windows[h].pop()
        window.append(piece)
        if h + n == self.size:
            return window
        self.count[h + n] += 1
        self.windows[h + n].append(window)
        return None

    def open(self) -> list[tuple[int, list]]:
        """(fill, pieces) of the open windows, the fullest first."""
        return [(h, w) for h in range(self.size - 1, 0, -1) for w in self.windows[h]]


def close_without_padding(levels: Levels) -> Iterator[list[tuple]]:
    """Windows of (doc_id, start, ids, doc_tokens) pieces that need no padding, from the open ones of ``levels``."""
    ragged = []
    for fill, window in levels.open():
        if fill & (fill - 1):
            ragged.append((fill, window))
        else:
            yield window
    lo, hi = 0, len(ragged) - 1
    while lo < hi:
        fill, window = ragged[lo]
        have, donor = ragged[hi]
        window, donor = list(window), list(donor)
        while fill < levels.size and donor:
            piece = donor.pop()
            room = levels.size - fill
            give, rest = _cut(piece, room)
            window.append(give)
            fill, have = fill + len(give[2]), have - len(give[2])
            if rest:
                donor.append(rest)
        ragged[lo], ragged[hi] = (fill, window), (have, donor)
        if fill == levels.size:
            yield window
            lo += 1
        if not donor:
            hi -= 1
    if lo == hi:
        fill, window = ragged[lo]
        left = list(reversed(window))
        while fill:
            part, power = [], 1 << (fill.bit_length() - 1)
            fill -= power
            while power:
                give, rest = _cut(left.pop(), power)
                part.append(give)
                power -= len(give[2])
                if rest:
                    left.append(rest)
            yield part


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple | None]:
    doc, start, ids, total = piece
    if len(ids) <= n:
        return piece, None
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def _rows(window: list[tuple], sequence: int) -> Iterator[tuple]:
    at = 0
    for doc, start, ids, total in window:
        yield doc, start, len(ids), zlib.crc32(ids.astype("<u4")), total, sequence, at, None
        at += len(ids)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 8
    types = [id_type] + [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*PLACED, "ids"])


def place_documents(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_items: int = 8192
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in PLACED[1:]) + ", ids binary"

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, sequence, kind = Levels(size), TaskContext.get().partitionId() << 32, None
        for b in batches:
            kind, rows = b.schema.field(0).type, []
            for doc, ids in zip(b.column(0).to_pylist(), text_ids(tokenizer, b.column(1).to_pylist())):
                ids = np.append(ids, np.array([end_id], ids.dtype))
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    piece = (doc, start, part.copy() if len(part) < len(ids) else part, len(ids))
                    window = [piece] if len(part) == size else levels.place(piece, len(part))
                    if window:
                        rows += _rows(window, sequence)
                        sequence += 1
            yield _batch(rows, kind)
        for _, window in levels.open():
            yield _batch([(d, s, len(i), None, n, None, None, i.tobytes()) for d, s, i, n in window], kind)

    def pooled(table: pa.Table) -> pa.Table:
        levels, shard = Levels(size), table.column("shard")[0].as_py()
        sequence, rows, kind = -1 - (shard << 32), [], table.schema.field("doc_id").type
        held = sorted(zip(*[table.column(c).to_pylist() for c in ("order", "doc_id", "start", "ids", "doc_tokens")]), key=lambda r: r[0])
        windows = []
        for _, doc, start, raw, total in held:
            ids = np.frombuffer(raw, dtype)
            windows.append(levels.place((doc, start, ids, total), len(ids)))
        for window in [*filter(None, windows), *close_without_padding(levels)]:
            rows += _rows(window, sequence)
            sequence -= 1
        return pa.Table.from_batches([_batch(rows, kind)]).drop_columns(["ids"])

    dtype = word_encoder(tokenizer).dtype
    rows = settle(docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t")).mapInArrow(online, schema), "placed")
    loose = rows.where("sequence_id IS NULL")
    shards = max(1, -(-loose.count() // shard_items))
    order = F.xxhash64(F.monotonically_increasing_id())
    loose = loose.select("doc_id", "start", "ids", "doc_tokens", order.alias("order")).withColumn("shard", F.pmod("order", F.lit(shards)))
    closed = loose.groupBy("shard").applyInArrow(pooled, schema.removesuffix(", ids binary"))
    return rows.where("sequence_id IS NOT NULL").select(*PLACED).unionByName(settle(closed, "pooled"))
