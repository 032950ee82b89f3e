"""Removal of repeated byte strings with a sparse, distributed suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller id, or same document and earlier start).

Suffixes.  Every window of ``length`` bytes is represented by its anchor: the position of the smallest hash among its ``K``-byte substrings (the
leftmost of equal ones).  Equal windows have the same anchor, so only suffixes that start at anchors are sorted, about one in
35 positions.  A run is the range of window starts that share an anchor; its context is the bytes that these windows cover.

Sort.  Sampled splitters range-partition the suffixes by their leading bytes, then digest of the first K bytes, digest of the context, and
place.  The place is part of the key, so a passage that fills a third of all documents is cut into as many ranges as it needs.
Each bucket is sorted by multikey quicksort, word by word.

Comparison.  Neighbours with equal contexts are the same run of windows: all but the first are repeats.  The windows of the first of its context are
compared one by one if other contexts share its anchor.  A short digest of the bytes that a quarter of a run's windows have in common leaves out the
quarters without a partner; if a bucket ends inside an anchor's group, all of its windows are compared (so nothing is missed at
bucket boundaries).  For that the hashes of these windows are range-partitioned and sorted the same way, and the first row of a bucket is compared with the
last rows of the buckets before it.

Every step moves digests and places; the text is joined twice, by document.  Digest equality is on 8 raw bytes and 64 bits (windows) or
8 raw bytes and 128 bits (contexts).

Defined results: a null text is empty.  Null ids come first.  Repeated rows (same id, same text): one counts as the first, the others as later
documents.  Rows with the same id and other texts are ordered by a hash of the text.  An empty table gives an empty result.  Extra columns are
ignored.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwright.llm.common import settle, ship, shuffle_partitions, text_of

K = 32
GROUP = 1 << 20
SMALL = 1 << 14
OVERSAMPLE = 64
_PLACE = 24  # bits of a position in a group
_LOW = -(1 << 63)

_rng = np.random.Generator(np.random.PCG64(20240601))
_TABLE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Digests of all substrings of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as signed numbers in the bytes' order."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | data[at + j]
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def quarters(length: int) -> list[tuple[int, int]]:
    """Ranges [lo, hi] of the distance from a window's start to its anchor."""
    cuts = np.linspace(0, length - K + 1, 5).astype(int).tolist()
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows in documents [starts, ends) of a buffer: lead, key, ctx, at (anchor), low (first window), n (windows)."""
    empty = {c: np.empty(0, np.int64) for c in ("lead", "key", "ctx", "parts", "at", "low", "n")}
    if len(data) < length:
        return empty
    hashes = Hashes(data)
    grams = hashes.windows(K)
    low_bits = np.uint64((1 << _PLACE) - 1)
    least = (grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - K + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    inside = np.zeros(len(data) + 1, np.int8)
    whole = ends - starts >= length
    inside[starts[whole]] += 1
    inside[ends[whole] - length + 1] -= 1
    places = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
    if not len(places):
        return empty
    anchor = (least[places] & low_bits).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(places) != 1)]))
    low, at = places[first], anchor[first]
    n = np.diff(np.append(first, len(places)))
    shape = ((at - low) << 32 | n).astype(np.uint64)
    ctx = _mixed(hashes.of(low, low + n - 1 + length) + shape * np.uint64(_BASE))
    parts = np.zeros(len(at), np.uint64)
    for lo, hi in quarters(length):
        common = hashes.of(np.maximum(at - lo, 0), np.minimum(at + length - hi, len(data)))
        parts = (parts << np.uint64(16)) | (common >> np.uint64(48))
    cols = {"lead": _leads(data, at), "key": grams[at].view(np.int64), "ctx": ctx.view(np.int64), "parts": parts.view(np.int64)}
    return cols | {"at": at, "low": low, "n": n}


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several words: multikey quicksort.  Equal parts go on with the next word; small ones are sorted at once."""
    out, todo = [], [(np.arange(len(words[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= SMALL or depth == len(words):
            if depth < len(words):
                rows = rows[np.lexsort([w[rows] for w in reversed(words[depth:])])]
            out.append(rows)
            continue
        v = words[depth][rows]
        pivot = np.sort(v[:: max(1, len(v) // 63)])[len(v[:: max(1, len(v) // 63)]) // 2]
        less, more = v < pivot, v > pivot
        todo += [(rows[more], depth), (rows[~(less | more)], depth + 1), (rows[less], depth)]
        todo = [t for t in todo if len(t[0])]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def bucket_of(words: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters (sorted) are at most each row."""
    rows = np.zeros(len(words[0]), np.int64)
    todo = [(np.arange(len(rows)), 0, len(splitters[0]) if splitters else 0, 0)]
    while todo:
        at, lo, hi, depth = todo.pop()
        if depth == len(words) or lo == hi:
            rows[at] = hi
            continue
        own, cut = words[depth][at], splitters[depth][lo:hi]
        a, b = np.searchsorted(cut, own, "left") + lo, np.searchsorted(cut, own, "right") + lo
        rows[at] = a
        tied = a < b
        for x in np.unique(a[tied]):
            sub = tied & (a == x)
            todo.append((at[sub], int(x), int(b[sub][0]), depth + 1))
    return rows.astype(np.int32)


def _groups(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about GROUP bytes: (data, row of each part, part starts, part ends, where a part starts in its text).

    A longer text goes in several parts that overlap by length - 1 bytes, so each window is in one of them.
    """
    parts: list[tuple[int, bytes, int]] = []
    size = 0

    def full():
        lens = np.array([len(b) for _, b, _ in parts], np.int64)
        ends = np.cumsum(lens)
        rows, offsets = (np.array([p[i] for p in parts], np.int64) for i in (0, 2))
        return np.frombuffer(b"".join(b for _, b, _ in parts), np.uint8), rows, ends - lens, ends, offsets

    for row, text in enumerate(batch.column("text")):
        data = text.as_py().encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - length + 1), GROUP):
            part = data[at : at + GROUP + length - 1]
            parts.append((row, part, at))
            size += len(part)
            if size >= GROUP:
                yield full()
                parts, size = [], 0
    if parts:
        yield full()


SUFFIX = ["lead", "key", "ctx", "doc", "twin", "pos"]
WINDOW = ["lead", "key", "doc", "twin", "pos"]


def _batch(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))


def _suffixes(length: int, splitters: list[np.ndarray] | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, twin = (b.column(c).to_numpy() for c in ("doc", "twin"))
            for data, rows, starts, ends, offsets in _groups(b, length):
                a = anchors(data, starts, ends, length)
                part = np.searchsorted(starts, a["low"], "right") - 1
                # of empty parts, which start where the next one does, the last is meant
                shift = offsets[part] - starts[part]
                cols = {"lead": a["lead"], "key": a["key"], "ctx": a["ctx"], "parts": a["parts"], "doc": doc[rows[part]], "twin": twin[rows[part]]}
                cols |= {"pos": a["at"] + shift, "low": a["low"] + shift, "n": a["n"]}
                yield _batch({"bucket": bucket_of([cols[c] for c in SUFFIX], splitters or [])} | cols)

    return of


def _sorted_bucket(batches: Iterator[pa.RecordBatch], words: list[str]) -> dict[str, np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    table = pa.Table.from_batches(got)
    cols = {c: table.column(c).to_numpy() for c in table.column_names}
    order = multikey_order([cols[c] for c in words])
    return {c: v[order] for c, v in cols.items()}


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


SPANS = "kind int, doc long, twin long, s long, e long"


def _compare_suffixes(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _sorted_bucket(batches, SUFFIX)
        if c is None:
            return
        group = _changes([c["lead"], c["key"]])
        first = group | _changes([c["ctx"]])
        number = np.cumsum(group) - 1
        contexts = np.bincount(number, first)[number]
        open_end = (number == 0) | (number == number[-1])


        def spans(kind: int, rows: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
            return _batch({"kind": np.full(len(rows), kind, np.int32), "doc": c["doc"][rows], "twin": c["twin"][rows], "s": s, "e": e})

        rows = np.flatnonzero(~first)
        yield spans(0, rows, c["low"][rows], c["low"][rows] + c["n"][rows] - 1 + length)
        edge = np.flatnonzero(first & ((contexts > 1) | open_end))
        for j, (lo, hi) in enumerate(quarters(length)):
            s = np.maximum(c["low"][edge], c["pos"][edge] - hi)
            e = np.minimum(c["low"][edge] + c["n"][edge], c["pos"][edge] - lo + 1)
            rows, s, e = edge[s < e], s[s < e], e[s < e]
            digest = (c["parts"][rows].view(np.uint64) >> np.uint64(16 * (3 - j))) & np.uint64(0xFFFF)
            _, same, many = np.unique(number[rows] << 16 | digest.astype(np.int64), return_inverse=True, return_counts=True)
            met = open_end[rows] | (many[same] > 1) if len(rows) else np.zeros(0, bool)
            yield spans(1, rows[met], s[met], e[met])

    return of


def _windows(length: int, splitters: list[np.ndarray] | None):
    """Hash rows of the windows in the lists s, e (ranges of starts) of each text."""

    def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
        for row in range(b.num_rows):
            data = np.frombuffer(b.column("text")[row].as_py().encode("utf-8", "surrogatepass"), np.uint8)
            s, e = (np.sort(b.column(x)[row].values.to_numpy()) for x in ("s", "e"))
            doc, twin = (b.column(x)[row].as_py() for x in ("doc", "twin"))
            for at in range(0, len(data) - length + 1, GROUP):
                lo, hi = np.clip(s, at, at + GROUP), np.clip(e, at, at + GROUP)
                lo, hi = lo[hi > lo], hi[hi > lo]
                if len(lo):
                    first = np.cumsum(hi - lo) - (hi - lo)
                    p = np.arange((hi - lo).sum()) + np.repeat(lo - first, hi - lo)
                    own = data[at : at + GROUP + length - 1]
                    key = Hashes(own).of(p - at, p - at + length).view(np.int64)
                    yield _leads(own, p - at), key, np.full(len(p), doc, np.int64), np.full(len(p), twin, np.int64), p

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, size = [], 0
            for row in rows_of(b):
                some.append(row)
                size += len(row[0])
                if size >= GROUP // 4:
                    yield placed(some)
                    some, size = [], 0
            if some:
                yield placed(some)

    def placed(some: list[tuple]) -> pa.RecordBatch:
        cols = dict(zip(WINDOW, map(np.concatenate, zip(*some))))
        return _batch({"bucket": bucket_of(list(cols.values()), splitters or [])} | cols)

    return of


def _compare_windows(length: int):
    """Repeats as kind 0; the first row of a bucket as kind 2 and its last one as kind 3, both with bucket, lead and key."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _sorted_bucket(batches, WINDOW)
        if c is None:
            return
        again = np.flatnonzero(~_changes([c["lead"], c["key"]]))
        for kind, rows in ((0, again), (2, np.array([0])), (3, np.array([len(c["pos"]) - 1]))):
            cols = {"kind": np.full(len(rows), kind, np.int32), "doc": c["doc"][rows], "twin": c["twin"][rows], "s": c["pos"][rows]}
            yield _batch(cols | {"e": cols["s"] + length, "bucket": c["bucket"][rows], "lead": c["lead"][rows], "key": c["key"][rows]})

    return of


def _splitters(sample: DataFrame, words: list[str], buckets: int) -> list[np.ndarray]:
    """At most buckets - 1 quantiles of a sample of about OVERSAMPLE x buckets rows, 4 times as many at most."""
    got = sample.select(*words).limit(4 * OVERSAMPLE * buckets).toPandas()
    cols = [got[w].to_numpy(np.int64) for w in words]
    order = multikey_order(cols) if len(got) else np.empty(0, np.int64)
    at = order[(np.arange(1, buckets) * len(order) // buckets)] if len(order) >= buckets else order
    return [c[at] for c in cols]


def _shares(want: int, total: float) -> tuple[float, float]:
    """Shares of documents and of their rows for a sample of ``want`` of ``total`` rows, spread over many documents."""
    share = min(1.0, want / max(1.0, total))
    docs = min(1.0, 32 * share)
    return docs, share / docs


def _every(share: float):
    """A condition that holds for about a share of all documents, by hash."""
    return F.pmod(F.xxhash64("doc", "twin"), F.lit(1_000_003)) < int(1_000_003 * share)


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(doc, twin, s, e): bytes of repeats, not merged.  rows: doc, twin, text, one per place in the order."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    schema = "bucket int, lead long, key long, ctx long, parts long, doc long, twin long, pos long, low long, n long"
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs, thin = _shares(OVERSAMPLE * n, total * 2 / (length - K + 2))
    sample = rows.where(_every(docs)).mapInArrow(_suffixes(length, None), schema)
    cut = _splitters(sample.where(F.rand(1) < thin), SUFFIX, n)
    suffixes = rows.mapInArrow(_suffixes(length, cut), schema).repartitionById(n, F.col("bucket"))
    spans = settle(suffixes.mapInArrow(_compare_suffixes(length), SPANS), "suffix-spans")

    edges = spans.where("kind = 1")
    windows = edges.agg(F.sum(F.col("e") - F.col("s"))).first()[0] or 0
    listed = edges.groupBy("doc", "twin").agg(F.sort_array(F.collect_list("s")).alias("s"), F.sort_array(F.collect_list("e")).alias("e"))
    schema = "bucket int, lead long, key long, doc long, twin long, pos long"
    docs, thin = _shares(OVERSAMPLE * n, windows)
    own = settle(listed.where(_every(docs)), "suffix-sample")
    sample = rows.where(_every(docs)).join(own, ["doc", "twin"]).mapInArrow(_windows(length, None), schema)
    cut = _splitters(sample.where(F.rand(1) < thin), WINDOW, n)
    hashed = rows.join(listed, ["doc", "twin"]).mapInArrow(_windows(length, cut), schema).repartitionById(n, F.col("bucket"))
    compared = settle(hashed.mapInArrow(_compare_windows(length), f"{SPANS}, bucket int, lead long, key long"), "window-spans")

    ends = compared.where("kind > 1").orderBy("bucket", "kind").collect()  # two rows per bucket
    carried = [(r.doc, r.twin, r.s, r.e) for last, r in zip([None, *ends], ends) if r.kind == 2 and last and (last.lead, last.key) == (r.lead, r.key)]
    out = spans.where("kind = 0").unionByName(compared.where("kind = 0").drop("bucket", "lead", "key")).select("doc", "twin", "s", "e")
    return out.unionByName(spark.createDataFrame(carried, "doc long, twin long, s long, e long"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "copies"]
    for b in batches:
        types = [b.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        rows: list[tuple] = []
        size = 0
        for row in range(b.num_rows):
            text = b.column("text")[row].as_py().encode("utf-8", "surrogatepass")
            n_removed, n_spans, kept = 0, 0, text
            if b.column("s")[row].is_valid:
                data, depth = np.frombuffer(text, np.uint8), np.zeros(len(text) + 1, np.int64)
                for col, by in (("s", 1), ("e", -1)):
                    at, many = np.unique(b.column(col)[row].values.to_numpy(), return_counts=True)
                    depth[at] += by * many
                gone = np.cumsum(depth[:-1]) > 0
                n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                n_removed, kept = int(gone.sum()), data[~gone].tobytes()
            rows.append((b.column("id")[row].as_py(), len(text), n_removed, n_spans, kept, b.column("copies")[row].as_py()))
            size += len(kept)
            if size > 8 * GROUP or row + 1 == b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, size = [], 0


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (bytes that stay)."""
    if length <= K + 1:
        raise ValueError(f"length must be over {K + 1}")
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    ids = docs.select(docs[id_col].alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    doc = F.coalesce(F.col("id").cast("long"), F.lit(_LOW))
    if ids.where("n > 1").isEmpty():
        rows = rows.withColumns({"copies": F.lit(1).cast("long"), "doc": doc, "twin": F.lit(0).cast("long")})
    else:
        rows = rows.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
        rows = settle(rows.withColumns({"doc": doc, "twin": F.xxhash64("text")}), "suffix-rows")
    spans = repeated_spans(rows.select("doc", "twin", "text"), length)
    listed = spans.groupBy("doc", "twin").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, copies long"
    out = rows.join(listed, ["doc", "twin"], "left").mapInArrow(_cut_out, schema)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    later = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    put = lambda c, v: F.when(later, v).otherwise(F.col(c)).alias(c)
    return out.select("id", "n_bytes", put("n_removed", F.col("n_bytes")), put("n_spans", F.lit(1)), put("kept", F.lit(b"")))
