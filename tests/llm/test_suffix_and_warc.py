import hashlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickwright.llm import suffix_dedup, warc_audit


def removed(docs, **how):
    return [r.asDict() for r in suffix_dedup.remove_repeats(docs, **how).collect()]


def compare(docs, length=100):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = brute.repeats_removed(rows, length)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in removed(docs, length=length)}
    assert got == want


def test_small_documents(spark, small_dir):
    compare(spark.read.parquet(f"{small_dir}/documents.parquet"))


def test_odd(odd):
    compare(odd)


@pytest.mark.parametrize("length", [40, 100])
def test_planted(spark, length):
    """Shared passages at odd places, near copies, periodic texts, overlaps and exact copies, over several partition counts."""
    rng = np.random.default_rng(length)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    word = lambda n: bytes(rng.choice(letters, n)).decode()
    passage, long = word(150), word(700)
    texts = [word(rng.integers(0, 400)) + passage[rng.integers(40) : 150 - rng.integers(40)] + word(rng.integers(0, 300)) for _ in range(60)]
    texts += [long[:i] + "#" + long[i:] for i in rng.integers(0, 700, 40)] + [long] * 20
    texts += ["ab" * 200, "ab" * 60, "a" * 500, "a" * 99, "a" * 100, "a" * 101, "é" * 70, "é" * 49 + "x" + "é" * 90, passage * 3, ""]
    order = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(i * 3, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            compare(docs.repartition(5), length)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_parts_of_long_texts(spark, monkeypatch):
    """Groups and parts shorter than the texts give the same anchors and windows."""
    rng = np.random.default_rng(8)
    text = bytes(rng.choice(np.frombuffer(b"abcd ", np.uint8), 3000)).decode()
    texts = [text, text[500:1900] + "x" + text[:800], text[::-1] + text[100:400]]
    want = brute.repeats_removed(list(enumerate(texts)))
    monkeypatch.setattr(suffix_dedup, "GROUP", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc": [0, 1, 2], "twin": [0, 0, 0], "text": texts, "id": [0, 1, 2], "copies": [1, 1, 1]})
    got = list(suffix_dedup._suffixes(100, None)(iter([batch])))
    spans = [r for b in suffix_dedup._compare_suffixes(100)(iter(got)) for r in b.to_pylist()]
    gone = {i: np.zeros(len(t), bool) for i, t in enumerate(texts)}
    for r in spans:
        if r["kind"] == 0:
            gone[r["doc"]][r["s"] : r["e"]] = True
    edges = {i: [r for r in spans if r["kind"] == 1 and r["doc"] == i] for i in range(3)}
    listed = pa.RecordBatch.from_pydict(
        {"doc": [0, 1, 2], "twin": [0] * 3, "text": texts, "s": [[r["s"] for r in edges[i]] for i in range(3)], "e": [[r["e"] for r in edges[i]] for i in range(3)]},
        schema=pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("text", pa.string()), ("s", pa.list_(pa.int64())), ("e", pa.list_(pa.int64()))]),
    )
    windows = list(suffix_dedup._windows(100, None)(iter([listed])))
    for b in suffix_dedup._compare_windows(100)(iter(windows)):
        for r in b.to_pylist():
            if r["kind"] == 0:
                gone[r["doc"]][r["s"] : r["e"]] = True
    assert {i: int(g.sum()) for i, g in gone.items()} == {i: w[1] for i, w in want.items()}


def test_order_and_buckets():
    rng = np.random.default_rng(2)
    words = [rng.integers(-3, 3, 50_000), rng.integers(0, 4, 50_000), rng.integers(-9, 9, 50_000)]
    order = suffix_dedup.multikey_order(words)
    rows = list(zip(*(w.tolist() for w in words)))
    assert [rows[i] for i in order] == sorted(rows)
    cut = sorted(rows[::5000])
    got = suffix_dedup.bucket_of(words, [np.array(c) for c in zip(*cut)])
    assert got.tolist() == [sum(c <= r for c in cut) for r in rows]


def test_repeated_rows_and_empty(repeated, empty):
    got = removed(repeated)
    assert len(got) == repeated.count() and not removed(empty)
    by = Counter((r["id"], r["n_bytes"], r["n_removed"]) for r in got)
    long = next(r.text for r in repeated.collect() if r.doc_id == 5 and len(r.text) > 1000)
    assert by[5, len(long), 0] == 1 and by[5, len(long), len(long)] == 1 and by[6, len(long), len(long)] == 2


@pytest.fixture(scope="module")
def pages(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/pages.parquet")
    return df.select("page_id", warc_audit.warc_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))


def plain_root(rows, fan):
    level = [(f, s, n, h) for f, s, n, h in rows]
    while len(level) > 1:
        up = []
        for i in range(0, len(level), fan):
            some = level[i : i + fan]
            text = "\n".join(f"{f}:{s}:{n}:{h}" for f, s, n, h in some)
            up.append((some[0][0], some[0][1], sum(x[2] for x in some), hashlib.sha256(text.encode()).hexdigest()))
        level = up
    return level[0][3]


def test_merkle_tree(pages):
    leaf = warc_audit.leaves(pages, per_file=16)
    rows = leaf.orderBy("ord").collect()
    records = sorted((r.page_id, bytes(r.record)) for r in pages.collect())
    assert [(r.id, r.length, r.hash) for r in rows] == [(i, len(b), hashlib.sha256(b).hexdigest()) for i, b in records]
    at = 0
    for r in rows:
        at = 0 if r.ord % 16 == 0 else at
        assert r.start == at and r.file == r.ord // 16
        at += r.length
    for fan in (2, 4, 16):
        assert warc_audit.root(warc_audit.merkle_tree(leaf, fan)) == plain_root([(r.file, r.start, r.length, r.hash) for r in rows], fan)
    body = records[3][1]
    assert body.startswith(b"WARC/1.1\r\nWARC-Type: resource\r\n") and body.endswith(b"\r\n\r\n")
    head, _, rest = body.partition(b"\r\n\r\n")
    assert int(head.rsplit(b"Content-Length: ")[1]) == len(rest) - 4


def test_audit(pages):
    one = warc_audit.merkle_tree(warc_audit.leaves(pages, 16), 4)
    assert warc_audit.audit(one, one, 4).count() == 0
    hurt = pages.withColumn("record", F.when(F.col("page_id").isin(2, 17, 18), F.concat(F.lit(b"x"), F.col("record").substr(2, 10**6))).otherwise(F.col("record")))
    two = warc_audit.merkle_tree(warc_audit.leaves(hurt, 16), 4)
    place = {r.id: r.ord for r in warc_audit.leaves(pages, 16).collect()}
    assert {r.ord for r in warc_audit.audit(one, two, 4).collect()} == {place[i] for i in (2, 17, 18)}
    short = warc_audit.merkle_tree(warc_audit.leaves(pages.where("page_id < 10"), 16), 4)
    n, m = one[0].count(), short[0].count()
    found = warc_audit.audit(one, short, 4).collect()
    assert {r.ord for r in found} == set(range(m, n)) and all(r.hash_two is None for r in found)
    none = warc_audit.merkle_tree(warc_audit.leaves(pages.limit(0), 16), 4)
    assert warc_audit.audit(one, none, 4).count() == n and warc_audit.audit(none, none, 4).count() == 0 and warc_audit.root(none) is None


def test_audit_against_a_manifest(spark):
    """Lost, added, damaged and exchanged records are one difference each, wherever they stand; nothing behind them moves."""
    rows = [(i, f"record {i} " + "x" * (i % 7)) for i in range(50)] + [(None, "a"), (None, "b"), (None, "b"), (20, "second copy of 20")]
    frame = lambda data: spark.createDataFrame([(i, t.encode()) for i, t in data], "page_id long, record binary").repartition(3)
    manifest = warc_audit.leaves(frame(rows), 16)
    text = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows}
    place = {(r.id, text[r.hash], r.copy): r.ord for r in manifest.collect()}
    one = warc_audit.merkle_tree(manifest, 4)

    def differences(data):
        two = warc_audit.placed(frame(data), manifest, 16)
        found = warc_audit.audit(one, warc_audit.merkle_tree(two, 4), 4).collect()
        return {r.ord: "lost" if r.hash_two is None else "extra" if r.hash_one is None else "damaged" for r in found}, two

    assert differences(rows)[0] == {}
    assert differences([r for r in rows if r[0] != 1])[0] == {place[1, rows[1][1], 0]: "lost"}
    assert differences([r for r in rows if r != (None, "b")] + [(None, "b")])[0] == {place[None, "b", 1]: "lost"}  # one of two equal ones
    assert differences([r for r in rows if r != (None, "a")] + [(None, "A")])[0] == {place[None, "a", 0]: "damaged"}
    got, two = differences(rows + [(-3, "new"), (99, "new too"), (None, "c")])
    assert got == {64: "extra", 65: "extra", 66: "extra"}
    assert {r.id: (r.ord, r.file, r.start) for r in two.collect() if r.ord >= 64} == {None: (64, 4, 0), -3: (65, 4, 1), 99: (66, 4, 4)}
    other = [{3: (3, "record 3 dAmaged and longer"), 30: (30, rows[31][1]), 31: (31, rows[30][1])}.get(i, r) for i, r in enumerate(rows) if i != 10]
    want = {place[i, rows[i][1], 0]: "lost" if i == 10 else "damaged" for i in (3, 10, 30, 31)}
    assert differences(other + [(500, "z")])[0] == {**want, 64: "extra"}
    assert set(differences([])[0].values()) == {"lost"} and len(differences([])[0]) == len(rows)
    none = warc_audit.leaves(frame(rows[:0]), 16)
    assert warc_audit.placed(frame(rows), none, 16).count() == len(rows)


def test_warc_odd(spark):
    rows = [(None, None, None), (1, "u", "b"), (1, "u", "b"), (1, None, "other"), (2, "", "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"ord": F.lit(1), "hash": F.lit("z"), "file": F.lit(1)})
    df = df.withColumn("record", warc_audit.warc_record(F.col("url"), F.col("html"), F.col("page_id")))
    leaf = warc_audit.leaves(df, 4)
    assert sorted(r.ord for r in leaf.collect()) == list(range(5))
    assert warc_audit.root(warc_audit.merkle_tree(leaf, 4))
