"""Each stage of the pipeline against a brute-force version on its own input, and run() as a whole."""

from collections import Counter, defaultdict

import brute
import corpus_pipeline
import pytest

from clickwright.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, small_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], small_dir).write.parquet(f"{folder}/{i}")
        tables.append(spark.read.parquet(f"{folder}/{i}"))
    return tables


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_quality(stages):
    # too few labels here to certify a cutoff: the base rule decides
    assert texts(stages[1]) == {i: t for i, t in texts(stages[0]).items() if not brute.quality(t)["base_failed"]}


def test_exact(stages):
    best = {}
    for i, t in texts(stages[1]).items():
        best[t] = max(i, best.get(t, -1))
    assert texts(stages[2]) == {i: t for t, i in best.items()}


def test_near(stages):
    want = brute.simhash(sorted(texts(stages[2]).items()))
    assert set(texts(stages[3])) == {c for _, c in want.values()}


def test_mixing(stages):
    before, after = Counter(r.doc_id for r in stages[3].collect()), Counter(r.doc_id for r in stages[4].collect())
    assert before.keys() == after.keys() and set(after.values()) <= {1, 2}
    assert texts(stages[3]) == texts(stages[4])
    assert after.total() > before.total()


def test_packing(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    ids = {i: plain.encode(t, add_special_tokens=False).ids + [0] for i, t in texts(stages[4]).items()}
    copies = Counter(r.doc_id for r in stages[4].collect())
    seats, pieces = defaultdict(list), Counter()
    for r in stages[5].collect():
        seats[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.start, r.length] += 1
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
    for seat in seats.values():
        at = 0
        for offset, n in sorted(seat):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(len(ids[i]) * n for i, n in copies.items())
    assert sum(n * c for (_, _, n), c in pieces.items()) == total and len(seats) <= -(-total // 2048) * 1.02 + 2


def test_run(spark, small_dir, stages):
    out = corpus_pipeline.run(spark, small_dir)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(out.select(*names).collect()) == Counter(stages[5].select(*names).collect())


def test_stages_keep_columns_of_any_name(spark, small_dir):
    """Strings under the names that the operators use on the way come back as they were."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60)
    names = ["_mix_source", "_mix_tokens", "_mix_hash", "_mix_block", "_mix_pass", "_mix_copies", "_dedup_id", "_dedup_digest", "_dedup_n", "_near_id", "_near_text",
             "_near_n", "_quality_n_words", "_quality_kept", "_quality_stratum", "_quality_cutoffs", "_sheltered", "_none", "fp", "id", "uid", "digest", "component"]
    plain = {r.doc_id for r in docs.collect()}
    rows = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, small_dir)
        assert out.columns == rows.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
        assert {r.doc_id for r in got} <= plain
