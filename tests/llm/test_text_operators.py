import hashlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickwright.llm import arrow_tokens, exact_dedup, mixing, packing, quality_rules, simhash_dedup, tokens
from clickwright.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def small(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(small, odd, keep):
    for docs in (small, odd):
        texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
        by = defaultdict(list)
        for i, t in texts.items():
            by[t].append(i)
        got = {r["id"]: r for r in rows(exact_dedup.exact_groups(docs, keep=keep, runs=16, fan_in=4))}
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            best = (max if keep == "largest" else min)(by[t])
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best, len(by[t]), best == i)
            assert got[i]["digest"].hex() == hashlib.sha256(t.encode()).hexdigest() and got[i]["n_bytes"] == len(t.encode())


def test_exact_repeats_and_empty(repeated, empty):
    got = rows(exact_dedup.exact_groups(repeated, runs=4, fan_in=2))
    assert len(got) == repeated.count()
    texts = {r.text or "" for r in repeated.collect()}
    assert sum(r["kept"] for r in got) == len(texts)
    stay = exact_dedup.keep_one_per_text(repeated)
    assert stay.columns == repeated.columns
    assert Counter(r.text or "" for r in stay.collect()) == Counter(texts)
    assert exact_dedup.keep_one_per_text(empty).count() == 0 == exact_dedup.exact_groups(empty).count()


def test_runs_are_sorted_and_merged(spark, small):
    """Every round brings a prefix range of some runs together, sorts it and aggregates in order; nothing is hashed."""
    digests = exact_dedup._digests(small["text"])
    run = (small["doc_id"] % 64).cast("int").alias("run")
    level = small.select(*digests, run, exact_dedup.F.struct("doc_id").alias("best"), exact_dedup.F.lit(1).alias("size"))
    level = level.withColumn("prefix", exact_dedup.F.substring("digest", 1, 2))
    plan = exact_dedup.merge_runs(level, 64, 8, "largest")._jdf.queryExecution().executedPlan().toString().split("+- ")
    kinds = [step.split("(")[0].split(" ")[0].strip() for step in plan]
    assert kinds.count("SortAggregate") == 4 and kinds.count("Sort") == kinds.count("Exchange") == 2 and "HashAggregate" not in " ".join(plan)
    assert all("hashpartitioning(run#" in step and "prefix#" in step for step in plan if step.startswith("Exchange"))
    assert all("[run#" in step and "digest#" in step for step in plan if step.startswith("Sort "))


def test_exact_hot_null_ids(spark):
    """A text of rows without ids, or of one id, is spread over the runs; one row of it stays."""
    docs = spark.createDataFrame([(None, "hot")] * 3000 + [(7, "same")] * 3000 + [(8, "own")], "doc_id long, text string").repartition(4)
    assert exact_dedup.digest_rows(docs, 16).where("id is null").select("run").distinct().count() == 16
    for keep in ("largest", "smallest"):
        got = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows(exact_dedup.exact_groups(docs, keep=keep, runs=16, fan_in=4)))
        want = {(None, None, 3000, True): 1, (None, None, 3000, False): 2999, (7, 7, 3000, True): 1, (7, 7, 3000, False): 2999, (8, 8, 1, True): 1}
        assert got == want
    mixed = spark.createDataFrame([(None, "t"), (3, "t"), (9, "t")], "doc_id long, text string")
    assert {keep: {r["keep_id"] for r in rows(exact_dedup.exact_groups(mixed, keep=keep))} for keep in ("largest", "smallest")} == {"largest": {9}, "smallest": {3}}


def test_quality_counts(small, odd):
    for docs in (small, odd):
        got = {r["doc_id"]: r for r in rows(quality_rules.with_features(docs))}
        for r in docs.select("doc_id", "text").collect():
            want = brute.quality(r.text)
            assert {k: got[r.doc_id][k] for k in want} == want, r.doc_id


def test_allowed_rejections(spark):
    from math import comb

    def exact(n, a, d):
        cdf, k = 0.0, -1
        for i in range(n + 1):
            cdf += comb(n, i) * a**i * (1 - a) ** (n - i)
            if cdf > d:
                break
            k = i
        return k

    cases = [(0, 0.01, 0.05), (10, 0.01, 0.05), (298, 0.01, 0.05), (299, 0.01, 0.05), (1000, 0.02, 0.01), (5000, 0.004, 0.0025), (300, 0.3, 0.2)]
    df = spark.createDataFrame(cases, "n long, a double, d double")
    got = df.select("n", "a", "d", quality_rules.allowed_rejections(F.col("n"), F.col("a"), F.col("d")).alias("k")).collect()
    assert [(r.n, r.k) for r in got] == [(n, exact(n, a, d)) for n, a, d in cases]


def test_quality_thresholds_hold(spark):
    """Planted junk is rejected; good documents keep their guarantee; a stratum without labels rejects nothing by the method."""
    rng = np.random.default_rng(1)
    data, labels = [], []
    for i in range(6000):
        junk = rng.random() < 0.2
        words = [f"w{rng.integers(9999)}" + ("%%%" if junk else "") for _ in range(40)]
        data.append((i, " ".join(words), "en" if i < 5500 else "xx"))
        if i < 5500 and i % 2:
            labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, marks).collect()}
    bad = {i for i, t, _ in data if "%%%" in t}
    first = {i for i, _, s in data if s == "en"}
    assert not kept & bad & first and not (first - bad) - kept
    assert {i for i, _, s in data if s == "xx"} <= kept
    none = quality_rules.keep_good(docs.limit(0), marks)
    assert none.columns == docs.columns and none.count() == 0
    assert quality_rules.keep_good(docs, marks.limit(0)).count() == len(data)


def test_quality_odd(spark, odd, repeated, empty):
    marks = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    for docs in (odd, repeated, empty):
        out = quality_rules.keep_good(docs, marks)
        assert out.columns == docs.columns
        want = sum(not brute.quality(r.text)["base_failed"] for r in docs.collect())
        assert out.count() == want


def test_quality_clashing_names(spark, odd):
    """Columns named like the operator's own."""
    marks = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    clash = odd.withColumns({c: F.lit("z") for c in ("cutoffs", "stratum", "n_words", "features", "failed_rules", "quality", "_id", "scores")})
    assert quality_rules.keep_good(clash, marks).columns == clash.columns
    counted = quality_rules.with_features(clash)
    judged = quality_rules.judge(counted, quality_rules.fit_cutoffs(counted, marks))
    assert {r.doc_id: r.kept for r in judged.collect()} == {r.doc_id: not brute.quality(r.text)["base_failed"] for r in odd.collect()}


def test_simhash(small, odd, spark):
    for docs in (small, odd):
        want = brute.simhash([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        got = {r["id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in rows(simhash_dedup.near_components(docs))}
        assert got == want


def test_simhash_links_all_plans(spark):
    """All links, whatever plan the cost estimate leads to; a dense ball and random points."""
    rng = np.random.default_rng(3)
    ball = [int(rng.integers(1 << 62))] * 200
    ball = [b ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 5))) for b in ball]
    fps = sorted({*ball, 0, 1, 3, *(int(x) for x in rng.integers(0, 1 << 63, 400))})
    df = spark.createDataFrame([(simhash_dedup._signed(f),) for f in fps], "fp long")
    for bits in (0, 1, 4, 6):
        got = {(r.a, r.b) for r in simhash_dedup.links(df, bits).collect()}
        signed = [simhash_dedup._signed(f) for f in fps]
        want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert got == want
    sample = np.array(fps, np.uint64)
    for n in (10, 10**6, 10**9, 10**12):
        probes = simhash_dedup.plan(sample, n, 4)
        parts = {m for m, _ in probes}
        assert sum(parts) == (1 << 64) - 1 or len(parts) < 5
        need = sum(1 + max(f.bit_count() for m, f in probes if m == part) for part in parts)
        assert need == 5


def test_simhash_plan_holds_the_pairs_once():
    """The driver plans on some two million pairs of fingerprints: 17 MB, and one mask of them at a time."""
    import tracemalloc

    sample = np.random.default_rng(5).integers(0, 1 << 63, simhash_dedup.SAMPLE, dtype=np.uint64)
    tracemalloc.start()
    probes = simhash_dedup.plan(sample, 10_000, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert probes and peak < 48e6


def simhash_classes(spark, fps):
    return spark.createDataFrame([(simhash_dedup._signed(f),) for f in fps], "fp long")


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_simhash_components_without_pairs(spark, bits):
    """Balls, chains that take several rounds and single points, against all pairs."""
    rng = np.random.default_rng(bits)
    chain, x = [], int(rng.integers(1 << 62))
    for i in range(64):  # 2 bits a step
        x ^= 1 << i | 1 << (i * 7 + 3) % 64
        chain.append(x)
    ball = [int(rng.integers(1 << 62))] * 100
    ball = [b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 5)))) for b in ball]
    fps = sorted({*chain, *ball, 0, (1 << 64) - 1, *(int(k) for k in rng.integers(0, 1 << 63, 200))})
    near = lambda a, b: (a ^ b).bit_count() <= bits
    want = {n: c for n, c in brute.components(fps, near).items() if any(near(n, b) for b in fps if b != n)}
    got = {r.node & (1 << 64) - 1: r.component for r in simhash_dedup.linked_components(simhash_classes(spark, fps), bits).collect()}
    assert got.keys() == want.keys()
    assert len(set(got.values())) == len(set(want.values())) == len({(got[n], want[n]) for n in got})
    assert all(got[c & (1 << 64) - 1] == c for c in got.values())


def test_simhash_writes_no_pairs(spark, monkeypatch):
    """A ball of k close fingerprints, all linked to each other, writes rows in proportion to k."""
    written = []

    def counted(df, name, real=simhash_dedup.settle):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(simhash_dedup, "settle", counted)
    ball = [1 << i | 1 << j for i in range(40) for j in range(i)]  # 780, 4 bits apart at most
    got = simhash_dedup.linked_components(simhash_classes(spark, ball), 4).collect()
    assert len(got) == len(ball) and len({r.component for r in got}) == 1
    assert max(written) <= len(ball) and len(written) <= 5
    assert simhash_dedup.linked_components(simhash_classes(spark, [5]), 4).count() == 0


@pytest.mark.parametrize("bits", [4, 5])
def test_simhash_large_groups(spark, monkeypatch, bits):
    """Groups beyond the limit meet at midpoints: the same components as all pairs give, and no join yields a row per pair."""
    rng = np.random.default_rng(bits)
    plans = []

    def seen(df, name, real=simhash_dedup.settle):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(simhash_dedup, "settle", seen)
    monkeypatch.setattr(simhash_dedup, "BUCKET", 8)
    centre, path = int(rng.integers(1 << 62)), []
    flips = lambda n: sum(1 << int(k) for k in rng.choice(64, n, replace=False))
    ball = [centre ^ flips(int(rng.integers(0, 4))) for _ in range(60)]
    near_by = [centre ^ 0x3FF ^ flips(int(rng.integers(0, 3))) for _ in range(40)]
    x = centre
    for _ in range(20):
        x ^= flips(bits)
        path.append(x)
    fps = sorted({*ball, *near_by, *path, *(int(k) for k in rng.integers(0, 1 << 63, 100))})
    near = lambda a, b: (a ^ b).bit_count() <= bits
    want = {n: c for n, c in brute.components(fps, near).items() if any(near(n, b) for b in fps if b != n)}
    got = {r.node & (1 << 64) - 1: r.component for r in simhash_dedup.linked_components(simhash_classes(spark, fps), bits).collect()}
    assert got.keys() == want.keys()
    assert len(set(got.values())) == len(set(want.values())) == len({(got[n], want[n]) for n in got})
    assert not [line for plan in plans for line in plan.splitlines() if "Join Inner" in line and "bit_count" in line]


def test_hooks_that_rise_and_fall(spark, monkeypatch):
    """A tree of smallest neighbours, some of them larger than their node, and long ways to a root: one table for each doubling, not two and a join for each round."""
    from clickwright.llm import components
    from clickwright.llm.components import hooked

    tables = []
    monkeypatch.setattr(components, "settle", lambda df, name, real=components.settle: (tables.append(name), real(df, name))[1])
    rng = np.random.default_rng(5)
    names = rng.permutation(400).tolist()
    linked = {n: set() for n in names}
    for i in range(1, 300):
        j = i - 1 if i < 60 else int(rng.integers(i))
        linked[names[i]].add(names[j])
        linked[names[j]].add(names[i])
    for i in range(300, 400, 2):
        linked[names[i]].add(names[i + 1])
        linked[names[i + 1]].add(names[i])
    hooks = {n: min(others) for n, others in linked.items()} | {1000 + i: 999 + i for i in range(1, 50)} | {1000: 1001}
    assert any(to > n for n, to in hooks.items())
    want = brute.components(hooks, lambda a, b: hooks[a] == b or hooks[b] == a)
    got = {r.node: r.component for r in hooked(spark.createDataFrame(list(hooks.items()), "a long, to long")).collect()}
    assert len(tables) <= 9  # ways of at most 64 hooks
    assert got.keys() == hooks.keys() and all(got[c] == c for c in got.values())
    assert len(set(got.values())) == len(set(want.values())) == len({(got[n], want[n]) for n in hooks})
    assert hooked(spark.createDataFrame([], "a long, to long")).count() == 0
    monkeypatch.setattr(components, "settle", lambda df, name, real=simhash_dedup.settle: (tables.append(name), real(df, name))[1])
    tables.clear()
    components.components(spark.createDataFrame(list(hooks.items()), "a long, b long")).count()
    assert len(tables) > 9


def test_simhash_odd(repeated, empty, odd):
    got = rows(simhash_dedup.near_components(repeated))
    assert len(got) == repeated.count()
    kept = simhash_dedup.keep_one_per_component(odd)
    assert kept.columns == odd.columns
    want = brute.simhash([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert simhash_dedup.keep_one_per_component(empty).count() == 0
    assert simhash_dedup.keep_one_per_component(repeated).count() == len({r["component"] for r in got})


def test_simhash_without_ids(spark):
    """Documents without an id, or with the same one, stay if their texts differ."""
    prose = [" ".join(f"w{k}x{i * (k + 3) % 509}" for i in range(80)) for k in range(4)]
    docs = spark.createDataFrame([(None, prose[0]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (None, prose[3])], "doc_id long, text string")
    kept = simhash_dedup.keep_one_per_component(docs).collect()
    assert sorted(r.text for r in kept) == sorted(prose) and {r.doc_id for r in kept if r.text == prose[3]} == {7}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(name, monkeypatch):
    """Numbers of ids without the ids, with a full memo, too."""
    import public_tokenizers

    from clickwright.llm import tokens

    rng, path = np.random.default_rng(5), public_tokenizers.path(name)
    parts = ["a", "Zé", "'s", "'", "\n", "\n\n", " ", "  ", ".", "!?", "23", "²", "\t", "数", "<|endoftext|>", "word", " next", "\u0301", ""]
    texts = ["", " ", *("".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(3000)), "x " * 5000]
    tok = tokens.encoder(path).tok
    want = [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert list(tokens.counted(path, texts)) == want
    monkeypatch.setattr(tokens, "SIZES", 100)
    assert list(tokens.counted(path, texts, 1 << 10)) == want
    assert [len(ids) for ids in tokens.encoded(path, texts, 1 << 10)] == want


def test_components(spark):
    from clickwright.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 151)}) == 1 and got[0] != got[100]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD_TEXTS = ["", " ", "a  b", " a b ", "a\n b", "x  y", "don't  we're 12 34\n\n\nend ", "　x y", "é ê 数据 数\U0001f600 z", "a " * 50, "\x1c a \x1c b", "<|endoftext|> x"]


def test_encoder_is_exact(small):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    texts = [r.text for r in small.collect()] + ODD_TEXTS
    old = tokens.MEMO, tokens.SLICE
    try:
        for memo, cut in ((300_000, 1 << 20), (50, 64), (50, 64)):
            tokens.MEMO, tokens.SLICE = memo, cut
            tokens._ENCODERS.clear()
            for _ in range(2):
                got = list(tokens.encoded(tokenizer_path(), texts, 5000))
                assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        tokens.MEMO, tokens.SLICE = old
        tokens._ENCODERS.clear()


def ids_of(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    return {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}


def test_arrow_tokens(small, odd):
    for docs in (small, odd):
        want, at = ids_of(docs), 0
        manifest = arrow_tokens.write_token_files(docs, tokenizer_path(), sequence_length=128, sequences_per_batch=3, files=4)
        got = {r["doc_id"]: r for r in rows(arrow_tokens.read_token_files(manifest))}
        for i in sorted(want):
            assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(want[i]), brute.crc(want[i]))
            at += len(want[i])
        flat = [x for i in sorted(want) for x in want[i]]
        seen = []
        for m in sorted(manifest.collect(), key=lambda r: r.part):
            f = arrow_tokens.TokenFile(f"{m.path}.arrow")
            own = []
            for k in range(m.n_sequences):
                ids, mask = f.sequence(k)
                assert len(ids) == len(mask) == 128
                own += ids[np.array(mask.to_pylist())].tolist()
            assert len(own) == m.n_tokens
            seen += own
        assert seen == flat


def test_arrow_tokens_are_views(small):
    manifest = arrow_tokens.write_token_files(small, tokenizer_path(), files=1)
    f = arrow_tokens.TokenFile(f"{manifest.first().path}.arrow")
    ids, _ = f.sequence(3)
    assert not ids.flags.owndata and not ids.flags.writeable and len(ids) == 2048


def test_arrow_tokens_odd(repeated, empty):
    manifest = arrow_tokens.write_token_files(repeated, tokenizer_path(), files=3)
    got = rows(arrow_tokens.read_token_files(manifest))
    assert len(got) == repeated.count()
    assert sorted(r["start"] for r in got) == sorted(np.cumsum([0] + [r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1].tolist())
    assert arrow_tokens.read_token_files(arrow_tokens.write_token_files(empty, tokenizer_path())).count() == 0


def check_packing(got, size):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for seats in by.values():
        at = 0
        for offset, n in sorted(seats):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def test_packing(small, odd):
    for docs in (small, odd):
        want = ids_of(docs)
        got = rows(packing.pack_documents(docs, tokenizer_path(), 2048, shard_items=64))
        n = check_packing(got, 2048)
        total = sum(map(len, want.values()))
        assert n <= -(-total // 2048) * 1.02 + 2
        parts = defaultdict(dict)
        for r in got:
            parts[r["doc_id"]][r["piece"]] = r
        assert parts.keys() == want.keys()
        for i, ids in want.items():
            at = 0
            for k in range(len(parts[i])):
                r = parts[i][k]
                assert r["start"] == at and r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
                assert r["length"] == 2048 or k == 0
                at += r["length"]
            assert at == len(ids) and len(parts[i]) == -(-len(ids) // 2048)


def test_packing_beats_or_equals_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(5):
        lengths = rng.integers(200, 900, 300).tolist()
        start = packing.Bins(2048)
        start.best_fit(sorted(range(300), key=lambda i: -lengths[i]), lengths)
        best = packing.evolve(lengths, 2048, rng, [], 6, 60)
        assert sorted(i for b in best.items for i in b) == list(range(300))
        assert all(sum(lengths[i] for i in b) == 2048 - r <= 2048 for b, r in zip(best.items, best.room))
        assert len(best.items) <= len(start.items)


def test_packing_odd(repeated, empty):
    got = rows(packing.pack_documents(repeated, tokenizer_path(), 64))
    check_packing(got, 64)
    assert sum(r["piece"] == 0 for r in got) == repeated.count()
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_mixing(small):
    docs = small
    spark = docs.sparkSession
    plan = mixing.plan_mix(mixing.measured(docs), target_entropy=0.97, max_repeats=4.0, block_tokens=500)
    per = {r.source: r for r in plan.sources.collect()}
    q = np.array([r.share for r in per.values()])
    p = q**plan.tau / (q**plan.tau).sum()
    assert np.allclose([r.weight for r in per.values()], p)
    h = lambda p: -(p * np.log(p)).sum() / np.log(len(p))
    assert 0 < plan.tau <= 1 and (h(p) >= 0.97 - 1e-6 or plan.tau == 0)
    assert max(r.passes for r in per.values()) <= 4.0 + 1e-6 and min(r.passes for r in per.values()) >= 1 - 1e-6
    out = mixing.in_order(mixing.emit(mixing.measured(docs), plan), plan).collect()
    copies = Counter(r.doc_id for r in out)
    source = {r.doc_id: r.source or "" for r in docs.collect()}
    assert copies.keys() == source.keys()
    size = {r.doc_id: r["_mix_tokens"] for r in mixing.measured(docs).collect()}
    longest = defaultdict(int)
    for i, s in source.items():
        longest[s] = max(longest[s], size[i])
    got = defaultdict(int)
    for r in out:
        got[source[r.doc_id]] += size[r.doc_id]
    for s, r in per.items():
        assert abs(got[s] - r.passes * r.tokens) <= longest[s] + 1
        assert {copies[i] for i in source if source[i] == s} <= {int(r.whole), int(r.whole) + 1}
    assert len({(r.doc_id, r["_mix_pass"]) for r in out}) == len(out) and all(0 < r["_mix_turn"] < 1 for r in out)
    again = mixing.plan_mix(mixing.measured(docs.repartition(7)), target_entropy=0.97, max_repeats=4.0, block_tokens=500)
    assert Counter(r.doc_id for r in mixing.emit(mixing.measured(docs), again).collect()) == copies
    assert spark is not None


def test_mixing_limits(small):
    rows_ = mixing.measured(small)
    limited = mixing.plan_mix(rows_, max_repeats=1.25)
    assert max(r.passes for r in limited.sources.collect()) == pytest.approx(1.25, abs=1e-4)
    total = sum(r.tokens for r in limited.sources.collect())
    cut = mixing.plan_mix(rows_, target_entropy=0.99, max_repeats=1.0, budget=total / 2, block_tokens=300)
    emitted = mixing.emit(rows_, cut).collect()
    assert max(Counter(r.doc_id for r in emitted).values()) == 1
    assert abs(sum(r["_mix_tokens"] for r in emitted) / total - 0.5) < 0.1


def test_mixing_counts_tokens(spark, small, odd):
    """Ids of the tokenizer and the end id; a script without spaces weighs as much as it is long."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    for docs in (small, odd):
        got = {r.doc_id: r["_mix_tokens"] for r in mixing.measured(docs, tokenizer=tokenizer_path()).collect()}
        assert got == {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    han, latin = "数据训练语料混合" * 200, "some plain words of text " * 200
    two = spark.createDataFrame([(1, han, "han"), (2, latin, "latin")], "doc_id long, text string, source string")
    share = {r.source: r.share for r in mixing.plan_mix(mixing.measured(two, tokenizer=tokenizer_path())).sources.collect()}
    assert share["han"] > 0.5 > mixing.plan_mix(mixing.measured(two)).sources.where("source = 'han'").first().share * 100
    sized = spark.createDataFrame([(1, "a", "x", 30), (2, "b", "y", None), (3, "c", "y", -4)], "doc_id long, text string, source string, n int")
    assert [r["_mix_tokens"] for r in mixing.measured(sized, tokens_col="n").orderBy("doc_id").collect()] == [30, 1, 1]
    out = mixing.mix_documents(sized, tokens_col="n", max_repeats=1.0)
    assert out.columns == sized.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, sized.collect()), key=str)


def test_mixing_encodes_each_text_once(small):
    """The emitting pass carries texts and encodes none of them."""
    plan = mixing.mix_documents(small, tokenizer=tokenizer_path(), max_repeats=1.25)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan


def test_mixing_odd(odd, repeated, empty):
    for docs in (odd, repeated, empty):
        out = mixing.mix_documents(docs, max_repeats=2.0, tokenizer=tokenizer_path())
        assert out.columns == docs.columns
        want = Counter((r.doc_id, r.text) for r in docs.collect())
        got = Counter((r.doc_id, r.text) for r in out.collect())
        assert got.keys() == want.keys() and all(want[k] <= got[k] <= 2 * want[k] for k in want)


@pytest.mark.parametrize("length,count,shard_items", [(700, 60, 10), (50, 60, 4)])
def test_packing_pools_the_worst_bins(spark, tmp_path, length, count, shard_items):
    """Where no bin fills up, or a shard holds less than a bin, shards still leave no bins half empty."""
    spark.range(count).select(F.col("id").alias("uid"), F.lit(length).cast("long").alias("length")).write.parquet(f"{tmp_path}/items")
    got = rows(packing.pack(spark.read.parquet(f"{tmp_path}/items"), 2048, shard_items, epochs=1, people=2, generations=2))
    assert sorted(r["uid"] for r in got) == list(range(count))
    seats = defaultdict(list)
    for r in got:
        seats[r["sequence_id"]].append(r["offset"])
    assert all(sorted(x) == [length * i for i in range(len(x))] for x in seats.values())
    assert len(seats) == -(-count // (2048 // length))


def test_packing_prefers_fewer_bins():
    fewer = [i // 8 for i in range(80)]
    fuller = [i // 10 for i in range(77)] + [8, 9, 10]
    best = packing.evolve([1] * 80, 10, np.random.default_rng(1), [fuller, fewer], 2, 0)
    assert len(best.room) == 10


def test_near_dedup_collects_the_drivers_garbage(spark):
    """What each of its many queries leaves in the driver goes before the heap is full."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(i, "a b c d e f g h"[: 3 + 4 * (i % 4)]) for i in range(12)], "doc_id long, text string")
    before = whole()
    assert simhash_dedup.near_components(docs).count() == 12
    assert whole() - before >= 3
