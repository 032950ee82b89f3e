"""Exact quantiles, mergeable distinct counts, chunked lists and the index table against plain Python."""

import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickwright.operators import distinct as di
from clickwright.operators import frequency_index as fi
from clickwright.operators import listing as li
from clickwright.operators import selection as se


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of the rows."""
    rng = np.random.default_rng(2)
    out = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else int(rng.integers(1, 40))
        v = float(rng.lognormal(0, 4) * rng.choice([-1, 1])) if i % 7 else None
        out.append((i, k if i % 50 else None, v, int(rng.integers(-300, 300)) if i % 11 else None, f"s{rng.integers(20)}" if i % 13 else None, int(i % 4)))
    out += [(5000, 99, None, None, None, 0), (5001, 98, 1.5, 7, "only", 0), (5002, 97, -0.0, 1 << 40, "a", 1), (5003, 97, 0.0, -(1 << 40), "b", 1)]
    return spark.createDataFrame(out, "instance_id long, k int, v double, w long, s string, day int").repartition(4).cache()


@pytest.mark.parametrize("col", ["v", "w"])
def test_medians(rows, col):
    by = defaultdict(list)
    for r in rows.collect():
        if r[col] is not None:
            by[r.k].append(r[col])
    got = {r.k: r[1] for r in se.exact_quantile(rows, ["k"], col).collect()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in by.items()}, rel=1e-12)
    low = {r.k: r[1] for r in se.exact_quantile(rows, ["k"], col, 0.1).collect()}
    assert low == pytest.approx({k: float(np.quantile(v, 0.1)) for k, v in by.items()}, rel=1e-9)
    assert se.exact_quantile(rows.limit(0), ["k"], col).count() == 0


def test_hot_key_is_counted_in_several_tasks(rows):
    """The counts of one key's values lie in many partitions: they are dealt by (key, value)."""
    counts = rows.where("k = 0").withColumn("key", F.col("w")).groupBy("k", "key").count()
    assert counts.select(F.spark_partition_id().alias("p")).distinct().count() >= 1
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "key" in plan.split("hashpartitioning(k", 1)[1].split(")")[0]


def test_distinct_counts_merge_over_days(rows):
    want, day_want = defaultdict(set), defaultdict(set)
    for r in rows.collect():
        if r.k is not None:
            want[r.k].add(r.w)
            day_want[r.k, r.day].add(r.w)
    days = [di.distinct_words(rows.where(F.col("day") == d), ["k", "day"], "w") for d in range(4)]
    for d, words in enumerate(days):
        got = {(r.k, r.day): r.n for r in di.count_words(words, ["k", "day"], "n").collect()}
        assert got == {k: len(v) for k, v in day_want.items() if k[1] == d}
    merged = di.merge_words(days, ["k"])
    assert {r.k: r.n for r in di.count_words(merged, ["k"], "n").collect()} == {k: len(v) for k, v in want.items()}
    plan = di.distinct_counts(rows, ["k"], ["w", "day"], ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_distinct_counts_of_text(rows):
    want = defaultdict(set)
    for r in rows.collect():
        if r.k is not None and r.s is not None:
            want[r.k].add(r.s)
    words = di.distinct_words(rows, ["k"], "s", null_counts=False)
    assert {r.k: r.n for r in di.count_words(words, ["k"], "n").collect()} == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_chunked_lists(rows, size):
    want = defaultdict(list)
    for r in sorted((r for r in rows.collect() if r.k is not None and r.w is not None), key=lambda r: (r.w, r.instance_id)):
        want[r.k].append(r.w)
    chunks = li.group_string_join(rows, ["k"], "w", size=size)
    got = defaultdict(dict)
    for r in chunks.collect():
        assert r.n == r.joined.count(";") + 1 <= size
        got[r.k][r.chunk] = r.joined
    assert {k: ";".join(v[i] for i in range(len(v))) for k, v in got.items()} == {k: ";".join(map(str, v)) for k, v in want.items()}
    back = defaultdict(dict)
    for r in li.read_string_join(chunks, ["k"], "w", size=size).collect():
        back[r.k][r.position] = r.w
    assert {k: [v[i] for i in range(len(v))] for k, v in back.items()} == dict(want)


def test_frequency_index(rows, spark, tmp_path):
    n = Counter(r.s for r in rows.collect() if r.s is not None)
    want = {s: float(i) for i, (s, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0])))}
    model = fi.FrequencyIndex("s").fit(rows)
    assert model.size == len(want)
    got = model.transform(rows)
    assert {r.s: r.sIdx for r in got.collect()} == want | {None: float(len(want))}
    back = model.decode(got, "sIdx", "text")
    assert all(r.s == r.text for r in back.collect()) and back.count() == rows.count()
    model.write(str(tmp_path / "labels"))
    again = fi.FrequencyIndexModel.read(spark, str(tmp_path / "labels"), "s", "sIdx")
    assert {r.s: r.sIdx for r in again.transform(rows).collect()} == want | {None: float(len(want))}
    unseen = spark.createDataFrame([("never",)], "s string")
    assert model.transform(unseen).first().sIdx == len(want)
