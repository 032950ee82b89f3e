"""Same results whatever the shuffle partitioning."""

from conftest import SF_SMALL

from clickwright.plans.catalog import QUERIES


def test_feature_build_independent_of_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = QUERIES["build_features"](spark, SF_SMALL)
        rows_a = sorted(tuple(r) for r in a.collect())
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = QUERIES["build_features"](spark, SF_SMALL)
        rows_b = sorted(tuple(r) for r in b.select(*a.columns).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows_a == rows_b


def test_ranks_independent_of_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("2", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(tuple(r) for r in QUERIES["label_encode"](spark, SF_SMALL).collect()))
            out.append(sorted(tuple(r) for r in QUERIES["stratified_folds"](spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[2] and out[1] == out[3]
