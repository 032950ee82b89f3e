"""Edge cases every grouped operator must cover (FIXTURES F7)."""

from pyspark.sql import functions as F

from clickwright.operators import clean as cl
from clickwright.operators import grouped as gr
from clickwright.operators import preprocess as pp
from clickwright.operators import sequence as seq

SCHEMA = "instance_id bigint, user_id bigint, item_id bigint, hour int, maphour int, item_brand_id bigint, item_price_level int, context_timestamp bigint, day int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_null_key_gives_null_group_features(spark):
    rows = [(1, 1, None, 3, 0, 7, 2, 100, 1), (2, 1, 5, 3, 0, 7, 2, 160, 1), (3, 1, 5, 4, 0, None, 0, 200, 1)]
    df = gr.expose_ratio(frame(spark, rows), [["item_id", "hour"]])
    got = {r["instance_id"]: (r["item_id_hour_cnt"], r["item_id_hour_ratio"]) for r in df.collect()}
    assert got[1] == (None, None)
    assert got[2] == (1, 0.5) and got[3] == (1, 0.5)
    rel = gr.relative_ratio(frame(spark, rows), {"item_brand_id": ["item_price_level"]})
    by = {r["instance_id"]: r["item_price_level_mean_by_item_brand_idratio"] for r in rel.collect()}
    assert by[3] is None and by[1] == 1.0


def test_zero_mean_ratio_is_null(spark):
    rows = [(1, 1, 1, 3, 0, 7, 0, 100, 1), (2, 2, 1, 3, 0, 7, 0, 160, 1)]
    rel = gr.relative_ratio(frame(spark, rows), {"item_brand_id": ["item_price_level"]})
    assert [r["item_price_level_mean_by_item_brand_idratio"] for r in rel.collect()] == [None, None]


def test_null_key_in_sequence_features(spark):
    rows = [(1, None, 1, 3, 0, 7, 0, 100, 1), (2, None, 1, 3, 0, 7, 0, 160, 1)]
    df = seq.rolling_neighbor_counts(frame(spark, rows), {"user": ["user_id"]})
    df = seq.gap_to_last_view(df, ["item_id"])
    df = seq.last_time_gap(df, ["user_id"])
    for r in df.collect():
        assert r["user_count_10_bf"] == 0.0 and r["diffWithLastView_item_id"] == -1.0 and r["user_id_lasttime_diff"] == -1
    # the click tab treats null keys as equal (duplicated semantics)
    tab = seq.click_position_tab(frame(spark, rows), [["user_id", "day"]])
    assert sorted(r["click_user_id_tab"] for r in tab.collect()) == [2, 3]


def test_single_row_and_all_equal(spark):
    rows = [(1, 1, 1, 3, 0, 7, 4, 100, 1)]
    df = seq.first_last_gap(frame(spark, rows), {"u": ["user_id", "day"]})
    r = df.first()
    assert (r["u_day_diffTime_first"], r["u_day_diffTime_last"]) == (-1, -1)
    eq = [(i, 1, 1, 3, 0, 7, 4, 100, 1) for i in range(1, 4)]
    d2 = seq.click_position_tab(frame(spark, eq), [["user_id", "day"]])
    assert sorted(r["click_user_id_tab"] for r in d2.collect()) == [1, 2, 3]


def test_empty_input(spark):
    df = frame(spark, [])
    assert gr.expose_ratio(df, [["item_id", "hour"]]).count() == 0
    assert seq.rolling_neighbor_counts(df, {"user": ["user_id"]}).count() == 0
    assert pp.label_encode(df, ["item_id"]).count() == 0


def test_active_counts_null_as_value_and_daily_does_not(spark):
    rows = [(1, 1, None, 3, 0, 7, 4, 100, 1), (2, 1, 5, 3, 0, 7, 4, 160, 1), (3, 1, 6, 3, 0, 7, 4, 170, 1)]
    df = gr.active_per_grain(frame(spark, rows), {"day": {"user_id": ["item_id"]}})
    assert {r["user_id_day__active_item_id__num"] for r in df.collect()} == {3}
    d2 = gr.KeyedFeatures().add(["user_id", "day"], {"__x": F.count_distinct("item_id")}, {"n": F.col("__x")}).apply(frame(spark, rows))
    assert {r["n"] for r in d2.collect()} == {2}


def test_category_code_single_token_and_empty(spark):
    rows = [(1, "1"), (2, ""), (3, None), (4, "1;5;9"), (5, "1;5;9"), (6, "1;7")]
    df = spark.createDataFrame(rows, "instance_id bigint, item_category_list string")
    out = {r["instance_id"]: r["secondLevelCatagory_Most_Freq"] for r in pp.category_frequency_code(df).collect()}
    assert out[1] == 0 and out[2] == 0 and out[3] == 0
    # '5' (2 rows) kept first; running 2 < 6 * 0.95; '7' (1 row) running 3 < 5.7 -> kept; least frequent = 1
    assert out[4] == 2 and out[6] == 1


def test_property_cut_to_forty_when_more_than_fifty(spark):
    # 100 tokens with counts 200 - t: about 73 stay below 0.8 of all tokens (> 50), so 40 are kept
    rows = []
    rid = 0
    for tok in range(100):
        for _ in range(200 - tok):
            rows.append((rid, str(tok)))
            rid += 1
    df = spark.createDataFrame(rows, "instance_id bigint, item_property_list string")
    kept = pp.kept_property_tokens(df)
    assert kept == list(range(40))
    flags = pp.property_flags(df, tokens=kept)
    assert len([c for c in flags.columns if c.startswith("preperty_")]) == 40


def test_missing_ratio_exactly_threshold_is_kept(spark):
    rows = [(i, None if i < 6 else 1.0, 2.0) for i in range(10)]
    df = spark.createDataFrame(rows, "instance_id bigint, a double, b double")
    assert cl.sparse_columns(df, 0.6) == []
    assert cl.sparse_columns(df, 0.5) == ["a"]


def test_lenient_parsing_counts_rejects(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from clickwright.functions import rejected_tokens, tokens_to_int
    from clickwright.sources import files as fs

    df = spark.createDataFrame([("1;x;3",), ("4",)], "t string")
    got = df.select(tokens_to_int("t").alias("v"), rejected_tokens("t").alias("n")).collect()
    assert [(r.v, r.n) for r in got] == [([1, 3], 1), ([4], 0)]
    with pytest.raises(PySparkException):
        df.select(tokens_to_int("t", lenient=False)).collect()
    path = f"{tmp_path}/log.csv"
    with open(path, "w") as f:
        f.write("a,b\n1,2\nx,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    rows = fs.read_csv(spark, path, schema, rejects="bad").orderBy(F.col("bad")).collect()
    assert [(r.a, r.b, r.bad) for r in rows] == [(1, 2, 0), (None, None, 1)]
    with pytest.raises(PySparkException):
        fs.read_csv(spark, path, schema, lenient=False).collect()


def test_packed_order_equals_struct_order(spark):
    """Nulls, ties, negative and extreme values: the packed numbers order rows as a struct does."""
    from pyspark.sql import functions as F

    from clickwright.operators.sequence import RowOrder

    big, times = (1 << 63) - 1, [None, -5, 0, 1_537_000_000, -(1 << 51), (1 << 51)]
    ids = [None, 1 - big, -1, 0, 1, 7, big]
    rows = [(t, i) for t in times for i in ids]
    df = spark.createDataFrame(rows, "ts long, id long")
    for columns in (["ts", "id"], ["id", "ts"], ["ts"]):
        packed, plain = RowOrder(columns, "ts"), RowOrder(columns, "ts", integers=False)
        assert packed.packed and not plain.packed
        keyed = df.select("ts", "id", packed.key().alias("p"), plain.key().alias("s"))
        assert keyed.orderBy("p").select(*columns).collect() == keyed.orderBy("s").select(*columns).collect()
        assert keyed.where(~packed.last(F.col("p")).eqNullSafe(F.col(columns[-1]))).count() == 0
    assert not RowOrder(["id", "other"], "ts").packed


def test_folds_of_many_classes(spark):
    """More labels than fit into literals are dealt as evenly."""
    from clickwright.operators import split as sp

    df = spark.range(6600).select(F.col("id").alias("instance_id"), F.when(F.col("id") % 1101 > 0, F.col("id") % 1101).alias("is_trade"))
    got = sp.stratified_folds(df, 3).groupBy("is_trade").agg(F.count("*").alias("n"), F.collect_list("fold").alias("f")).collect()
    assert len(got) == 1101 and all({r.f.count(k) for k in range(3)} <= {r.n // 3, -(-r.n // 3)} for r in got)
