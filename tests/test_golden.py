"""Hand-worked golden rows (FIXTURES F5, F6)."""

from pyspark.sql import functions as F

from clickwright import functions as fx
from clickwright.operators import preprocess as pp
from clickwright.operators import sequence as seq

F5_ROWS = [(1, 1, "A", 1000), (2, 1, "A", 1000), (3, 1, "B", 1300), (4, 1, "A", 1600), (5, 1, "A", 2200), (6, 2, "A", 1000)]
F5_EXPECTED = {
    # id: bf, af, last, next, tab, first, last_gap, last_view
    1: (1, 0, -1, 0, 2, 0, 1200, -1),
    2: (1, 0, 0, 300, 1, 0, 1200, -1),
    3: (1, 2, 300, 300, 1, 300, 900, -1),
    4: (0, 1, 300, 600, 1, 600, 600, 600),
    5: (0, 0, 600, -1, 3, 1200, 0, 600),
    6: (0, 0, -1, -1, 0, -1, -1, -1),
}


def f5_frame(spark):
    df = spark.createDataFrame(F5_ROWS, "instance_id bigint, user_id bigint, shop_id string, context_timestamp bigint")
    return df.withColumn("day", F.lit(1))


def test_sequence_golden_rows(spark):
    df = f5_frame(spark)
    df = seq.rolling_neighbor_counts(df, {"user": ["user_id"]})
    df = seq.last_time_gap(df, ["user_id"])
    df = seq.next_time_gap(df, ["user_id"])
    df = seq.click_position_tab(df, [["user_id", "day"]])
    df = seq.first_last_gap(df, {"u": ["user_id", "day"]})
    df = seq.gap_to_last_view(df, ["shop_id"])
    cols = ["user_count_10_bf", "user_count_10_af", "user_id_lasttime_diff", "user_id_nexttime_diff", "click_user_id_tab",
            "u_day_diffTime_first", "u_day_diffTime_last", "diffWithLastView_shop_id"]
    got = {r["instance_id"]: tuple(r[c] for c in cols) for r in df.collect()}
    assert got == F5_EXPECTED
    assert dict(df.dtypes)["user_count_10_bf"] == "double"
    assert dict(df.dtypes)["diffWithLastView_shop_id"] == "double"


def test_scalar_golden_values(spark):
    hours = [0, 1, 6, 7, 12, 13, 18, 19, 23]
    df = spark.createDataFrame([(h,) for h in hours], "hour int")
    assert [r[0] for r in df.select(fx.bin_right_closed("hour")).collect()] == [-1, 0, 0, 1, 1, 2, 2, 3, 3]
    mins = spark.createDataFrame([(m,) for m in [0, 14, 15, 59]], "minute int")
    assert [r[0] for r in mins.select(fx.modulo_plus_one("minute", 15)).collect()] == [1, 15, 1, 15]
    one = spark.createDataFrame([(1.0 / 32,)], "x double")
    assert one.select(fx.round_half_even("x", 4)).first()[0] == 0.0312


def test_predicted_parse_and_miss_count(spark):
    df = spark.createDataFrame([("12:34;56:-1;78:90,91;9:8", "1;2", "5")], "p string, cats string, props string")
    r = df.select(fx.predicted_categories("p").alias("c"), fx.predicted_properties("p").alias("q")).first()
    assert r["c"] == [12, 56, 78, 9]
    assert r["q"] == [34]
    miss = spark.createDataFrame([("1;2", "2:0;3:0;", "7")], "item_category_list string, predict_category_property string, item_property_list string")
    out = pp.predicted_category_match(miss).first()
    assert out["hitCategory"] == 1


def test_label_encode_numeric_order(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([100, -1, 10, 9, 10])], "instance_id bigint, item_id bigint")
    out = {r["instance_id"]: r["item_id"] for r in pp.label_encode(df, ["item_id"]).collect()}
    assert out == {0: 3, 1: 0, 2: 2, 3: 1, 4: 2}


def test_label_encode_null_gets_next_code(spark):
    df = spark.createDataFrame([(0, 5), (1, None), (2, 7)], "instance_id bigint, item_city_id bigint")
    out = {r["instance_id"]: r["item_city_id"] for r in pp.label_encode(df, ["item_city_id"]).collect()}
    assert out == {0: 0, 1: 2, 2: 1}
