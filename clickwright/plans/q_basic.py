"""Queries for sources/sinks, column management, cleaning, joins, aggregations,
sorts, set operations and scalar functions (§2.1-2.5, §2.7-2.9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clickwright import functions as fx
from clickwright.operators import aggregate as ag
from clickwright.operators import clean as cl
from clickwright.operators import columns as co
from clickwright.operators import joins as jn
from clickwright.operators import listing as li
from clickwright.plans.catalog import log, register, scan, with_clicklog
from clickwright.session import scratch_path
from clickwright.sources import files as fs
from clickwright.sources.clicklog import CLICKLOG_COLUMNS

ALL = ", ".join(CLICKLOG_COLUMNS)
SQL_ALL = with_clicklog("SELECT * FROM clicklog")

# ---------------------------------------------------------------- 2.1 sources / sinks


@register("read_log", SQL_ALL)
def q_read_log(spark, sf_dir):
    df = log(spark, sf_dir)
    path = fs.write_log(df, scratch_path(spark, "log"))
    return fs.read_log(spark, path, schema=df.schema)


@register("read_log_limited", with_clicklog("SELECT * FROM clicklog ORDER BY instance_id LIMIT 1000"))
def q_read_log_limited(spark, sf_dir):
    return fs.read_log_limited(log(spark, sf_dir), 1000)


FEATURE_FILE_COLS = ["instance_id", "day", "item_brand_id", "item_city_id", "shop_score_service", "user_age_level"]


@register("read_csv", with_clicklog(f"SELECT {', '.join(FEATURE_FILE_COLS)} FROM clicklog"))
def q_read_csv(spark, sf_dir):
    df = log(spark, sf_dir).select(*FEATURE_FILE_COLS)
    path = fs.write_csv(df, scratch_path(spark, "features-csv"))
    return fs.read_csv(spark, path, df.schema)


@register("export_csv", SQL_ALL)
def q_export_csv(spark, sf_dir):
    df = log(spark, sf_dir)
    path = fs.export_csv(df, scratch_path(spark, "export"))
    return fs.read_csv(spark, path, df.schema)


@register("read_labels_headerless", with_clicklog("SELECT is_trade FROM clicklog"))
def q_read_labels(spark, sf_dir):
    path = fs.write_labels_headerless(log(spark, sf_dir), scratch_path(spark, "labels"))
    return fs.read_labels_headerless(spark, path)


@register("concat_columns_by_position", with_clicklog("SELECT instance_id, user_id, day, is_trade FROM clicklog"))
def q_concat(spark, sf_dir):
    df = log(spark, sf_dir)
    data = df.select("instance_id", "user_id", "day").orderBy("instance_id")
    label = df.select("instance_id", "is_trade").orderBy("instance_id").select("is_trade")
    return fs.concat_columns_by_position(data, label)


@register("save_dataset", SQL_ALL)
def q_save_dataset(spark, sf_dir):
    folder = fs.save_dataset(log(spark, sf_dir), scratch_path(spark, "dataset"))
    return fs.load_dataset(spark, folder)[0]


@register("load_dataset", SQL_ALL)
def q_load_dataset(spark, sf_dir):
    folder = fs.save_dataset(log(spark, sf_dir), scratch_path(spark, "dataset-by-day"), partition_by="day")
    data, _ = fs.load_dataset(spark, folder)
    return data.select(*CLICKLOG_COLUMNS)


@register("row_count", with_clicklog("SELECT count(*) AS row_count FROM clicklog"))
def q_row_count(spark, sf_dir):
    return fs.row_count(scan(spark, sf_dir, "instance_id"))


# ---------------------------------------------------------------- 2.2 columns


@register("select_columns", with_clicklog("SELECT instance_id, user_id, item_id, context_timestamp FROM clicklog"))
def q_select(spark, sf_dir):
    return co.select_columns(scan(spark, sf_dir, "instance_id", "user_id", "item_id", "context_timestamp"), ["instance_id", "user_id", "item_id", "context_timestamp"])


@register(
    "derive_column",
    with_clicklog(
        "SELECT instance_id, CAST(minute // 15 AS INTEGER) AS quarter, CAST(day * 24 + hour AS INTEGER) AS day_hour FROM clicklog"
    ),
)
def q_derive(spark, sf_dir):
    df = co.derive_column(
        scan(spark, sf_dir, "instance_id", "day", "hour", "minute"), {"quarter": fx.floor_div("minute", 15), "day_hour": (F.col("day") * 24 + F.col("hour")).cast("int")}
    )
    return df.select("instance_id", "quarter", "day_hour")


STRING_COLS = ["item_category_list", "item_property_list", "predict_category_property"]
NON_STRING = [c for c in CLICKLOG_COLUMNS if c not in STRING_COLS]


@register("drop_columns", with_clicklog(f"SELECT {', '.join(NON_STRING)} FROM clicklog"))
def q_drop(spark, sf_dir):
    return co.drop_columns(log(spark, sf_dir), STRING_COLS)


@register("rename_columns", with_clicklog("SELECT instance_id, user_id AS uid, item_id AS iid FROM clicklog"))
def q_rename(spark, sf_dir):
    return co.rename_columns(scan(spark, sf_dir, "instance_id", "user_id", "item_id").select("instance_id", "user_id", "item_id"), {"user_id": "uid", "item_id": "iid"})


@register("cast_column", with_clicklog("SELECT instance_id, CAST(shop_star_level AS DOUBLE) AS shop_star_level_double FROM clicklog"))
def q_cast(spark, sf_dir):
    return co.cast_column(log(spark, sf_dir), "shop_star_level", "double", "shop_star_level_double").select(
        "instance_id", "shop_star_level_double"
    )


@register("filter_by_day", with_clicklog("SELECT * FROM clicklog WHERE day < 24"))
def q_filter_day(spark, sf_dir):
    return co.filter_by_day(log(spark, sf_dir), "<", 24)


NUMERIC_COLS = [c for c in NON_STRING]


@register("select_by_dtype", with_clicklog(f"SELECT {', '.join(NUMERIC_COLS)} FROM clicklog"))
def q_by_dtype(spark, sf_dir):
    return co.select_by_dtype(log(spark, sf_dir))


def _useless_kept():
    from clickwright.schema import COLS_THAT_USELESS

    return [c for c in NUMERIC_COLS if c not in COLS_THAT_USELESS]


@register("drop_useless_columns", with_clicklog(f"SELECT {', '.join(_useless_kept())} FROM clicklog"))
def q_useless(spark, sf_dir):
    return co.drop_useless_columns(log(spark, sf_dir))[0]


def _best_cols():
    from clickwright.schema import BEST_VARIABLE, COLS_WITH_CATEGORY_TYPE

    return [c for c in dict.fromkeys(BEST_VARIABLE + COLS_WITH_CATEGORY_TYPE) if c in CLICKLOG_COLUMNS]


@register("select_best_columns", with_clicklog(f"SELECT {', '.join(_best_cols())} FROM clicklog"))
def q_best(spark, sf_dir):
    return co.select_best_columns(log(spark, sf_dir))


WANTED = ["item_brand_id", "item_sales_level", "item_collected_level", "user_age_level", "day", "is_trade", "not_a_column"]


@register(
    "intersect_feature_list",
    with_clicklog(f"SELECT {', '.join(c for c in CLICKLOG_COLUMNS if c in WANTED and c not in ('day', 'is_trade'))} FROM clicklog"),
)
def q_intersect(spark, sf_dir):
    df = log(spark, sf_dir)
    return df.select(*co.intersect_feature_list(df, WANTED))


@register("split_off_label", with_clicklog(f"SELECT {', '.join(c for c in CLICKLOG_COLUMNS if c != 'is_trade')} FROM clicklog"))
def q_split_label(spark, sf_dir):
    return co.split_off_label(log(spark, sf_dir))[0]


# ---------------------------------------------------------------- 2.3 cleaning


def with_purchase_value(df):
    """Revenue column present only on purchases (a naturally sparse float column)."""
    return df.withColumn("purchase_value", F.when(F.col("is_trade") == 1, F.col("shop_score_service")))


PV_SQL = "CASE WHEN is_trade = 1 THEN shop_score_service END"


@register("sentinel_to_null", with_clicklog("SELECT instance_id, nullif(user_age_level, -1) AS user_age_level FROM clicklog"))
def q_sentinel(spark, sf_dir):
    return cl.sentinel_to_null(log(spark, sf_dir).select("instance_id", "user_age_level"), ["user_age_level"])


def _missing_sql():
    parts = []
    for c in NON_STRING:
        parts.append(f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL OR {c} = -1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing_ratio FROM clicklog")
    for c in STRING_COLS:
        parts.append(f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing_ratio FROM clicklog")
    return with_clicklog(" UNION ALL ".join(parts))


@register("missing_ratio", _missing_sql())
def q_missing(spark, sf_dir):
    return cl.missing_ratio(log(spark, sf_dir)).withColumnRenamed("column", "column_name")


@register("drop_sparse_columns", with_clicklog(f"SELECT {ALL} FROM clicklog"))
def q_drop_sparse(spark, sf_dir):
    # purchase_value is missing on ~80 % of rows (> 0.6) and is dropped
    return cl.drop_sparse_columns(with_purchase_value(log(spark, sf_dir)))


@register(
    "impute_mean",
    with_clicklog(
        f"SELECT instance_id, round_even(coalesce(nullif({PV_SQL}, -1.0), (SELECT avg(nullif({PV_SQL}, -1.0)) FROM clicklog)), 6) "
        "AS purchase_value FROM clicklog"
    ),
)
def q_impute_mean(spark, sf_dir):
    df = cl.impute_mean(with_purchase_value(log(spark, sf_dir)).select("instance_id", "purchase_value"))
    return df.select("instance_id", F.bround("purchase_value", 6).alias("purchase_value"))


@register(
    "impute_column_inplace",
    with_clicklog(
        f"SELECT instance_id, round_even(coalesce({PV_SQL}, (SELECT avg({PV_SQL}) FROM clicklog)), 6) AS purchase_value FROM clicklog"
    ),
)
def q_imputer(spark, sf_dir):
    df = cl.impute_column_inplace(with_purchase_value(log(spark, sf_dir)).select("instance_id", "purchase_value"), "purchase_value")
    return df.select("instance_id", F.bround("purchase_value", 6).alias("purchase_value"))


@register(
    "fill_constant",
    with_clicklog("SELECT instance_id, coalesce(item_city_id, -1) AS item_city_id, coalesce(shop_star_level, -1) AS shop_star_level FROM clicklog"),
)
def q_fill(spark, sf_dir):
    return cl.fill_constant(log(spark, sf_dir).select("instance_id", "item_city_id", "shop_star_level"), -1)


# ---------------------------------------------------------------- 2.4 joins


@register(
    "left_join_features",
    with_clicklog(
        "SELECT c.instance_id, a.item_hour_n FROM clicklog c LEFT JOIN a ON c.item_id = a.item_id AND c.hour = a.hour",
        "a AS (SELECT item_id, hour, count(*) AS item_hour_n FROM clicklog GROUP BY item_id, hour)",
    ),
)
def q_left_join(spark, sf_dir):
    df = log(spark, sf_dir)
    feat = ag.group_size(df, ["item_id", "hour"], "item_hour_n")
    return jn.left_join_features(df, feat, ["item_id", "hour"]).select("instance_id", "item_hour_n")


@register(
    "left_join_on_expr",
    with_clicklog(
        "SELECT c.instance_id, c.day, d.day AS day_right, d.hours FROM clicklog c LEFT JOIN d ON c.day = d.day",
        "d AS (SELECT day, array_to_string(list_sort(list(DISTINCT hour)), ',') AS hours FROM clicklog GROUP BY day)",
    ),
)
def q_join_expr(spark, sf_dir):
    df = log(spark, sf_dir)
    day_hours = ag.group_collect_set(df, ["day"], "hour", "hours").withColumn("hours", F.array_join("hours", ","))
    return jn.left_join_on_expr(df.select("instance_id", "day"), day_hours, "day")


SALES_NAMES = {i: ("low" if i < 5 else "high") for i in range(10)}


@register(
    "lookup_map",
    with_clicklog("SELECT instance_id, CASE WHEN item_sales_level < 5 THEN 'low' WHEN item_sales_level < 10 THEN 'high' END AS sales_band FROM clicklog"),
)
def q_lookup(spark, sf_dir):
    return jn.lookup_map(log(spark, sf_dir), "item_sales_level", SALES_NAMES, "sales_band").select("instance_id", "sales_band")


# ---------------------------------------------------------------- 2.5 aggregations


@register("group_size", with_clicklog("SELECT user_id, day, count(*) AS size FROM clicklog GROUP BY user_id, day"))
def q_group_size(spark, sf_dir):
    return ag.group_size(scan(spark, sf_dir, "user_id", "day"), ["user_id", "day"])


@register("group_mean", with_clicklog("SELECT item_id, avg(hour) AS hour_mean, avg(user_age_level) AS user_age_level_mean FROM clicklog GROUP BY item_id"))
def q_group_mean(spark, sf_dir):
    return ag.group_mean(log(spark, sf_dir), ["item_id"], ["hour", "user_age_level"])


@register(
    "group_agg_dict",
    with_clicklog("SELECT day, avg(context_timestamp) AS mean_context_timestamp, max(context_timestamp) AS max_context_timestamp FROM clicklog GROUP BY day"),
)
def q_group_agg_dict(spark, sf_dir):
    return ag.group_agg(scan(spark, sf_dir, "day", "context_timestamp"), ["day"], [("context_timestamp", "mean"), ("context_timestamp", "max")])


@register(
    "group_multi_agg",
    with_clicklog("SELECT day, hour, avg(context_timestamp) AS mean_context_timestamp, count(context_timestamp) AS count_context_timestamp FROM clicklog GROUP BY day, hour"),
)
def q_group_multi(spark, sf_dir):
    return ag.group_agg(scan(spark, sf_dir, "day", "hour", "context_timestamp"), ["day", "hour"], [("context_timestamp", "mean"), ("context_timestamp", "count")])


@register(
    "group_distinct_with_null",
    with_clicklog("SELECT user_id, day, count(DISTINCT item_city_id) + max(CASE WHEN item_city_id IS NULL THEN 1 ELSE 0 END) AS item_city_id_distinct FROM clicklog GROUP BY user_id, day"),
)
def q_distinct_null(spark, sf_dir):
    return ag.group_distinct_with_null(scan(spark, sf_dir, "user_id", "day", "item_city_id"), ["user_id", "day"], "item_city_id")


@register("group_nunique", with_clicklog("SELECT shop_id, day, count(DISTINCT item_id) AS item_id_nunique FROM clicklog GROUP BY shop_id, day"))
def q_nunique(spark, sf_dir):
    return ag.group_nunique(scan(spark, sf_dir, "shop_id", "day", "item_id"), ["shop_id", "day"], "item_id")


@register(
    "group_sum_transform",
    with_clicklog("SELECT instance_id, round_even(sum(shop_score_service) OVER (PARTITION BY user_id), 6) AS user_value_sum FROM clicklog"),
)
def q_sum_transform(spark, sf_dir):
    df = ag.group_sum_transform(log(spark, sf_dir), ["user_id"], "shop_score_service", "user_value_sum")
    return df.select("instance_id", F.bround("user_value_sum", 6).alias("user_value_sum"))


@register(
    "group_collect_list",
    with_clicklog(
        "SELECT day, string_agg(CAST(hour AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY hour) AS hour_list FROM "
        "(SELECT day, hour, count(*) AS n FROM clicklog GROUP BY day, hour) GROUP BY day"
    ),
)
def q_collect_list(spark, sf_dir):
    g = ag.group_collect_list(scan(spark, sf_dir, "day", "hour"), ["day"], "hour")
    return g.select("day", F.array_join(F.transform("hour_list", lambda x: F.concat_ws(":", x["value"], x["count"])), ",").alias("hour_list"))


@register(
    "group_collect_set",
    with_clicklog("SELECT day, array_to_string(list_sort(list(DISTINCT hour)), ',') AS hour_set FROM clicklog GROUP BY day"),
)
def q_collect_set(spark, sf_dir):
    g = ag.group_collect_set(scan(spark, sf_dir, "day", "hour"), ["day"], "hour")
    return g.select("day", F.array_join("hour_set", ",").alias("hour_set"))


CHUNK = 64


@register(
    "group_string_join",
    with_clicklog(
        "SELECT user_id, chunk, count(*) AS n, string_agg(CAST(context_timestamp AS VARCHAR), ';' ORDER BY pos) AS user_time_join, "
        f"string_agg(CAST(CASE WHEN pos % {CHUNK} = 0 THEN context_timestamp ELSE context_timestamp - before END AS VARCHAR), ';' ORDER BY pos) AS deltas FROM "
        f"(SELECT *, CAST(pos // {CHUNK} AS BIGINT) AS chunk FROM (SELECT user_id, context_timestamp, row_number() OVER w - 1 AS pos, lag(context_timestamp) OVER w AS before "
        "FROM clicklog WHERE user_id IS NOT NULL AND context_timestamp IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY context_timestamp, instance_id))) "
        "GROUP BY user_id, chunk",
    ),
)
def q_string_join(spark, sf_dir):
    df = scan(spark, sf_dir, "instance_id", "user_id", "context_timestamp")
    return li.group_string_join(df, ["user_id"], "context_timestamp", size=CHUNK, out="user_time_join")


@register(
    "group_string_join_read",
    with_clicklog(
        "SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id, item_id ORDER BY context_timestamp) - 1 AS BIGINT) AS position, context_timestamp FROM clicklog "
        "WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND context_timestamp IS NOT NULL"
    ),
)
def q_string_join_read(spark, sf_dir):
    """The lists of (user, item), read back from their delta-coded chunks."""
    df = scan(spark, sf_dir, "instance_id", "user_id", "item_id", "context_timestamp")
    chunks = li.group_string_join(df, ["user_id", "item_id"], "context_timestamp", size=CHUNK)
    return li.read_string_join(chunks, ["user_id", "item_id"], "context_timestamp", size=CHUNK)


@register("value_counts", with_clicklog("SELECT item_sales_level, count(*) AS count FROM clicklog WHERE item_sales_level IS NOT NULL GROUP BY 1"))
def q_value_counts(spark, sf_dir):
    return ag.value_counts(scan(spark, sf_dir, "item_sales_level"), "item_sales_level")


@register(
    "top_value_per_group",
    with_clicklog(
        "SELECT c.instance_id, t.shop_id AS user_id_top_shop_id FROM clicklog c LEFT JOIN t ON c.user_id = t.user_id",
        "p AS (SELECT user_id, shop_id, count(*) AS n FROM clicklog WHERE user_id IS NOT NULL AND shop_id IS NOT NULL GROUP BY 1, 2)",
        "t AS (SELECT user_id, shop_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, shop_id) AS rn FROM p) WHERE rn = 1)",
    ),
)
def q_top_value(spark, sf_dir):
    return ag.top_value_per_group(log(spark, sf_dir), "user_id", "shop_id").select("instance_id", "user_id_top_shop_id")


@register("global_max", with_clicklog("SELECT max(day) AS max_day FROM clicklog"))
def q_global_max(spark, sf_dir):
    return ag.global_max(scan(spark, sf_dir, "day"), "day")


@register("distinct_rows", with_clicklog("SELECT DISTINCT user_id, day FROM clicklog"))
def q_distinct(spark, sf_dir):
    return ag.distinct_rows(scan(spark, sf_dir, "user_id", "day"), ["user_id", "day"])


def _dedup_sql(direction):
    return with_clicklog(
        f"SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY user_id {direction}, "
        f"context_timestamp {direction}, instance_id {direction}) AS rn FROM clicklog) WHERE rn = 1"
    )


@register("dedup_keep_first", _dedup_sql("ASC"))
def q_dedup_first(spark, sf_dir):
    return ag.dedup_keep(log(spark, sf_dir), ["user_id", "day"], ["user_id", "context_timestamp"], "first")


@register("dedup_keep_last", _dedup_sql("DESC"))
def q_dedup_last(spark, sf_dir):
    return ag.dedup_keep(log(spark, sf_dir), ["user_id", "day"], ["user_id", "context_timestamp"], "last")


@register(
    "duplicate_mask",
    with_clicklog(
        "SELECT instance_id, count(*) OVER w > 1 AS is_duplicated, "
        "row_number() OVER (w ORDER BY context_timestamp, instance_id) = 1 AS is_first, "
        "row_number() OVER (w ORDER BY context_timestamp DESC, instance_id DESC) = 1 AS is_last "
        "FROM clicklog WINDOW w AS (PARTITION BY user_id, item_id, day)"
    ),
)
def q_dup_mask(spark, sf_dir):
    out = ag.duplicate_mask(log(spark, sf_dir), ["user_id", "item_id", "day"], ["context_timestamp"])
    return out.select("instance_id", "is_duplicated", "is_first", "is_last")


# ---------------------------------------------------------------- 2.7 sorts, limits, top-k


@register("sort_by_user_time", with_clicklog("SELECT instance_id, user_id, context_timestamp FROM clicklog ORDER BY user_id, context_timestamp, instance_id"))
def q_sort_user_time(spark, sf_dir):
    return scan(spark, sf_dir, "instance_id", "user_id", "context_timestamp").select("instance_id", "user_id", "context_timestamp").orderBy("user_id", "context_timestamp", "instance_id")


@register("sort_by_time", with_clicklog("SELECT instance_id, context_timestamp FROM clicklog ORDER BY context_timestamp DESC, instance_id"))
def q_sort_time(spark, sf_dir):
    return scan(spark, sf_dir, "instance_id", "context_timestamp").select("instance_id", "context_timestamp").orderBy(F.col("context_timestamp").desc(), "instance_id")


@register("limit_rows", with_clicklog("SELECT instance_id, context_timestamp FROM clicklog ORDER BY instance_id LIMIT 100"))
def q_limit(spark, sf_dir):
    return scan(spark, sf_dir, "instance_id", "context_timestamp").select("instance_id", "context_timestamp").orderBy("instance_id").limit(100)


@register(
    "top_k_per_group",
    with_clicklog(
        "SELECT user_id, item_id, n FROM (SELECT user_id, item_id, count(*) AS n, "
        "row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, item_id) AS rn FROM clicklog GROUP BY user_id, item_id) WHERE rn <= 3"
    ),
)
def q_top_k(spark, sf_dir):
    pairs = scan(spark, sf_dir, "user_id", "item_id").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("item_id").asc())
    # rank-limit filter: Spark plans a WindowGroupLimit that keeps <= k rows per key before the shuffle
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 3).drop("rn")


# ---------------------------------------------------------------- 2.8 set operations


@register(
    "concat_train_test",
    with_clicklog("SELECT instance_id, day, CASE WHEN day < 24 THEN 'train' ELSE 'test' END AS split FROM clicklog"),
)
def q_concat_train_test(spark, sf_dir):
    df = scan(spark, sf_dir, "instance_id", "day").select("instance_id", "day")
    return co.concat_tagged({"train": df.where("day < 24"), "test": df.where("coalesce(day >= 24, true)")})


def _int_list_sql(expr):
    return f"list_filter(list_transform({expr}, lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL)"


CATS_SQL = _int_list_sql("string_split(item_category_list, ';')")
PROPS_SQL = _int_list_sql("string_split(item_property_list, ';')")
PRED_CATS_SQL = _int_list_sql(r"regexp_extract_all(predict_category_property, '(\d+):', 1)")
PRED_PROPS_SQL = _int_list_sql(r"regexp_extract_all(predict_category_property, ':(\w+);', 1)")


@register(
    "token_set_difference",
    with_clicklog(
        f"SELECT instance_id, array_to_string(list_sort(list_distinct(list_filter({CATS_SQL}, lambda x: NOT list_contains({PRED_CATS_SQL}, x)))), ';') "
        "AS unpredicted_categories FROM clicklog"
    ),
)
def q_token_diff(spark, sf_dir):
    df = log(spark, sf_dir)
    diff = F.array_except(fx.tokens_to_int("item_category_list"), fx.predicted_categories("predict_category_property"))
    return df.select("instance_id", F.array_join(F.array_sort(diff), ";").alias("unpredicted_categories"))


# ---------------------------------------------------------------- 2.9 scalar functions

TS_SQL = "make_timestamp(context_timestamp * 1000000)"
SCALARS = {
    "split_string": (lambda: F.array_join(fx.split_string("item_category_list"), "|"),
                     "array_to_string(string_split(item_category_list, ';'), '|')"),
    "nth_token": (lambda: fx.nth_token("item_category_list", 1), "string_split(item_category_list, ';')[2]"),
    "tokens_to_int": (lambda: F.array_join(fx.tokens_to_int("item_property_list"), ","), f"array_to_string({PROPS_SQL}, ',')"),
    "regex_find_all": (lambda: F.concat_ws("/", F.array_join(fx.predicted_categories("predict_category_property"), ","),
                                           F.array_join(fx.predicted_properties("predict_category_property"), ",")),
                       f"array_to_string({PRED_CATS_SQL}, ',') || '/' || array_to_string({PRED_PROPS_SQL}, ',')"),
    "to_set": (lambda: F.array_join(F.array_sort(F.array_distinct(fx.tokens_to_int("item_property_list"))), ","),
               f"array_to_string(list_sort(list_distinct({PROPS_SQL})), ',')"),
    "set_size": (lambda: fx.set_size(fx.tokens_to_int("item_property_list")), f"CAST(len(list_distinct({PROPS_SQL})) AS INTEGER)"),
    "array_membership": (lambda: F.array_contains(fx.tokens_to_int("item_property_list"), F.lit(10)), f"list_contains({PROPS_SQL}, 10)"),
    "number_to_string": (lambda: fx.number_to_string("context_timestamp"), "CAST(context_timestamp AS VARCHAR)"),
    "epoch_to_timestamp": (lambda: F.timestamp_add("SECOND", F.col("context_timestamp"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")),
                           TS_SQL),
    "day_of_month": (lambda: fx.day_of_month("context_timestamp"), f"CAST(dayofmonth({TS_SQL}) AS INTEGER)"),
    "hour": (lambda: fx.hour_of_day("context_timestamp"), f"CAST(hour({TS_SQL}) AS INTEGER)"),
    "minute": (lambda: fx.minute_of_hour("context_timestamp"), f"CAST(minute({TS_SQL}) AS INTEGER)"),
    "utc_day": (lambda: fx.day_of_month(F.floor(F.col("context_timestamp").cast("string").try_cast("double"))),
                f"CAST(dayofmonth({TS_SQL}) AS INTEGER)"),
    "utc_hour": (lambda: fx.hour_of_day(F.floor(F.col("context_timestamp").cast("string").try_cast("double"))),
                 f"CAST(hour({TS_SQL}) AS INTEGER)"),
    "bin_right_closed": (lambda: fx.bin_right_closed("hour"), "CAST(CASE WHEN hour BETWEEN 1 AND 24 THEN (hour - 1) // 6 ELSE -1 END AS INTEGER)"),
    "modulo_plus_one": (lambda: fx.modulo_plus_one("minute", 15), "CAST(minute % 15 + 1 AS INTEGER)"),
    "floor_div": (lambda: fx.floor_div("minute", 10), "CAST(minute // 10 AS INTEGER)"),
    "round_half_even": (lambda: fx.round_half_even(F.col("minute") / F.lit(32), 4), "round_even(minute / 32, 4)"),
    "arith_compare": (lambda: ((F.col("hour") + F.col("minute") * 2 - 3) > F.col("day")) & ~(F.col("is_trade") == 1),
                      "((hour + minute * 2 - 3) > day) AND NOT (is_trade = 1)"),
    "array_of_columns": (lambda: F.array("day", "hour")[0] + F.array("day", "hour")[1], "[day, hour][1] + [day, hour][2]"),
    "conditional": (lambda: F.when(F.col("user_age_level") != -1, F.col("user_age_level")).otherwise(F.lit(None)),
                    "CASE WHEN user_age_level <> -1 THEN user_age_level END"),
    "is_null": (lambda: F.col("item_city_id").isNull(), "item_city_id IS NULL"),
}


def _scalar_query(name, build):
    def q(spark, sf_dir):
        return log(spark, sf_dir).select("instance_id", build().alias(name))

    return q


for _name, (_build, _sql) in SCALARS.items():
    register(_name, with_clicklog(f"SELECT instance_id, {_sql} AS {_name} FROM clicklog"))(_scalar_query(_name, _build))


@register(
    "flatten_tokens",
    with_clicklog("SELECT instance_id, t AS token FROM (SELECT instance_id, unnest(" + PROPS_SQL + ") AS t FROM clicklog)"),
)
def q_flatten(spark, sf_dir):
    return log(spark, sf_dir).select("instance_id", F.explode(fx.tokens_to_int("item_property_list")).alias("token"))
