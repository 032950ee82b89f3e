"""Queries for preprocessing composites and token value tables (§2.6 tail, §2.7, §2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickwright.functions import nth_token, tokens_to_int
from clickwright.operators import preprocess as pp
from clickwright.plans.catalog import log, register, with_clicklog
from clickwright.plans.ordered import global_rank
from clickwright.schema import COL_NEED_ENCODE

TIME_SQL_COLS = [
    "CAST(dayofmonth(make_timestamp(context_timestamp * 1000000)) AS INTEGER) AS day",
    "CAST(hour(make_timestamp(context_timestamp * 1000000)) AS INTEGER) AS hour",
    "CAST(minute(make_timestamp(context_timestamp * 1000000)) AS INTEGER) AS minute",
    "CAST(CASE WHEN hour(make_timestamp(context_timestamp * 1000000)) BETWEEN 1 AND 24 "
    "THEN (hour(make_timestamp(context_timestamp * 1000000)) - 1) // 6 ELSE -1 END AS INTEGER) AS maphour",
    "CAST(minute(make_timestamp(context_timestamp * 1000000)) % 15 + 1 AS INTEGER) AS mapmin",
]


@register("time_parts", with_clicklog("SELECT instance_id, context_timestamp, " + ", ".join(TIME_SQL_COLS) + " FROM clicklog"))
def q_time_parts(spark, sf_dir):
    return pp.time_parts(log(spark, sf_dir).select("instance_id", "context_timestamp"))


CAT_VALUES_SQL = [
    "tok AS (SELECT instance_id, string_split(item_category_list, ';')[2] AS v FROM clicklog)",
    "vc AS (SELECT v, count(*) AS cnt FROM tok WHERE v IS NOT NULL GROUP BY v)",
    "r AS (SELECT v, cnt, sum(cnt) OVER (ORDER BY cnt DESC, v ASC ROWS UNBOUNDED PRECEDING) AS cum FROM vc)",
    "k AS (SELECT v, cnt, row_number() OVER (ORDER BY cnt ASC, v ASC) AS code FROM r "
    "WHERE cum < (SELECT count(*) FROM clicklog) * 0.95)",
]


@register(
    "category_frequency_code",
    with_clicklog(
        "SELECT tok.instance_id, CAST(coalesce(k.code, 0) AS INTEGER) AS secondLevelCatagory_Most_Freq "
        "FROM tok LEFT JOIN k ON tok.v = k.v", *CAT_VALUES_SQL,
    ),
)
def q_category_code(spark, sf_dir):
    return pp.category_frequency_code(log(spark, sf_dir)).select("instance_id", "secondLevelCatagory_Most_Freq")


def _category_value_table(spark, sf_dir):
    df = log(spark, sf_dir)
    return (
        df.select(nth_token("item_category_list", 1).alias("v")).where(F.col("v").isNotNull())
        .groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
    ), df


@register(
    "cumulative_share_cut",
    with_clicklog("SELECT v, cnt, CAST(cum AS BIGINT) AS cum FROM r WHERE cum < (SELECT count(*) FROM clicklog) * 0.95",
                  *CAT_VALUES_SQL[:3]),
)
def q_cum_cut(spark, sf_dir):
    vc, df = _category_value_table(spark, sf_dir)
    n = df.count()
    r = global_rank(vc, [F.col("cnt").desc(), F.col("v").asc()], "rn", sum_col="cnt", running_sum="cum")
    return r.where(F.col("cum") < F.lit(n * 0.95)).select("v", "cnt", "cum")


@register("frequency_rank", with_clicklog("SELECT v, cnt, code FROM k", *CAT_VALUES_SQL))
def q_freq_rank(spark, sf_dir):
    vc, df = _category_value_table(spark, sf_dir)
    n = df.count()
    r = global_rank(vc, [F.col("cnt").desc(), F.col("v").asc()], "rn", sum_col="cnt", running_sum="cum")
    kept = r.where(F.col("cum") < F.lit(n * 0.95)).select("v", "cnt")
    return global_rank(kept, [F.col("cnt").asc(), F.col("v").asc()], "code")


PROP_SQL = [
    "tok AS (SELECT instance_id, TRY_CAST(unnest(string_split(item_property_list, ';')) AS BIGINT) AS t FROM clicklog)",
    "vc AS (SELECT t, count(*) AS cnt FROM tok WHERE t IS NOT NULL GROUP BY t)",
    "r AS (SELECT t, cnt, row_number() OVER (ORDER BY cnt DESC, t) AS rn, "
    "sum(cnt) OVER (ORDER BY cnt DESC, t ROWS UNBOUNDED PRECEDING) AS cum FROM vc)",
    "k0 AS (SELECT t, rn FROM r WHERE cum < (SELECT sum(cnt) FROM vc) * 0.8)",
    "k AS (SELECT t FROM k0 WHERE (SELECT count(*) FROM k0) <= 50 OR rn <= 40)",
]


@register(
    "property_flags",
    with_clicklog("SELECT DISTINCT tok.instance_id, tok.t AS property_token FROM tok JOIN k ON tok.t = k.t", *PROP_SQL),
)
def q_property_flags(spark, sf_dir):
    return pp.property_flags_long(log(spark, sf_dir))


@register(
    "top_n_values",
    with_clicklog("SELECT t AS property_token, cnt FROM vc ORDER BY cnt DESC, t LIMIT 40", *PROP_SQL[:2]),
)
def q_top_n_values(spark, sf_dir):
    toks = log(spark, sf_dir).select(F.explode(tokens_to_int("item_property_list")).alias("property_token"))
    vc = toks.groupBy("property_token").agg(F.count(F.lit(1)).alias("cnt"))
    return vc.orderBy(F.col("cnt").desc(), F.col("property_token").asc()).limit(40)


def _int_list(expr):
    return f"list_filter(list_transform({expr}, lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL)"


def _hit_sql(have_col, pattern):
    have = _int_list(f"string_split({have_col}, ';')")
    pred = _int_list(f"regexp_extract_all(predict_category_property, '{pattern}', 1)")
    return (
        f"CAST(CASE WHEN {have_col} IS NULL OR predict_category_property IS NULL THEN -1 ELSE "
        f"len(list_filter(list_distinct({have}), lambda x: NOT list_contains({pred}, x))) END AS INTEGER)"
    )


@register(
    "predicted_category_match",
    with_clicklog(
        "SELECT instance_id, " + _hit_sql("item_category_list", r"(\d+):") + " AS hitCategory, "
        + _hit_sql("item_property_list", r":(\w+);") + " AS hitProperty FROM clicklog"
    ),
)
def q_predicted(spark, sf_dir):
    return pp.predicted_category_match(log(spark, sf_dir)).select("instance_id", "hitCategory", "hitProperty")


ENCODED = ["item_brand_id", "item_city_id", "item_id", "user_id", "shop_id"]
assert all(c in COL_NEED_ENCODE for c in ENCODED)


def _encode_sql():
    cols = [
        f"CAST(CASE WHEN {c} IS NULL THEN (SELECT count(DISTINCT {c}) FROM clicklog) "
        f"ELSE dense_rank() OVER (ORDER BY {c}) - 1 END AS BIGINT) AS {c}"
        for c in ENCODED
    ]
    return with_clicklog("SELECT instance_id, " + ", ".join(cols) + " FROM clicklog")


@register("label_encode", _encode_sql())
def q_label_encode(spark, sf_dir):
    return pp.label_encode(log(spark, sf_dir)).select("instance_id", *ENCODED)
