"""Queries for the grouped features (§2.6 grouped part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickwright.operators import grouped as gr
from clickwright.operators.selection import exact_quantile
from clickwright.plans.catalog import log, register, scan, with_clicklog
from clickwright.plans.ordered import fresh_source, materialize
from clickwright.schema import (
    ACTIVE_PER_GRAIN, AGGREGATE_LEVEL, EXPOSE_PAIRS, MINUTE_BUCKETS, RELATIVE_RATIO,
)

EXPOSE_COLS = [f"{i}_{g}_{s}" for i, g in EXPOSE_PAIRS for s in ("cnt", "ratio")]
AGG_LEVEL_COLS = [f"{ids}_TO_{c}_mean" for c, idl in AGGREGATE_LEVEL.items() for ids in idl]
ACTIVE_COLS = [f"{a}_{g}__active_{b}__num" for g, d in ACTIVE_PER_GRAIN.items() for a, bl in d.items() for b in bl]
REL_COLS = [f"{c}_mean_by_{ids}{s}" for ids, cols in RELATIVE_RATIO.items() for s in ("", "ratio") for c in cols]
MINUTE_COLS = [f"min{n}_user_click" for n in MINUTE_BUCKETS]


def maphour_sql(h="hour"):
    return f"CAST(CASE WHEN {h} > 0 AND {h} <= 24 THEN ({h} - 1) // 6 ELSE -1 END AS INTEGER)"


def expose_sql_cols():
    cols = []
    for ids, grain in EXPOSE_PAIRS:
        g = maphour_sql() if grain == "maphour" else grain
        ok = f"{ids} IS NOT NULL AND {g} IS NOT NULL"
        cnt = f"count(*) OVER (PARTITION BY {ids}, {g})"
        tot = f"sum(CASE WHEN {g} IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {ids})"
        cols.append(f"CASE WHEN {ok} THEN {cnt} END AS {ids}_{grain}_cnt")
        cols.append(f"CASE WHEN {ok} THEN round_even({cnt} / {tot}, 4) END AS {ids}_{grain}_ratio")
    return cols


@register("expose_ratio", with_clicklog("SELECT instance_id, " + ", ".join(expose_sql_cols()) + " FROM clicklog"))
def q_expose(spark, sf_dir):
    from clickwright.operators.preprocess import time_parts

    df = log(spark, sf_dir).transform(time_parts)
    return gr.expose_ratio(df).select("instance_id", *EXPOSE_COLS)


def agg_level_sql_cols():
    return [
        f"CASE WHEN {ids} IS NOT NULL THEN avg({c}) OVER (PARTITION BY {ids}) END AS {ids}_TO_{c}_mean"
        for c, idl in AGGREGATE_LEVEL.items() for ids in idl
    ]


@register("aggregate_level", with_clicklog("SELECT instance_id, " + ", ".join(agg_level_sql_cols()) + " FROM clicklog"))
def q_agg_level(spark, sf_dir):
    return gr.aggregate_level(log(spark, sf_dir)).select("instance_id", *AGG_LEVEL_COLS)


def active_sql():
    ctes, joins, cols = [], [], []
    n = 0
    for grain, d in ACTIVE_PER_GRAIN.items():
        for a, bl in d.items():
            n += 1
            sel = ", ".join(
                f"count(DISTINCT {b}) + max(CASE WHEN {b} IS NULL THEN 1 ELSE 0 END) AS {a}_{grain}__active_{b}__num" for b in bl
            )
            ctes.append(f"a{n} AS (SELECT {a}, {grain}, {sel} FROM clicklog WHERE {a} IS NOT NULL AND {grain} IS NOT NULL GROUP BY {a}, {grain})")
            joins.append(f"LEFT JOIN a{n} ON c.{a} = a{n}.{a} AND c.{grain} = a{n}.{grain}")
            cols += [f"CAST(a{n}.{a}_{grain}__active_{b}__num AS BIGINT) AS {a}_{grain}__active_{b}__num" for b in bl]
    body = "SELECT c.instance_id, " + ", ".join(cols) + " FROM clicklog c " + " ".join(joins)
    return with_clicklog(body, *ctes)


@register("active_per_grain", active_sql())
def q_active(spark, sf_dir):
    df = log(spark, sf_dir)
    return gr.active_per_grain(df, source=fresh_source(df)).select("instance_id", *ACTIVE_COLS)


@register("active_per_grain_merged", active_sql())
def q_active_merged(spark, sf_dir):
    """The same features from the written bitmap words of two spans of days, merged."""
    df = log(spark, sf_dir)
    fresh = fresh_source(df)
    spans = [F.coalesce(F.col("day") <= 22, F.lit(True)), F.col("day") > 22]
    kept = [{n: materialize(w, "active-words") for n, w in gr.active_words(fresh().where(s)).items()} for s in spans]
    return gr.active_from_words(df, kept).select("instance_id", *ACTIVE_COLS)


MEDIANS = [("user_id", "context_timestamp"), ("shop_id", "shop_score_service")]


@register(
    "group_median",
    with_clicklog(" UNION ALL ".join(
        f"SELECT '{k}' AS key_name, {k} AS key, round_even(CAST(median({c}) AS DOUBLE), 6) AS median FROM clicklog WHERE {c} IS NOT NULL GROUP BY {k}"
        for k, c in MEDIANS)),
)
def q_group_median(spark, sf_dir):
    """Exact medians per key by distributed selection."""
    parts = [exact_quantile(scan(spark, sf_dir, k, c), [k], c).select(F.lit(k).alias("key_name"), F.col(k).alias("key"), F.bround(f"median_{c}", 6).alias("median"))
             for k, c in MEDIANS]
    return parts[0].unionByName(parts[1])


def rel_sql_cols():
    cols = []
    for ids, cs in RELATIVE_RATIO.items():
        for c in cs:
            m = f"(CASE WHEN {ids} IS NOT NULL THEN avg({c}) OVER (PARTITION BY {ids}) END)"
            cols.append(f"{m} AS {c}_mean_by_{ids}")
            cols.append(f"round_even({c} / nullif({m}, 0), 5) AS {c}_mean_by_{ids}ratio")
    return cols


@register("relative_ratio", with_clicklog("SELECT instance_id, " + ", ".join(rel_sql_cols()) + " FROM clicklog"))
def q_relative(spark, sf_dir):
    return gr.relative_ratio(log(spark, sf_dir)).select("instance_id", *REL_COLS)


@register(
    "daily_shop_item_count",
    with_clicklog(
        "SELECT c.instance_id, CAST(a.n AS BIGINT) AS shop_item_unique_day FROM clicklog c LEFT JOIN a "
        "ON c.shop_id = a.shop_id AND c.day = a.day",
        "a AS (SELECT shop_id, day, count(DISTINCT item_id) AS n FROM clicklog "
        "WHERE shop_id IS NOT NULL AND day IS NOT NULL GROUP BY shop_id, day)",
    ),
)
def q_shop_item(spark, sf_dir):
    return gr.daily_shop_item_count(log(spark, sf_dir)).select("instance_id", "shop_item_unique_day")


@register(
    "daily_user_clicks",
    with_clicklog(
        "SELECT instance_id, CASE WHEN user_id IS NOT NULL AND day IS NOT NULL THEN count(*) OVER (PARTITION BY user_id, day) END "
        "AS user_id_query_day FROM clicklog"
    ),
)
def q_user_day(spark, sf_dir):
    return gr.daily_user_clicks(log(spark, sf_dir)).select("instance_id", "user_id_query_day")


@register(
    "minute_bucket_clicks",
    with_clicklog(
        "SELECT instance_id, "
        + ", ".join(f"count(*) OVER (PARTITION BY user_id, day, hour, minute // {n}) AS min{n}_user_click" for n in MINUTE_BUCKETS)
        + " FROM clicklog"
    ),
)
def q_minute(spark, sf_dir):
    return gr.minute_bucket_clicks(log(spark, sf_dir)).select("instance_id", *MINUTE_COLS)
