"""Queries for the ordered and group-position sequence features (§2.6)."""

from __future__ import annotations

from clickwright.operators import sequence as seq
from clickwright.plans.catalog import log, register, with_clicklog
from clickwright.schema import CLICK_TAB_SUBSETS, FIRST_LAST_GROUPS, LAST_VIEW_GRAINS, ROLLING_KEYS


def _roll_sql(seconds: int) -> str:
    tag = "10" if seconds == 600 else str(seconds // 60)
    parts = []
    for prefix, keys in ROLLING_KEYS.items():
        part = ", ".join(keys)
        nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        for suffix, frame in (("bf", f"1 FOLLOWING AND {seconds - 1} FOLLOWING"), ("af", f"{seconds - 1} PRECEDING AND 1 PRECEDING")):
            parts.append(
                f"CAST(CASE WHEN {nn} THEN count(*) OVER (PARTITION BY {part} ORDER BY context_timestamp "
                f"RANGE BETWEEN {frame}) ELSE 0 END AS DOUBLE) AS {prefix}_count_{tag}_{suffix}"
            )
    return with_clicklog("SELECT instance_id,\n  " + ",\n  ".join(parts) + "\nFROM clicklog")


def _roll_cols(seconds):
    tag = "10" if seconds == 600 else str(seconds // 60)
    return [f"{p}_count_{tag}_{s}" for p in ROLLING_KEYS for s in ("bf", "af")]


@register("rolling_neighbor_counts", _roll_sql(600))
def q_rolling(spark, sf_dir):
    return seq.rolling_neighbor_counts(log(spark, sf_dir)).select("instance_id", *_roll_cols(600))


@register("rolling_neighbor_counts_day", _roll_sql(86400))
def q_rolling_day(spark, sf_dir):
    return seq.rolling_neighbor_counts(log(spark, sf_dir), seconds=86400).select("instance_id", *_roll_cols(86400))


def _win_sql(keys, order):
    return f"PARTITION BY {', '.join(keys)} ORDER BY {order}"


def _gap_sql(kind: str) -> str:
    cols = []
    for c in ("user_id", "item_id"):
        w = _win_sql([c], "context_timestamp, instance_id")
        if kind == "last":
            e = f"context_timestamp - lag(context_timestamp) OVER ({w})"
        else:
            e = f"lead(context_timestamp) OVER ({w}) - context_timestamp"
        cols.append(f"CAST(CASE WHEN {c} IS NULL THEN -1 ELSE coalesce({e}, -1) END AS BIGINT) AS {c}_{kind}time_diff")
    return with_clicklog("SELECT instance_id, " + ", ".join(cols) + " FROM clicklog")


@register("last_time_gap", _gap_sql("last"))
def q_last_gap(spark, sf_dir):
    return seq.last_time_gap(log(spark, sf_dir)).select("instance_id", "user_id_lasttime_diff", "item_id_lasttime_diff")


@register("next_time_gap", _gap_sql("next"))
def q_next_gap(spark, sf_dir):
    return seq.next_time_gap(log(spark, sf_dir)).select("instance_id", "user_id_nexttime_diff", "item_id_nexttime_diff")


def _last_view_sql():
    cols = []
    for g in LAST_VIEW_GRAINS:
        w = f"PARTITION BY user_id, {g} ORDER BY context_timestamp RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        cols.append(
            f"CAST(CASE WHEN user_id IS NULL OR {g} IS NULL THEN -1 ELSE "
            f"coalesce(context_timestamp - max(context_timestamp) OVER ({w}), -1) END AS DOUBLE) AS diffWithLastView_{g}"
        )
    return with_clicklog("SELECT instance_id, " + ", ".join(cols) + " FROM clicklog")


@register("gap_to_last_view", _last_view_sql())
def q_last_view(spark, sf_dir):
    return seq.gap_to_last_view(log(spark, sf_dir)).select("instance_id", *[f"diffWithLastView_{g}" for g in LAST_VIEW_GRAINS])


def tab_name(subset):
    return "click_" + "_".join(c for c in subset if c != "day") + "_tab"


def _tab_sql_cols():
    cols = []
    for subset in CLICK_TAB_SUBSETS:
        part = ", ".join(subset)
        cols.append(
            f"CAST(CASE WHEN count(*) OVER (PARTITION BY {part}) = 1 THEN 0 "
            f"WHEN row_number() OVER (PARTITION BY {part} ORDER BY user_id, context_timestamp, instance_id) = 1 THEN 2 "
            f"WHEN row_number() OVER (PARTITION BY {part} ORDER BY user_id DESC, context_timestamp DESC, instance_id DESC) = 1 THEN 3 "
            f"ELSE 1 END AS INTEGER) AS {tab_name(subset)}"
        )
    return cols


def _first_last_sql_cols():
    cols = []
    for p, keys in FIRST_LAST_GROUPS.items():
        part = ", ".join(keys)
        w = (f"PARTITION BY {part} ORDER BY user_id, context_timestamp, instance_id "
             "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
        single = f"count(*) OVER (PARTITION BY {part}) = 1"
        cols.append(f"CAST(CASE WHEN {single} THEN -1 ELSE context_timestamp - first_value(context_timestamp) OVER ({w}) END AS BIGINT) AS {p}_day_diffTime_first")
        cols.append(f"CAST(CASE WHEN {single} THEN -1 ELSE last_value(context_timestamp) OVER ({w}) - context_timestamp END AS BIGINT) AS {p}_day_diffTime_last")
    return cols


@register("click_position_tab", with_clicklog("SELECT instance_id, " + ", ".join(_tab_sql_cols()) + " FROM clicklog"))
def q_tab(spark, sf_dir):
    return seq.click_position_tab(log(spark, sf_dir)).select("instance_id", *[tab_name(s) for s in CLICK_TAB_SUBSETS])


FIRST_LAST_COLS = [f"{p}_day_diffTime_{s}" for p in FIRST_LAST_GROUPS for s in ("first", "last")]


@register("first_last_gap", with_clicklog("SELECT instance_id, " + ", ".join(_first_last_sql_cols()) + " FROM clicklog"))
def q_first_last(spark, sf_dir):
    return seq.first_last_gap(log(spark, sf_dir)).select("instance_id", *FIRST_LAST_COLS)
