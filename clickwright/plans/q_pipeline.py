"""Queries for the composed pipelines (§2.15)."""

from __future__ import annotations

from clickwright.plans.catalog import ORACLE, log, register, with_clicklog
from clickwright.plans.pipeline import build_features, feature_columns
from clickwright.sources.clicklog import CLICKLOG_COLUMNS

FAMILY_SQL = {
    "expose": ["expose_ratio"],
    "aggregate_level": ["aggregate_level"],
    "active": ["active_per_grain"],
    "relative": ["relative_ratio"],
    "positions": ["click_position_tab", "first_last_gap"],
    "ordered": ["last_time_gap", "next_time_gap", "rolling_neighbor_counts"],
    "size": ["daily_shop_item_count", "daily_user_clicks", "minute_bucket_clicks"],
    "last_view": ["gap_to_last_view"],
}


def _build_features_sql() -> str:
    ctes = [
        "base AS (SELECT *, CAST(CASE WHEN hour BETWEEN 1 AND 24 THEN (hour - 1) // 6 ELSE -1 END AS INTEGER) AS maphour, "
        "CAST(minute % 15 + 1 AS INTEGER) AS mapmin FROM clicklog)"
    ]
    joins, names = [], []
    for fam, ops in FAMILY_SQL.items():
        for op in ops:
            ctes.append(f"f_{op} AS ({ORACLE[op]})")
            joins.append(f"LEFT JOIN f_{op} USING (instance_id)")
            names.append(op)
    cols = [f"base.{c}" for c in CLICKLOG_COLUMNS + ["maphour", "mapmin"]]
    feats = [c for fam in feature_columns().values() for c in fam]
    body = f"SELECT {', '.join(cols + feats)} FROM base " + " ".join(joins)
    return with_clicklog(body, *ctes)


@register("build_features", _build_features_sql())
def q_build_features(spark, sf_dir):
    return build_features(log(spark, sf_dir), materialize_input=False)
