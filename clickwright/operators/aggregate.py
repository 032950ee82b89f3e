"""Aggregations and distinct: sizes, means, distinct counts, lists, top values, de-duplication.

All are groupBy aggregations with map-side partial aggregation; per-row
("transform") variants attach the per-key result back with ``attach``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwright.operators.joins import all_not_null, attach


def group_size(df: DataFrame, keys: Sequence[str], name: str = "size") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])


def group_agg(df: DataFrame, keys: Sequence[str], spec: Sequence[tuple[str, str]]) -> DataFrame:
    """Explicit list of (column, aggregate) pairs -> ``{agg}_{column}`` (a dict would lose repeated columns)."""
    from clickwright.operators.grouped import _agg_fn

    return df.groupBy(*keys).agg(*[_agg_fn(a, c).alias(f"{a}_{c}") for c, a in spec])


def group_distinct_with_null(df: DataFrame, keys: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """Distinct values per key where null counts as one value."""
    name = name or f"{col}_distinct"
    return df.groupBy(*keys).agg((F.count_distinct(col) + F.max(F.col(col).isNull().cast("bigint"))).alias(name))


def group_nunique(df: DataFrame, keys: Sequence[str], col: str, name: str | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per key (``approx`` uses HyperLogLog++)."""
    name = name or f"{col}_nunique"
    agg = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.groupBy(*keys).agg(agg.alias(name))


def group_sum_transform(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Group sum broadcast to each row (null keys -> null)."""
    feat = df.where(all_not_null(keys)).groupBy(*keys).agg(F.sum(col).alias(name))
    return attach(df, feat, keys)


def group_collect_list(df: DataFrame, keys: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """Per key, the multiset of values as a sorted run-length list ``[(value, count), ...]``.

    Equal values are pre-aggregated before the shuffle, so the list is bounded
    by the number of distinct values per key, not by the key's row count.  With many distinct
    values use the long form, ``df.groupBy(*keys, col).count()``.
    """
    name = name or f"{col}_list"
    pairs = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("count"))
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("value"), "count"))).alias(name))


def group_collect_set(df: DataFrame, keys: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """Per key, the sorted distinct values.  One row holds them all, so this is for value domains that are known to be
    small; ``df.select(*keys, col).distinct()`` is the long form without a bound."""
    name = name or f"{col}_set"
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(col)).alias(name))


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Frequency table, most frequent first (ties by value)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(
        F.col(name).desc(), F.col(col).asc()
    )


def top_value_per_group(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """``{a}_top_{b}``: the most frequent ``b`` of each ``a`` (ties -> smallest ``b``), attached per row.

    Counts per (a, b) are partial aggregations; the winner per ``a`` is a
    ``min`` over ``struct(-count, b)`` -- again a partial aggregation.
    """
    name = name or f"{a}_top_{b}"
    pairs = df.where(all_not_null([a, b])).groupBy(a, b).agg(F.count(F.lit(1)).alias("__c"))
    best = pairs.groupBy(a).agg(F.min(F.struct((-F.col("__c")).alias("nc"), F.col(b).alias("v")))["v"].alias(name))
    return attach(df, best, [a])


def global_max(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    return df.agg(F.max(col).alias(name or f"max_{col}"))


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.select(*cols).distinct() if cols else df.distinct()


def dedup_keep(
    df: DataFrame, subset: Sequence[str], order: Sequence[str], keep: str = "first", id_col: str = "instance_id"
) -> DataFrame:
    """Keep the first (or last) row of each ``subset`` group in ``order`` (+ id); nulls group together.

    Only order columns and ids are aggregated (a partial aggregation: one candidate per key and
    task before the shuffle); the rows follow by a semi-join on their unique ``id_col``.
    """
    packed = F.struct(*dict.fromkeys([*order, id_col]))
    agg = F.min(packed) if keep == "first" else F.max(packed)
    picked = df.groupBy(*subset).agg(agg.alias("__p")).select(F.col(f"__p.{id_col}").alias(id_col))
    return df.join(picked, id_col, "left_semi")


def duplicate_mask(
    df: DataFrame, subset: Sequence[str], order: Sequence[str], id_col: str = "instance_id"
) -> DataFrame:
    """Per row: ``is_duplicated`` (group has >1 row), ``is_first`` / ``is_last`` in ``order`` + id."""
    k = list(order) + [id_col]
    feat = df.groupBy(*subset).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(*k))[id_col].alias("__f"), F.max(F.struct(*k))[id_col].alias("__l")
    )
    out = attach(df, feat, subset, null_safe=True)
    return out.withColumns(
        {
            "is_duplicated": F.col("__n") > 1,
            "is_first": F.col(id_col) == F.col("__f"),
            "is_last": F.col(id_col) == F.col("__l"),
        }
    ).drop("__n", "__f", "__l")
