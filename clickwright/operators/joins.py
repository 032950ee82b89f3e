"""Joins: attaching per-key features back onto rows, expression joins, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType


def all_not_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def null_safe_keys(keys: Sequence[str], types: Mapping[str, DataType]) -> dict[str, Column]:
    """Columns without nulls that are equal just where ``keys`` are equal or both null.

    Grouping by them and joining on them takes one shuffle of the groups; a ``<=>`` join would shuffle them again.
    """
    out = {}
    for k in keys:
        default = F.lit("") if isinstance(types[k], StringType) else F.lit(0)
        out[f"__v_{k}"] = F.coalesce(F.col(k), default.cast(types[k]))
        out[f"__z_{k}"] = F.col(k).isNull()
    return out


def attach(df: DataFrame, features: DataFrame, keys: Sequence[str], *, null_safe: bool = False,
           drop_right_keys: bool = True) -> DataFrame:
    """Left equi-join of a per-key feature table (unique on ``keys``) onto the rows.

    No broadcast is forced: AQE measures the materialised feature table and
    switches to a broadcast join only under its threshold; otherwise the
    sort-merge join's skewed partitions (hot keys) are split by AQE.
    With ``null_safe`` a null key matches a null key (pandas ``merge``/``duplicated``).
    """
    keys = list(keys)
    if not null_safe:
        return df.join(features, on=keys, how="left")
    renamed = features.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = df.join(renamed, cond, "left")
    return joined.drop(*[f"__r_{k}" for k in keys]) if drop_right_keys else joined


def left_join_features(df: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach(df, features, keys)


def left_join_on_expr(left: DataFrame, right: DataFrame, key: str, right_key_alias: str | None = None) -> DataFrame:
    """``left.join(right, left.k == right.k, "left")`` keeping both key columns.

    The right copy of the key is renamed (``right_key_alias``) so the result
    has unique column names.
    """
    alias = right_key_alias or f"{key}_right"
    r = right.withColumnRenamed(key, alias)
    return left.join(r, F.col(key) == F.col(alias), "left")


def lookup_map(df: DataFrame, column: str, mapping, out: str) -> DataFrame:
    """Map values through a dictionary; values missing from it become null.

    A Python dict becomes a map literal evaluated inside the projection (no
    join at all); a DataFrame mapping ``(column, out)`` is left-joined.
    """
    if isinstance(mapping, Mapping):
        pairs = []
        for k, v in mapping.items():
            pairs += [F.lit(k), F.lit(v)]
        m = F.create_map(*pairs)
        return df.withColumn(out, F.try_element_at(m, F.col(column)))
    return attach(df, mapping.select(column, out), [column])
