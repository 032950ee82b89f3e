"""Projections, filters and column management."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickwright.schema import BEST_VARIABLE, COLS_THAT_USELESS, COLS_WITH_CATEGORY_TYPE


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def derive_column(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Add or overwrite several columns in one projection."""
    return df.withColumns(dict(exprs))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def cast_column(df: DataFrame, col: str, to: str = "double", out: str | None = None) -> DataFrame:
    """Cast with ``try_cast`` (dirty text becomes null instead of failing under ANSI)."""
    return df.withColumn(out or col, F.col(col).try_cast(to))


def filter_by_day(df: DataFrame, op: str, day: int, col: str = "day") -> DataFrame:
    ops = {"<": F.col(col) < day, "<=": F.col(col) <= day, "==": F.col(col) == day, "!=": F.col(col) != day,
           ">": F.col(col) > day, ">=": F.col(col) >= day}
    return df.where(ops[op])


def numeric_columns(df: DataFrame, include_bool: bool = True, only_double: bool = False) -> list[str]:
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if only_double:
            if isinstance(t, (T.DoubleType, T.FloatType)):
                out.append(f.name)
        elif isinstance(t, T.NumericType) or (include_bool and isinstance(t, T.BooleanType)):
            out.append(f.name)
    return out


def select_by_dtype(df: DataFrame, only_double: bool = False) -> DataFrame:
    """Keep int/float/bool columns (or only floating ones)."""
    return df.select(*numeric_columns(df, only_double=only_double))


def drop_useless_columns(df: DataFrame, extra: Sequence[str] = (), useless: Sequence[str] = COLS_THAT_USELESS) -> tuple[DataFrame, list[str]]:
    """Drop the configured useless columns, ``extra`` and every non-numeric column.

    Returns the table and the dropped names."""
    keep_types = set(numeric_columns(df))
    dropped = [c for c in df.columns if c in set(useless) | set(extra) or c not in keep_types]
    return df.select(*[c for c in df.columns if c not in dropped]), dropped


def concat_tagged(parts: Mapping[str, DataFrame], tag: str = "split") -> DataFrame:
    """Rows of all tables, one after the other, with the table's name in ``tag``; columns that one lacks are null."""
    out = None
    for name, df in parts.items():
        own = df.withColumn(tag, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def select_best_columns(df: DataFrame, best: Sequence[str] = BEST_VARIABLE, category: Sequence[str] = COLS_WITH_CATEGORY_TYPE) -> DataFrame:
    """Curated list followed by the category columns: ordered, de-duplicated, present ones only."""
    wanted = list(dict.fromkeys(list(best) + list(category)))
    return df.select(*[c for c in wanted if c in df.columns])


def intersect_feature_list(df: DataFrame, wanted: Sequence[str], exclude: Sequence[str] = ("day", "is_trade")) -> list[str]:
    """Feature columns of ``df`` that are in ``wanted``, in table order, minus ``exclude``."""
    w = set(wanted)
    return [c for c in df.columns if c in w and c not in set(exclude)]


def split_off_label(df: DataFrame, label: str = "is_trade") -> tuple[DataFrame, DataFrame]:
    """(features, label) projections of the same table (kept row-aligned by a key, not by position)."""
    return df.drop(label), df.select(label)
