"""Missing values: sentinels, missing ratios, sparse-column dropping, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwright.operators.columns import numeric_columns
from clickwright.schema import SPARSE_COLUMN_RATIO


def sentinel_to_null(df: DataFrame, cols: Sequence[str] | None = None, sentinel=-1) -> DataFrame:
    """Replace the ``-1`` sentinel with null (not NaN, so aggregates skip it)."""
    cols = list(cols) if cols is not None else numeric_columns(df, include_bool=False)
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def missing_ratio(df: DataFrame, sentinel=-1) -> DataFrame:
    """Long table (column, missing_ratio): share of null (or sentinel) values per column, one pass."""
    numeric = set(numeric_columns(df, include_bool=False))
    aggs = []
    for c in df.columns:
        miss = F.col(c).isNull()
        if c in numeric:
            miss = miss | (F.col(c) == F.lit(sentinel))
        aggs.append(F.avg(miss.cast("double")).alias(c))
    wide = df.agg(*aggs)
    return wide.unpivot([], df.columns, "column", "missing_ratio")


def sparse_columns(df: DataFrame, threshold: float = SPARSE_COLUMN_RATIO, sentinel=-1) -> list[str]:
    """Columns whose missing ratio is strictly above ``threshold`` (one action, one row per column)."""
    return [r["column"] for r in missing_ratio(df, sentinel).collect() if r["missing_ratio"] is not None and r["missing_ratio"] > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = SPARSE_COLUMN_RATIO, sentinel=-1) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold, sentinel))


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None, sentinel=-1.0) -> DataFrame:
    """Floating columns: sentinel/null -> column mean (means from one aggregation row)."""
    cols = list(cols) if cols is not None else numeric_columns(df, only_double=True)
    if not cols:
        return df
    means = df.agg(*[F.avg(F.nullif(F.col(c), F.lit(sentinel))).alias(c) for c in cols]).first()
    return df.withColumns(
        {c: F.coalesce(F.nullif(F.col(c), F.lit(sentinel)), F.lit(means[c]).cast("double")) for c in cols}
    )


def impute_column_inplace(df: DataFrame, col: str, strategy: str = "mean") -> DataFrame:
    """Spark ML ``Imputer`` with the same input and output column (cast to double first)."""
    from pyspark.ml.feature import Imputer

    d = df.withColumn(col, F.col(col).cast("double"))
    model = Imputer(inputCols=[col], outputCols=[col], strategy=strategy).fit(d)
    return model.transform(d)


def fill_constant(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(cols) if cols else None)
