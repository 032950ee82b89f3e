"""User-defined functions: Arrow-batched pandas UDFs and batch maps.

Built-in expressions remain the default everywhere in the feature path;
these are the general forms for logic that has no built-in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.IntegerType())
def utc_day_udf(ts: pd.Series) -> pd.Series:
    """Day of month (UTC) of epoch seconds given as text or numbers."""
    secs = pd.to_numeric(ts, errors="coerce")
    return pd.to_datetime(secs, unit="s", utc=True).dt.day.astype("Int32")


@F.pandas_udf(T.IntegerType())
def utc_hour_udf(ts: pd.Series) -> pd.Series:
    secs = pd.to_numeric(ts, errors="coerce")
    return pd.to_datetime(secs, unit="s", utc=True).dt.hour.astype("Int32")


@F.pandas_udf(T.IntegerType())
def add_columns_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Multi-column UDF: element-wise sum of two integer columns."""
    return (a + b).astype("Int32")


@F.pandas_udf(T.StringType())
def trade_outcome_udf(is_trade: pd.Series) -> pd.Series:
    """0 -> "success", anything else -> "failure" (the registered SQL function)."""
    return pd.Series(np.where(is_trade == 0, "success", "failure"))


def register_sql_udfs(spark: SparkSession) -> None:
    spark.udf.register("userfunction", trade_outcome_udf)


def row_map(df: DataFrame, col: str) -> DataFrame:
    """(value, 1) pairs per row -- a projection, no Python."""
    return df.select(F.col(col).alias("key"), F.lit(1).alias("one"))


def time_parts_batches(df: DataFrame, ts: str = "context_timestamp", id_col: str = "instance_id") -> DataFrame:
    """Row-wise apply in its general form: ``mapInPandas`` over Arrow batches.  A null time gives null parts."""

    def fn(batches):
        for pdf in batches:
            t = pd.to_datetime(pdf[ts].astype("Int64"), unit="s", utc=True)
            yield pd.DataFrame({id_col: pdf[id_col].astype("Int64"), **{p: getattr(t.dt, p).astype("Int32") for p in ("day", "hour", "minute")}})

    schema = f"{id_col} bigint, day int, hour int, minute int"
    return df.select(id_col, ts).mapInPandas(fn, schema)
