"""File sources and sinks: text logs, CSV, headerless label files, Parquet datasets."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickwright.plans.ordered import with_position
from clickwright.schema import LOG_SCHEMA, ColumnRoles
from clickwright.session import released_shuffles


def _typed(df: DataFrame, schema: T.StructType, lenient: bool, rejects: str | None = None) -> DataFrame:
    """Cast string columns read from text to the schema's types, by name.

    ``lenient``: a bad cell becomes null instead of an error; ``rejects`` names a column with the number of a row's bad cells.
    """
    types = {f.name: f.dataType for f in schema.fields if f.name in df.columns}
    cast = {c: F.col(c).try_cast(t) if lenient else F.col(c).cast(t) for c, t in types.items()}
    bad = [(F.col(c).isNotNull() & cast[c].isNull()).cast("int") for c in types]
    count = [reduce(lambda a, b: a + b, bad, F.lit(0)).alias(rejects)] if rejects else []
    return df.select(*[cast[c].alias(c) if c in cast else F.col(c) for c in df.columns], *count)


def read_log(
    spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA, sep: str = " ", lenient: bool = True, rejects: str | None = None
) -> DataFrame:
    """Headered, delimited text log -> typed table (columns matched by header name)."""
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return _typed(raw, schema, lenient, rejects)


def read_log_limited(df: DataFrame, n: int, order_by: str = "instance_id") -> DataFrame:
    """First ``n`` rows in a deterministic order (the ``nrows`` option)."""
    return df.orderBy(order_by).limit(n)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = True, rejects: str | None = None) -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return _typed(raw, schema, lenient, rejects)


def read_labels_headerless(spark: SparkSession, path: str, name: str = "is_trade") -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField(name, T.IntegerType())])).csv(path)


def write_log(df: DataFrame, path: str, sep: str = " ") -> str:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


export_csv = write_csv


def write_labels_headerless(df: DataFrame, path: str, name: str = "is_trade") -> str:
    df.select(name).write.mode("overwrite").option("header", False).csv(path)
    return path


def concat_columns_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Glue two tables side by side, row by row (``pd.concat(axis=1)``).

    Positions follow each DataFrame's partition order, so both inputs should be
    ordered explicitly (``orderBy``).  Unequal lengths pad with nulls (full
    outer join on the position).  The result has no order of its own.  Prefer a real key whenever one exists.
    """
    lp = with_position(left, "_pos")
    rp = with_position(right, "_pos")
    return lp.join(rp, "_pos", "full_outer").drop("_pos")


def save_dataset(df: DataFrame, folder: str, roles: ColumnRoles | None = None, partition_by: str | None = None) -> str:
    """Persist the prepared table (Parquet) and its column roles (one-row JSON side table)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with released_shuffles(df.sparkSession):
        writer.parquet(f"{folder}/data")
    roles = roles or ColumnRoles()
    df.sparkSession.createDataFrame([(json.dumps(roles.to_dict()),)], "roles string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{folder}/roles")
    return folder


def load_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, ColumnRoles]:
    data = spark.read.parquet(f"{folder}/data")
    row = spark.read.text(f"{folder}/roles").first()
    roles = ColumnRoles.from_dict(json.loads(row[0])) if row else ColumnRoles()
    return data, roles


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row table (``count(*)`` with partial counts per task)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))
