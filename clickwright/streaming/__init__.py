"""Streaming ingestion of the impression log.

The source project is batch-only: it has no streaming operator, watermark or
stateful logic.  What carries over to a stream are the *row-local*
preprocessing steps (time parts, predicted-category match, sentinel
handling), which are plain projections and therefore valid on a streaming
DataFrame unchanged.  Grouped and sequence features need whole keys, so they
run as batch jobs over the accumulated table (``plans.pipeline``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clickwright.operators.preprocess import predicted_category_match, time_parts


def read_log_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """New Parquet files of the log arriving in ``folder``, as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def row_local_preprocess(df: DataFrame) -> DataFrame:
    """Stateless per-row preprocessing; the same code serves batch and streaming inputs."""
    return predicted_category_match(time_parts(df))


def append_to_table(df: DataFrame, path: str, checkpoint: str):
    """Exactly-once append of the preprocessed stream to a Parquet table (file sink + checkpoint)."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
