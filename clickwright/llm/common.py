"""What the operators share: the input table, written intermediates and let-bindings in SQL expressions."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwright.session import scratch_path

#: white space of the contracts: space and U+0009 to U+000D
WHITE = " \t\n\x0b\x0c\r"
_SHIPPED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application (Spark's file server sends the archive)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = f"{tempfile.mkdtemp(prefix='clickwright-')}/{package.name}"
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        _SHIPPED.add(app)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def sheltered(docs: DataFrame, *needed: str | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the needed columns and all others in one struct, so that no name among them can clash with a column
    made on the way; and the function that brings the columns of ``docs`` back."""
    used = [c for c in docs.columns if c in needed]
    others = [docs[f"`{c}`"] for c in docs.columns if c not in needed] or [F.lit(None).cast("int").alias("none")]
    packed = docs.select(*used, F.struct(*others).alias("_sheltered"))
    return packed, lambda df: df.select(*[df[c] if c in needed else df["_sheltered"].getField(c).alias(c) for c in docs.columns])


@contextmanager
def _released_shuffles(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as each write has ended."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, not a recomputation), fixes
    non-deterministic ids and gives Spark the real size of the table for its join choice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _released_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shrink_driver(spark: SparkSession) -> None:
    """A collection in the driver: its heap is given back only so, and what a query leaves there (plans, broadcast tables, events) would otherwise
    stay until the heap is full.  For steps of many queries; some tenths of a second each."""
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: SQL has no let, a one-element transform is one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
