"""Registered queries (Spark) and their DuckDB oracle SQL, keyed by operator name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickwright.sources.clicklog import CLICKLOG_SQL, clicklog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def with_clicklog(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {CLICKLOG_SQL}{extra}\n{body}"


_LOGS: dict[tuple, DataFrame] = {}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impression log of ``sf_dir``: derived once per session and data folder, written as
    Parquet into the shared checkpoint folder, and read back (pruning + pushdown) by every query."""
    from clickwright.plans.ordered import materialize

    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _LOGS:
        _LOGS[key] = materialize(clicklog(spark, sf_dir), "clicklog")
    return _LOGS[key]


def scan(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of the log, read once from the given tables: for queries of a single pass."""
    return clicklog(spark, sf_dir, columns)


# query modules register themselves on import
from clickwright.plans import q_sequence, q_grouped, q_preprocess, q_basic, q_pipeline, q_model  # noqa: E402,F401
