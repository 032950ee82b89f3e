"""Ordered lists of a key's values as numbered chunks of bounded size.

One string per key would grow with the key.  Here every chunk holds at most ``size`` values in order: as text, joined by ``;``, and delta-coded
(the first value, then the differences).  Positions come from a distributed rank, so a hot key's list is built by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwright.operators.joins import all_not_null
from clickwright.plans.ordered import global_rank


def group_string_join(df: DataFrame, keys: Sequence[str], value: str, id_col: str = "instance_id", size: int = 1024, out: str = "joined") -> DataFrame:
    """(keys, chunk, n, out, deltas): the integer values of each key by (value, id), ``size`` to a chunk.  Null keys and values are left out."""
    held = df.where(all_not_null([*keys, value])).select(*keys, value, id_col)
    ranked = global_rank(held, [*[F.col(k).asc() for k in keys], F.col(value).asc(), F.col(id_col).asc()], "__rank")
    first = ranked.groupBy(*keys).agg(F.min("__rank").alias("__first"))
    placed = ranked.join(first, list(keys)).withColumn("__at", F.col("__rank") - F.col("__first"))
    chunks = placed.groupBy(*keys, F.floor(F.col("__at") / F.lit(size)).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("__at", F.col(value).cast("bigint").alias("v")))).alias("__held")
    )
    values = F.col("__held.v")
    steps = F.transform(values, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(values, i - 1)))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ";")
    return chunks.select(*keys, "chunk", F.size("__held").cast("bigint").alias("n"), text(values).alias(out), text(steps).alias("deltas"))


def read_string_join(chunks: DataFrame, keys: Sequence[str], value: str, size: int = 1024, deltas: str = "deltas") -> DataFrame:
    """(keys, position, value): the values of delta-coded chunks, one row each, with their 0-based place in the key's list."""
    steps = F.transform(F.split(deltas, ";"), lambda s: s.cast("bigint"))
    rows = chunks.select(*keys, "chunk", F.posexplode(steps).alias("__i", "__step"))
    upto = Window.partitionBy(*keys, "chunk").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a chunk at most
    return rows.select(*keys, (F.col("chunk") * size + F.col("__i")).alias("position"), F.sum("__step").over(upto).alias(value))
