"""Exact quantiles per key by distributed selection.

``F.median`` keeps all distinct values of a key in one task.  Here values are counted per (key, value) with a map-side aggregate, and the counts are summed
by the leading bits of the value's order-preserving 64-bit key.  A window over these ranges (at most 2^24, 2^20 and 2^20 per key) says which range has the wanted
rank; only its counts go on to the next 20 bits.  So no task needs to hold a key's values, and a hot key's counts are spread over tasks by value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from clickwright.plans.ordered import materialize

SHIFTS = (40, 20, 0)


def order_key(df: DataFrame, col: str) -> Column:
    """Order-preserving 64-bit keys; NaN is the largest, as in Spark's order."""
    if isinstance(df.schema[col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return F.col(col).cast("bigint")

    @F.pandas_udf(LongType())
    def bits_of(values: pd.Series) -> pd.Series:
        bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)
        return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF)))

    return bits_of(F.col(col).cast("double"))


def exact_quantile(df: DataFrame, keys: Sequence[str], col: str, q: float = 0.5, name: str | None = None) -> DataFrame:
    """(keys, name): the ``q`` quantile of the non-null values per key, interpolated between the two neighbouring values (0.5: the median).

    Null keys form a group of their own; a key without values has no row.
    """
    name = name or f"median_{col}"
    held = df.where(F.col(col).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(col).alias("value"))
    ks = [f"k{i}" for i in range(len(keys))]
    counts = held.withColumn("key", order_key(held, "value")).groupBy(*ks, "key").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    counts = materialize(counts, "selection-counts")
    same = lambda a, b: [a[k].eqNullSafe(b[f"{k}_"]) for k in ks]
    renamed = lambda d: d.select(*[F.col(k).alias(f"{k}_") if k in ks else F.col(k) for k in d.columns])

    total = counts.groupBy(*ks).agg(F.sum("n").alias("rows"))
    place = (F.col("rows") - 1) * F.lit(float(q))
    low = F.floor(place)
    # the two wanted ranks of each key (0-based), as rows; the second has the weight of the fraction
    targets = total.select(*ks, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), low.alias("rank"), (1 - (place - low)).alias("weight")),
        F.struct(F.lit(1).alias("side"), F.least(low + 1, F.col("rows") - 1).alias("rank"), (place - low).alias("weight")),
    )).alias("t")).select(*ks, "t.*")
    left, wanted = counts, materialize(targets, "selection-targets")
    for level, shift in enumerate(SHIFTS):
        if level:
            # the counts of the ranges that were picked, once per target
            range_ = F.shiftright("key", SHIFTS[level - 1])
            t = renamed(wanted)
            left = counts.join(t, [*same(counts, t), range_ == t["prefix"]]).select(*ks, "side", "rank", "weight", "key", "n", "value")
            per = left.groupBy(*ks, "side", F.shiftright("key", shift).alias("prefix"))
        else:
            per = left.groupBy(*ks, F.shiftright("key", shift).alias("prefix"))
        ranges = per.agg(F.sum("n").alias("n"), *([F.first("rank").alias("rank"), F.first("weight").alias("weight")] if level else []),
                         *([F.first("value").alias("value")] if shift == 0 else []))
        by = Window.partitionBy(*ks, *(["side"] if level else [])).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
        if not level:
            t = renamed(wanted)
            ranges = ranges.join(t, same(ranges, t)).select(*ks, "side", "rank", "weight", "prefix", "n", "before")
        hit = ranges.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        wanted = hit.select(*ks, "side", (F.col("rank") - F.col("before")).alias("rank"), "weight", "prefix", *(["value"] if shift == 0 else []))
        wanted = materialize(wanted, "selection-ranges")
    low_value, high_value = (F.max(F.when(F.col("side") == s, F.col("value").cast("double"))) for s in (0, 1))
    share = F.max(F.when(F.col("side") == 1, F.col("weight")))
    value = F.when(share == 0, low_value).otherwise(low_value + (high_value - low_value) * share)
    return wanted.groupBy(*ks).agg(value.alias(name)).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], name)
