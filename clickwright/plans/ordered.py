"""Global positions, ranks and running sums without a single-partition window.

An ``orderBy`` range-partitions the rows, so every task holds one contiguous
slice of the total order.  The slices are frozen with a reliable checkpoint
(written to the cluster's checkpoint folder), which makes partition ids and
in-partition positions stable across the two passes:

1. one tiny aggregation returns, per partition, its row count and value sum
   (at most ``numPartitions`` rows reach the driver);
2. every row gets ``offset[partition] + position in partition`` -- and, for a
   running sum, ``sum_offset[partition] + in-partition running sum`` computed
   by a window keyed on the partition id (each window group is one slice).

Hot keys do not matter: the range partitioner splits on the full (unique)
sort key, so no task ever holds more than one balanced slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwright.session import checkpoint_dir, released_shuffles


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (cuts lineage, survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _offset_expr(values: dict[int, int], key: Column) -> Column:
    """The partition's offset, by index into an array literal."""
    if not values:
        return F.lit(0).cast("bigint")
    offsets = [int(values.get(k, 0)) for k in range(max(values) + 1)]
    return F.coalesce(F.get(F.lit(offsets).cast("array<bigint>"), key), F.lit(0).cast("bigint"))


def with_position(
    df: DataFrame,
    position: str = "_pos",
    *,
    sum_col: str | None = None,
    running_sum: str | None = None,
    frozen: bool = False,
) -> DataFrame:
    """Add the 0-based position of every row in the DataFrame's partition order.

    With ``sum_col``/``running_sum`` also add the inclusive running sum of
    ``sum_col`` in that order.
    """
    ck = df if frozen else freeze(df)
    ck = ck.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    aggs = [F.count(F.lit(1)).alias("n")]
    if sum_col:
        aggs.append(F.sum(sum_col).alias("s"))
    stats = sorted(ck.groupBy("_pid").agg(*aggs).collect(), key=lambda r: r["_pid"])
    n_off, s_off, n_acc, s_acc = {}, {}, 0, 0
    for r in stats:
        n_off[r["_pid"]] = n_acc
        n_acc += r["n"]
        if sum_col:
            s_off[r["_pid"]] = s_acc
            s_acc += r["s"] or 0
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    out = ck.withColumn(position, _offset_expr(n_off, F.col("_pid")) + local)
    if sum_col:
        w = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(running_sum, _offset_expr(s_off, F.col("_pid")) + F.sum(sum_col).over(w))
    return out.drop("_pid", "_mid")


def global_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    rank: str = "_rank",
    *,
    sum_col: str | None = None,
    running_sum: str | None = None,
) -> DataFrame:
    """1-based row number in ``order`` (which must be a total order) and optional running sum."""
    out = with_position(df.orderBy(*order), "_pos0", sum_col=sum_col, running_sum=running_sum)
    return out.withColumn(rank, F.col("_pos0") + F.lit(1)).drop("_pos0")


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Unlike an RDD checkpoint, later readers get column pruning and filter
    pushdown on the written table.
    """
    from clickwright.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    with released_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out._clickwright_path = path
    return out


def fresh_source(df: DataFrame, transform=None):
    """A callable returning the same data as a *new* relation (fresh attribute ids).

    Feature tables built from a fresh read join back onto rows derived from
    ``df`` without self-join attribute de-duplication, which otherwise makes
    plan analysis grow quadratically with the number of joined features.
    Falls back to ``df`` itself when it is not a materialised table.
    """
    path = getattr(df, "_clickwright_path", None)
    schema = df.schema

    def make():
        base = df.sparkSession.read.schema(schema).parquet(path) if path else df
        return transform(base) if transform else base

    return make
