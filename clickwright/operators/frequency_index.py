"""Index of a column's values by falling frequency, fitted and kept as a table.

The labels never reach the driver: they are counted by a map-side aggregate, ranked by a distributed sort and written; encoding and decoding
are joins, which Spark broadcasts only if the measured table is small and otherwise splits at skewed values.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwright.plans.ordered import global_rank, materialize


class FrequencyIndexModel(Transformer):
    """Adds the index of ``col`` as a double ``out``: 0 for the most frequent value (ties by text); null and unseen values get ``size``."""

    def __init__(self, labels: DataFrame, col: str, out: str) -> None:
        super().__init__()
        #: label (text), idx
        self.labels, self.col, self.out = labels, col, out
        self.size = labels.count()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = self.labels.select(F.col("label").alias("__label"), F.col("idx").alias("__idx"))
        joined = dataset.join(known, F.col(self.col).cast("string") == F.col("__label"), "left")
        attribute = {"ml_attr": {"type": "nominal", "num_vals": self.size + 1, "name": self.out}}
        index = F.coalesce("__idx", F.lit(self.size)).cast("double").alias(self.out, metadata=attribute)
        return joined.select(*[F.col(f"`{c}`") for c in dataset.columns if c != self.out], index)

    def decode(self, dataset: DataFrame, index_col: str, out: str) -> DataFrame:
        """The text of each index; null for ``size`` and over."""
        known = self.labels.select(F.col("label").alias(out), F.col("idx").alias("__idx"))
        return dataset.join(known, F.col(index_col).cast("bigint") == F.col("__idx"), "left").drop("__idx")

    def write(self, path: str) -> None:  # noqa: D102
        self.labels.write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, col: str, out: str) -> FrequencyIndexModel:
        return cls(spark.read.parquet(path), col, out)


class FrequencyIndex(Estimator):
    """Fits a ``FrequencyIndexModel``."""

    def __init__(self, col: str, out: str | None = None) -> None:
        super().__init__()
        self.col, self.out = col, out or f"{col}Idx"

    def _fit(self, dataset: DataFrame) -> FrequencyIndexModel:
        label = F.col(self.col).cast("string").alias("label")
        counts = dataset.select(label).where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        ranked = global_rank(counts, [F.col("n").desc(), F.col("label").asc()], "__rank")
        labels = materialize(ranked.select("label", (F.col("__rank") - 1).alias("idx")), "frequency-index")
        return FrequencyIndexModel(labels, self.col, self.out)
