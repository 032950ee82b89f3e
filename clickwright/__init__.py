"""clickwright: click-log feature engineering and conversion modelling on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function usable with
``df.transform``.  Grouped features are computed as partial aggregations and
attached back with equi-joins (AQE decides broadcast vs. shuffle at run time
and splits skewed partitions); ordered sequence features run windows over the
de-duplicated ``(key, second)`` table, whose per-key size is bounded by the
time span of the log rather than by the number of clicks.
"""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
