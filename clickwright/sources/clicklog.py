"""The impression log (``clicklog``) derived from the driver tables.

One row per ``events`` row.  Dimension attributes come from left joins with
``part``, ``customer`` and ``supplier``; no side is forced to broadcast --
AQE turns a join into a broadcast only after measuring the dimension's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwright.functions import epoch_seconds, day_of_month, hour_of_day, minute_of_hour

CLICKLOG_COLUMNS = [
    "instance_id", "user_id", "item_id", "context_timestamp", "day", "hour", "minute", "is_trade",
    "shop_id", "item_city_id", "item_brand_id", "item_price_level", "item_sales_level",
    "item_collected_level", "user_age_level", "shop_star_level", "item_category_list",
    "item_property_list", "predict_category_property", "shop_score_service",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: columns that need a dimension table
NEEDS = {
    "part": {
        "item_brand_id", "item_price_level", "item_sales_level", "item_collected_level", "item_category_list", "item_property_list",
        "predict_category_property",
    },
    "customer": {"user_age_level"},
    "supplier": {"shop_star_level"},
}


def clicklog(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The log, or some of its columns; a dimension none of them needs is not read."""
    wanted = set(columns or CLICKLOG_COLUMNS)
    needed = {table for table, cols in NEEDS.items() if cols & wanted}
    events = read_table(spark, sf_dir, "events")
    ts_type = events.schema["ts"].dataType
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey"),
        F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int").alias("item_brand_id"),
        F.col("p_size"),
        F.col("p_retailprice"),
        F.length("p_name").alias("p_name_len"),
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    ev = events.select(
        F.col("event_id").alias("instance_id"),
        F.col("user_id"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("item_id"),
        epoch_seconds("ts", ts_type).alias("context_timestamp"),
        (F.col("event_type") == F.lit("purchase")).cast("int").alias("is_trade"),
        F.col("value").alias("shop_score_service"),
    ).withColumns(
        {
            "day": day_of_month("context_timestamp"),
            "hour": hour_of_day("context_timestamp"),
            "minute": minute_of_hour("context_timestamp"),
            "shop_id": F.col("item_id") % F.lit(20),
            "item_city_id": F.nullif(F.col("item_id") % F.lit(7), F.lit(0)),
        }
    )
    supplier = supplier.where(F.col("s_suppkey").between(-19, 19))  # a shop is a remainder of 20: at most 39 rows can match
    joined = ev
    for name, table, key, own in (("part", part, "item_id", "p_partkey"), ("customer", customer, "user_id", "c_custkey"),
                                  ("supplier", supplier, "shop_id", "s_suppkey")):
        if name in needed:
            joined = joined.join(table, F.col(key) == F.col(own), "left")
        else:
            joined = joined.withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields})
    out = joined.select(
        "instance_id", "user_id", "item_id", "context_timestamp", "day", "hour", "minute", "is_trade",
        "shop_id", "item_city_id", "item_brand_id",
        F.col("p_size").alias("item_price_level"),
        (F.col("p_size") % F.lit(10)).alias("item_sales_level"),
        (F.floor("p_retailprice") % F.lit(17)).alias("item_collected_level"),
        F.when(F.col("user_id") % F.lit(10) == F.lit(0), F.lit(-1))
        .otherwise(F.coalesce(F.col("c_nationkey"), F.lit(-1)))
        .cast("int")
        .alias("user_age_level"),
        F.col("s_nationkey").alias("shop_star_level"),
        F.concat_ws(";", F.lit("1"), F.col("item_brand_id").cast("string"), F.col("p_size").cast("string")).alias(
            "item_category_list"
        ),
        F.concat_ws(
            ";", (F.col("item_id") % F.lit(50)).cast("string"), F.col("p_size").cast("string"),
            F.col("p_name_len").cast("string"),
        ).alias("item_property_list"),
        F.concat(
            (F.col("user_id") % F.lit(25)).cast("string"), F.lit(":"), (F.col("item_id") % F.lit(50)).cast("string"),
            F.lit(";"), F.col("p_size").cast("string"), F.lit(":"),
            (F.col("instance_id") % F.lit(50)).cast("string"), F.lit(";"),
        ).alias("predict_category_property"),
        "shop_score_service",
    )
    return out.select(*columns) if columns else out


# The same view for the DuckDB oracle (tables are pre-registered views).
CLICKLOG_SQL = """
clicklog AS (
  WITH ev AS (
    SELECT event_id AS instance_id, user_id,
           TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
           CAST(floor(epoch(ts)) AS BIGINT) AS context_timestamp,
           CAST(dayofmonth(ts) AS INTEGER) AS day,
           CAST(hour(ts) AS INTEGER) AS hour,
           CAST(minute(ts) AS INTEGER) AS minute,
           CAST(event_type = 'purchase' AS INTEGER) AS is_trade,
           value AS shop_score_service
    FROM events
  ), p AS (
    SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS item_brand_id,
           p_size, p_retailprice, length(p_name) AS p_name_len
    FROM part
  )
  SELECT ev.instance_id, ev.user_id, ev.item_id, ev.context_timestamp, ev.day, ev.hour, ev.minute, ev.is_trade,
         ev.item_id % 20 AS shop_id,
         nullif(ev.item_id % 7, 0) AS item_city_id,
         p.item_brand_id,
         p.p_size AS item_price_level,
         p.p_size % 10 AS item_sales_level,
         CAST(floor(p.p_retailprice) AS BIGINT) % 17 AS item_collected_level,
         CAST(CASE WHEN ev.user_id % 10 = 0 THEN -1 ELSE coalesce(c.c_nationkey, -1) END AS INTEGER) AS user_age_level,
         s.s_nationkey AS shop_star_level,
         concat_ws(';', '1', CAST(p.item_brand_id AS VARCHAR), CAST(p.p_size AS VARCHAR)) AS item_category_list,
         concat_ws(';', CAST(ev.item_id % 50 AS VARCHAR), CAST(p.p_size AS VARCHAR), CAST(p.p_name_len AS VARCHAR))
           AS item_property_list,
         CAST(ev.user_id % 25 AS VARCHAR) || ':' || CAST(ev.item_id % 50 AS VARCHAR) || ';' || CAST(p.p_size AS VARCHAR)
           || ':' || CAST(ev.instance_id % 50 AS VARCHAR) || ';' AS predict_category_property,
         ev.shop_score_service
  FROM ev
  LEFT JOIN p ON ev.item_id = p.p_partkey
  LEFT JOIN customer c ON ev.user_id = c.c_custkey
  LEFT JOIN supplier s ON ev.item_id % 20 = s.s_suppkey
)
"""
