"""Preprocessing composites: time parts, token codes, property flags, label codes.

Value tables (distinct tokens / values with their counts) are ranked with
``plans.ordered.global_rank`` -- a range-partitioned, distributed row number
and running sum -- never with a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwright.functions import (
    bin_right_closed, day_of_month, hour_of_day, miss_count, minute_of_hour, modulo_plus_one, nth_token,
    predicted_categories, predicted_properties, tokens_to_int,
)
from clickwright.operators.joins import attach
from clickwright.plans.ordered import global_rank, materialize
from clickwright.schema import CATEGORY_FRAC, COL_NEED_ENCODE, PROPERTY_FRAC, PROPERTY_MAX_KEPT, PROPERTY_MIN_COUNT


def time_parts(df: DataFrame, ts: str = "context_timestamp") -> DataFrame:
    """Add ``day`` (of month), ``hour``, ``minute``, ``maphour`` and ``mapmin`` from epoch seconds (UTC)."""
    df = df.withColumns({"day": day_of_month(ts), "hour": hour_of_day(ts), "minute": minute_of_hour(ts)})
    return df.withColumns({"maphour": bin_right_closed("hour"), "mapmin": modulo_plus_one("minute", 15)})


def category_frequency_code(
    df: DataFrame, column: str = "item_category_list", frac: float = CATEGORY_FRAC,
    out: str = "secondLevelCatagory_Most_Freq",
) -> DataFrame:
    """Frequency code of the second token of ``column``.

    Values are counted and sorted by (count desc, value asc); the leading ones
    whose running count stays below ``frac`` x (number of rows) are kept and
    numbered by ascending frequency (least frequent kept value = 1).  Other
    values and rows without a second token get 0.
    """
    second = nth_token(column, 1)
    counts = materialize(df.select(second.alias("__v")).groupBy("__v").agg(F.count(F.lit(1)).alias("__cnt")), "category-counts")
    n_rows = counts.agg(F.sum("__cnt")).first()[0] or 0
    vc = counts.where(F.col("__v").isNotNull())
    ranked = global_rank(vc, [F.col("__cnt").desc(), F.col("__v").asc()], "__r", sum_col="__cnt", running_sum="__cum")
    kept = ranked.where(F.col("__cum") < F.lit(n_rows * frac)).select("__v", "__cnt")
    coded = global_rank(kept, [F.col("__cnt").asc(), F.col("__v").asc()], "__code").select("__v", "__code")
    coded = materialize(coded, "category-codes")  # of known size when the join is planned: the rows move only if it is large
    out_df = attach(df.withColumn("__v", second), coded, ["__v"])
    return out_df.withColumn(out, F.coalesce(F.col("__code"), F.lit(0)).cast("int")).drop("__v", "__code")


def kept_property_tokens(
    df: DataFrame, column: str = "item_property_list", frac: float = PROPERTY_FRAC,
    min_count: int = PROPERTY_MIN_COUNT, max_kept: int = PROPERTY_MAX_KEPT,
) -> list[int]:
    """Most frequent property tokens: running count (count desc, token asc) below ``frac`` x all
    tokens; when more than ``max_kept`` qualify only the first ``min_count`` are kept.
    At most ``max_kept`` tokens reach the driver."""
    toks = df.select(F.explode(tokens_to_int(column)).alias("__t"))
    vc = toks.groupBy("__t").agg(F.count(F.lit(1)).alias("__cnt"))
    vc = materialize(vc, "property-counts")
    total = vc.agg(F.sum("__cnt")).first()[0] or 0
    tokens, running = [], 0
    # more than max_kept survivors are cut to min_count, so the first max_kept + 1 tokens decide
    for r in vc.orderBy(F.col("__cnt").desc(), F.col("__t").asc()).limit(max_kept + 1).collect():
        running += r["__cnt"]
        if running >= total * frac:
            break
        tokens.append(r["__t"])
    if len(tokens) > max_kept:
        tokens = tokens[:min_count]
    return tokens


def property_flags(df: DataFrame, column: str = "item_property_list", tokens: Sequence[int] | None = None, **kw) -> DataFrame:
    """One boolean column ``preperty_{token}`` per kept token: does the row's list contain it."""
    tokens = kept_property_tokens(df, column, **kw) if tokens is None else list(tokens)
    arr = tokens_to_int(column)
    return df.withColumns({f"preperty_{t}": F.array_contains(arr, F.lit(t)) for t in tokens})


def property_flags_long(df: DataFrame, column: str = "item_property_list", tokens: Sequence[int] | None = None, **kw) -> DataFrame:
    """Long form of ``property_flags``: one ``(instance_id, property_token)`` row per true flag."""
    tokens = kept_property_tokens(df, column, **kw) if tokens is None else list(tokens)
    spark = df.sparkSession
    kept = spark.createDataFrame([(int(t),) for t in tokens], "property_token bigint")
    rows = df.select("instance_id", F.explode(F.array_distinct(tokens_to_int(column))).alias("property_token"))
    # the kept list has at most PROPERTY_MAX_KEPT rows: a proven broadcast bound
    return rows.join(F.broadcast(kept), "property_token", "left_semi")


def predicted_category_match(
    df: DataFrame, categories: str = "item_category_list", properties: str = "item_property_list",
    predicted: str = "predict_category_property",
) -> DataFrame:
    """``hitCategory`` / ``hitProperty``: how many of the item's categories / properties were
    *not* predicted (set difference size); -1 when an input is missing."""
    return df.withColumns(
        {
            "hitCategory": miss_count(tokens_to_int(categories), predicted_categories(predicted)).cast("int"),
            "hitProperty": miss_count(tokens_to_int(properties), predicted_properties(predicted)).cast("int"),
        }
    )


def label_encode(df: DataFrame, columns: Sequence[str] = COL_NEED_ENCODE) -> DataFrame:
    """Replace each value by its 0-based position among the sorted distinct values (numeric
    order for numbers); null gets the next code after all values.  Columns not present are skipped.

    All columns of one type are ranked together: their (column, value) pairs are
    stacked, de-duplicated and sorted once by a distributed global rank; a
    column's codes are its ranks minus the column's first rank.
    """
    cols = [c for c in columns if c in df.columns]
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for dtype, group in by_type.items():
        stacked = None
        for c in group:
            part = df.select(F.lit(c).alias("__c"), F.col(c).alias("__v")).where(F.col("__v").isNotNull())
            stacked = part if stacked is None else stacked.unionByName(part)
        ranked = global_rank(stacked.distinct(), [F.col("__c").asc(), F.col("__v").asc()], "__r")
        ranked = materialize(ranked, "label-codes", partition_by="__c")  # each column then reads its own codes only
        bounds = {r["__c"]: (r["lo"], r["n"]) for r in ranked.groupBy("__c").agg(F.min("__r").alias("lo"), F.count(F.lit(1)).alias("n")).collect()}
        for c in group:
            lo, n = bounds.get(c, (1, 0))
            mapping = ranked.where(F.col("__c") == F.lit(c)).select(F.col("__v").alias(c), (F.col("__r") - F.lit(lo)).alias("__code"))
            df = attach(df, mapping, [c])
            df = df.withColumn(c, F.when(F.col(c).isNull(), F.lit(n)).otherwise(F.col("__code")).cast("bigint")).drop("__code")
    return df


#: columns that the row expressions of ``preprocess`` read
ROW_INPUTS = ("context_timestamp", "item_category_list", "item_property_list", "predict_category_property")


def preprocess(df: DataFrame, encode: Sequence[str] = COL_NEED_ENCODE, property_tokens: Sequence[int] | None = None) -> DataFrame:
    """Time parts -> category code -> property flags -> predicted match -> label codes.

    The code columns come from joins, all others are row expressions: those are added after the joins, so that rows are moved without them.
    """

    def rows_only(rows: DataFrame) -> DataFrame:
        return predicted_category_match(property_flags(rows, tokens=tokens))

    tokens = kept_property_tokens(df) if property_tokens is None else list(property_tokens)
    made = time_parts(df.limit(0))
    added = [c for c in rows_only(made).columns if c not in df.columns]
    if set(encode) & {*ROW_INPUTS, "day", "hour", "minute", *added, "secondLevelCatagory_Most_Freq"}:
        return label_encode(rows_only(category_frequency_code(time_parts(df))), encode)
    out = rows_only(time_parts(label_encode(category_frequency_code(df), encode)))
    encoded = [c for c in out.columns if c in set(encode)]
    rest = [c for c in [*made.columns, "secondLevelCatagory_Most_Freq", *added] if c not in encoded]
    return out.select(*dict.fromkeys([*encoded, *rest]))
