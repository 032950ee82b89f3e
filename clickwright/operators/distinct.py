"""Exact distinct counts as mergeable bitmaps.

The set of a group's values is kept as words of 64 bits: ``word`` is the value's code without its last six bits, ``bits`` has a one for each value in
that range.  Words are built by a map-side ``bit_or``, so a hot group costs its distinct words per task, and nothing is expanded per counted column.  Two
sets merge by ``bit_or`` of equal words.  So the words of a day are written once, and counts over more days (or coarser grains) come from
words alone, without rereading rows.

Integers are their own codes.  Other types get dense codes by value order from a distributed rank, in a table that is joined.  Null counts as one more
value where asked for; it is the word ``NULL_WORD``, which no 64-bit code has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from clickwright.operators.joins import all_not_null
from clickwright.plans.ordered import global_rank

NULL_WORD = -(1 << 62)


def dense_codes(df: DataFrame, col: str) -> DataFrame:
    """(col, code): 0-based codes of the distinct values in value order, ranked without a global window."""
    ranked = global_rank(df.where(F.col(col).isNotNull()).select(col).distinct(), [F.col(col).asc()], "__rank")
    return ranked.select(col, (F.col("__rank") - 1).alias("code"))


def distinct_words(df: DataFrame, keys: Sequence[str], col: str, null_counts: bool = True, codes: DataFrame | None = None) -> DataFrame:
    """(keys, word, bits) of the distinct values of ``col`` per key; keys with a null part form no group."""
    held = df.where(all_not_null(keys))
    if codes is not None or not isinstance(df.schema[col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        codes = (codes if codes is not None else dense_codes(df, col)).select(F.col(col).alias("__value"), "code")
        held = held.select(*keys, col).join(codes, F.col(col) == F.col("__value"), "left").drop("__value")
    else:
        held = held.select(*keys, col, F.col(col).cast("bigint").alias("code"))
    word = F.when(F.col(col).isNull(), NULL_WORD).otherwise(F.shiftright("code", 6))
    bit = F.when(F.col(col).isNull(), 1).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("code", F.lit(64)).cast("int")))
    if not null_counts:
        held = held.where(F.col(col).isNotNull())
    return held.select(*keys, word.alias("word"), bit.alias("bit")).groupBy(*keys, "word").agg(F.bit_or("bit").alias("bits"))


def merge_words(words: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The union of sets, over the given keys (fewer than the words have: a coarser grain)."""
    out = words[0].select(*keys, "word", "bits")
    for more in words[1:]:
        out = out.unionByName(more.select(*keys, "word", "bits"))
    return out.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def count_words(words: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name): the number of distinct values per key."""
    return words.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias(name))


def distinct_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str], names: Sequence[str], null_counts: bool = True, source=None) -> DataFrame:
    """(keys, names): exact distinct counts of several columns per key, a bitmap aggregation each; ``source()`` gives fresh relations of ``df``."""
    out = None
    for col, name in zip(cols, names):
        part = count_words(distinct_words(source() if source else df, keys, col, null_counts), keys, name)
        out = part if out is None else out.join(part, list(keys), "full" if not null_counts else "inner")
    return out
