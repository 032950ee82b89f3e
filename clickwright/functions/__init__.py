"""Scalar column expressions (all JVM built-ins; no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickwright.schema import MAPHOUR_BINS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(c, dtype: T.DataType | None = None) -> Column:
    """Whole epoch seconds (floor) of a timestamp, independent of the session time zone.

    ``TIMESTAMP_NTZ`` values are wall-clock UTC times; they are decomposed into
    date and time-of-day fields, which do not depend on the session zone.
    """
    c = col(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_seconds(c)
    return (
        F.unix_date(F.to_date(c)).cast("bigint") * F.lit(86400)
        + F.hour(c).cast("bigint") * F.lit(3600)
        + F.minute(c).cast("bigint") * F.lit(60)
        + F.second(c).cast("bigint")
    )


def day_of_month(sec) -> Column:
    """Day of month (UTC) of epoch seconds."""
    return F.dayofmonth(F.date_from_unix_date(F.floor(col(sec) / F.lit(86400)).cast("int"))).cast("int")


def hour_of_day(sec) -> Column:
    return F.floor(F.pmod(col(sec), F.lit(86400)) / F.lit(3600)).cast("int")


def minute_of_hour(sec) -> Column:
    return F.floor(F.pmod(col(sec), F.lit(3600)) / F.lit(60)).cast("int")


def bin_right_closed(h, edges=MAPHOUR_BINS) -> Column:
    """Code of the right-closed bin ``(e[i], e[i+1]]`` holding ``h``; -1 outside (or null).

    With edges 0,6,12,18,24: hour 0 -> -1, 1..6 -> 0, 7..12 -> 1, 13..18 -> 2, 19..23 -> 3.
    """
    h = col(h)
    expr = F.lit(-1)
    for i in range(len(edges) - 1, 0, -1):
        expr = F.when((h > F.lit(edges[i - 1])) & (h <= F.lit(edges[i])), F.lit(i - 1)).otherwise(expr)
    return expr.cast("int")


def modulo_plus_one(m, n: int = 15) -> Column:
    return (F.pmod(col(m), F.lit(n)) + F.lit(1)).cast("int")


def floor_div(m, n: int) -> Column:
    return F.floor(col(m) / F.lit(n)).cast("int")


def round_half_even(c, digits: int) -> Column:
    return F.bround(col(c), digits)


def split_string(c, sep: str = ";") -> Column:
    return F.split(col(c), sep)


def nth_token(c, i: int, sep: str = ";") -> Column:
    """0-based token ``i``; null when the list is shorter (instead of raising)."""
    return F.get(F.split(col(c), sep), i)


def tokens_to_int(c, sep: str = ";", lenient: bool = True) -> Column:
    """Split and cast every token to bigint; with ``lenient`` unparsable tokens are dropped, else they are an error."""
    tokens = F.split(col(c), sep)
    if not lenient:
        return F.transform(tokens, lambda x: x.cast("bigint"))
    return F.filter(F.transform(tokens, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def rejected_tokens(c, sep: str = ";") -> Column:
    """Number of tokens that ``tokens_to_int`` drops."""
    return F.size(F.filter(F.split(col(c), sep), lambda x: x.try_cast("bigint").isNull()))


# Fixed patterns of the predicted-category parser: digits right before ':'
# (categories) and a word run between ':' and ';' (properties).
CATEGORY_PATTERN = r"(\d+)(?=:)"
PROPERTY_PATTERN = r"(?<=:)(\w+)(?=;)"


def regex_find_all_int(c, pattern: str) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(pattern), 1)
    return F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def predicted_categories(c) -> Column:
    return regex_find_all_int(c, CATEGORY_PATTERN)


def predicted_properties(c) -> Column:
    return regex_find_all_int(c, PROPERTY_PATTERN)


def set_size(arr) -> Column:
    return F.size(F.array_distinct(col(arr)))


def miss_count(have, predicted) -> Column:
    """|set(have) - set(predicted)|, -1 when either side is null."""
    have, predicted = col(have), col(predicted)
    return F.when(have.isNull() | predicted.isNull(), F.lit(-1)).otherwise(
        F.size(F.array_except(F.array_distinct(have), predicted))
    )


def number_to_string(c) -> Column:
    return col(c).cast("string")


def nullif_sentinel(c, sentinel=-1) -> Column:
    return F.nullif(col(c), F.lit(sentinel))


def knuth_bucket(c, buckets: int = 100) -> Column:
    """Deterministic, overflow-free multiplicative hash of a bigint id into ``buckets`` buckets."""
    h = F.pmod(F.pmod(col(c), F.lit(2147483648)) * F.lit(2654435761), F.lit(4294967296))
    return F.pmod(h, F.lit(buckets)).cast("int")


def knuth_bucket_sql(c: str, buckets: int = 100) -> str:
    return f"(((({c} % 2147483648) * 2654435761) % 4294967296) % {buckets})"
