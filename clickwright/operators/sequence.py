"""Ordered sequence features over each key's click history.

Window semantics are evaluated on the de-duplicated ``(key, second)`` table:
rows of the same key and second are pre-aggregated (count, lowest and
highest ``instance_id``) before any shuffle, so a key's window partition
holds at most one row per distinct second -- bounded by the time span of
the log, not by the number of clicks, however hot the key.  Results are
attached back with an equi-join on ``(key, second)``.

Group-position features (first/last click, click tab) need no order at all:
``min``/``max`` of the order's columns, packed into one number, is a partial
hash aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwright.operators.joins import all_not_null, attach
from clickwright.schema import (
    CLICK_TAB_SUBSETS, FIRST_LAST_GROUPS, LAST_VIEW_GRAINS, ROLL_SECONDS, ROLLING_KEYS,
)

TS = "context_timestamp"
ID = "instance_id"


def _roll_tag(seconds: int) -> str:
    return "10" if seconds == 600 else str(seconds // 60)


BUCKET_SECONDS = 7 * 86400


def ordered_key_features(
    df: DataFrame,
    keys: Sequence[str],
    *,
    last_gap: str | None = None,
    next_gap: str | None = None,
    rolling: tuple[str, int] | None = None,
    last_view: str | None = None,
    ts: str = TS,
    id_col: str = ID,
    source=None,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """All ordered features of one key set from one ``(key, second)`` table and one join.

    * ``last_gap``  -- ts minus the previous row's ts in (ts, id) order, -1 if none;
    * ``next_gap``  -- next row's ts minus ts in (ts, id) order, -1 if none;
    * ``rolling=(prefix, s)`` -- ``{prefix}_count_{m}_bf``: rows with ``0 < t - ts < s``
      (later clicks) and ``..._af``: rows with ``-s < t - ts < 0`` (earlier clicks), as doubles;
    * ``last_view`` -- ts minus the latest strictly earlier ts, -1.0 if none.

    Windows are partitioned by (key, time bucket of ``bucket_seconds``), so a
    window partition holds at most one bucket of distinct seconds however long
    the log.  Seconds within ``s`` of a bucket edge are copied into the
    neighbouring bucket as halo rows (counted, never emitted); the previous /
    next second across buckets comes from a per-(key, bucket) min/max summary.
    A row whose key has a null component has no history: gaps -1, counts 0.
    """
    keys = list(keys)
    s_roll = int(rolling[1]) if rolling else 0
    width = max(int(bucket_seconds), s_roll)
    sec = (
        (source() if source else df).where(all_not_null(keys + [ts]))
        .groupBy(*keys, ts)
        .agg(F.count(F.lit(1)).alias("__n"), F.min(id_col).alias("__id_lo"), F.max(id_col).alias("__id_hi"))
        .withColumn("__b", F.floor(F.col(ts) / F.lit(width)))
    )
    need_prev, need_next = bool(last_gap or last_view), bool(next_gap)
    rows = sec.withColumn("__core", F.lit(True))
    if rolling:
        # each second goes to its own bucket and, near an edge, as a halo row to the neighbour: one read of the table
        start = F.col("__b") * F.lit(width)

        def place(bucket, core):
            return F.struct(bucket.alias("b"), F.lit(core).alias("core"))

        places = F.array_compact(
            F.array(
                place(F.col("__b"), True),
                F.when(F.col(ts) - start < F.lit(s_roll), place(F.col("__b") - 1, False)),
                F.when(start + F.lit(width) - F.col(ts) <= F.lit(s_roll), place(F.col("__b") + 1, False)),
            )
        )
        rows = sec.withColumn("__place", F.explode(places)).withColumns({"__b": F.col("__place.b"), "__core": F.col("__place.core")})
        rows = rows.drop("__place")
    w = Window.partitionBy(*keys, "__b").orderBy(ts)
    core_ts = F.when(F.col("__core"), F.col(ts))
    cols = {}
    # previous / next *core* second inside the bucket (halo rows skipped); both frames are
    # "unbounded preceding .. -1 row", which Spark evaluates incrementally
    if need_prev:
        cols["__prev_in"] = F.last(core_ts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if need_next:
        w_desc = Window.partitionBy(*keys, "__b").orderBy(F.col(ts).desc())
        cols["__next_in"] = F.last(core_ts, ignorenulls=True).over(w_desc.rowsBetween(Window.unboundedPreceding, -1))
    if rolling:

        def upto(k):
            return F.sum("__n").over(w.rangeBetween(Window.unboundedPreceding, k))

        cols["__bf"] = F.coalesce(upto(s_roll - 1) - upto(0), F.lit(0))
        cols["__af"] = F.coalesce(upto(-1) - upto(-s_roll), upto(-1), F.lit(0))
    feat = rows.withColumns(cols).where(F.col("__core")).drop("__n", "__core")
    if need_prev or need_next:
        # neighbouring non-empty buckets: one row per (key, bucket), a window per key over buckets
        wb = Window.partitionBy(*keys).orderBy("__b")
        summary = sec.groupBy(*keys, "__b").agg(F.min(ts).alias("__bmin"), F.max(ts).alias("__bmax"))
        summary = summary.select(
            *keys, "__b", F.lag("__bmax").over(wb).alias("__prev_b"), F.lead("__bmin").over(wb).alias("__next_b")
        )
        feat = feat.join(summary, keys + ["__b"], "left")
        if need_prev:
            feat = feat.withColumn("__prev", F.coalesce(F.col("__prev_in"), F.col("__prev_b")))
        if need_next:
            feat = feat.withColumn("__next", F.coalesce(F.col("__next_in"), F.col("__next_b")))
    feat = feat.drop("__b")
    out = attach(df, feat, keys + [ts])
    new = {}
    if last_gap:
        new[last_gap] = (
            F.when(F.col("__id_lo").isNull(), F.lit(-1))
            .when(F.col(id_col) != F.col("__id_lo"), F.lit(0))
            .when(F.col("__prev").isNull(), F.lit(-1))
            .otherwise(F.col(ts) - F.col("__prev"))
            .cast("bigint")
        )
    if next_gap:
        new[next_gap] = (
            F.when(F.col("__id_hi").isNull(), F.lit(-1))
            .when(F.col(id_col) != F.col("__id_hi"), F.lit(0))
            .when(F.col("__next").isNull(), F.lit(-1))
            .otherwise(F.col("__next") - F.col(ts))
            .cast("bigint")
        )
    if rolling:
        prefix, s = rolling
        tag = _roll_tag(int(s))
        new[f"{prefix}_count_{tag}_bf"] = F.coalesce(F.col("__bf"), F.lit(0)).cast("double")
        new[f"{prefix}_count_{tag}_af"] = F.coalesce(F.col("__af"), F.lit(0)).cast("double")
    if last_view:
        new[last_view] = F.coalesce(F.col(ts) - F.col("__prev"), F.lit(-1)).cast("double")
    keep = [c for c in df.columns if c not in new]
    return out.select(*keep, *[e.alias(n) for n, e in new.items()])


def last_time_gap(df: DataFrame, columns: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    """``{c}_lasttime_diff``: seconds since the previous click of the same ``c`` (ties: ``instance_id``)."""
    base = df
    for c in columns:
        df = ordered_key_features(df, [c], last_gap=f"{c}_lasttime_diff", source=lambda: base)
    return df


def next_time_gap(df: DataFrame, columns: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    """``{c}_nexttime_diff``: seconds until the next click of the same ``c``."""
    base = df
    for c in columns:
        df = ordered_key_features(df, [c], next_gap=f"{c}_nexttime_diff", source=lambda: base)
    return df


def rolling_neighbor_counts(df: DataFrame, keys: Mapping[str, Sequence[str]] = ROLLING_KEYS, seconds: int = ROLL_SECONDS) -> DataFrame:
    """Clicks of the same key less than ``seconds`` later (``_bf``) / earlier (``_af``).

    Note the naming: ``bf`` counts *later* clicks and ``af`` *earlier* ones.
    Same-second clicks and gaps of exactly ``seconds`` are excluded.
    """
    base = df
    for prefix, ks in keys.items():
        df = ordered_key_features(df, ks, rolling=(prefix, seconds), source=lambda: base)
    return df


def gap_to_last_view(df: DataFrame, grains: Sequence[str] = LAST_VIEW_GRAINS, user: str = "user_id") -> DataFrame:
    """``diffWithLastView_{g}``: seconds since the user's latest strictly earlier view of the same ``g``."""
    base = df
    for g in grains:
        df = ordered_key_features(df, [user, g], last_view=f"diffWithLastView_{g}", source=lambda: base)
    return df


#: seconds are taken as within +-2^52, so that (seconds, id) or (id, seconds) fit into one decimal(38,0)
_SECONDS, _LONGS = (1 << 53, -(1 << 52)), (1 << 64, -(1 << 63))


def _whole(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)")


class RowOrder:
    """First and last values in the order of one or two columns, as plain numbers.

    ``min``/``max`` of a struct can only be aggregated by sorting the rows of each task; of a long or a decimal they are hash aggregates.
    Nulls come first.  More columns, or columns that are not integers, are compared as a struct.
    """

    def __init__(self, columns: Sequence[str], seconds: str, integers: bool = True):
        self.columns = list(columns)
        self.spans = [_SECONDS if c == seconds else _LONGS for c in self.columns]
        self.packed = integers and (len(columns) == 1 or (len(columns) == 2 and _SECONDS in self.spans))

    def _number(self, i: int) -> Column:
        return F.coalesce(F.col(self.columns[i]).cast("bigint"), F.lit(self.spans[i][1]))

    def key(self) -> Column:
        if not self.packed:
            return F.struct(*self.columns)
        if len(self.columns) == 1:
            return self._number(0)
        span, low = self.spans[1]
        scaled = (self._number(0).cast("decimal(19,0)") * F.lit(Decimal(span))).cast("decimal(38,0)")
        return (scaled + (self._number(1).cast("decimal(38,0)") - _whole(low))).cast("decimal(38,0)")

    def last(self, key: Column) -> Column:
        """The last column's value in a key."""
        if not self.packed:
            return key[self.columns[-1]]
        span, low = self.spans[-1]
        value = key if len(self.columns) == 1 else (F.pmod(key, _whole(span)) + _whole(low)).cast("bigint")
        return F.nullif(value, F.lit(low).cast("bigint"))


def group_position_specs(
    batch,
    *,
    tab_subsets: Sequence[Sequence[str]] = (),
    gap_groups: Mapping[str, Sequence[str]] | None = None,
    order: Sequence[str] = ("user_id", TS),
    id_col: str = ID,
    integers: bool = True,
) -> list[str]:
    """Add click-tab and first/last-gap specs to a ``KeyedFeatures`` batch (null keys group together).

    Per key set: size, and the first and last row in (``order``, id) order, as partial aggregations.  Columns of the key set are
    constant in a group and left out of the order.  ``integers``: all columns of the order are integers (see ``RowOrder``).
    """
    names = []
    single = F.col("__pn") == F.lit(1)
    n = {"__pn": F.count(F.lit(1))}
    for subset in tab_subsets:
        name = "click_" + "_".join(c for c in subset if c != "day") + "_tab"
        names.append(name)
        rows = RowOrder([*(c for c in order if c not in subset), id_col], TS, integers)
        expr = (
            F.when(single, F.lit(0))
            .when(F.col(id_col) == rows.last(F.col("__pf")), F.lit(2))
            .when(F.col(id_col) == rows.last(F.col("__pl")), F.lit(3))
            .otherwise(F.lit(1))
            .cast("int")
        )
        batch.add(subset, n | {"__pf": F.min(rows.key()), "__pl": F.max(rows.key())}, {name: expr}, mask_null_keys=False)
    for p, keys in (gap_groups or {}).items():
        f, l = f"{p}_day_diffTime_first", f"{p}_day_diffTime_last"
        names += [f, l]
        # the time of the first row does not depend on what orders rows after it
        upto = order[: list(order).index(TS)] if TS in order else [*order, id_col]
        rows = RowOrder([*(c for c in upto if c not in keys), TS], TS, integers)
        batch.add(
            keys,
            n | {"__gf": F.min(rows.key()), "__gl": F.max(rows.key())},
            {
                f: F.when(single, F.lit(-1)).otherwise(F.col(TS) - rows.last(F.col("__gf"))).cast("bigint"),
                l: F.when(single, F.lit(-1)).otherwise(rows.last(F.col("__gl")) - F.col(TS)).cast("bigint"),
            },
            mask_null_keys=False,
        )
    return names


def are_integers(df: DataFrame, columns: Sequence[str]) -> bool:
    return all(df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for c in columns)


def group_position_features(
    df: DataFrame,
    *,
    tab_subsets: Sequence[Sequence[str]] = (),
    gap_groups: Mapping[str, Sequence[str]] | None = None,
    order: Sequence[str] = ("user_id", TS),
    id_col: str = ID,
) -> DataFrame:
    """Click tab codes and first/last gaps; one aggregation + one join per distinct key set."""
    from clickwright.operators.grouped import KeyedFeatures

    batch = KeyedFeatures()
    integers = are_integers(df, [*order, TS, id_col])
    group_position_specs(batch, tab_subsets=tab_subsets, gap_groups=gap_groups, order=order, id_col=id_col, integers=integers)
    return batch.apply(df)


def click_position_tab(df: DataFrame, subsets: Sequence[Sequence[str]] = CLICK_TAB_SUBSETS) -> DataFrame:
    """``click_{keys}_tab``: 0 only click of the group, 2 first, 3 last, 1 in between; order (user, ts, id)."""
    return group_position_features(df, tab_subsets=subsets)


def first_last_gap(
    df: DataFrame, groups: Mapping[str, Sequence[str]] = FIRST_LAST_GROUPS, order: Sequence[str] = ("user_id", TS)
) -> DataFrame:
    """``{p}_day_diffTime_first/last``: gap to the group's first/last row in (``order``, id) order; -1 for singletons.

    ``order=("context_timestamp",)`` takes the first and last in time instead of (user, time)."""
    return group_position_features(df, gap_groups=groups, order=order)
