"""Grouped features: per-key counts, ratios, means and distinct counts.

Each feature table is a partial aggregation (map-side combine, so a hot key
costs one row per task before the shuffle), attached back with ``attach``.
Keys with a null component form no group, so their features are null, as in
a pandas ``groupby`` followed by a left ``merge``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwright.operators.distinct import count_words, distinct_counts, distinct_words, merge_words
from clickwright.operators.joins import all_not_null, attach, null_safe_keys
from clickwright.schema import (
    ACTIVE_PER_GRAIN, AGGREGATE_LEVEL, EXPOSE_PAIRS, EXPOSE_RATIO_DIGITS, MINUTE_BUCKETS, RELATIVE_RATIO,
    RELATIVE_RATIO_DIGITS,
)


def _agg_fn(name: str, c: str, order_col: str = "instance_id"):
    fns = {
        "mean": lambda: F.avg(c),
        "sum": lambda: F.sum(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "std": lambda: F.stddev_samp(c),
        "var": lambda: F.var_samp(c),
        "median": lambda: F.median(c),
        "count": lambda: F.count(c),
        "size": lambda: F.count(F.lit(1)),
        "nunique": lambda: F.count_distinct(c),
        "first": lambda: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))),
        "last": lambda: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))),
    }
    if name not in fns:
        raise ValueError(f"unsupported aggregate {name!r}; choose from {sorted(fns)}")
    return fns[name]()


class KeyedFeatures:
    """Feature specs grouped by key set: one partial aggregation and one join per key set.

    ``add(keys, aggs, post)``: ``aggs`` maps temporary names to aggregate
    expressions, ``post`` maps output names to row expressions over them.
    With ``mask_null_keys`` (the pandas ``groupby`` + ``merge`` behaviour) a
    row whose key has a null component gets null; otherwise null keys form a
    group of their own (pandas ``duplicated`` / ``drop_duplicates``).
    """

    def __init__(self):
        self._specs: dict[tuple, dict] = {}

    def add(self, keys: Sequence[str], aggs: Mapping[str, Column], post: Mapping[str, Column], mask_null_keys: bool = True):
        spec = self._specs.setdefault(tuple(keys), {"aggs": {}, "post": {}, "null_safe": False})
        spec["aggs"].update(aggs)
        guard = all_not_null(keys)
        spec["post"].update({k: (F.when(guard, v) if mask_null_keys else v) for k, v in post.items()})
        spec["null_safe"] = spec["null_safe"] or not mask_null_keys
        return self

    def apply(self, df: DataFrame, source=None) -> DataFrame:
        """Attach every key set's features; aggregates read ``source()`` (same rows as ``df``) if given.

        They always read the rows as given, never those that earlier key sets were joined to, so n key
        sets cost n aggregations and n joins.  Key sets of more columns have more groups, and their joins move the
        rows: they come first, as long as the rows carry few features.
        """
        base, types, given, made = df, {f.name: f.dataType for f in df.schema}, df.columns, self.output_columns()
        for keys, spec in sorted(self._specs.items(), key=lambda s: (-len(s[0]), len(s[1]["post"]))):
            src = source() if source else base
            if spec["null_safe"]:
                on = null_safe_keys(keys, types)
                df, src = df.withColumns(on), src.withColumns(on)
            else:
                on = keys
                src = src.where(all_not_null(keys))
            feat = src.groupBy(*on).agg(*[e.alias(n) for n, e in spec["aggs"].items()])
            keep = [c for c in df.columns if c not in spec["post"] and (c in keys or c not in on)]
            df = attach(df, feat, list(on)).select(*keep, *[e.alias(n) for n, e in spec["post"].items()])
        return df.select(*[c for c in given if c not in made], *dict.fromkeys(made))

    def output_columns(self) -> list[str]:
        return [c for spec in self._specs.values() for c in spec["post"]]


def expose_ratio(df: DataFrame, pairs: Sequence[Sequence[str]] = EXPOSE_PAIRS, digits: int = EXPOSE_RATIO_DIGITS, source=None) -> DataFrame:
    """``{ids}_{grain}_cnt`` rows per (ids, grain) and ``{ids}_{grain}_ratio`` its share of the ids' rows.

    All grains of one ``ids`` share one aggregation at (ids, grains...); counts
    and totals are windows over that aggregate table, whose partitions hold one
    row per grain combination (e.g. 24 hours), then one join brings them back.
    """
    grains_of: dict[str, list[str]] = defaultdict(list)
    for ids, grain in pairs:
        grains_of[ids].append(grain)
    base = df
    for ids, grains in grains_of.items():
        keys = [ids, *grains]
        agg = (source() if source else base).where(F.col(ids).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        cols = {}
        for g in grains:
            cols[f"{ids}_{g}_cnt"] = F.when(F.col(g).isNotNull(), F.sum("__n").over(Window.partitionBy(ids, g)))
            cols[f"__tot_{g}"] = F.sum(F.when(F.col(g).isNotNull(), F.col("__n"))).over(Window.partitionBy(ids))
        agg = agg.withColumns(cols)
        agg = agg.withColumns(
            {f"{ids}_{g}_ratio": F.bround(F.col(f"{ids}_{g}_cnt") / F.col(f"__tot_{g}"), digits) for g in grains}
        ).drop("__n", *[f"__tot_{g}" for g in grains])
        df = attach(df, agg, keys, null_safe=True)
        df = df.withColumns(
            {c: F.when(F.col(ids).isNotNull(), F.col(c)) for g in grains for c in (f"{ids}_{g}_cnt", f"{ids}_{g}_ratio")}
        )
    return df


def aggregate_level_specs(batch: KeyedFeatures, spec: Mapping[str, Sequence[str]] = AGGREGATE_LEVEL, aggs: Sequence[str] = ("mean",)) -> list[str]:
    names = []
    for c, ids_list in spec.items():
        for ids in ids_list:
            for agg in aggs:
                name = f"{ids}_TO_{c}_{agg}"
                names.append(name)
                batch.add([ids], {f"__{name}": _agg_fn(agg, c)}, {name: F.col(f"__{name}")})
    return names


def aggregate_level(df: DataFrame, spec: Mapping[str, Sequence[str]] = AGGREGATE_LEVEL, aggs: Sequence[str] = ("mean",)) -> DataFrame:
    """``{ids}_TO_{col}_{agg}``: aggregate of ``col`` over each ``ids`` (one groupBy per key)."""
    batch = KeyedFeatures()
    aggregate_level_specs(batch, spec, aggs)
    return batch.apply(df)


def active_per_grain_specs(batch: KeyedFeatures, spec: Mapping[str, Mapping[str, Sequence[str]]] = ACTIVE_PER_GRAIN) -> list[str]:
    names = []
    for grain, per_key in spec.items():
        for ids1, ids2_list in per_key.items():
            for ids2 in ids2_list:
                name = f"{ids1}_{grain}__active_{ids2}__num"
                names.append(name)
                batch.add(
                    [ids1, grain],
                    {f"__{name}": F.count_distinct(ids2) + F.max(F.col(ids2).isNull().cast("bigint"))},
                    {name: F.col(f"__{name}")},
                )
    return names


def active_per_grain(df: DataFrame, spec: Mapping[str, Mapping[str, Sequence[str]]] = ACTIVE_PER_GRAIN, source=None) -> DataFrame:
    """``{ids1}_{grain}__active_{ids2}__num``: distinct ``ids2`` per (ids1, grain); null counts as one value.

    Exact, by a bitmap aggregation per counted column: no row is expanded per distinct count.
    """
    out = df
    for grain, per_key in spec.items():
        for ids1, cols in per_key.items():
            names = [f"{ids1}_{grain}__active_{c}__num" for c in cols]
            out = attach(out, distinct_counts(source() if source else df, [ids1, grain], cols, names, source=source), [ids1, grain])
    return out


def active_words(df: DataFrame, spec: Mapping[str, Mapping[str, Sequence[str]]] = ACTIVE_PER_GRAIN) -> dict[str, DataFrame]:
    """The sets behind ``active_per_grain`` as bitmap words, by feature name: what is kept of a day, to be merged with other days."""
    return {f"{ids1}_{grain}__active_{c}__num": distinct_words(df, [ids1, grain], c) for grain, d in spec.items() for ids1, cols in d.items() for c in cols}


def active_from_words(df: DataFrame, days: Sequence[Mapping[str, DataFrame]], spec: Mapping[str, Mapping[str, Sequence[str]]] = ACTIVE_PER_GRAIN) -> DataFrame:
    """``active_per_grain`` for ``df`` from the words of several days, merged; the days' rows are not read again."""
    out = df
    for grain, per_key in spec.items():
        for ids1, cols in per_key.items():
            feat = None
            for c in cols:
                name = f"{ids1}_{grain}__active_{c}__num"
                part = count_words(merge_words([d[name] for d in days], [ids1, grain]), [ids1, grain], name)
                feat = part if feat is None else feat.join(part, [ids1, grain])
            out = attach(out, feat, [ids1, grain])
    return out


def relative_ratio_specs(batch: KeyedFeatures, spec: Mapping[str, Sequence[str]] = RELATIVE_RATIO, digits: int = RELATIVE_RATIO_DIGITS) -> list[str]:
    names = []
    for ids, cols in spec.items():
        for c in cols:
            mean = f"{c}_mean_by_{ids}"
            names.append(mean)
            batch.add([ids], {f"__{mean}": F.avg(c)}, {mean: F.col(f"__{mean}")})
        for c in cols:
            mean = f"{c}_mean_by_{ids}"
            names.append(f"{mean}ratio")
            batch.add([ids], {}, {f"{mean}ratio": F.bround(F.try_divide(F.col(c), F.col(f"__{mean}")), digits)})
    return names


def relative_ratio(df: DataFrame, spec: Mapping[str, Sequence[str]] = RELATIVE_RATIO, digits: int = RELATIVE_RATIO_DIGITS) -> DataFrame:
    """``{col}_mean_by_{ids}`` and ``{col}_mean_by_{ids}ratio`` = round(col / mean, 5); zero mean -> null."""
    batch = KeyedFeatures()
    relative_ratio_specs(batch, spec, digits)
    return batch.apply(df)


def group_count_feature(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    feat = df.where(all_not_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return attach(df, feat, keys)


def daily_specs(batch: KeyedFeatures) -> list[str]:
    """``shop_item_unique_day`` (distinct items per shop and day, nulls not counted) and
    ``user_id_query_day`` (rows per user and day)."""
    batch.add(["shop_id", "day"], {"__sid": F.count_distinct("item_id")}, {"shop_item_unique_day": F.col("__sid")})
    batch.add(["user_id", "day"], {"__uqd": F.count(F.lit(1))}, {"user_id_query_day": F.col("__uqd")})
    return ["shop_item_unique_day", "user_id_query_day"]


def daily_shop_item_count(df: DataFrame, shop: str = "shop_id", item: str = "item_id", day: str = "day") -> DataFrame:
    """``shop_item_unique_day``: distinct items per (shop, day); nulls are not counted."""
    batch = KeyedFeatures().add([shop, day], {"__sid": F.count_distinct(item)}, {"shop_item_unique_day": F.col("__sid")})
    return batch.apply(df)


def daily_user_clicks(df: DataFrame, user: str = "user_id", day: str = "day") -> DataFrame:
    """``user_id_query_day``: rows per (user, day)."""
    return KeyedFeatures().add([user, day], {"__uqd": F.count(F.lit(1))}, {"user_id_query_day": F.col("__uqd")}).apply(df)


def minute_bucket_clicks(df: DataFrame, buckets: Sequence[int] = MINUTE_BUCKETS, minute: str = "minute", source=None) -> DataFrame:
    """``min{n}_user_click``: rows per (user, day, hour, minute // n).

    One aggregation at minute level; each bucket count is a window over that
    table partitioned by (user, day, hour, bucket) -- at most 60 rows each.
    """
    keys = ["user_id", "day", "hour", minute]
    # clustering by the hour serves all buckets: each is inside one hour
    agg = (source() if source else df).where(all_not_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    agg = agg.repartition(*keys[:3])
    agg = agg.withColumns(
        {
            f"min{n}_user_click": F.sum("__n").over(Window.partitionBy("user_id", "day", "hour", F.floor(F.col(minute) / F.lit(n))))
            for n in buckets
        }
    ).drop("__n")
    return attach(df, agg, keys)
