"""Queries for ML transforms, UDFs, splits, training, metrics and pipelines (§2.11-2.15)."""

from __future__ import annotations

import uuid
from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickwright.functions import knuth_bucket_sql
from clickwright.operators import boosting as bo
from clickwright.operators import clean as cl
from clickwright.operators import metrics as me
from clickwright.operators import ml
from clickwright.operators import model as mo
from clickwright.operators import split as sp
from clickwright.operators import udfs
from clickwright.operators.columns import intersect_feature_list
from clickwright.plans.catalog import log, register, with_clicklog
from clickwright.plans.pipeline import prepare_dataset, training_features
from clickwright.plans.q_basic import ALL, PV_SQL, with_purchase_value
from clickwright.schema import BEST_VARIABLE
from clickwright.session import scratch_path

# ---------------------------------------------------------------- 2.11 ML feature transforms

BRAND_RANK_CTE = (
    "r AS (SELECT CAST(item_brand_id AS VARCHAR) AS b, "
    "row_number() OVER (ORDER BY count(*) DESC, CAST(item_brand_id AS VARCHAR)) - 1 AS idx "
    "FROM clicklog WHERE item_brand_id IS NOT NULL GROUP BY 1)"
)
BRAND_IDX_SQL = "CAST(coalesce(r.idx, (SELECT count(*) FROM r)) AS DOUBLE)"


@register(
    "string_index",
    with_clicklog(f"SELECT instance_id, {BRAND_IDX_SQL} AS item_brand_idIdx FROM clicklog LEFT JOIN r "
                  "ON CAST(item_brand_id AS VARCHAR) = r.b", BRAND_RANK_CTE),
)
def q_string_index(spark, sf_dir):
    out, _ = ml.string_index(log(spark, sf_dir), "item_brand_id")
    return out.select("instance_id", "item_brand_idIdx")


@register(
    "one_hot",
    with_clicklog(
        f"SELECT instance_id, CAST(CASE WHEN {BRAND_IDX_SQL} < (SELECT count(*) FROM r) THEN {BRAND_IDX_SQL} ELSE -1 END AS INTEGER) "
        "AS hot_index FROM clicklog LEFT JOIN r ON CAST(item_brand_id AS VARCHAR) = r.b", BRAND_RANK_CTE,
    ),
)
def q_one_hot(spark, sf_dir):
    idx, _ = ml.string_index(log(spark, sf_dir), "item_brand_id")
    oh = ml.one_hot(idx, ["item_brand_idIdx"])
    return oh.select("instance_id", ml.hot_position(oh, "item_brand_idIdx", "item_brand_idIdx_OneHot").alias("hot_index"))


@register("index_to_string", with_clicklog("SELECT instance_id, CAST(item_brand_id AS VARCHAR) AS brand_original FROM clicklog"))
def q_index_to_string(spark, sf_dir):
    idx, model = ml.string_index(log(spark, sf_dir), "item_brand_id")
    return ml.index_to_string(idx, "item_brand_idIdx", "brand_original", model).select("instance_id", "brand_original")


def _rank_cte(name: str, col: str) -> str:
    return (f"{name} AS (SELECT CAST({col} AS VARCHAR) AS b, row_number() OVER (ORDER BY count(*) DESC, CAST({col} AS VARCHAR)) - 1 AS idx "
            f"FROM clicklog WHERE {col} IS NOT NULL GROUP BY 1)")


def _hot_sql(name: str, col: str, alias: str) -> str:
    idx = f"coalesce({name}.idx, (SELECT count(*) FROM {name}))"
    return f"CAST(CASE WHEN {idx} < (SELECT count(*) FROM {name}) THEN {idx} ELSE -1 END AS INTEGER) AS {alias}"


@register(
    "ml_pipeline",
    with_clicklog(
        "SELECT c.instance_id, " + _hot_sql("rb", "item_brand_id", "brand_hot") + ", " + _hot_sql("rs", "shop_id", "shop_hot")
        + " FROM clicklog c LEFT JOIN rb ON CAST(c.item_brand_id AS VARCHAR) = rb.b LEFT JOIN rs ON CAST(c.shop_id AS VARCHAR) = rs.b",
        _rank_cte("rb", "item_brand_id"), _rank_cte("rs", "shop_id"),
    ),
)
def q_ml_pipeline(spark, sf_dir):
    cols = ["item_brand_id", "shop_id"]
    out = ml.ml_pipeline(log(spark, sf_dir).select("instance_id", *cols), cols, keep_index=True)
    hot = [ml.hot_position(out, f"{c}Idx", f"{c}Idx_OneHot").alias(n) for c, n in zip(cols, ("brand_hot", "shop_hot"))]
    # position of the 1 in each one-hot vector (-1 for the dropped last category)
    return out.select("instance_id", *hot)


@register(
    "assemble_vector",
    with_clicklog("SELECT instance_id, CAST(day AS DOUBLE) AS f0, CAST(hour AS DOUBLE) AS f1, CAST(minute AS DOUBLE) AS f2 FROM clicklog"),
)
def q_assemble(spark, sf_dir):
    v = ml.assemble_vector(log(spark, sf_dir), ["day", "hour", "minute"], "feature")
    return ml.vector_columns(v, "feature", ["f0", "f1", "f2"]).select("instance_id", "f0", "f1", "f2")


@register(
    "sql_transform",
    with_clicklog("SELECT instance_id, CASE WHEN is_trade = 0 THEN 'success' ELSE 'failure' END AS outcome FROM clicklog"),
)
def q_sql_transform(spark, sf_dir):
    udfs.register_sql_udfs(spark)
    return ml.sql_transform(log(spark, sf_dir), "SELECT instance_id, userfunction(is_trade) AS outcome FROM __THIS__")


@register(
    "bucketize",
    with_clicklog("SELECT instance_id, CAST(CASE WHEN hour < 6 THEN 0 WHEN hour < 12 THEN 1 WHEN hour < 18 THEN 2 ELSE 3 END AS DOUBLE) AS hour_bucket FROM clicklog"),
)
def q_bucketize(spark, sf_dir):
    return ml.bucketize(log(spark, sf_dir), "hour", [0, 6, 12, 18, 24], "hour_bucket").select("instance_id", "hour_bucket")


@register("interact", with_clicklog("SELECT instance_id, CAST(hour * minute AS DOUBLE) AS hour_x_minute FROM clicklog"))
def q_interact(spark, sf_dir):
    v = ml.interact(log(spark, sf_dir), ["hour", "minute"], "inter")
    return ml.vector_columns(v, "inter", ["hour_x_minute"]).select("instance_id", "hour_x_minute")


def _hm(df):
    return ml.assemble_vector(df, ["hour", "minute"], "hm")


NORM = "sqrt(hour * hour + minute * minute)"


@register(
    "normalize",
    with_clicklog(f"SELECT instance_id, round_even(CASE WHEN {NORM} = 0 THEN 0 ELSE hour / {NORM} END, 6) AS n0, "
                  f"round_even(CASE WHEN {NORM} = 0 THEN 0 ELSE minute / {NORM} END, 6) AS n1 FROM clicklog"),
)
def q_normalize(spark, sf_dir):
    v = ml.normalize(_hm(log(spark, sf_dir)), "hm", "n")
    return ml.vector_columns(v, "n", ["n0", "n1"], 6).select("instance_id", "n0", "n1")


@register(
    "standard_scale",
    with_clicklog("SELECT instance_id, round_even(hour / stddev_samp(hour) OVER (), 6) AS s0, "
                  "round_even(minute / stddev_samp(minute) OVER (), 6) AS s1 FROM clicklog"),
)
def q_standard(spark, sf_dir):
    v = ml.standard_scale(_hm(log(spark, sf_dir)), "hm", "s")
    return ml.vector_columns(v, "s", ["s0", "s1"], 6).select("instance_id", "s0", "s1")


def _mm(c):
    return (f"round_even(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE "
            f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6)")


@register("minmax_scale", with_clicklog(f"SELECT instance_id, {_mm('hour')} AS m0, {_mm('minute')} AS m1 FROM clicklog"))
def q_minmax(spark, sf_dir):
    v = ml.minmax_scale(_hm(log(spark, sf_dir)), "hm", "m")
    return ml.vector_columns(v, "m", ["m0", "m1"], 6).select("instance_id", "m0", "m1")


@register("elementwise_product", with_clicklog("SELECT instance_id, CAST(hour * 2.0 AS DOUBLE) AS e0, CAST(minute * 0.5 AS DOUBLE) AS e1 FROM clicklog"))
def q_elementwise(spark, sf_dir):
    v = ml.elementwise_product(_hm(log(spark, sf_dir)), "hm", "e", [2.0, 0.5])
    return ml.vector_columns(v, "e", ["e0", "e1"]).select("instance_id", "e0", "e1")


# ---------------------------------------------------------------- 2.12 UDFs

TS_SQL = "make_timestamp(context_timestamp * 1000000)"


@register("scalar_udf", with_clicklog(f"SELECT instance_id, CAST(dayofmonth({TS_SQL}) AS INTEGER) AS day_udf FROM clicklog"))
def q_scalar_udf(spark, sf_dir):
    df = log(spark, sf_dir)
    return df.select("instance_id", udfs.utc_day_udf(F.col("context_timestamp").cast("string")).alias("day_udf"))


@register("multi_column_udf", with_clicklog("SELECT instance_id, CAST(day + hour AS INTEGER) AS day_plus_hour FROM clicklog"))
def q_multi_udf(spark, sf_dir):
    return log(spark, sf_dir).select("instance_id", udfs.add_columns_udf("day", "hour").alias("day_plus_hour"))


@register(
    "sql_registered_udf",
    with_clicklog("SELECT instance_id, CASE WHEN is_trade = 0 THEN 'success' ELSE 'failure' END AS outcome FROM clicklog"),
)
def q_sql_udf(spark, sf_dir):
    udfs.register_sql_udfs(spark)
    view = f"clicklog_{uuid.uuid4().hex[:8]}"
    log(spark, sf_dir).createOrReplaceTempView(view)
    out = spark.sql(f"SELECT instance_id, userfunction(is_trade) AS outcome FROM {view}")
    spark.catalog.dropTempView(view)
    return out


@register("row_map", with_clicklog("SELECT context_timestamp AS key, 1 AS one FROM clicklog"))
def q_row_map(spark, sf_dir):
    return udfs.row_map(log(spark, sf_dir), "context_timestamp")


@register(
    "row_apply",
    with_clicklog(f"SELECT instance_id, CAST(dayofmonth({TS_SQL}) AS INTEGER) AS day, CAST(hour({TS_SQL}) AS INTEGER) AS hour, "
                  f"CAST(minute({TS_SQL}) AS INTEGER) AS minute FROM clicklog"),
)
def q_row_apply(spark, sf_dir):
    return udfs.time_parts_batches(log(spark, sf_dir))


@F.pandas_udf(T.DoubleType())
def _weighted_median(values: pd.Series, counts: pd.Series) -> float:
    """Median of a multiset given as (value, count) pairs, without expanding it."""
    order = values.argsort()
    v, c = values.to_numpy()[order], counts.to_numpy()[order]
    n = int(c.sum())
    cum = c.cumsum()
    lo = v[(cum > (n - 1) // 2).argmax()]
    hi = v[(cum > n // 2).argmax()]
    return float(lo + hi) / 2.0


@register("group_udaf", with_clicklog("SELECT user_id, CAST(median(hour) AS DOUBLE) AS hour_median FROM clicklog GROUP BY user_id"))
def q_group_udaf(spark, sf_dir):
    # equal values are counted first (partial aggregation), so each Python group holds at most
    # one row per distinct hour -- never a key's whole click list
    pairs = log(spark, sf_dir).groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("user_id").agg(_weighted_median("hour", "n").alias("hour_median"))


@register(
    "group_map",
    with_clicklog(
        "SELECT user_id, shop_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, shop_id) AS rn FROM "
        "(SELECT user_id, shop_id, count(*) AS n FROM clicklog GROUP BY 1, 2)) WHERE rn = 1"
    ),
)
def q_group_map(spark, sf_dir):
    pairs = log(spark, sf_dir).groupBy("user_id", "shop_id").agg(F.count(F.lit(1)).alias("n"))

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["n", "shop_id"], ascending=[False, True]).head(1)

    # each group is one user's (shop, count) table: bounded by the number of shops
    return pairs.groupBy("user_id").applyInPandas(top, "user_id bigint, shop_id bigint, n bigint")


# ---------------------------------------------------------------- 2.13 sampling and splits


@register("sample_rows", with_clicklog(f"SELECT {ALL} FROM clicklog WHERE {knuth_bucket_sql('instance_id', 1000)} < 100"))
def q_sample(spark, sf_dir):
    return sp.sample_rows_by_id(log(spark, sf_dir), 100)


@register(
    "random_split",
    with_clicklog(f"SELECT instance_id, CASE WHEN {knuth_bucket_sql('instance_id')} < 80 THEN 'train' ELSE 'test' END AS split FROM clicklog"),
)
def q_random_split(spark, sf_dir):
    return sp.hash_split(log(spark, sf_dir).select("instance_id"), 80)


@register(
    "split_last_period",
    with_clicklog("SELECT instance_id, day, CASE WHEN day = (SELECT max(day) FROM clicklog) THEN 'test' ELSE 'train' END AS split FROM clicklog"),
)
def q_split_last(spark, sf_dir):
    return sp.split_last_period(log(spark, sf_dir).select("instance_id", "day"), "day")


@register(
    "split_two_level_by_day",
    with_clicklog(
        "SELECT instance_id, day, CASE WHEN day < 24 THEN 'train' WHEN day = 24 THEN 'test' ELSE 'other' END AS split, "
        "CASE WHEN day < 23 THEN 'train_inner' WHEN day = 23 THEN 'validation' END AS inner_split FROM clicklog"
    ),
)
def q_split_two(spark, sf_dir):
    return sp.split_two_level_by_day(log(spark, sf_dir).select("instance_id", "day"))


@register(
    "stratified_folds",
    with_clicklog(
        "SELECT instance_id, is_trade, CAST((row_number() OVER (PARTITION BY is_trade ORDER BY "
        f"{knuth_bucket_sql('instance_id', 1 << 30)}, instance_id) - 1) % 5 AS INTEGER) AS fold FROM clicklog"
    ),
)
def q_folds(spark, sf_dir):
    return sp.stratified_folds(log(spark, sf_dir).select("instance_id", "is_trade"), 5)


@register(
    "downsample_negatives",
    with_clicklog(f"SELECT instance_id, is_trade FROM clicklog WHERE is_trade = 1 OR {knuth_bucket_sql('instance_id')} < 20"),
)
def q_downsample(spark, sf_dir):
    return sp.downsample_negatives(log(spark, sf_dir).select("instance_id", "is_trade"), 20)


# ---------------------------------------------------------------- 2.14 training, scoring, metrics

_PREPARED: dict[tuple, tuple] = {}
_MODELS: dict[tuple, mo.FittedGBT] = {}


def prepared(spark, sf_dir):
    """The prepared table, its features and its category codes: made and saved once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _PREPARED:
        data, roles = prepare_dataset(log(spark, sf_dir), scratch_path(spark, "prepared"))
        features, categorical = training_features(data, roles)
        _PREPARED[key] = data, features, mo.category_codes(data, categorical)
    return _PREPARED[key]


def _fit_cached(spark, sf_dir, name, fit):
    """Fit once per session and data folder; queries that score the same model share it."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _MODELS:
        _MODELS[key] = fit(*prepared(spark, sf_dir))
    return _MODELS[key]


def last_day(data):
    return data.agg(F.max("day")).first()[0]


def wrapper_model(data, features, codes):
    """All days but the last, evaluated on both sets in every round."""
    last = F.col("day") == last_day(data)
    rounds = mo.REFERENCE_GBT["wrapper_rounds"]
    return mo.gbt_fit(data.where(F.coalesce(~last, F.lit(True))), features, rounds=rounds, validation=data.where(last), categories=codes)


def refit_model(data, features, codes):
    return mo.gbt_fit(data.where("day < 24"), features, rounds=mo.REFERENCE_GBT["refit_rounds"], categories=codes)


def early_model(data, features, codes):
    return mo.gbt_fit_early_stop(data.where("day < 23"), data.where("day = 23"), features, categories=codes)


def subset_model(data, features, codes):
    """The curated features that the table has (``user_star_level`` has no source here)."""
    return early_model(data, intersect_feature_list(data.select(*features), BEST_VARIABLE, exclude=("day", "is_trade")), codes)


def p_valid():
    return F.col("p").between(0.0, 1.0).alias("p_valid")


def _scored_sql(where: str, more: str = "") -> str:
    return with_clicklog(f"SELECT instance_id, is_trade, true AS p_valid{more} FROM clicklog WHERE {where}")


@register("gbt_fit", _scored_sql("day = (SELECT max(day) FROM clicklog)", ", CAST(252 AS INTEGER) AS trees"))
def q_gbt_fit(spark, sf_dir):
    data = prepared(spark, sf_dir)[0]
    model = _fit_cached(spark, sf_dir, "wrapper", wrapper_model)
    scored = mo.predict_proba(model, data.where(F.col("day") == last_day(data)))
    return scored.select("instance_id", "is_trade", p_valid(), F.lit(model.trees).alias("trees"))


@register("gbt_fit_early_stop", _scored_sql("day = 24", ", true AS best_is_lowest"))
def q_gbt_early(spark, sf_dir):
    data = prepared(spark, sf_dir)[0]
    model = _fit_cached(spark, sf_dir, "early", early_model)
    lowest = model.trees - 1 == min(range(len(model.validation_loss)), key=model.validation_loss.__getitem__)
    return mo.predict_proba(model, data.where("day = 24")).select("instance_id", "is_trade", p_valid(), F.lit(lowest).alias("best_is_lowest"))


@register("gbt_refit", _scored_sql("day = 24", ", CAST(219 AS INTEGER) AS trees"))
def q_gbt_refit(spark, sf_dir):
    data = prepared(spark, sf_dir)[0]
    model = _fit_cached(spark, sf_dir, "refit", refit_model)
    return mo.predict_proba(model, data.where("day = 24")).select("instance_id", "is_trade", p_valid(), F.lit(model.trees).alias("trees"))


@register("predict_proba", _scored_sql("day = 24"))
def q_predict(spark, sf_dir):
    data = prepared(spark, sf_dir)[0]
    model = _fit_cached(spark, sf_dir, "refit", refit_model)
    return mo.predict_proba(model, data.where("day = 24")).select("instance_id", "is_trade", p_valid())


@register("fit_feature_subset", _scored_sql("day = 24", ", CAST(15 AS INTEGER) AS n_features"))
def q_subset(spark, sf_dir):
    data = prepared(spark, sf_dir)[0]
    model = _fit_cached(spark, sf_dir, "subset", subset_model)
    scored = mo.predict_proba(model, data.where("day = 24"))
    return scored.select("instance_id", "is_trade", p_valid(), F.lit(len(model.features)).alias("n_features"))


#: rounds of the fits without early stop, if not the reference's (252 and 219)
LEAFWISE_ROUNDS: int | None = None
_LEAFWISE: dict[tuple, dict[str, bo.Booster]] = {}


def leafwise(spark, sf_dir, *names):
    """The named ones of the reference's four fits (wrapper, refit, early stop, curated subset), by default all: grown side by side in the same passes,
    once per session and data folder.  A fit left out has no rounds; its rows still take part in the bins, which so are the same in every query."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    fits = _LEAFWISE.setdefault(key, {})
    wanted = [n for n in names or ("wrapper", "refit", "early", "subset") if n not in fits]
    if wanted:
        data, features, codes = prepared(spark, sf_dir)
        day, last = F.col("day"), last_day(data)
        curated = intersect_feature_list(data.select(*features), BEST_VARIABLE, exclude=("day", "is_trade"))
        how = mo.REFERENCE_GBT
        specs = {
            "wrapper": bo.Spec(F.coalesce(day != last, F.lit(True)), day == last, None, LEAFWISE_ROUNDS or how["wrapper_rounds"]),
            "refit": bo.Spec(day < 24, None, None, LEAFWISE_ROUNDS or how["refit_rounds"]),
            "early": bo.Spec(day < 23, day == 23, None, how["n_estimators"], how["early_stopping_rounds"]),
            "subset": bo.Spec(day < 23, day == 23, curated, how["n_estimators"], how["early_stopping_rounds"]),
        }
        asked = [s if n in wanted else replace(s, rounds=0) for n, s in specs.items()]
        made = dict(zip(specs, bo.boost_many(data, features, asked, categories=codes)))
        fits.update({n: made[n] for n in wanted})
    return fits


def _leafwise_scores(spark, sf_dir, name, where):
    model = leafwise(spark, sf_dir, name)[name]
    scored = bo.predict(model, prepared(spark, sf_dir)[0].where(where))
    return scored.select("instance_id", "is_trade", F.bround("p", 9).alias("p"), F.lit(model.rounds).alias("trees"))


@register("leafwise_fit")
def q_leafwise_fit(spark, sf_dir):
    """Probabilities of the last day by 48-leaf trees with L1 3, L2 5 and a minimum hessian weight of 5 (no SQL; tests compare with a plain booster)."""
    return _leafwise_scores(spark, sf_dir, "wrapper", F.col("day") == last_day(prepared(spark, sf_dir)[0]))


@register("leafwise_refit")
def q_leafwise_refit(spark, sf_dir):
    return _leafwise_scores(spark, sf_dir, "refit", "day = 24")


@register("leafwise_early_stop")
def q_leafwise_early(spark, sf_dir):
    return _leafwise_scores(spark, sf_dir, "early", "day = 24")


@register("leafwise_subset")
def q_leafwise_subset(spark, sf_dir):
    return _leafwise_scores(spark, sf_dir, "subset", "day = 24")


@register("leafwise_leaves")
def q_leafwise_leaves(spark, sf_dir):
    """The leaf of each tree for the rows of the test day."""
    scored = bo.predict(leafwise(spark, sf_dir, "refit")["refit"], prepared(spark, sf_dir)[0].where("day = 24"), leaves="leaves")
    return scored.select("instance_id", F.posexplode("leaves").alias("tree", "leaf"))


@register("leafwise_evaluate")
def q_leafwise_evaluate(spark, sf_dir):
    """Per model: trees, best round and losses, and log loss and AUC on its test day."""
    data, rows = prepared(spark, sf_dir)[0], []
    models = leafwise(spark, sf_dir)
    for name in ("wrapper", "refit", "early", "subset"):
        model = models[name]
        test = data.where(F.col("day") == (last_day(data) if name == "wrapper" else 24))
        scored = bo.predict(model, test).select("is_trade", "p")
        loss, auc = me.log_loss(scored).first()[0], me.roc_auc(scored).first()[0]
        rows.append((name, model.rounds, model.train_loss[model.rounds - 1], min(model.validation_loss, default=None), loss, auc))
    kinds = "model string, trees int, train_loss double, validation_loss double, log_loss double, auc double"
    return spark.createDataFrame(rows, kinds).select("model", "trees", *[F.bround(c, 9).alias(c) for c in ("train_loss", "validation_loss", "log_loss", "auc")])


@register("leafwise_out_of_fold")
def q_leafwise_folds(spark, sf_dir):
    """Each row scored by the one of five models, grown side by side, that did not see its stratified fold."""
    data, features, codes = prepared(spark, sf_dir)
    dealt = sp.stratified_folds(data, 5)
    scored = bo.out_of_fold(dealt, features, folds=5, rounds=mo.REFERENCE_GBT["wrapper_rounds"], categories=codes)
    return scored.select("instance_id", "is_trade", "fold", F.bround("p", 9).alias("p"))


def with_fixed_score(df):
    """A deterministic score column from the data, for exact metric checks."""
    return df.withColumn("p", F.coalesce((F.col("item_sales_level") + 1) / F.lit(11.0), F.lit(0.5)))


P_SQL = "coalesce((item_sales_level + 1) / 11.0, 0.5)"


@register(
    "log_loss",
    with_clicklog(f"SELECT round_even(-avg(is_trade * ln(least(greatest({P_SQL}, 1e-15), 1 - 1e-15)) + (1 - is_trade) * "
                  f"ln(1 - least(greatest({P_SQL}, 1e-15), 1 - 1e-15))), 9) AS log_loss FROM clicklog"),
)
def q_log_loss(spark, sf_dir):
    return me.log_loss(with_fixed_score(log(spark, sf_dir))).select(F.bround("log_loss", 9).alias("log_loss"))


@register(
    "roc_auc",
    with_clicklog(
        "SELECT round_even(sum(pos * (cum_neg - neg + neg / 2.0)) / (sum(pos) * sum(neg)), 9) AS auc FROM "
        "(SELECT pos, neg, sum(neg) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS cum_neg FROM "
        f"(SELECT {P_SQL} AS p, sum(is_trade) AS pos, sum(1 - is_trade) AS neg FROM clicklog GROUP BY 1))"
    ),
)
def q_auc(spark, sf_dir):
    return me.roc_auc(with_fixed_score(log(spark, sf_dir))).select(F.bround("auc", 9).alias("auc"))


@register("signed_error_sum", with_clicklog(f"SELECT round_even(sum(is_trade - {P_SQL}), 6) AS signed_error_sum FROM clicklog"))
def q_signed(spark, sf_dir):
    return me.signed_error_sum(with_fixed_score(log(spark, sf_dir))).select(F.bround("signed_error_sum", 6).alias("signed_error_sum"))


# ---------------------------------------------------------------- 2.15 pipelines


def _preprocess_sql() -> str:
    from clickwright.plans.q_preprocess import ENCODED, TIME_SQL_COLS
    from clickwright.sources.clicklog import CLICKLOG_COLUMNS

    ctes = [
        "ctok AS (SELECT instance_id, string_split(item_category_list, ';')[2] AS v FROM clicklog)",
        "cvc AS (SELECT v, count(*) AS cnt FROM ctok WHERE v IS NOT NULL GROUP BY v)",
        "cr AS (SELECT v, cnt, sum(cnt) OVER (ORDER BY cnt DESC, v ASC ROWS UNBOUNDED PRECEDING) AS cum FROM cvc)",
        "ck AS (SELECT v, row_number() OVER (ORDER BY cnt ASC, v ASC) AS code FROM cr "
        "WHERE cum < (SELECT count(*) FROM clicklog) * 0.95)",
        "ptok AS (SELECT instance_id, TRY_CAST(unnest(string_split(item_property_list, ';')) AS BIGINT) AS t FROM clicklog)",
        "pvc AS (SELECT t, count(*) AS cnt FROM ptok WHERE t IS NOT NULL GROUP BY t)",
        "pr AS (SELECT t, row_number() OVER (ORDER BY cnt DESC, t) AS rn, "
        "sum(cnt) OVER (ORDER BY cnt DESC, t ROWS UNBOUNDED PRECEDING) AS cum FROM pvc)",
        "pk0 AS (SELECT t, rn FROM pr WHERE cum < (SELECT sum(cnt) FROM pvc) * 0.8)",
        "pk AS (SELECT t FROM pk0 WHERE (SELECT count(*) FROM pk0) <= 50 OR rn <= 40)",
        "pf AS (SELECT instance_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS flags FROM "
        "(SELECT DISTINCT ptok.instance_id, ptok.t FROM ptok JOIN pk ON ptok.t = pk.t) GROUP BY instance_id)",
    ]
    from clickwright.plans.q_preprocess import _hit_sql

    enc = {
        c: f"CAST(CASE WHEN c.{c} IS NULL THEN (SELECT count(DISTINCT {c}) FROM clicklog) "
           f"ELSE dense_rank() OVER (ORDER BY c.{c}) - 1 END AS BIGINT) AS {c}"
        for c in ENCODED
    }
    time_cols = {t.rsplit(" AS ", 1)[1]: t.replace("context_timestamp", "c.context_timestamp") for t in TIME_SQL_COLS}
    cols = []
    for c in CLICKLOG_COLUMNS:
        cols.append(enc.get(c) or time_cols.get(c) or f"c.{c}")
    cols += [time_cols["maphour"], time_cols["mapmin"],
             "CAST(coalesce(ck.code, 0) AS INTEGER) AS secondLevelCatagory_Most_Freq",
             "coalesce(pf.flags, '') AS property_flags",
             _hit_sql("c.item_category_list", r"(\d+):").replace("predict_category_property", "c.predict_category_property") + " AS hitCategory",
             _hit_sql("c.item_property_list", r":(\w+);").replace("predict_category_property", "c.predict_category_property") + " AS hitProperty"]
    body = ("SELECT " + ", ".join(cols) + " FROM clicklog c LEFT JOIN ctok ON c.instance_id = ctok.instance_id "
            "LEFT JOIN ck ON ctok.v = ck.v LEFT JOIN pf ON c.instance_id = pf.instance_id")
    return with_clicklog(body, *ctes)


@register("preprocess", _preprocess_sql())
def q_preprocess(spark, sf_dir):
    from clickwright.operators.preprocess import kept_property_tokens, preprocess

    df = log(spark, sf_dir)
    tokens = sorted(kept_property_tokens(df))
    out = preprocess(df, property_tokens=tokens)
    # the data-dependent flag columns, folded into one comparable column (kept tokens present in the row)
    flags = F.concat_ws(",", *[F.when(F.col(f"preperty_{t}"), F.lit(str(t))) for t in tokens]) if tokens else F.lit("")
    return out.withColumn("property_flags", flags).drop(*[f"preperty_{t}" for t in tokens])


def _load_and_prepare_sql() -> str:
    from clickwright.plans.catalog import ORACLE
    from clickwright.plans.pipeline import feature_columns
    from clickwright.plans.q_pipeline import FAMILY_SQL
    from clickwright.sources.clicklog import CLICKLOG_SQL

    pre_cte = f"clicklog AS ({ORACLE['preprocess']})"
    ops = [op for fam in FAMILY_SQL.values() for op in fam]
    ctes = [f"f_{op} AS ({ORACLE[op].replace(CLICKLOG_SQL, pre_cte, 1)})" for op in ops]
    feats = [c for fam in feature_columns().values() for c in fam]
    body = "SELECT base.*, " + ", ".join(feats) + " FROM clicklog base " + " ".join(f"LEFT JOIN f_{op} USING (instance_id)" for op in ops)
    return "WITH " + pre_cte + ",\n" + ",\n".join(ctes) + "\n" + body


@register("load_and_prepare", _load_and_prepare_sql())
def q_load_and_prepare(spark, sf_dir):
    from clickwright.operators.preprocess import kept_property_tokens
    from clickwright.plans.pipeline import load_and_prepare

    df = log(spark, sf_dir)
    tokens = sorted(kept_property_tokens(df))
    out = load_and_prepare(df, property_tokens=tokens)[0]
    flags = F.concat_ws(",", *[F.when(F.col(f"preperty_{t}"), F.lit(str(t))) for t in tokens]) if tokens else F.lit("")
    return out.withColumn("property_flags", flags).drop(*[f"preperty_{t}" for t in tokens])


@register(
    "clean_experiment",
    with_clicklog(
        f"SELECT {ALL}, CASE WHEN day < 24 THEN 'train' WHEN day = 24 THEN 'test' ELSE 'other' END AS split, "
        "CASE WHEN day < 23 THEN 'train_inner' WHEN day = 23 THEN 'validation' END AS inner_split FROM clicklog"
    ),
)
def q_clean_experiment(spark, sf_dir):
    from clickwright.plans.pipeline import clean_experiment

    out = clean_experiment(with_purchase_value(log(spark, sf_dir)))
    return out.withColumn("shop_score_service", F.bround("shop_score_service", 6))


@register(
    "train_evaluate",
    with_clicklog(
        "SELECT count(*) AS n_test, CAST(252 AS INTEGER) AS trees, CAST(252 AS INTEGER) AS rounds_evaluated, true AS metrics_valid "
        "FROM clicklog WHERE day = (SELECT max(day) FROM clicklog)"
    ),
)
def q_train_evaluate(spark, sf_dir):
    from clickwright.plans.pipeline import train_evaluate

    data, features, _ = prepared(spark, sf_dir)
    res = train_evaluate(data, features, model=_fit_cached(spark, sf_dir, "wrapper", wrapper_model))
    valid = res["log_loss"] > 0 and (res["auc"] is None or 0 <= res["auc"] <= 1) and min(res["train_loss"] + res["test_loss"]) > 0
    evaluated = len(res["train_loss"]) if len(res["train_loss"]) == len(res["test_loss"]) else -1
    n_test = data.where(F.col("day") == last_day(data)).count()
    return spark.createDataFrame([(n_test, res["trees"], evaluated, valid)], "n_test long, trees int, rounds_evaluated int, metrics_valid boolean")
