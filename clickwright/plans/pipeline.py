"""Pipelines: preprocessing, the feature build, preparation, cleaning and training flows.

``build_features`` materialises its input once (Parquet in the checkpoint
folder), computes every feature family from a column-pruned projection of it
-- a family's own joins move only ids and keys -- and assembles the wide
table with 1:1 joins on ``instance_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwright.operators import grouped as gr
from clickwright.operators import preprocess as pp
from clickwright.operators import sequence as seq
from clickwright.operators.columns import drop_useless_columns
from clickwright.plans.ordered import fresh_source, materialize
from clickwright.schema import (
    ACTIVE_PER_GRAIN, AGGREGATE_LEVEL, CLICK_TAB_SUBSETS, EXPOSE_PAIRS, FIRST_LAST_GROUPS, LAST_VIEW_GRAINS,
    MINUTE_BUCKETS, RELATIVE_RATIO, ROLL_SECONDS, ColumnRoles,
)

ID = "instance_id"


def _tab(subset):
    return "click_" + "_".join(c for c in subset if c != "day") + "_tab"


def feature_columns(roll_seconds: int = ROLL_SECONDS) -> dict[str, list[str]]:
    """Output columns of every feature family, in the reference's generation order."""
    tag = "10" if roll_seconds == 600 else str(roll_seconds // 60)
    return {
        "expose": [f"{i}_{g}_{s}" for i, g in EXPOSE_PAIRS for s in ("cnt", "ratio")],
        "aggregate_level": [f"{ids}_TO_{c}_mean" for c, idl in AGGREGATE_LEVEL.items() for ids in idl],
        "active": [f"{a}_{g}__active_{b}__num" for g, d in ACTIVE_PER_GRAIN.items() for a, bl in d.items() for b in bl],
        "relative": [f"{c}_mean_by_{ids}{s}" for ids, cols in RELATIVE_RATIO.items() for s in ("", "ratio") for c in cols],
        "positions": [_tab(s) for s in CLICK_TAB_SUBSETS]
        + [f"{p}_day_diffTime_{s}" for p in FIRST_LAST_GROUPS for s in ("first", "last")],
        "ordered": ["user_id_lasttime_diff", "item_id_lasttime_diff", "user_id_nexttime_diff", "item_id_nexttime_diff"]
        + [f"{p}_count_{tag}_{s}" for p in ("user", "user_shop", "user_item") for s in ("bf", "af")],
        "size": ["shop_item_unique_day", "user_id_query_day"] + [f"min{n}_user_click" for n in MINUTE_BUCKETS],
        "last_view": [f"diffWithLastView_{g}" for g in LAST_VIEW_GRAINS],
    }


def _ordered_family(base: DataFrame, roll_seconds: int, source=None) -> DataFrame:
    """All ordered features, one (key, second) table per key set; those of few features first, as each join moves the rows."""
    d = base
    for g in LAST_VIEW_GRAINS:
        if g != "shop_id":
            d = seq.ordered_key_features(d, ["user_id", g], last_view=f"diffWithLastView_{g}", source=source)
    d = seq.ordered_key_features(d, ["item_id"], last_gap="item_id_lasttime_diff", next_gap="item_id_nexttime_diff", source=source)
    d = seq.ordered_key_features(d, ["user_id", "item_id"], rolling=("user_item", roll_seconds), source=source)
    d = seq.ordered_key_features(d, ["user_id", "shop_id"], rolling=("user_shop", roll_seconds),
                                 last_view="diffWithLastView_shop_id", source=source)
    return seq.ordered_key_features(d, ["user_id"], last_gap="user_id_lasttime_diff", next_gap="user_id_nexttime_diff",
                                    rolling=("user", roll_seconds), source=source)


def build_features(df: DataFrame, roll_seconds: int = ROLL_SECONDS, materialize_input: bool = True) -> DataFrame:
    """Every feature generator of the reference, in its configuration, on a log with time parts."""
    needs_time = not ({"maphour", "mapmin"} <= set(df.columns))
    if materialize_input:
        df = materialize(df, "features-input")
    # every family and every feature table reads its own fresh relation of the input
    fresh = fresh_source(df, pp.time_parts if needs_time else None)
    base = fresh()
    cols = feature_columns(roll_seconds)
    # every grouped feature, merged by key set: one aggregation and one join per key set
    batch = gr.KeyedFeatures()
    gr.aggregate_level_specs(batch)
    gr.active_per_grain_specs(batch)
    gr.relative_ratio_specs(batch)
    seq.group_position_specs(batch, tab_subsets=CLICK_TAB_SUBSETS, gap_groups=FIRST_LAST_GROUPS,
                             integers=seq.are_integers(base, ["user_id", seq.TS, seq.ID]))
    gr.daily_specs(batch)
    grouped_cols = batch.output_columns()
    families = [
        gr.expose_ratio(fresh(), source=fresh).select(ID, *cols["expose"]),
        batch.apply(fresh(), source=fresh).select(ID, *grouped_cols),
        _ordered_family(fresh(), roll_seconds, source=fresh).select(ID, *cols["ordered"], *cols["last_view"]),
        gr.minute_bucket_clicks(fresh(), source=fresh).select(ID, *[c for c in cols["size"] if c.startswith("min")]),
    ]
    out = base
    for fam in families:
        out = out.join(fam, ID, "left")
    ordered = [c for fam in cols.values() for c in fam]
    return out.select(*base.columns, *ordered)


def new_feature_roles(roll_seconds: int = ROLL_SECONDS) -> list[str]:
    return [c for fam in feature_columns(roll_seconds).values() for c in fam]


def load_and_prepare(df: DataFrame, property_tokens=None) -> tuple[DataFrame, ColumnRoles]:
    """Preprocess -> features; the label stays a column; roles say which columns are which."""
    pre = pp.preprocess(df, property_tokens=property_tokens)
    feats = build_features(pre)
    added = [c for c in feats.columns if c not in df.columns]
    roles = ColumnRoles().with_new(continuous=added)
    return feats, roles


def clean_experiment(df: DataFrame, label: str = "is_trade", threshold: float = 0.6) -> DataFrame:
    """Profile missing values -> drop sparse columns -> impute float means -> tag the day split."""
    from clickwright.operators import clean as cl
    from clickwright.operators import split as sp

    kept = cl.drop_sparse_columns(df, threshold)
    imputed = cl.impute_mean(kept)
    return sp.split_two_level_by_day(imputed)


def prepare_dataset(df: DataFrame, folder: str) -> tuple[DataFrame, ColumnRoles]:
    """Prepare -> save -> reload: the table that models are trained on, and its column roles."""
    from clickwright.sources.files import load_dataset, save_dataset

    prepared, roles = load_and_prepare(df)
    save_dataset(prepared, folder, roles)
    return load_dataset(df.sparkSession, folder)


def training_features(data: DataFrame, roles: ColumnRoles) -> tuple[list[str], list[str]]:
    """(features, the categorical ones among them): all kept columns but the label."""
    kept, _ = drop_useless_columns(data)
    features = [c for c in kept.columns if c != roles.label]
    return features, [c for c in features if c in set(roles.category)]


def train_evaluate(df: DataFrame, features: list[str], label: str = "is_trade", model=None, **gbt) -> dict:
    """Last-day split -> GBT fit -> per-round losses on both sets, test-day log-loss and AUC."""
    from clickwright.operators import metrics as me
    from clickwright.operators import model as mo
    from clickwright.operators import split as sp

    split = sp.split_last_period(df, "day")
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    model = model or mo.gbt_fit(train, features, label, validation=test, **gbt)
    scored = mo.predict_proba(model, test)
    return {
        "log_loss": me.log_loss(scored, label, "p").first()[0],
        "auc": me.roc_auc(scored, label, "p").first()[0],
        "trees": model.trees,
        "train_loss": model.train_loss,
        "test_loss": model.validation_loss,
    }
