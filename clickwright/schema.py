"""Column roles, fixed column lists and the typed schema of the impression log."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference configuration (column names and
# feature-generator settings).  Kept verbatim and in their original order.
# ---------------------------------------------------------------------------
COL_NEED_ENCODE = [
    "context_id", "item_brand_id", "item_city_id", "item_id", "user_id", "shop_id",
    "context_page_id", "user_occupation_id",
]
COLS_WITH_CATEGORY_TYPE = [
    "instance_id", "item_id", "item_brand_id", "item_city_id", "item_price_level",
    "item_sales_level", "item_collected_level", "item_pv_level", "user_id", "user_gender_id",
    "user_age_level", "user_occupation_id", "user_star_level", "context_id", "context_page_id",
    "shop_id", "shop_review_num_level", "shop_star_level", "is_trade",
]
COLS_WITH_CONTINUE_TYPE = [
    "shop_review_positive_rate", "shop_score_service", "shop_score_delivery", "shop_score_description",
]
COLS_WITH_STR_TYPE = ["item_category_list", "item_property_list", "predict_category_property"]
COLS_WITH_OTHER_TYPE = ["context_timestamp"]
COLS_THAT_USELESS = [
    "context_timestamp", "instance_id", "item_id", "user_id", "context_id", "context_page_id",
    "shop_id", "is_trade", "item_category_list", "item_property_list", "predict_category_property",
]
BEST_VARIABLE = [
    "day", "item_brand_id", "item_sales_level", "item_collected_level", "user_age_level",
    "user_star_level", "user_count_10_bf", "click_item_id_user_id_tab", "u_day_diffTime_last",
    "diffWithLastView_item_brand_id", "item_category_list_day__active_item_id__num",
    "i_day_diffTime_last", "item_price_level_mean_by_item_brand_id",
    "user_id_day__active_item_city_id__num", "user_id_lasttime_diff", "i_day_diffTime_first",
    "item_collected_level_mean_by_item_city_id",
]
# feature-generator configuration of the feature pipeline (fixed values)
EXPOSE_PAIRS = [["item_id", "hour"], ["item_id", "maphour"], ["user_id", "hour"], ["user_id", "maphour"]]
AGGREGATE_LEVEL = {"hour": ["user_id", "item_id", "shop_id"], "user_age_level": ["item_id", "item_brand_id", "shop_id"]}
ACTIVE_PER_GRAIN = {
    "day": {
        "item_category_list": ["item_id", "user_id"],
        "user_id": ["item_city_id", "shop_id", "item_brand_id"],
        "item_id": ["user_id"],
        "shop_id": ["user_id"],
        "item_brand_id": ["user_id"],
    }
}
RELATIVE_RATIO = {
    "item_brand_id": ["item_price_level", "item_sales_level", "item_collected_level"],
    "item_city_id": ["item_price_level", "item_sales_level", "item_collected_level"],
    "item_category_list": ["item_price_level", "item_sales_level", "item_collected_level"],
}
CLICK_TAB_SUBSETS = [
    ["user_id", "day"],
    ["item_id", "user_id", "day"],
    ["item_brand_id", "user_id", "day"],
    ["shop_id", "user_id", "day"],
    ["item_city_id", "user_id", "day"],
]
FIRST_LAST_GROUPS = {
    "u": ["user_id", "day"],
    "i": ["item_id", "day"],
    "b": ["item_brand_id", "user_id", "day"],
    "s": ["shop_id", "user_id", "day"],
}
ROLLING_KEYS = {"user": ["user_id"], "user_shop": ["user_id", "shop_id"], "user_item": ["user_id", "item_id"]}
LAST_VIEW_GRAINS = ["shop_id", "item_brand_id", "item_sales_level"]
MINUTE_BUCKETS = [10, 15, 30, 45]
MAPHOUR_BINS = [0, 6, 12, 18, 24]
# numeric settings of the reference
ROLL_SECONDS = 600
CATEGORY_FRAC = 0.95
PROPERTY_FRAC = 0.8
PROPERTY_MIN_COUNT = 40
PROPERTY_MAX_KEPT = 50
SPARSE_COLUMN_RATIO = 0.6
EXPOSE_RATIO_DIGITS = 4
RELATIVE_RATIO_DIGITS = 5
# ---------------------------------------------------------------------------

# Typed schema of the raw space-delimited impression log (27 columns).
LOG_SCHEMA = T.StructType(
    [
        T.StructField("instance_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("item_category_list", T.StringType()),
        T.StructField("item_property_list", T.StringType()),
        T.StructField("item_brand_id", T.LongType()),
        T.StructField("item_city_id", T.LongType()),
        T.StructField("item_price_level", T.IntegerType()),
        T.StructField("item_sales_level", T.IntegerType()),
        T.StructField("item_collected_level", T.IntegerType()),
        T.StructField("item_pv_level", T.IntegerType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_gender_id", T.IntegerType()),
        T.StructField("user_age_level", T.IntegerType()),
        T.StructField("user_occupation_id", T.LongType()),
        T.StructField("user_star_level", T.IntegerType()),
        T.StructField("context_id", T.LongType()),
        T.StructField("context_timestamp", T.LongType()),
        T.StructField("context_page_id", T.LongType()),
        T.StructField("predict_category_property", T.StringType()),
        T.StructField("shop_id", T.LongType()),
        T.StructField("shop_review_num_level", T.IntegerType()),
        T.StructField("shop_review_positive_rate", T.DoubleType()),
        T.StructField("shop_star_level", T.IntegerType()),
        T.StructField("shop_score_service", T.DoubleType()),
        T.StructField("shop_score_delivery", T.DoubleType()),
        T.StructField("shop_score_description", T.DoubleType()),
        T.StructField("is_trade", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class ColumnRoles:
    """Immutable column roles carried next to a DataFrame (no global lists)."""

    category: tuple[str, ...] = tuple(COLS_WITH_CATEGORY_TYPE)
    continuous: tuple[str, ...] = tuple(COLS_WITH_CONTINUE_TYPE)
    useless: tuple[str, ...] = tuple(COLS_THAT_USELESS)
    label: str = "is_trade"
    extra: dict = field(default_factory=dict)

    def with_new(self, category=(), continuous=()) -> "ColumnRoles":
        return replace(
            self,
            category=tuple(dict.fromkeys(self.category + tuple(category))),
            continuous=tuple(dict.fromkeys(self.continuous + tuple(continuous))),
        )

    def to_dict(self) -> dict:
        return {
            "category": list(self.category),
            "continuous": list(self.continuous),
            "useless": list(self.useless),
            "label": self.label,
        }

    @staticmethod
    def from_dict(d: dict) -> "ColumnRoles":
        return ColumnRoles(tuple(d["category"]), tuple(d["continuous"]), tuple(d["useless"]), d["label"])
