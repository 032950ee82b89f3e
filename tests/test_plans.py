"""Plan checks: no Python in the feature path, no single-partition windows, pushdown."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from clickwright.plans.catalog import QUERIES


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(plan: str) -> list[str]:
    """Window operators whose partition spec is empty (the whole input in one task)."""
    return [line.strip() for line in plan.splitlines() if "Window [" in line and "], [], [" in line]


def test_feature_build_stays_in_the_jvm(spark):
    plan = executed_plan(QUERIES["build_features"](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan
    assert "Window [" in plan
    assert unpartitioned_windows(plan) == []


def test_rank_helpers_have_no_global_window(spark):
    for name in ["label_encode", "roc_auc", "category_frequency_code", "stratified_folds"]:
        plan = executed_plan(QUERIES[name](spark, SF_SMALL))
        # a global aggregate's final merge may gather one partial row per task; a window may not
        assert unpartitioned_windows(plan) == [], name


def test_scan_pushdown_and_pruning(spark):
    from clickwright.sources.clicklog import read_table
    from pyspark.sql import functions as F

    df = read_table(spark, SF_SMALL, "events").where(F.col("user_id") == 7).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_ordered_windows_are_bucketed(spark):
    """Sequence windows partition by (key, time bucket); the only per-key windows run over the
    bucket summary (one row per key and bucket)."""
    plan = executed_plan(QUERIES["rolling_neighbor_counts"](spark, SF_SMALL))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        partition_spec = line.split("], [", 1)[1].split("]", 1)[0]
        assert "__b" in partition_spec, line
    plan = executed_plan(QUERIES["last_time_gap"](spark, SF_SMALL))
    for line in [line for line in plan.splitlines() if "Window [" in line]:
        partition_spec = line.split("], [", 1)[1].split("]", 1)[0]
        ordered_by_bucket = "ORDER BY __b" in line or "__b#" in line.split("], [")[-1]
        assert "__b" in partition_spec or ordered_by_bucket, line


def analysed(df):
    """Plan before adaptive execution, without broadcasts."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_one_join_per_key_set(spark):
    """Also before adaptive execution: n key sets cost n joins of the rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, joins in (("click_position_tab", 5), ("first_last_gap", 4), ("rolling_neighbor_counts", 3), ("expose_ratio", 2)):
            plan = analysed(QUERIES[name](spark, SF_SMALL))
            assert plan.count("SortMergeJoin") == joins, (name, plan.count("SortMergeJoin"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_positions_are_hash_aggregates_with_two_shuffles_per_key_set(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, key_sets in (("click_position_tab", 5), ("first_last_gap", 4)):
            plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            assert "SortAggregate" not in plan, name
            assert plan.count("Exchange hashpartitioning") == 2 * key_sets, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_single_pass_queries_read_no_dimension(spark):
    plan = executed_plan(QUERIES["row_count"](spark, SF_SMALL))
    assert "events.parquet" in plan and not any(t in plan for t in ("part.parquet", "customer.parquet", "supplier.parquet"))


def test_label_codes_read_their_own_column(spark):
    plan = executed_plan(QUERIES["label_encode"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(__c" in plan


def test_no_private_checkpoint_folder_on_a_cluster():
    from clickwright.session import checkpoint_dir, is_local

    assert is_local("local[8]") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn") and not is_local("spark://h:7077")

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    import pytest

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_rows_move_before_they_carry_what_row_expressions_make(spark):
    from clickwright.operators import preprocess as pp

    kinds = "instance_id long, item_id long, user_id long, context_timestamp long, day int, item_category_list string, item_property_list string, predict_category_property string"
    rows = [(i, i % 3, i % 2 or None, 1_400_000_000 + i, 1, f"1;{i % 2}", f"{i % 4};7", "1:7;") for i in range(8)]
    out = pp.preprocess(spark.createDataFrame(rows, kinds), property_tokens=[7, 2])
    assert out.columns == [
        "user_id", "item_id", "instance_id", "context_timestamp", "day", "item_category_list", "item_property_list", "predict_category_property",
        "hour", "minute", "maphour", "mapmin", "secondLevelCatagory_Most_Freq", "preperty_7", "preperty_2", "hitCategory", "hitProperty"]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Join" in plan and "preperty_" not in plan.split("Join", 1)[1] and "maphour" not in plan.split("Join", 1)[1]
    got = {r.instance_id: (r.user_id, r.item_id, r.preperty_7, r.preperty_2, r.hitProperty) for r in out.collect()}
    assert got[2] == (1, 2, True, True, got[2][4]) and got[1][:4] == (0, 1, True, False)


def test_key_sets_of_more_columns_are_joined_first(spark):
    from clickwright.operators.grouped import KeyedFeatures

    df = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 2, 6), (3, 2, 2, 7)], "id int, a int, b int, v int")
    batch = KeyedFeatures().add(["a"], {"__x": F.sum("v")}, {"by_a": F.col("__x")}).add(["a", "b"], {"__y": F.sum("v")}, {"by_ab": F.col("__y")})
    out = batch.apply(df)
    assert out.columns == ["id", "a", "b", "v", "by_a", "by_ab"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, 5, 11, 5), (2, 1, 2, 6, 11, 6), (3, 2, 2, 7, 7, 7)]
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 2)
    assert top[1].splitlines()[0].count(" = ") == 1 and top[2].splitlines()[0].count(" = ") == 2
