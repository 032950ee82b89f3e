"""Spark queries against their DuckDB oracle SQL (the driver's correctness gate, run locally)."""

import pytest
from conftest import SF_ORACLE
from oracle import compare, duck

from clickwright.plans.catalog import ORACLE, QUERIES

#: fits of some hundred trees; test_model.py fits small ones
SLOW = {"gbt_fit", "gbt_fit_early_stop", "gbt_refit", "predict_proba", "fit_feature_subset", "train_evaluate"}
FAST = sorted(n for n in ORACLE if n not in SLOW)


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF_ORACLE), ORACLE[name], con)
    assert res["ok"], res


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
