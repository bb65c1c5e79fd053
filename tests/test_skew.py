"""The same answers when one customer and one part hold a third of all rows."""

import pytest

import __spark_entry__ as contract
from tests.compare import TABLES, difference, duck

SKEWED = ["load_customers", "load_bridge", "churn_by_state", "churn_by_service", "complaints_p75",
          "describe_numeric", "boxplot_stats", "dedupe_keep_first", "dedupe_names",
          "acv_percentile_rank", "retention_scores", "risk_factors", "retention_top3_by_state",
          "stratified_split", "eval_metrics", "roc_curve", "duplicate_profile", "fk_orphans"]


@pytest.fixture(scope="module")
def skewed_dir(sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duck(sf_dir)
    changes = {
        "orders": "REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)",
        "lineitem": "REPLACE (CASE WHEN l_orderkey % 3 = 1 THEN 11 ELSE l_partkey END AS l_partkey)",
    }
    for name in TABLES:
        con.execute(f"COPY (SELECT * {changes.get(name, '')} FROM {name}) "
                    f"TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", SKEWED)
def test_hot_keys(spark, skewed_dir, name):
    frame = contract.queries()[name](spark, skewed_dir)
    assert difference(frame, duck(skewed_dir), contract.oracle_sql()[name]) is None
