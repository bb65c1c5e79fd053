"""Plan shapes that decide behaviour at scale, and consistency of the tables."""

import pytest
from pyspark.sql import functions as F

from stayrate.plans import reports, retention
from stayrate.plans.catalogue import QUERIES
from stayrate.sources import accounts as derived
from stayrate.sources import staging


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_the_report_needs(spark, sf_dir):
    text = plan(reports.churn_by_sla(staging.account(spark, sf_dir)))
    assert "ReadSchema: struct<SLA_Breaches:bigint,Churn:int>" in text
    assert "GreaterThan(SLA_Breaches,0)" in text


def test_customer_joins_are_co_located(spark, sf_dir):
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = staging.account(spark, sf_dir).select("Customer_ID", "State").join(
            retention.prediction(spark, sf_dir).select("Customer_ID", "Risk_Category"), "Customer_ID")
        text = plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert "Exchange" not in text and "Bucketed: true" in text


def test_group_limit_before_the_exchange(spark, sf_dir):
    frame = reports.retention_top_by_state(
        staging.account(spark, sf_dir), retention.prediction(spark, sf_dir))
    assert "WindowGroupLimit" in plan(frame)


def test_top_reports_do_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(reports.top_churned_accounts(staging.account(spark, sf_dir)))


@pytest.mark.parametrize("name", ["retention_scores", "risk_factors", "whatif_grid", "geo_rollup",
                                  "dominant_factor", "acv_percentile_rank", "score_profiles"])
def test_no_python_and_no_cartesian(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "CartesianProduct" not in text
    assert "NestedLoop" not in text


def test_unstaged_tables_are_the_same(spark, sf_dir):
    stored = staging.account(spark, sf_dir)
    lazy = derived.derive_accounts(spark, sf_dir, derived.derive_usage(spark, sf_dir))
    assert stored.exceptAll(lazy).count() == 0 and lazy.exceptAll(stored).count() == 0


def test_groups_add_up(spark, sf_dir):
    total = staging.account(spark, sf_dir).count()
    states = reports.churn_by_state(staging.account(spark, sf_dir))
    assert states.agg(F.sum("Total_Customers")).first()[0] == total
    tiers = QUERIES["risk_distribution"](spark, sf_dir)
    assert tiers.agg(F.sum("Customers")).first()[0] == total
    shares = QUERIES["churn_by_reason"](spark, sf_dir).agg(F.sum("Pct_of_Churn")).first()[0]
    assert shares == pytest.approx(100, abs=0.1)
    flags = staging.account_wide(spark, sf_dir).agg(
        F.sum(sum(F.col(c) for c in staging.flag_services(spark, sf_dir)))).first()[0]
    assert QUERIES["services_bridge"](spark, sf_dir).count() == flags


def test_few_scans_for_ranks(spark, sf_dir):
    """Ranks are written once: the rows are read again only to receive them."""
    text = plan(QUERIES["acv_percentile_rank"](spark, sf_dir))
    assert text.count("FileScan parquet") <= 3, text


def test_line_joins_carry_no_flag_texts(spark, sf_dir):
    """Two small flags go through the joins of the line items, and the days once known."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = derived.derive_usage(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[:plan.index("Join Inner, (l_orderkey")]
    assert "l_returnflag" not in above and "l_linestatus" not in above and "l_shipdate#" not in above.split("datediff")[0]
