"""Dashboard aggregates: trends, bins, drill-down, cards and exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate import schemas
from stayrate.functions import measures as m
from stayrate.functions import rules
from stayrate.session import literal_rows


def calendar(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day between the two date columns of a one-row frame, with month keys."""
    days = bounds.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("Date"))
    return days.withColumns({"Month_Key": F.date_format("Date", "yyyy-MM"),
                             "Month_Year": F.date_format("Date", "MMM yyyy")})


def monthly_churn_trend(customers: DataFrame) -> DataFrame:
    """Churned accounts per calendar month; months without churn count 0."""
    per_day = (customers.filter(F.col("Churn_Date").isNotNull()).groupBy("Churn_Date")
               .agg(F.count(F.lit(1)).alias("n")))
    bounds = per_day.agg(F.min("Churn_Date").alias("lo"), F.max("Churn_Date").alias("hi"))
    days = calendar(bounds.select(F.trunc("lo", "MM").alias("lo"), F.last_day("hi").alias("hi")),
                    "lo", "hi")
    joined = days.join(per_day, F.col("Date") == F.col("Churn_Date"), "left")
    return (joined.groupBy("Month_Key", "Month_Year")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("Churned_Customers"))
            .orderBy("Month_Key"))


def city_revenue_lost(customers: DataFrame, top: int = 10) -> DataFrame:
    cities = m.churn_summary(customers, "City", "State")
    return cities.orderBy(F.desc("Revenue_at_Risk"), "City", "State").limit(top)


def churn_by_downtime_bin(customers: DataFrame, width: int = 10) -> DataFrame:
    start = (F.floor(F.col("Downtime_Hours") / width) * width).cast("bigint").alias("Downtime_From")
    binned = customers.select(start, "Churn")
    return m.churn_summary(binned, "Downtime_From", revenue=False).orderBy("Downtime_From")


def churn_by_complaint_bucket(customers: DataFrame) -> DataFrame:
    bucket = rules.complaint_bucket(F.col("Number_of_Complaints")).alias("Complaints")
    return m.churn_summary(customers.select(bucket, "Churn"), "Complaints",
                           revenue=False).orderBy("Complaints")


def geo_rollup(customers: DataFrame) -> DataFrame:
    """Drill-down totals: overall, per state, and per city of a state.

    Cities are aggregated once; the two coarser levels are sums over the cities.
    """
    cities = customers.groupBy("State", "City").agg(
        m.total().alias("n"), m.churned().alias("c"), m.churned_revenue().alias("r"))
    return cities.rollup("State", "City").agg(
        F.grouping_id().cast("bigint").alias("Level"), F.sum("n").alias("Total_Customers"),
        F.sum("c").alias("Churned_Customers"), m.share(F.sum("c"), F.sum("n")).alias("Churn_Rate_Pct"),
        F.sum("r").alias("Revenue_at_Risk"))


def experience_grid(customers: DataFrame) -> DataFrame:
    """Network against support satisfaction in whole points, by churn outcome."""
    return customers.groupBy(
        F.floor("Network_Satisfaction").alias("Network_Satisfaction"),
        F.floor("Support_Satisfaction").alias("Support_Satisfaction"), "Churn").agg(
        m.total().alias("Customers"), F.sum("Annual_Contract_Value").alias("Portfolio_ACV"))


def kpi_overview(customers: DataFrame) -> DataFrame:
    """Overview cards; the rate of an empty slice is 0."""
    rate = F.coalesce(m.churn_rate(1), F.lit(0.0))
    lost = F.coalesce(m.churned_revenue().cast("double"), F.lit(0.0))
    return customers.agg(
        m.total().alias("Customers"), F.coalesce(m.churned(), F.lit(0)).alias("Churned"),
        rate.alias("Churn_Rate_Pct"), F.round(lost / 1e7, 1).alias("Revenue_at_Risk_Crore"))


def kpi_risk(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_if(F.col("Risk_Category") == "High").alias("High_Risk"),
        F.count_if(F.col("Risk_Category") == "Critical").alias("Critical_Risk"),
        F.round(F.avg("Churn_Probability") * 100, 1).alias("Avg_Probability_Pct"),
        F.round(F.sum("Revenue_at_Risk").cast("double") / 1e7, 1).alias("Revenue_at_Risk_Crore"))


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Accounts per tier in tier order; a tier without accounts has NULL."""
    tiers = literal_rows(scored.sparkSession, "Tier_Order BIGINT, Risk_Category STRING",
                         list(enumerate(schemas.RISK_LEVELS, 1)))
    counts = scored.groupBy("Risk_Category").agg(F.count(F.lit(1)).alias("Customers"))
    return tiers.join(counts, "Risk_Category", "left").orderBy("Tier_Order")


def active_exposure(scored: DataFrame) -> DataFrame:
    """Active accounts and predicted revenue at risk: per tier, High + Critical, and all."""
    active = scored.filter(F.col("Churn") == 0)
    scopes = F.array_compact(F.array(
        F.col("Risk_Category"),
        F.when(F.col("Risk_Category").isin("High", "Critical"), "High + Critical"),
        F.lit("All active")))
    return (active.select("Revenue_at_Risk", F.explode(scopes).alias("Scope")).groupBy("Scope")
            .agg(F.count(F.lit(1)).alias("Customers"),
                 F.sum("Revenue_at_Risk").alias("Revenue_at_Risk")))
