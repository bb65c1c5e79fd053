"""Exploratory reports: state and service tables, counts, drivers and insights."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate import schemas
from stayrate.functions import measures as m
from stayrate.functions import rules
from stayrate.operators import stats


def rate_vs_volume(customers: DataFrame, place: str, top: int,
                   min_customers: int = 0) -> DataFrame:
    """Places leading by churn rate (given enough accounts) and by churned accounts."""
    places = m.churn_summary(customers, place).withColumn(
        "Active_Customers", F.col("Total_Customers") - F.col("Churned_Customers"))

    def leaders(df: DataFrame, measure: str, label: str) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.desc(measure), place))
        return (df.withColumns({"Ranking": F.lit(label), "Position": rank})
                .filter(F.col("Position") <= top))

    large = places.filter(F.col("Total_Customers") >= min_customers)
    return leaders(large, "Churn_Rate_Pct", "rate").unionByName(
        leaders(places, "Churned_Customers", "volume"))


def service_churn_wide(wide: DataFrame, flags: list[str]) -> DataFrame:
    """Churn per service flag from one scan; services without subscribers are absent."""
    tall = wide.select("Churn", "Annual_Contract_Value", F.inline(F.array(*[
        F.struct(F.lit(f).alias("Service"), F.col(f).alias("_flag")) for f in flags])))
    return (tall.filter(F.col("_flag") == 1).groupBy("Service").agg(
        m.total().alias("Customers"), m.churn_rate().alias("Churn_Rate_Pct"),
        m.churned_revenue().alias("Revenue_at_Risk"))
        .orderBy(F.desc("Churn_Rate_Pct"), "Service"))


def value_counts(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """Rows per value of each column in one scan; a number keeps the leading values."""
    tall = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("Column_Name"), F.col(c).cast("string").alias("Value"))
        for c in columns])))
    counts = (tall.filter(F.col("Value").isNotNull()).groupBy("Column_Name", "Value")
              .agg(F.count(F.lit(1)).alias("Customers")))
    limited = {c: n for c, n in columns.items() if n}
    result = counts.filter(~F.col("Column_Name").isin(list(limited))) if limited else counts
    for c, n in limited.items():
        leading = counts.filter(F.col("Column_Name") == c)
        result = result.unionByName(leading.orderBy(F.desc("Customers"), "Value").limit(n))
    return result


def class_balance(df: DataFrame, label: str = schemas.TARGET) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return counts.select(label, F.col("n").alias("Customers"),
                         (F.col("n") / total.scalar()).alias("Share"))


def corr_with_churn(customers: DataFrame) -> DataFrame:
    """Churn drivers by strength of their correlation with churn, undefined ones last."""
    drivers = [c for c in schemas.CHURN_DRIVERS if c != schemas.TARGET]
    pairs = stats.correlations(customers, [(c, schemas.TARGET) for c in drivers])
    return (pairs.select(F.col("Column_A").alias("Driver"), F.round("Correlation", 6).alias("Correlation"))
            .orderBy(F.desc_nulls_last(F.abs("Correlation")), "Driver"))


def collinear_pairs(customers: DataFrame, threshold: float = 0.9) -> DataFrame:
    columns = [c for c in schemas.COLLINEAR_CANDIDATES if c in customers.columns]
    pairs = stats.correlations(customers, list(combinations(columns, 2)))
    return (pairs.withColumn("Correlation", F.round("Correlation", 6))
            .filter(F.abs("Correlation") > threshold))


def _mean_if(column: Column, churn: int) -> Column:
    return F.avg(F.when(F.col("Churn") == churn, column))


def driver_gap(customers: DataFrame) -> DataFrame:
    down, csat = F.col("Downtime_Hours"), F.col("Customer_Satisfaction_Score")
    return customers.agg(
        F.round(_mean_if(down, 1), 1).alias("Downtime_Churned"),
        F.round(_mean_if(down, 0), 1).alias("Downtime_Active"),
        F.round(_mean_if(csat, 1), 2).alias("Satisfaction_Churned"),
        F.round(_mean_if(csat, 0), 2).alias("Satisfaction_Active"))


def insight_summary(customers: DataFrame, services: DataFrame) -> DataFrame:
    """The headline findings as (Insight, Name, Value): worst service, state and industry
    by rate, top reason by count, overall rate and churned contract value."""
    def leader(grouped: DataFrame, key: str, measure: str, label: str) -> DataFrame:
        # Smallest (-measure, key): the largest measure, first key on a tie.
        best = F.min(F.struct((-F.col(measure).cast("double")).alias("v"), F.col(key).alias("k")))
        return grouped.agg(best.alias("b")).select(
            F.lit(label).alias("Insight"), F.col("b.k").alias("Name"),
            (-F.col("b.v")).alias("Value"))

    reasons = (customers.filter(F.col("Churn") == 1).groupBy("Churn_Reason")
               .agg(F.count(F.lit(1)).alias("n")))
    overall = customers.agg(m.churn_rate().alias("rate"), m.churned_revenue().alias("lost"))
    totals = overall.select(F.inline(F.array(
        F.struct(F.lit("overall churn rate").alias("Insight"), F.lit("all").alias("Name"),
                 F.col("rate").alias("Value")),
        F.struct(F.lit("contract value lost").alias("Insight"), F.lit("all").alias("Name"),
                 F.col("lost").cast("double").alias("Value")))))
    return (totals
            .unionByName(leader(reasons, "Churn_Reason", "n", "top churn reason"))
            .unionByName(leader(services, "Service_Name", "Churn_Rate_Pct", "worst service"))
            .unionByName(leader(m.churn_summary(customers, "State"), "State",
                                "Churn_Rate_Pct", "worst state"))
            .unionByName(leader(m.churn_summary(customers, "Industry"), "Industry",
                                "Churn_Rate_Pct", "worst industry")))


def segment_value_share(customers: DataFrame) -> DataFrame:
    """Each segment's share of accounts and of contract value, with its churn rate."""
    totals = customers.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.sum("Annual_Contract_Value").alias("v")).alias("t"))
    grouped = customers.groupBy("Customer_Segment").agg(
        m.total().alias("Customers"), F.sum("Annual_Contract_Value").alias("Portfolio_ACV"),
        m.churn_rate().alias("Churn_Rate_Pct"))
    return grouped.withColumn("_t", totals.scalar()).withColumns({
        "Pct_of_Customers": m.share(F.col("Customers"), F.col("_t.n")),
        "Pct_of_ACV": m.share(F.col("Portfolio_ACV"), F.col("_t.v")),
    }).drop("_t")


def loyal_vs_churned(customers: DataFrame) -> DataFrame:
    """Average of each metric for active and churned accounts and the gap in percent."""
    compared = {
        "Downtime_Hours": F.col("Downtime_Hours"),
        "Support_Response_Hours": F.col("Support_Response_Hours"),
        "Network_Satisfaction": F.col("Network_Satisfaction"),
        "Service_Quality_Score": F.col("Service_Quality_Score"),
        "Number_of_Services": F.col("Number_of_Services"),
        "Annual_Contract_Value": F.col("Annual_Contract_Value").cast("double"),
        "Pct_Multi_Year": F.when(F.col("Contract_Type") == "Multi-Year", 100.0).otherwise(0.0),
    }
    means = customers.agg(*[
        f for i, c in enumerate(compared.values())
        for f in (_mean_if(c, 0).alias(f"a{i}"), _mean_if(c, 1).alias(f"c{i}"))])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("Metric"), F.round(f"a{i}", 2).alias("Active"),
                 F.round(f"c{i}", 2).alias("Churned"),
                 F.round(F.try_divide(F.col(f"c{i}") - F.col(f"a{i}"), F.col(f"a{i}")) * 100, 1)
                  .alias("Gap_Pct"))
        for i, name in enumerate(compared)])))


def column_groups(df: DataFrame) -> DataFrame:
    """Which documented columns of each group the frame has, with non-null counts."""
    listed = [(g, c) for g, cols in schemas.COLUMN_GROUPS.items() for c in cols if c in df.columns]
    counted = df.agg(*[F.count(c).alias(c) for _, c in listed])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("Column_Group"), F.lit(c).alias("Column_Name"),
                 F.col(c).alias("Non_Null")) for g, c in listed])))


def reason_table(customers: DataFrame) -> DataFrame:
    """Distinct churn reasons with their category and accounts."""
    return (customers.filter(F.col("Churn_Reason").isNotNull())
            .groupBy("Churn_Reason", rules.reason_category(F.col("Churn_Reason")).alias("Category"))
            .agg(F.count(F.lit(1)).alias("Customers")))
