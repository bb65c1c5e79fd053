"""The business reports on customers, subscriptions and predictions.

Every ordering ends in the natural key, so ties and cut-offs are repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions import measures as m
from stayrate.functions import rules
from stayrate.operators import ranks


def by_rate(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(F.desc("Churn_Rate_Pct"), *keys)


def total_customers(customers: DataFrame) -> DataFrame:
    return customers.agg(m.total().alias("Total_Customers"))


def total_churn(customers: DataFrame) -> DataFrame:
    return customers.agg(m.churned().alias("Total_Churned_Customers"))


def churn_rate(customers: DataFrame) -> DataFrame:
    return m.churn_summary(customers, revenue=False)


def churn_by_state(customers: DataFrame) -> DataFrame:
    """Rate, volume and revenue per state, ranked both ways.

    The ranks see one row per state, so the unpartitioned windows stay small.
    """
    states = m.churn_summary(customers, "State")
    return by_rate(states.withColumns({
        "Rank_by_Rate": F.rank().over(Window.orderBy(F.desc("Churn_Rate_Pct"))),
        "Rank_by_Volume": F.rank().over(Window.orderBy(F.desc("Churned_Customers"))),
    }), "State")


def churn_by_city(customers: DataFrame, min_customers: int = 50, top: int = 15) -> DataFrame:
    cities = m.churn_summary(customers, "City", "State", revenue=False)
    return by_rate(cities.filter(F.col("Total_Customers") >= min_customers), "City", "State").limit(top)


def churn_by_service(customers: DataFrame, bridge: DataFrame, catalog: DataFrame) -> DataFrame:
    """Churn per service. Subscriptions are summed per service before the catalog joins,
    so the catalog meets one row per service and a popular service is no hot join key.
    Services that the catalog does not list stay, without a category."""
    paired = bridge.join(customers.select("Customer_ID", "Churn", "Annual_Contract_Value"),
                         "Customer_ID")
    services = paired.groupBy("Service_Name").agg(
        m.total().alias("Subscribers"), m.churned().alias("Churned_Subscribers"),
        m.churn_rate().alias("Churn_Rate_Pct"), m.churned_revenue().alias("Revenue_at_Risk"))
    return by_rate(services.join(catalog, "Service_Name", "left").select(
        "Service_Category", "Service_Name", "Subscribers", "Churned_Subscribers",
        "Churn_Rate_Pct", "Revenue_at_Risk"), "Service_Name")


def churn_by_industry(customers: DataFrame) -> DataFrame:
    return by_rate(m.churn_summary(customers, "Industry"), "Industry")


def churn_by_segment(customers: DataFrame) -> DataFrame:
    return by_rate(m.churn_summary(customers, "Customer_Segment", revenue=False),
                   "Customer_Segment")


def churn_by_contract(customers: DataFrame) -> DataFrame:
    return by_rate(m.churn_summary(customers, "Contract_Type", revenue=False), "Contract_Type")


def churn_by_size(customers: DataFrame) -> DataFrame:
    return by_rate(m.churn_summary(customers, "Company_Size", revenue=False), "Company_Size")


def _share_of_total(grouped: DataFrame, count: str, alias: str, total: DataFrame) -> DataFrame:
    """Add each row's percentage of a one-value ``total``."""
    return grouped.withColumn(alias, m.share(F.col(count), total.scalar()))


def churn_by_reason(customers: DataFrame) -> DataFrame:
    """Churned accounts per reason with its category and share of all churn."""
    churned = customers.filter(F.col("Churn") == 1)
    grouped = churned.groupBy("Churn_Reason").agg(m.total().alias("Customers"))
    labelled = grouped.withColumn("Reason_Category", F.coalesce(
        rules.reason_category(F.col("Churn_Reason")), F.lit("Other")))
    share = _share_of_total(labelled, "Customers", "Pct_of_Churn",
                            customers.agg(F.sum("Churn").alias("t")))
    return share.orderBy(F.desc("Customers"), "Churn_Reason")


def churn_by_category(customers: DataFrame) -> DataFrame:
    churned = customers.filter(F.col("Churn") == 1)
    category = rules.reason_category(F.col("Churn_Reason")).alias("Reason_Category")
    return (churned.groupBy(category).agg(m.total().alias("Customers"))
            .orderBy(F.desc("Customers"), "Reason_Category"))


def revenue_lost(customers: DataFrame) -> DataFrame:
    return customers.agg(
        m.churned_revenue().alias("Total_Revenue_Lost"),
        F.sum("Annual_Contract_Value").alias("Total_Portfolio_ACV"),
        m.share(m.churned_revenue(), F.sum("Annual_Contract_Value")).alias("Pct_Revenue_Lost"))


def top_churned_accounts(customers: DataFrame, top: int = 15) -> DataFrame:
    return (customers.filter(F.col("Churn") == 1)
            .select("Customer_ID", "Company_Name", "Industry", "State", "City",
                    "Number_of_Services", "Annual_Contract_Value", "Churn_Reason", "Churn_Date")
            .orderBy(F.desc("Annual_Contract_Value"), "Customer_ID").limit(top))


def active_profile(customers: DataFrame) -> DataFrame:
    def mean(c: str, alias: str):
        return F.round(F.avg(c), 2).alias(alias)
    return customers.filter(F.col("Churn") == 0).agg(
        m.total().alias("Active_Customers"), mean("Years_With_Provider", "Avg_Tenure_Years"),
        mean("Customer_Satisfaction_Score", "Avg_Satisfaction"),
        mean("Network_Uptime", "Avg_Network_Uptime"),
        mean("Number_of_Services", "Avg_Services_Subscribed"),
        F.sum("Annual_Contract_Value").alias("Total_Active_ACV"))


def high_risk_customers(customers: DataFrame, predictions: DataFrame, top: int = 50) -> DataFrame:
    flagged = predictions.filter(F.col("Risk_Category").isin("High", "Critical")).select(
        "Customer_ID", "Churn_Probability", "Risk_Category", "Revenue_at_Risk",
        "Main_Risk_Factor", "Recommended_Action")
    who = customers.select("Customer_ID", "Company_Name", "Industry", "State", "City")
    return (who.join(flagged, "Customer_ID")
            .orderBy(F.desc("Revenue_at_Risk"), "Customer_ID").limit(top))


def complaints_p75(customers: DataFrame, share: float = 0.75, top: int = 100) -> DataFrame:
    """Accounts at or above the smallest complaint count whose PERCENT_RANK is >= share."""
    cut = ranks.running_counts(customers, ["Number_of_Complaints"]).agg(
        ranks.value_reaching(ranks.percent_rank(), share).alias("cut")).first()["cut"]
    chosen = customers.select(
        "Customer_ID", "Company_Name", "Number_of_Complaints", "Number_of_Service_Tickets",
        "Churn", "Customer_Satisfaction_Score")
    chosen = chosen.filter(F.col("Number_of_Complaints") >= F.lit(cut))
    return chosen.orderBy(F.desc("Number_of_Complaints"), "Customer_ID").limit(top)


def churn_by_sla(customers: DataFrame) -> DataFrame:
    return (customers.groupBy("SLA_Breaches").agg(
        m.total().alias("Customers"), m.churned().alias("Churned"),
        m.churn_rate().alias("Churn_Rate_Pct"))
        .filter(F.col("SLA_Breaches") > 0).orderBy(F.desc("SLA_Breaches")))


def churned_vs_active(customers: DataFrame) -> DataFrame:
    averages = {"Avg_Satisfaction": "Customer_Satisfaction_Score", "Avg_NPS": "NPS_Score",
                "Avg_Network_Satisfaction": "Network_Satisfaction",
                "Avg_Support_Satisfaction": "Support_Satisfaction",
                "Avg_Downtime_Hours": "Downtime_Hours",
                "Avg_Support_Response_Hours": "Support_Response_Hours"}
    status = rules.churn_status(F.col("Churn")).alias("Customer_Status")
    return customers.groupBy(status).agg(
        m.total().alias("Customers"),
        *[F.round(F.avg(c), 2).alias(alias) for alias, c in averages.items()])


def retention_top_by_state(customers: DataFrame, predictions: DataFrame, top: int = 3) -> DataFrame:
    """The riskiest active accounts of each state. The rank filter becomes a per-task
    group limit, so a state with many accounts sends only ``top`` rows per task."""
    active = customers.filter(F.col("Churn") == 0).select(
        "Customer_ID", "Company_Name", "State", "Annual_Contract_Value")
    risk = predictions.select("Customer_ID", "Churn_Probability", "Risk_Category")
    order = Window.partitionBy("State").orderBy(F.desc("Churn_Probability"), "Customer_ID")
    return (active.join(risk, "Customer_ID")
            .withColumn("State_Risk_Rank", F.row_number().over(order))
            .filter(F.col("State_Risk_Rank") <= top).orderBy("State", "State_Risk_Rank"))


def customers_with_risk(customers: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Customers with their prediction columns; unchanged where no predictions exist."""
    if predictions is None:
        return customers
    added = ["Churn_Probability", "Risk_Category", "Revenue_at_Risk", "CLV",
             "Retention_Priority_Score", "Retention_Priority_Bucket", "Main_Risk_Factor",
             "Recommended_Action"]
    return customers.join(predictions.select("Customer_ID", *added), "Customer_ID", "left")


def priority_list(customers: DataFrame, predictions: DataFrame, top: int = 25) -> DataFrame:
    """Active accounts by retention priority."""
    joined = customers_with_risk(customers.filter(F.col("Churn") == 0), predictions)
    return (joined.orderBy(F.desc_nulls_last("Retention_Priority_Score"), "Customer_ID").limit(top)
            .select("Customer_ID", "Company_Name", "Industry", "State", "Annual_Contract_Value",
                    "Churn_Probability", "Risk_Category", "Retention_Priority_Score",
                    "Retention_Priority_Bucket", "Main_Risk_Factor", "Recommended_Action"))
