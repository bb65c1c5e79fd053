"""Account tables derived from the order-history tables.

The driver data has no churn tables, so accounts, subscriptions and the service
catalog are derived from customers, their orders and line items. Counts and money are
integers or DECIMAL, and every threshold is on integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Churn reasons, indexed by customer key modulo 15.
_REASONS = [
    "Poor Network Quality", "Frequent Downtime", "Service Reliability", "Slow Customer Support",
    "Poor Service Quality", "High Pricing", "Billing Problems", "Contract Issues",
    "Competitor Offer", "Better Technology Elsewhere", "Lack of Features",
    "Migration to Cloud Provider", "Internal IT Transformation", "Business Closure", "Other",
]
_CATEGORIES = ["Connectivity", "Cloud", "Security", "Communication", "IoT"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _tenths(numerator: str, denominator: str) -> Column:
    """numerator / denominator tenths, rounded half up on integers, as a double."""
    return F.expr(f"(2 * {numerator} + {denominator}) div (2 * {denominator})").cast("double") / 10


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is summed of each line item, with its order's customer and its part's brand."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("od"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # What the joins carry is small: two flags instead of two texts, and the quantity of failed
    # lines only.
    flag = F.col("l_returnflag")
    returned = flag == "R"
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_discount",
        F.when(returned, 2).when(flag == "A", 1).otherwise(0).cast("tinyint").alias("back"),
        F.when(returned & (F.col("l_linestatus") == "F"), F.col("l_quantity")).alias("failed_qty"),
        F.coalesce(returned & (F.col("l_linestatus") == "F"), F.lit(False)).alias("failed"))
    placed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "k", "l_partkey", "l_discount", "back", "failed_qty", "failed",
        F.datediff(F.col("l_shipdate").cast("date"), F.col("od")).alias("days"))
    return (placed
            .join(part, F.col("l_partkey") == F.col("p_partkey")))


def derive_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items summed per (customer, service): the one pass over the largest join.

    Subscriptions are its keys and account measures are sums over its rows. Map-side
    combining bounds what any (customer, service) pair sends, however many lines it has.
    """
    days = F.col("days")
    return _lines(spark, sf_dir).groupBy(
        F.col("k").alias("Customer_ID"), F.col("p_brand").alias("Service_Name")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("back") == 2).alias("complaints"),
        F.count_if(F.col("back") > 0).alias("tickets"),
        F.sum(F.when(F.col("failed"), F.col("failed_qty")).otherwise(0.0)).alias("dq"),
        F.count_if("failed").alias("outages"),
        F.count_if(days > 1200).alias("late"),
        F.sum(F.abs(days)).alias("lag_days"),
        F.count_if(F.col("l_discount") == 0).alias("bill"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc_pct"))


def derive_accounts(spark: SparkSession, sf_dir: str, usage: DataFrame) -> DataFrame:
    """One row per customer that has orders with line items."""
    orders = table(spark, sf_dir, "orders")
    per_order = orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("acv"),
        F.min(F.col("o_orderdate").cast("date")).alias("first_dt"),
        F.max(F.col("o_orderdate").cast("date")).alias("last_dt"))
    as_of = orders.agg(F.max(F.col("o_orderdate").cast("date"))).scalar()
    sums = ["n_lines", "complaints", "tickets", "outages", "late", "lag_days", "bill", "disc_pct"]
    per_line = usage.groupBy(F.col("Customer_ID").alias("k")).agg(
        F.count("Service_Name").alias("nsvc"), F.min("Service_Name").alias("main_svc"),
        F.sum("dq").cast("bigint").alias("dq"), *[F.sum(c).alias(c) for c in sums])

    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    bal = F.col("c_acctbal")
    base = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(per_order, F.col("c_custkey") == per_order["k"]).drop("k")
        .join(per_line, F.col("c_custkey") == per_line["k"]).drop("k")
        .withColumn("as_of", as_of)
        .withColumns({
            "size_": F.when(bal < 2500, "Small").when(bal < 5500, "Medium")
                      .when(bal < 8500, "Large").otherwise("Enterprise"),
            "churn_": F.when(F.datediff("as_of", "last_dt") > 300, 1).otherwise(0),
            "cons_": F.when(F.col("disc_pct") > 5 * F.col("n_lines"), 1).otherwise(0),
            "csat_": F.greatest(F.lit(1.0), _tenths("100 * (n_lines - complaints)", "n_lines")),
            "resp_": _tenths("10 * lag_days", "24 * n_lines"),
            "cheaper_": _tenths("40 * disc_pct", "n_lines"),
        })
    )
    key, considered, churned = F.col("c_custkey"), F.col("cons_") == 1, F.col("churn_") == 1
    segment = (F.when(F.col("size_") == "Small", "SMB").when(F.col("size_") == "Medium", "Mid-Market")
               .when(F.col("size_") == "Large", "Large Enterprise")
               .otherwise("Strategic/Key Account"))
    threat = (F.when(~considered, "Low").when(F.col("csat_") >= 7.5, "Medium")
              .when(F.col("csat_") >= 6, "High").otherwise("Critical"))
    outages = F.col("outages").cast("double")
    return base.select(
        key.alias("Customer_ID"), F.col("c_name").alias("Company_Name"),
        F.col("size_").alias("Company_Size"), F.col("c_mktsegment").alias("Industry"),
        _pick(key % 3, ["New Business", "Existing Business", "Upsell/Expansion"]).alias("Customer_Type"),
        segment.alias("Customer_Segment"),
        F.round(F.datediff("as_of", "first_dt").cast("double") / 365.25, 1).alias("Years_With_Provider"),
        F.col("n_name").alias("State"),
        F.concat("n_name", F.lit("-C"), (key % 2).cast("string")).alias("City"),
        F.col("r_name").alias("Region"),
        F.col("nsvc").alias("Number_of_Services"), F.col("main_svc").alias("Primary_Service"),
        F.floor(F.col("acv").cast("double") / 12).cast("double").alias("Monthly_Bill"),
        F.col("acv").cast("decimal(14,2)").alias("Annual_Contract_Value"),
        _pick(key % 3, ["Monthly", "Annual", "Multi-Year"]).alias("Contract_Type"),
        (key % 37).alias("Contract_Remaining_Months"),
        F.greatest(F.lit(90.0), 100 - outages / 2).alias("Network_Uptime"),
        F.round(F.col("dq").cast("double") / 5, 1).alias("Downtime_Hours"),
        F.col("outages").alias("Number_of_Outages"),
        (5 + key % 60).cast("double").alias("Average_Latency_ms"),
        (F.col("bill").cast("double") / 4).alias("Packet_Loss_Percentage"),
        F.col("resp_").alias("Support_Response_Hours"),
        (F.col("resp_") * 4).alias("Support_Resolution_Hours"),
        F.col("complaints").alias("Number_of_Complaints"),
        F.col("tickets").alias("Number_of_Service_Tickets"),
        F.least(F.lit(6), F.col("late")).alias("SLA_Breaches"), F.col("bill").alias("Billing_Issues"),
        F.col("csat_").alias("Customer_Satisfaction_Score"),
        F.round((F.col("csat_") - 5.5) * 22).cast("int").alias("NPS_Score"),
        F.greatest(F.lit(1), 10 - F.floor((F.col("resp_") - 18) / 6)).cast("double")
         .alias("Support_Satisfaction"),
        F.greatest(F.lit(1), 10 - F.floor(outages / 2)).cast("double").alias("Network_Satisfaction"),
        F.greatest(F.lit(1), 10 - F.col("bill")).cast("double").alias("Billing_Satisfaction"),
        F.col("csat_").alias("Service_Satisfaction"),
        F.col("cons_").alias("Competitor_Considered"),
        F.when(considered, -F.col("cheaper_")).otherwise(0.0).alias("Competitor_Price_Difference"),
        F.when(considered, (55 + key % 36).cast("double") / 10).otherwise(0.0)
         .alias("Competitor_Service_Rating"),
        F.when(considered, _pick(key % 4, ["Rival A", "Rival B", "Rival C", "Rival D"]))
         .alias("Competitor_Offer"),
        threat.alias("Competitor_Threat_Level"),
        F.col("churn_").alias("Churn"), F.when(churned, F.col("last_dt")).alias("Churn_Date"),
        F.when(churned, _pick(key % 15, _REASONS)).alias("Churn_Reason"))


def subscriptions(usage: DataFrame) -> DataFrame:
    """One row per (customer, service) subscription."""
    return usage.select("Customer_ID", "Service_Name").filter(F.col("Service_Name").isNotNull())


def derive_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service dimension: one row per brand, with a category by brand number."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("Service_Name")).distinct()
    number = F.substring("Service_Name", 7, 9).cast("int") % 5
    return brands.withColumn("Service_Category", _pick(number, _CATEGORIES))


def flag_services(catalog: DataFrame) -> dict[str, str]:
    """Flag column -> service name, for every service of the catalog in order of number.

    The catalog is the service dimension; a wide table has one column per row of it.
    """
    names = [r[0] for r in catalog.select("Service_Name").filter("Service_Name IS NOT NULL").collect()]
    return {f"Service_{n.partition('#')[2]}": n
            for n in sorted(names, key=lambda n: (len(n), n))}


def with_flags(accounts: DataFrame, bridge: DataFrame, services: dict[str, str]) -> DataFrame:
    """Accounts plus one 0/1 column per service."""
    flags = bridge.groupBy("Customer_ID").agg(*[
        F.max(F.when(F.col("Service_Name") == brand, 1).otherwise(0)).alias(flag)
        for flag, brand in services.items()])
    return accounts.join(flags, "Customer_ID", "left").fillna(0, subset=list(services))


def with_defects(accounts: DataFrame) -> DataFrame:
    """Accounts with quality defects, for the validation operators.

    Accounts whose contract runs out this month appear twice, accounts without SLA
    breaches report an impossible uptime, and accounts of a considered competitor lost
    their state. ``Ingest_Order`` tells the first copy from the second.
    """
    first = accounts.withColumn("Ingest_Order", F.lit(1))
    again = (accounts.filter(F.col("Contract_Remaining_Months") == 0)
             .withColumn("Ingest_Order", F.lit(2)))
    return first.unionByName(again).withColumns({
        "Network_Uptime": F.when(F.col("SLA_Breaches") == 0, 101.0)
                           .otherwise(F.col("Network_Uptime")),
        "State": F.when(F.col("Competitor_Considered") == 0, F.col("State")),
    })


def with_broken_keys(accounts: DataFrame, bridge: DataFrame, catalog: DataFrame,
                     predictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables with key defects added, for the integrity checks; no row is removed.

    Accounts at the end of their contract, subscriptions to one service, the IoT services
    and the predictions of the critical tier are there twice. Subscriptions of churned accounts to
    an unlisted service and of unknown accounts, and predictions of unknown accounts, are
    added under negative ids.
    """
    ended = accounts.filter(F.col("Contract_Remaining_Months") == 0)
    churned = accounts.filter(F.col("Churn") == 1).select("Customer_ID")
    unlisted = churned.select("Customer_ID", F.lit("Unlisted").alias("Service_Name"))
    doubled = bridge.filter(F.col("Service_Name") == "Brand#7")
    unknown = bridge.filter(F.col("Service_Name") == "Brand#11").withColumn(
        "Customer_ID", -F.col("Customer_ID"))
    critical = predictions.filter(F.col("Risk_Category") == "Critical")
    return (accounts.unionByName(ended),
            bridge.unionByName(unlisted).unionByName(doubled).unionByName(unknown),
            catalog.unionByName(catalog.filter(F.col("Service_Category") == "IoT")),
            predictions.unionByName(critical).unionByName(
                critical.withColumn("Customer_ID", -F.col("Customer_ID"))))
