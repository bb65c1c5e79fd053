"""One DuckDB statement per registered query that SQL can express."""

from __future__ import annotations

from oracle.views import LOGIT, SERVICE_NUMBERS, TERM_NAMES, term_columns, using

STATEMENTS: dict[str, str] = {}


def check(name: str, views: str, body: str) -> None:
    STATEMENTS[name] = using(views, "\n" + body.strip())


RATE = "round(CAST(sum(Churn) * 100 AS DOUBLE) / count(*), 2)"
LOST = "CAST(sum(CASE WHEN Churn = 1 THEN Annual_Contract_Value ELSE 0 END) AS DOUBLE)"
CHURNED = "CAST(sum(Churn) AS BIGINT)"
AS_DOUBLE = "REPLACE (CAST(Annual_Contract_Value AS DOUBLE) AS Annual_Contract_Value)"

# --- Scans, loads and sinks
for name in ("scan_csv", "scan_csv_gz", "scan_optional"):
    check(name, "acct", f"SELECT * {AS_DOUBLE} FROM acct")
check("load_customers", "account", f"SELECT * {AS_DOUBLE} FROM account")
check("load_catalog", "catalog_", "SELECT * FROM catalog_")
check("load_bridge", "bridge", "SELECT * FROM bridge")
check("load_predictions", "prediction", """
SELECT Customer_ID, Churn_Probability, Risk_Category, Revenue_at_Risk, Main_Risk_Factor,
       Recommended_Action FROM prediction""")
check("load_counts", "account bridge catalog_ prediction", """
SELECT 'customers' AS Table_Name, count(*) AS Rows FROM account
UNION ALL SELECT 'customer_services', count(*) FROM bridge
UNION ALL SELECT 'service_catalog', count(*) FROM catalog_
UNION ALL SELECT 'churn_predictions', count(*) FROM prediction""")
for name in ("sink_predictions", "retention_scores", "retention_from_csv"):
    check(name, "prediction", "SELECT * FROM prediction")

# --- Filters and mappings
check("filter_churned", "account", """
SELECT Customer_ID, State, CAST(Annual_Contract_Value AS DOUBLE) AS Annual_Contract_Value,
       Churn_Date, Churn_Reason FROM account WHERE Churn = 1""")
check("filter_in", "prediction", """
SELECT Customer_ID, Risk_Category, Churn_Probability, Revenue_at_Risk
FROM prediction WHERE Risk_Category IN ('High', 'Critical')""")
check("slice_filter", "risk", """
SELECT Customer_ID, Industry, Customer_Segment, Risk_Category,
       CAST(Annual_Contract_Value AS DOUBLE) AS Annual_Contract_Value
FROM risk WHERE Industry IN ('BUILDING', 'MACHINERY') AND Customer_Segment IN ('SMB', 'Mid-Market')
  AND Risk_Category IN ('Medium', 'High')""")
check("filter_all_services", "account bridge", """
SELECT Customer_ID, State, Number_of_Services FROM account
WHERE Customer_ID IN (SELECT Customer_ID FROM bridge WHERE Service_Name = 'Brand#11')
  AND Customer_ID IN (SELECT Customer_ID FROM bridge WHERE Service_Name = 'Brand#23')""")
check("filter_all_flags", "wide", """
SELECT Customer_ID, Churn FROM wide WHERE Service_1 = 1 AND Service_2 = 1""")
check("slicer_values", "risk", "UNION ".join(
    f"SELECT '{c}' AS Slicer, {c} AS Value FROM risk WHERE {c} IS NOT NULL "
    for c in ("State", "City", "Industry", "Customer_Segment", "Churn_Reason", "Contract_Type",
              "Risk_Category")))
check("reason_category", "acct", """
SELECT Churn_Reason, Churn_Category AS Category, count(*) AS Customers
FROM acct WHERE Churn_Reason IS NOT NULL GROUP BY 1, 2""")
_GROUPS = {
    "Customer Info": "Customer_ID Company_Name Company_Size Industry Customer_Type "
                     "Customer_Segment Years_With_Provider",
    "Geography": "State City Region",
    "Service Usage": "Number_of_Services Primary_Service Monthly_Bill Annual_Contract_Value "
                     "Contract_Type",
    "Service Quality": "Network_Uptime Downtime_Hours SLA_Breaches Support_Response_Hours",
    "Experience": "Customer_Satisfaction_Score NPS_Score",
    "Competitor": "Competitor_Considered Competitor_Threat_Level",
    "Churn": "Churn Churn_Date Churn_Reason Churn_Category",
}
check("column_groups", "acct", " UNION ALL ".join(
    f"SELECT '{g}' AS Column_Group, '{c}' AS Column_Name, count({c}) AS Non_Null FROM acct"
    for g, cols in _GROUPS.items() for c in cols.split()))

# --- Joins
check("customers_with_risk", "risk", """
SELECT Customer_ID, State, Churn, Churn_Probability, Risk_Category, Revenue_at_Risk, CLV,
  Retention_Priority_Score, Retention_Priority_Bucket, Main_Risk_Factor, Recommended_Action
FROM risk""")
check("risk_distribution", "prediction", """
SELECT Tier_Order, t.Risk_Category, n AS Customers
FROM (VALUES (CAST(1 AS BIGINT), 'Low'), (2, 'Medium'), (3, 'High'), (4, 'Critical'))
       t(Tier_Order, Risk_Category)
LEFT JOIN (SELECT Risk_Category, count(*) AS n FROM prediction GROUP BY 1) c
  ON c.Risk_Category = t.Risk_Category""")

# --- Business reports
check("total_customers", "account", "SELECT count(*) AS Total_Customers FROM account")
check("total_churn", "account", f"SELECT {CHURNED} AS Total_Churned_Customers FROM account")
check("churn_rate", "account", f"""
SELECT count(*) AS Total_Customers, {CHURNED} AS Churned_Customers, {RATE} AS Churn_Rate_Pct
FROM account""")
check("churn_by_state", "account", f"""
SELECT *, rank() OVER (ORDER BY Churn_Rate_Pct DESC) AS Rank_by_Rate,
  rank() OVER (ORDER BY Churned_Customers DESC) AS Rank_by_Volume
FROM (SELECT State, count(*) AS Total_Customers, {CHURNED} AS Churned_Customers,
             {RATE} AS Churn_Rate_Pct, {LOST} AS Revenue_at_Risk FROM account GROUP BY State)""")
check("churn_by_city", "account", f"""
SELECT City, State, count(*) AS Total_Customers, {CHURNED} AS Churned_Customers,
       {RATE} AS Churn_Rate_Pct
FROM account GROUP BY City, State HAVING count(*) >= 25
ORDER BY Churn_Rate_Pct DESC, City, State LIMIT 15""")
check("churn_by_service", "account bridge catalog_", f"""
SELECT Service_Category, b.Service_Name, count(*) AS Subscribers,
  {CHURNED} AS Churned_Subscribers, {RATE} AS Churn_Rate_Pct, {LOST} AS Revenue_at_Risk
FROM bridge b JOIN account a ON a.Customer_ID = b.Customer_ID
LEFT JOIN catalog_ c ON c.Service_Name = b.Service_Name GROUP BY 1, 2""")
check("churn_by_industry", "account", f"""
SELECT Industry, count(*) AS Total_Customers, {CHURNED} AS Churned_Customers,
       {RATE} AS Churn_Rate_Pct, {LOST} AS Revenue_at_Risk FROM account GROUP BY Industry""")
for name, key in (("churn_by_segment", "Customer_Segment"), ("churn_by_contract", "Contract_Type"),
                  ("churn_by_size", "Company_Size")):
    check(name, "account", f"""
SELECT {key}, count(*) AS Total_Customers, {CHURNED} AS Churned_Customers,
       {RATE} AS Churn_Rate_Pct FROM account GROUP BY {key}""")
check("churn_by_reason", "acct", """
SELECT Churn_Reason, Churn_Category AS Reason_Category, count(*) AS Customers,
  round(count(*) * 100.0 / (SELECT sum(Churn) FROM acct), 2) AS Pct_of_Churn
FROM acct WHERE Churn = 1 GROUP BY 1, 2""")
check("churn_by_category", "acct", """
SELECT Churn_Category AS Reason_Category, count(*) AS Customers
FROM acct WHERE Churn = 1 GROUP BY 1""")
check("revenue_lost", "account", f"""
SELECT {LOST} AS Total_Revenue_Lost,
  CAST(sum(Annual_Contract_Value) AS DOUBLE) AS Total_Portfolio_ACV,
  round({LOST} * 100 / CAST(sum(Annual_Contract_Value) AS DOUBLE), 2) AS Pct_Revenue_Lost
FROM account""")
check("top_churned_accounts", "account", """
SELECT Customer_ID, Company_Name, Industry, State, City, Number_of_Services,
  CAST(Annual_Contract_Value AS DOUBLE) AS Annual_Contract_Value, Churn_Reason, Churn_Date
FROM account WHERE Churn = 1
ORDER BY account.Annual_Contract_Value DESC, Customer_ID LIMIT 15""")
check("active_profile", "account", """
SELECT count(*) AS Active_Customers, round(avg(Years_With_Provider), 2) AS Avg_Tenure_Years,
  round(avg(Customer_Satisfaction_Score), 2) AS Avg_Satisfaction,
  round(avg(Network_Uptime), 2) AS Avg_Network_Uptime,
  round(avg(Number_of_Services), 2) AS Avg_Services_Subscribed,
  CAST(sum(Annual_Contract_Value) AS DOUBLE) AS Total_Active_ACV
FROM account WHERE Churn = 0""")
check("high_risk_customers", "prediction", """
SELECT Customer_ID, Company_Name, Industry, State, City, Churn_Probability, Risk_Category,
  Revenue_at_Risk, Main_Risk_Factor, Recommended_Action
FROM prediction WHERE Risk_Category IN ('High', 'Critical')
ORDER BY Revenue_at_Risk DESC, Customer_ID LIMIT 50""")
check("complaints_p75", "account", """
SELECT Customer_ID, Company_Name, Number_of_Complaints, Number_of_Service_Tickets, Churn,
  Customer_Satisfaction_Score FROM account
WHERE Number_of_Complaints >= (
  SELECT min(Number_of_Complaints) FROM (
    SELECT Number_of_Complaints, percent_rank() OVER (ORDER BY Number_of_Complaints) AS r
    FROM account) WHERE r >= 0.75)
ORDER BY Number_of_Complaints DESC, Customer_ID LIMIT 100""")
check("churn_by_sla", "account", f"""
SELECT SLA_Breaches, count(*) AS Customers, {CHURNED} AS Churned, {RATE} AS Churn_Rate_Pct
FROM account GROUP BY SLA_Breaches HAVING SLA_Breaches > 0""")
check("churned_vs_active", "account", """
SELECT CASE WHEN Churn = 1 THEN 'Churned' ELSE 'Active' END AS Customer_Status,
  count(*) AS Customers, round(avg(Customer_Satisfaction_Score), 2) AS Avg_Satisfaction,
  round(avg(NPS_Score), 2) AS Avg_NPS,
  round(avg(Network_Satisfaction), 2) AS Avg_Network_Satisfaction,
  round(avg(Support_Satisfaction), 2) AS Avg_Support_Satisfaction,
  round(avg(Downtime_Hours), 2) AS Avg_Downtime_Hours,
  round(avg(Support_Response_Hours), 2) AS Avg_Support_Response_Hours
FROM account GROUP BY Churn""")
check("retention_top3_by_state", "risk", """
SELECT Customer_ID, Company_Name, State, CAST(Annual_Contract_Value AS DOUBLE) AS Annual_Contract_Value,
  Churn_Probability, Risk_Category, rn AS State_Risk_Rank
FROM (SELECT *, row_number() OVER (PARTITION BY State
                                   ORDER BY Churn_Probability DESC, Customer_ID) AS rn
      FROM risk WHERE Churn = 0) WHERE rn <= 3""")
check("priority_list", "risk", """
SELECT Customer_ID, Company_Name, Industry, State,
  CAST(Annual_Contract_Value AS DOUBLE) AS Annual_Contract_Value, Churn_Probability,
  Risk_Category, Retention_Priority_Score, Retention_Priority_Bucket, Main_Risk_Factor,
  Recommended_Action
FROM risk WHERE Churn = 0 ORDER BY Retention_Priority_Score DESC, Customer_ID LIMIT 25""")

# --- Exploration
for name, key, top, least in (("state_rate_vs_volume", "State", 10, 0),
                              ("city_rate_vs_volume", "City", 15, 25)):
    check(name, "account", f"""
, s AS (SELECT {key}, count(*) AS Total_Customers, {CHURNED} AS Churned_Customers,
          {RATE} AS Churn_Rate_Pct, {LOST} AS Revenue_at_Risk,
          count(*) - {CHURNED} AS Active_Customers FROM account GROUP BY {key})
SELECT *, 'rate' AS Ranking, row_number() OVER (ORDER BY Churn_Rate_Pct DESC, {key}) AS Position
FROM s WHERE Total_Customers >= {least} QUALIFY Position <= {top}
UNION ALL
SELECT *, 'volume', row_number() OVER (ORDER BY Churned_Customers DESC, {key}) AS Position
FROM s QUALIFY Position <= {top}""")
check("service_churn_wide", "wide", " UNION ALL ".join(
    f"SELECT 'Service_{i}' AS Service, count(*) AS Customers, {RATE} AS Churn_Rate_Pct, "
    f"{LOST} AS Revenue_at_Risk FROM wide WHERE Service_{i} = 1 HAVING count(*) > 0"
    for i in SERVICE_NUMBERS))
check("value_counts", "account", """
SELECT Column_Name, Value, Customers FROM (
  SELECT Column_Name, Value, count(*) AS Customers,
    row_number() OVER (PARTITION BY Column_Name ORDER BY count(*) DESC, Value) AS Position
  FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS Column_Name, CAST({c} AS VARCHAR) AS Value FROM account"
    for c in ("Company_Size", "Customer_Segment", "Industry", "Contract_Type", "Churn")) + """)
  GROUP BY 1, 2)
WHERE Column_Name <> 'Industry' OR Position <= 10""")
check("class_balance", "account", """
SELECT Churn, count(*) AS Customers,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM account), 6) AS Share
FROM account GROUP BY Churn""")
_KEY = ("Years_With_Provider", "Monthly_Bill", "Annual_Contract_Value", "Network_Uptime",
        "Downtime_Hours", "Support_Response_Hours", "Customer_Satisfaction_Score", "NPS_Score")
check("describe_numeric", "account", " UNION ALL ".join(f"""
SELECT '{c}' AS Column_Name, count(x) AS Count, round(avg(x), 6) AS Mean,
  round(stddev_samp(x), 6) AS Std, min(x) AS Min, max(x) AS Max,
  round(quantile_cont(x, 0.25), 6) AS Q25, round(quantile_cont(x, 0.5), 6) AS Q50,
  round(quantile_cont(x, 0.75), 6) AS Q75
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM account)""" for c in _KEY))
_FULL_COLUMNS = """
Customer_ID Company_Name Company_Size Industry Customer_Type Customer_Segment Years_With_Provider
State City Region Number_of_Services Primary_Service Monthly_Bill Annual_Contract_Value
Contract_Type Contract_Remaining_Months Network_Uptime Downtime_Hours Number_of_Outages
Average_Latency_ms Packet_Loss_Percentage Support_Response_Hours Support_Resolution_Hours
Number_of_Complaints Number_of_Service_Tickets SLA_Breaches Billing_Issues
Customer_Satisfaction_Score NPS_Score Support_Satisfaction Network_Satisfaction
Billing_Satisfaction Service_Satisfaction Competitor_Considered Competitor_Price_Difference
Competitor_Service_Rating Competitor_Offer Competitor_Threat_Level Churn Churn_Date Churn_Reason
Service_Quality_Score Churn_Category""".split()


def neutral_type(column: str) -> str:
    """What a column holds, from the type that this engine gives it."""
    return f"""CASE WHEN any_value(typeof({column})) IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer'
      WHEN any_value(typeof({column})) IN ('FLOAT', 'DOUBLE') THEN 'number'
      WHEN any_value(typeof({column})) LIKE 'DECIMAL%' THEN 'decimal'
      WHEN any_value(typeof({column})) = 'VARCHAR' THEN 'text'
      WHEN any_value(typeof({column})) = 'DATE' THEN 'date' ELSE 'other' END"""


check("profile_schema", "acct", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS Position, '{c}' AS Column_Name, {neutral_type(c)} AS Data_Type, "
    f"count({c}) AS Non_Null FROM acct" for i, c in enumerate(_FULL_COLUMNS, 1)))
check("histogram", "account", " UNION ALL ".join(f"""
SELECT '{c}' AS Column_Name, b AS Bin, round(lo + b * ((hi - lo) / {n}), 6) AS Bin_Start,
  count(*) AS Customers
FROM (SELECT lo, hi, CAST(least({n} - 1, floor(({c} - lo) * {n} / (hi - lo))) AS BIGINT) AS b
      FROM account, (SELECT min({c}) AS lo, max({c}) AS hi FROM account))
GROUP BY b, lo, hi""" for c, n in (("Network_Uptime", 40), ("Customer_Satisfaction_Score", 20))))
check("boxplot_stats", "account", """
, v AS (SELECT Churn, 'Downtime_Hours' AS c, Downtime_Hours AS x FROM account
        UNION ALL SELECT Churn, 'Customer_Satisfaction_Score', Customer_Satisfaction_Score FROM account),
q AS (SELECT Churn, c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2,
             quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1, 2),
f AS (SELECT v.*, q1, q2, q3,
             x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM v JOIN q ON q.Churn = v.Churn AND q.c = v.c)
SELECT Churn, c AS Column_Name, round(any_value(q1), 6) AS Q1, round(any_value(q2), 6) AS Median,
  round(any_value(q3), 6) AS Q3, min(x) FILTER (inside) AS Whisker_Low,
  max(x) FILTER (inside) AS Whisker_High, count(*) FILTER (NOT inside) AS Outliers
FROM f GROUP BY 1, 2""")
_DRIVERS = ("Downtime_Hours", "Number_of_Outages", "SLA_Breaches", "Support_Response_Hours",
            "Support_Resolution_Hours", "Number_of_Complaints", "Billing_Issues",
            "Packet_Loss_Percentage", "Average_Latency_ms", "Customer_Satisfaction_Score",
            "NPS_Score", "Network_Uptime", "Years_With_Provider", "Number_of_Services",
            "Service_Quality_Score", "Churn")
check("corr_matrix", "acct", ", mtx AS (SELECT " + ", ".join(
    f"round(corr({a}, {b}), 6) AS \"{a}|{b}\"" for a in _DRIVERS for b in _DRIVERS)
    + " FROM acct) " + " UNION ALL ".join(
    f"SELECT '{a}' AS Column_A, '{b}' AS Column_B, \"{a}|{b}\" AS Correlation FROM mtx"
    for a in _DRIVERS for b in _DRIVERS))
check("corr_with_churn", "acct", " UNION ALL ".join(
    f"SELECT '{c}' AS Driver, round(corr({c}, Churn), 6) AS Correlation FROM acct"
    for c in _DRIVERS if c != "Churn"))
_NEAR = ("Annual_Contract_Value", "Monthly_Bill", "Number_of_Complaints",
         "Number_of_Service_Tickets", "Support_Response_Hours", "Support_Resolution_Hours")
check("collinear_pairs", "account", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS Column_A, '{b}' AS Column_B, "
    f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS Correlation FROM account"
    for i, a in enumerate(_NEAR) for b in _NEAR[i + 1:]) + ") WHERE abs(Correlation) > 0.9")
check("driver_gap", "account", """
SELECT round(avg(Downtime_Hours) FILTER (Churn = 1), 1) AS Downtime_Churned,
  round(avg(Downtime_Hours) FILTER (Churn = 0), 1) AS Downtime_Active,
  round(avg(Customer_Satisfaction_Score) FILTER (Churn = 1), 2) AS Satisfaction_Churned,
  round(avg(Customer_Satisfaction_Score) FILTER (Churn = 0), 2) AS Satisfaction_Active
FROM account""")
check("segment_value_share", "account", f"""
SELECT Customer_Segment, count(*) AS Customers,
  CAST(sum(Annual_Contract_Value) AS DOUBLE) AS Portfolio_ACV, {RATE} AS Churn_Rate_Pct,
  round(count(*) * 100.0 / (SELECT count(*) FROM account), 2) AS Pct_of_Customers,
  round(CAST(sum(Annual_Contract_Value) * 100 AS DOUBLE)
        / (SELECT CAST(sum(Annual_Contract_Value) AS DOUBLE) FROM account), 2) AS Pct_of_ACV
FROM account GROUP BY Customer_Segment""")
check("loyal_vs_churned", "acct", " UNION ALL ".join(f"""
SELECT '{n}' AS Metric, round(a, 2) AS Active, round(c, 2) AS Churned,
       round((c - a) / a * 100, 1) AS Gap_Pct
FROM (SELECT avg(x) FILTER (Churn = 0) AS a, avg(x) FILTER (Churn = 1) AS c
      FROM (SELECT Churn, CAST({x} AS DOUBLE) AS x FROM acct))""" for n, x in (
    ("Downtime_Hours", "Downtime_Hours"), ("Support_Response_Hours", "Support_Response_Hours"),
    ("Network_Satisfaction", "Network_Satisfaction"),
    ("Service_Quality_Score", "Service_Quality_Score"),
    ("Number_of_Services", "Number_of_Services"),
    ("Annual_Contract_Value", "Annual_Contract_Value"),
    ("Pct_Multi_Year", "CASE WHEN Contract_Type = 'Multi-Year' THEN 100 ELSE 0 END"))))
check("insight_summary", "account bridge", f"""
SELECT 'overall churn rate' AS Insight, 'all' AS Name, {RATE} AS Value FROM account
UNION ALL SELECT 'contract value lost', 'all', {LOST} FROM account
UNION ALL (SELECT 'top churn reason', Churn_Reason, CAST(count(*) AS DOUBLE) FROM account
  WHERE Churn = 1 GROUP BY Churn_Reason ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL (SELECT 'worst service', Service_Name, {RATE} FROM bridge b
  JOIN account a ON a.Customer_ID = b.Customer_ID GROUP BY Service_Name ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL (SELECT 'worst state', State, {RATE} FROM account GROUP BY State ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL (SELECT 'worst industry', Industry, {RATE} FROM account GROUP BY Industry
  ORDER BY 3 DESC, 2 LIMIT 1)""")

# --- Data quality
_NULL_COLUMNS = [*_FULL_COLUMNS, "Ingest_Order"]
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS Column_Name, count(*) - count({c}) AS Null_Count, count(*) AS n FROM dirty"
    for c in _NULL_COLUMNS)
_EXPECTED = "Column_Name IN ('Churn_Date', 'Churn_Reason', 'Churn_Category', 'Competitor_Offer')"
check("null_profile", "dirty", f"""
SELECT Column_Name, Null_Count, round(Null_Count * 100.0 / n, 2) AS Null_Pct,
       {_EXPECTED} AS Expected
FROM ({_NULLS}) WHERE Null_Count > 0""")
_BEYOND_KEY = "SELECT count(*) - count(DISTINCT Customer_ID) FROM dirty"
_BEYOND_ROW = ("SELECT (SELECT count(*) FROM dirty) - count(*) FROM "
               "(SELECT DISTINCT * EXCLUDE (Ingest_Order) FROM dirty)")
check("duplicate_profile", "dirty", f"""
SELECT 'key' AS Scope, ({_BEYOND_KEY}) AS Duplicates
UNION ALL SELECT 'row', ({_BEYOND_ROW})""")
_BOUNDS = (("Network_Uptime", 90, 100), ("Customer_Satisfaction_Score", 1, 10),
           ("NPS_Score", -100, 100), ("Support_Satisfaction", 1, 10),
           ("Network_Satisfaction", 1, 10), ("Billing_Satisfaction", 1, 10),
           ("Service_Satisfaction", 1, 10))
_RANGES = " UNION ALL ".join(
    f"SELECT '{c}' AS Metric, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS Violations FROM dirty"
    for c, lo, hi in _BOUNDS)
check("range_violations", "dirty", f"SELECT * FROM ({_RANGES}) WHERE Violations > 0")
check("fill_structural_nulls", "dirty", """
SELECT Customer_ID, Ingest_Order, coalesce(Churn_Reason, 'Not Churned') AS Churn_Reason,
  coalesce(Churn_Category, 'Not Churned') AS Churn_Category,
  coalesce(Competitor_Offer, 'None') AS Competitor_Offer, Churn_Date FROM dirty""")
check("dedupe_keep_first", "dirty", """
SELECT Customer_ID, Ingest_Order, State, Network_Uptime,
       CAST(Annual_Contract_Value AS DOUBLE) AS Annual_Contract_Value
FROM dirty QUALIFY row_number() OVER (PARTITION BY Customer_ID ORDER BY Ingest_Order) = 1""")
check("iqr_outliers", "account", """
, q AS (SELECT quantile_cont(CAST(Annual_Contract_Value AS DOUBLE), 0.25) AS q1,
               quantile_cont(CAST(Annual_Contract_Value AS DOUBLE), 0.75) AS q3 FROM account)
SELECT Customer_ID, CAST(Annual_Contract_Value AS DOUBLE) AS Annual_Contract_Value,
  CAST(account.Annual_Contract_Value AS DOUBLE) < q1 - 1.5 * (q3 - q1)
  OR CAST(account.Annual_Contract_Value AS DOUBLE) > q3 + 1.5 * (q3 - q1) AS Is_Outlier
FROM account, q""")
check("validation_report", "dirty", f"""
SELECT 'rows' AS Check_Name, 'loaded' AS Item, count(*) AS Value FROM dirty
UNION ALL SELECT CASE WHEN {_EXPECTED} THEN 'null_expected' ELSE 'null_unexpected' END,
  Column_Name, Null_Count FROM ({_NULLS}) WHERE Null_Count > 0
UNION ALL SELECT 'duplicate', 'key', ({_BEYOND_KEY})
UNION ALL SELECT 'duplicate', 'row', ({_BEYOND_ROW})
UNION ALL SELECT 'range', Metric, Violations FROM ({_RANGES}) WHERE Violations > 0""")
check("validated_accounts", "dirty", """
SELECT Customer_ID, State, Network_Uptime, coalesce(Churn_Reason, 'Not Churned') AS Churn_Reason,
  coalesce(Churn_Category, 'Not Churned') AS Churn_Category,
  coalesce(Competitor_Offer, 'None') AS Competitor_Offer
FROM dirty QUALIFY row_number() OVER (PARTITION BY Customer_ID ORDER BY Ingest_Order) = 1""")
check("fk_orphans", "account bridge catalog_ prediction", """,
customers AS (SELECT Customer_ID FROM account
  UNION ALL SELECT Customer_ID FROM account WHERE Contract_Remaining_Months = 0),
listed AS (SELECT Service_Name FROM catalog_
  UNION ALL SELECT Service_Name FROM catalog_ WHERE Service_Category = 'IoT'),
held AS (SELECT Customer_ID, Service_Name FROM bridge
  UNION ALL SELECT Customer_ID, 'Unlisted' FROM account WHERE Churn = 1
  UNION ALL SELECT Customer_ID, Service_Name FROM bridge WHERE Service_Name = 'Brand#7'
  UNION ALL SELECT -Customer_ID, Service_Name FROM bridge WHERE Service_Name = 'Brand#11'),
predicted AS (SELECT Customer_ID FROM prediction
  UNION ALL SELECT Customer_ID FROM prediction WHERE Risk_Category = 'Critical'
  UNION ALL SELECT -Customer_ID FROM prediction WHERE Risk_Category = 'Critical')
SELECT 'pk_customers' AS Constraint_Name, count(*) - count(DISTINCT Customer_ID) AS Violations FROM customers
UNION ALL SELECT 'pk_service_catalog', count(*) - count(DISTINCT Service_Name) FROM listed
UNION ALL SELECT 'pk_customer_services', count(*) - count(DISTINCT (Customer_ID, Service_Name)) FROM held
UNION ALL SELECT 'pk_churn_predictions', count(*) - count(DISTINCT Customer_ID) FROM predicted
UNION ALL SELECT 'fk_services_customer', count(*) FROM held
  WHERE Customer_ID NOT IN (SELECT Customer_ID FROM customers)
UNION ALL SELECT 'fk_services_catalog', count(*) FROM held
  WHERE Service_Name NOT IN (SELECT Service_Name FROM listed)
UNION ALL SELECT 'fk_predictions_customer', count(*) FROM predicted
  WHERE Customer_ID NOT IN (SELECT Customer_ID FROM customers)""")

# --- Features
check("feature_clv", "prediction", "SELECT Customer_ID, CLV FROM prediction")
check("features", "account", """
SELECT Customer_ID,
  round(Number_of_Service_Tickets / (Years_With_Provider + 0.1), 6) AS Tickets_per_Tenure_Year,
  round(Number_of_Complaints * (10 - Customer_Satisfaction_Score), 6) AS Complaint_Satisfaction_Gap,
  CASE WHEN Contract_Remaining_Months <= 3 THEN 1 ELSE 0 END AS Contract_Ending_Soon,
  CASE WHEN Competitor_Considered = 1 THEN -Competitor_Price_Difference ELSE 0 END AS Price_Pressure,
  CAST(round(CAST(Downtime_Hours AS DECIMAL(8,1)) * Annual_Contract_Value
    * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DOUBLE) AS Revenue_Weighted_Downtime,
  size_rank AS Company_Size_Rank,
  round(CAST(Number_of_Services AS DOUBLE) / (size_rank + 1), 6) AS Services_per_Size_Tier
FROM (SELECT *, CASE Company_Size WHEN 'Small' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Large' THEN 2
                                  WHEN 'Enterprise' THEN 3 END AS size_rank FROM account)""")
_DROPPED = ("Customer_ID", "Company_Name", "Churn_Date", "Churn_Reason", "Churn_Category",
            "Primary_Service", "Competitor_Offer", "Monthly_Bill", "Number_of_Service_Tickets",
            "Support_Resolution_Hours", "Churn")
_MODEL = [c for c in _FULL_COLUMNS if c not in _DROPPED] + [
    "CLV", "Tickets_per_Tenure_Year", "Complaint_Satisfaction_Gap", "Contract_Ending_Soon",
    "Price_Pressure", "Revenue_Weighted_Downtime", "Company_Size_Rank", "Services_per_Size_Tier"]
# Ratios and products of the engineered inputs are numbers, flags and ranks integers.
_ENGINEERED = {"CLV": "number", "Tickets_per_Tenure_Year": "number", "Complaint_Satisfaction_Gap": "number",
               "Contract_Ending_Soon": "integer", "Price_Pressure": "number",
               "Revenue_Weighted_Downtime": "number", "Company_Size_Rank": "integer",
               "Services_per_Size_Tier": "number"}
check("feature_columns", "acct", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS Position, '{c}' AS Column_Name, "
    + (f"'{_ENGINEERED[c]}'" if c in _ENGINEERED else neutral_type(c))
    + " AS Data_Type, count(*) AS Non_Null FROM acct" for i, c in enumerate(_MODEL, 1)))
_CATS = ("Company_Size", "Industry", "Customer_Type", "Customer_Segment", "State", "City",
         "Region", "Contract_Type", "Competitor_Threat_Level")
check("one_hot", "account", " UNION ALL ".join(
    f"SELECT Customer_ID, '{c}_' || {c} AS Feature FROM account WHERE {c} IS NOT NULL"
    for c in _CATS))
for name in ("one_hot_unseen", "one_hot_sparse"):
    check(name, "account", " UNION ALL ".join(
        f"SELECT Customer_ID, '{c}_' || {c} AS Feature FROM account "
        f"WHERE {c} IN (SELECT {c} FROM account WHERE Region <> 'ASIA')"
        for c in ("State", "City", "Region")))

# --- Trained models: what must hold of them, and the sizes that the split gives
check("model_lr_optimality", "account split", "SELECT '(Intercept)' AS Feature, TRUE AS Is_Optimal" + "".join(
    f" UNION ALL SELECT '{c}', TRUE" for c in _MODEL if c not in _CATS) + "".join(
    f" UNION ALL SELECT DISTINCT '{c}_' || {c}, TRUE FROM account JOIN split USING (Customer_ID) "
    f"WHERE NOT Is_Test AND {c} IS NOT NULL" for c in _CATS))
check("model_dt_leaves", "split", """
SELECT count(*) AS Training_Rows, CAST(sum(Churn) AS BIGINT) AS Training_Churned,
  CAST(count(*) AS DOUBLE) AS Weight, TRUE AS Leaves_Large_Enough, TRUE AS Depth_Allowed
FROM split WHERE NOT Is_Test""")
check("model_artifact", "account", "SELECT Customer_ID, TRUE AS Is_Same FROM account")
check("feature_importance_checked", "account", """
SELECT r AS Rank, TRUE AS Is_Encoded, TRUE AS Is_Sorted, TRUE AS Is_Non_Negative FROM range(1, 16) t(r)""")
check("sink_report", "split", """
SELECT CAST(4 AS BIGINT) AS Models, CAST(15 AS BIGINT) AS Features,
  count(*) FILTER (NOT Is_Test) AS Train_Rows, count(*) FILTER (Is_Test) AS Test_Rows,
  TRUE AS Best_Is_First, TRUE AS Features_Sorted FROM split""")

# --- Standard scores and derived scores
check("zscore", "scored", """
SELECT Customer_ID, round((Downtime_Hours - m1) / (s1 + 1e-9), 6) AS Downtime_Hours,
  round((NPS_Score - m9) / (s9 + 1e-9), 6) AS NPS_Score FROM account, st""")
check("threat_level", "account", """
SELECT Customer_ID, CASE WHEN t <= 0.25 THEN 'Low' WHEN t <= 0.5 THEN 'Medium'
  WHEN t <= 0.75 THEN 'High' ELSE 'Critical' END AS Threat_Level
FROM (SELECT Customer_ID, greatest(0.02::DOUBLE, least(0.95::DOUBLE,
        0.15::DOUBLE + (10 - Customer_Satisfaction_Score) / 20)) AS t FROM account)""")
check("quality_score", "acct", "SELECT Customer_ID, Service_Quality_Score FROM acct")
check("nps_score", "account", """
SELECT Customer_ID, CAST(round(greatest(-100, least(100, (Customer_Satisfaction_Score - 5.5) * 22)))
  AS BIGINT) AS NPS FROM account""")
check("dominant_factor", "acct scored", """
, r AS (SELECT avg(Support_Resolution_Hours) AS mr, stddev_pop(Support_Resolution_Hours) AS sr FROM acct),
z AS (SELECT acct.*, (Network_Uptime - m10) / (s10 + 1e-9) AS z_up,
  (Packet_Loss_Percentage - m7) / (s7 + 1e-9) AS z_loss, (Downtime_Hours - m1) / (s1 + 1e-9) AS z_down,
  (Number_of_Outages - m2) / (s2 + 1e-9) AS z_out,
  (Support_Response_Hours - m4) / (s4 + 1e-9) AS z_resp,
  (Support_Resolution_Hours - mr) / (sr + 1e-9) AS z_resol,
  (Billing_Issues - m6) / (s6 + 1e-9) AS z_bill, (SLA_Breaches - m3) / (s3 + 1e-9) AS z_sla
  FROM acct, st, r WHERE Churn = 1),
f AS (
SELECT Customer_ID, 1 AS o, 'Poor Network Quality' AS name, -z_up + z_loss AS v FROM z
UNION ALL SELECT Customer_ID, 2, 'Frequent Downtime', z_down + z_out FROM z
UNION ALL SELECT Customer_ID, 3, 'Slow Customer Support', z_resp + z_resol FROM z
UNION ALL SELECT Customer_ID, 4, 'High Pricing', CASE WHEN Competitor_Price_Difference < -10 THEN 2 ELSE 0 END FROM z
UNION ALL SELECT Customer_ID, 5, 'Billing Problems', z_bill FROM z
UNION ALL SELECT Customer_ID, 6, 'Contract Issues', CASE WHEN Contract_Remaining_Months <= 2 THEN 1.8 ELSE 0 END FROM z
UNION ALL SELECT Customer_ID, 7, 'Poor Service Quality', (100 - Service_Quality_Score) / 20 FROM z
UNION ALL SELECT Customer_ID, 8, 'Competitor Offer', Competitor_Considered * 1.6 FROM z
UNION ALL SELECT Customer_ID, 9, 'Better Technology Elsewhere', CASE WHEN Competitor_Considered = 1 THEN Competitor_Service_Rating / 3 ELSE 0 END FROM z
UNION ALL SELECT Customer_ID, 10, 'Service Reliability', z_sla FROM z)
SELECT Customer_ID, name AS Dominant_Factor, round(v, 6) AS Dominant_Factor_Score
FROM f QUALIFY row_number() OVER (PARTITION BY Customer_ID ORDER BY round(v, 6) DESC, o) = 1""")
check("dedupe_names", "account", """
SELECT Customer_ID, CASE WHEN rn = 1 THEN Name ELSE Name || ' ' || rn END AS Unique_Name
FROM (SELECT Customer_ID, Name, row_number() OVER (PARTITION BY Name ORDER BY Customer_ID) AS rn
      FROM (SELECT Customer_ID, Industry || ' ' || Company_Size AS Name FROM account))""")
check("services_bridge", "bridge", """
SELECT Customer_ID, 'Service_' || substr(Service_Name, 7) AS Service_Name FROM bridge""")

# --- Scoring
check("scorecard", "scored", "SELECT Customer_ID, Churn_Probability FROM scored")
for name, columns in (
        ("risk_tier", "Churn_Probability, Risk_Category"), ("revenue_at_risk", "Revenue_at_Risk"),
        ("priority_score", "CLV, Retention_Priority_Score"),
        ("priority_bucket", "Retention_Priority_Bucket"),
        ("recommended_action", "Recommended_Action"),
        ("readable_factors", "Top_Risk_Factors, Main_Risk_Factor")):
    check(name, "prediction", f"SELECT Customer_ID, {columns} FROM prediction")
check("score_summary", "prediction", """
, labelled AS (SELECT 'risk' AS Section, Risk_Category AS Label, Revenue_at_Risk AS r FROM prediction
        UNION ALL SELECT 'priority', Retention_Priority_Bucket, Revenue_at_Risk FROM prediction
        UNION ALL SELECT 'total', 'all', Revenue_at_Risk FROM prediction)
SELECT Section, Label, count(*) AS Customers,
  CAST(sum(CAST(r AS DECIMAL(14,2))) AS DOUBLE) AS Revenue_at_Risk FROM labelled GROUP BY 1, 2""")
check("top_critical", "prediction", """
SELECT Customer_ID, Company_Name, Churn_Probability, Annual_Contract_Value, Main_Risk_Factor,
  Recommended_Action FROM prediction WHERE Retention_Priority_Bucket = 'Critical'
ORDER BY Retention_Priority_Score DESC, Customer_ID LIMIT 10""")
check("risk_factors", "shown", """
SELECT account.Customer_ID, coalesce(raw, '') AS Risk_Factors
FROM account LEFT JOIN shown ON shown.Customer_ID = account.Customer_ID""")
check("acv_percentile_rank", "account", """
SELECT Customer_ID, round((rank() OVER (ORDER BY Annual_Contract_Value)
  + (count(*) OVER (PARTITION BY Annual_Contract_Value) - 1) / 2) / count(*) OVER (), 6) AS Rank_Pct
FROM account""")

_PROFILE = """
, prof AS (
SELECT Customer_ID AS Profile_ID, Years_With_Provider, Monthly_Bill, Network_Uptime,
  Downtime_Hours, Number_of_Complaints, Customer_Satisfaction_Score, Support_Response_Hours,
  SLA_Breaches, Number_of_Services, Competitor_Considered,
  CASE WHEN Contract_Type <> 'Monthly' THEN Contract_Remaining_Months ELSE 12 END AS Contract_Remaining_Months,
  Company_Size,
  CAST(trunc((Customer_Satisfaction_Score - 5.5) * 20) AS BIGINT) AS NPS_Score,
  CAST(greatest(1, trunc(Downtime_Hours / 8)) AS BIGINT) AS Number_of_Outages,
  0 AS Billing_Issues, 0.5 AS Packet_Loss_Percentage,
  CASE WHEN Competitor_Considered = 1 THEN -12.0 ELSE 0.0 END AS Competitor_Price_Difference
FROM account),
sp AS (
SELECT *, CASE Company_Size WHEN 'Small' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Large' THEN 2 ELSE 3 END AS size_rank,
  CASE WHEN Contract_Remaining_Months <= 2 THEN 1 ELSE 0 END AS window_ FROM prof),
pp AS (
SELECT *, 1 / (1 + exp(-""" + LOGIT + """)) AS p
FROM (SELECT sp.*, """ + term_columns() + """ FROM sp CROSS JOIN st)),
pt AS (SELECT *, CASE WHEN p < 0.3 THEN 'Low' WHEN p < 0.6 THEN 'Medium' WHEN p < 0.8 THEN 'High'
                 ELSE 'Critical' END AS tier FROM pp)
"""
check("score_profiles", "scored", _PROFILE + """
SELECT Profile_ID, Contract_Remaining_Months, Company_Size, NPS_Score, Number_of_Outages,
  Monthly_Bill * 12 AS Annual_Contract_Value, round(p, 6) AS Churn_Probability,
  tier AS Risk_Category FROM pt""")
check("profile_reasons", "scored", _PROFILE + """
SELECT Profile_ID, coalesce(nullif(concat_ws(', ',
    CASE WHEN Downtime_Hours > 30 THEN 'high downtime' END,
    CASE WHEN Number_of_Complaints > 5 THEN 'high complaint volume' END,
    CASE WHEN Customer_Satisfaction_Score < 6 THEN 'low satisfaction' END,
    CASE WHEN SLA_Breaches > 1 THEN 'repeated SLA breaches' END,
    CASE WHEN Support_Response_Hours > 12 THEN 'slow support response' END,
    CASE WHEN Competitor_Considered = 1 THEN 'actively considering a competitor' END), ''),
  'no major single risk factor — profile looks healthy') AS Main_Risk_Factors,
  CASE WHEN tier IN ('High', 'Critical') THEN 'Immediate account intervention — priority network/support escalation and retention outreach.'
       WHEN tier = 'Medium' THEN 'Proactive check-in and satisfaction review.'
       ELSE 'Standard monitoring cadence.' END AS Recommended_Action FROM pt""")

# --- What-if
_NOTE = "Scenario ESTIMATE from the trained model, not a guaranteed business outcome."
_AT_RISK = "Churn_Probability >= 0.6"
_SHIFTS = {
    "reduce_downtime": lambda m: {
        "Downtime_Hours": f"Downtime_Hours * (1 - {m}::DOUBLE)",
        "Number_of_Outages": f"round_even(Number_of_Outages * (1 - {m}::DOUBLE), 0)"},
    "improve_support_response": lambda m: {
        "Support_Response_Hours": f"Support_Response_Hours * (1 - {m}::DOUBLE)"},
    "retention_offer_high_risk": lambda m: {
        "Customer_Satisfaction_Score": f"CASE WHEN {_AT_RISK} THEN greatest(1, least(10, "
        f"Customer_Satisfaction_Score * (1 + {m}::DOUBLE))) ELSE Customer_Satisfaction_Score END",
        "Competitor_Price_Difference": f"CASE WHEN {_AT_RISK} THEN Competitor_Price_Difference "
        f"+ {m}::DOUBLE * 10 ELSE Competitor_Price_Difference END"},
}
_BARE = "Customer_ID, Churn_Probability"


def _case(scenario: str, m: float, note: bool) -> str:
    extra = f", '{_NOTE}' AS Note" if note else ""
    return f"""
SELECT '{scenario}' AS Scenario, {m}::DOUBLE AS Magnitude,
  round(avg(Churn_Probability), 4) AS Avg_Probability_Before,
  round(avg(1 / (1 + exp(-{LOGIT}))), 4) AS Avg_Probability_After{extra}
FROM (SELECT base.{_BARE.replace(', ', ', base.')}, {term_columns(_SHIFTS[scenario](m))}
      FROM base CROSS JOIN st)"""


_BASE = (", base AS (SELECT * EXCLUDE (" + ", ".join(f"t_{n}" for n in TERM_NAMES)
         + ") FROM scored)")
for name, scenario in (("whatif_downtime", "reduce_downtime"),
                       ("whatif_support", "improve_support_response"),
                       ("whatif_offer", "retention_offer_high_risk")):
    check(name, "scored", _BASE + " UNION ALL ".join(_case(scenario, m, True) for m in (0.2, 0.5)))
check("whatif_grid", "scored", _BASE + " UNION ALL ".join(
    _case(s, m, False) for s in _SHIFTS for m in (0.0, 0.1, 0.2, 0.3)))

# --- Dashboard
_MEASURES = f"""
  count(*) AS Total_Customers, count(*) FILTER (Churn = 1) AS Churned_Customers,
  count(*) FILTER (Churn = 0) AS Active_Customers,
  round(CAST(count(*) FILTER (Churn = 1) AS DOUBLE) / count(*), 6) AS Churn_Rate,
  {LOST} AS Revenue_at_Risk_Actual,
  CAST(sum(CAST(Revenue_at_Risk AS DECIMAL(14,2))) AS DOUBLE) AS Revenue_at_Risk_Predicted,
  CAST(sum(Annual_Contract_Value) AS DOUBLE) AS Total_Portfolio_ACV,
  round({LOST} / CAST(sum(Annual_Contract_Value) AS DOUBLE), 6) AS Pct_Revenue_at_Risk,
  round(avg(Years_With_Provider), 6) AS Avg_Customer_Lifetime,
  round(avg(Customer_Satisfaction_Score), 6) AS Avg_Satisfaction,
  count(*) FILTER (Risk_Category IN ('High', 'Critical')) AS High_Risk_Customers,
  CAST(sum(CASE WHEN Risk_Category = 'Critical' THEN CAST(Revenue_at_Risk AS DECIMAL(14,2)) ELSE 0 END)
    AS DOUBLE) AS Critical_Risk_Revenue"""
check("measures", "risk", f"SELECT {_MEASURES} FROM risk")
check("measures_sliced", "risk", f"""
SELECT Region, {_MEASURES} FROM risk WHERE Contract_Type = 'Annual' GROUP BY Region""")
check("monthly_churn_trend", "account", """
, r AS (SELECT date_trunc('month', min(Churn_Date)) AS lo, max(Churn_Date) AS hi FROM account),
mo AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS d FROM r)
SELECT strftime(d, '%Y-%m') AS Month_Key, strftime(d, '%b %Y') AS Month_Year,
  count(Churn_Date) AS Churned_Customers
FROM mo LEFT JOIN account ON date_trunc('month', Churn_Date) = d GROUP BY d""")
check("city_revenue_lost", "account", f"""
SELECT City, State, count(*) AS Total_Customers, {CHURNED} AS Churned_Customers,
  {RATE} AS Churn_Rate_Pct, {LOST} AS Revenue_at_Risk
FROM account GROUP BY City, State ORDER BY Revenue_at_Risk DESC, City, State LIMIT 10""")
check("churn_by_downtime_bin", "account", f"""
SELECT CAST(floor(Downtime_Hours / 10) * 10 AS BIGINT) AS Downtime_From,
  count(*) AS Total_Customers, {CHURNED} AS Churned_Customers, {RATE} AS Churn_Rate_Pct
FROM account GROUP BY 1""")
check("churn_by_complaint_bucket", "account", f"""
SELECT CASE WHEN Number_of_Complaints = 0 THEN '0' WHEN Number_of_Complaints <= 2 THEN '1-2'
            WHEN Number_of_Complaints <= 5 THEN '3-5' ELSE '6+' END AS Complaints,
  count(*) AS Total_Customers, {CHURNED} AS Churned_Customers, {RATE} AS Churn_Rate_Pct
FROM account GROUP BY 1""")
check("geo_rollup", "account", f"""
SELECT State, City, CAST(grouping(State, City) AS BIGINT) AS Level, count(*) AS Total_Customers,
  {CHURNED} AS Churned_Customers, {RATE} AS Churn_Rate_Pct, {LOST} AS Revenue_at_Risk
FROM account GROUP BY ROLLUP (State, City)""")
check("experience_grid", "account", """
SELECT CAST(floor(Network_Satisfaction) AS BIGINT) AS Network_Satisfaction,
  CAST(floor(Support_Satisfaction) AS BIGINT) AS Support_Satisfaction, Churn,
  count(*) AS Customers, CAST(sum(Annual_Contract_Value) AS DOUBLE) AS Portfolio_ACV
FROM account GROUP BY 1, 2, 3""")
check("kpi_overview", "account", f"""
SELECT count(*) AS Customers, {CHURNED} AS Churned,
  round(CAST(sum(Churn) * 100 AS DOUBLE) / count(*), 1) AS Churn_Rate_Pct,
  round({LOST} / 1e7, 1) AS Revenue_at_Risk_Crore FROM account""")
check("kpi_risk", "prediction", """
SELECT count(*) FILTER (Risk_Category = 'High') AS High_Risk,
  count(*) FILTER (Risk_Category = 'Critical') AS Critical_Risk,
  round(avg(Churn_Probability) * 100, 1) AS Avg_Probability_Pct,
  round(sum(Revenue_at_Risk) / 1e7, 1) AS Revenue_at_Risk_Crore FROM prediction""")
check("active_exposure", "risk", """
, a AS (SELECT Risk_Category, CAST(Revenue_at_Risk AS DECIMAL(14,2)) AS r FROM risk WHERE Churn = 0),
s AS (SELECT Risk_Category AS Scope, r FROM a
      UNION ALL SELECT 'High + Critical', r FROM a WHERE Risk_Category IN ('High', 'Critical')
      UNION ALL SELECT 'All active', r FROM a)
SELECT Scope, count(*) AS Customers, CAST(sum(r) AS DOUBLE) AS Revenue_at_Risk FROM s GROUP BY 1""")

# --- Splitting and evaluation
check("stratified_split", "split", "SELECT * FROM split")
check("standardize", "split", """
, f AS (SELECT avg(Downtime_Hours) AS md, stddev_pop(Downtime_Hours) AS sd,
               avg(Support_Response_Hours) AS mr, stddev_pop(Support_Response_Hours) AS sr
        FROM account JOIN split ON split.Customer_ID = account.Customer_ID WHERE NOT Is_Test)
SELECT Customer_ID, round((Downtime_Hours - md) / sd, 6) AS Downtime_Hours,
  round((Support_Response_Hours - mr) / sr, 6) AS Support_Response_Hours FROM account, f""")
_CELLS = """
, c AS (SELECT CAST(count(*) FILTER (y = 1 AND p >= 0.5) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (y = 0 AND p >= 0.5) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (y = 1 AND p < 0.5) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (y = 0 AND p < 0.5) AS DOUBLE) AS tn FROM held)
"""
check("eval_metrics", "held", _CELLS + """
, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM held),
u AS (SELECT sum(k) FILTER (y = 1) AS s, CAST(sum(y) AS DOUBLE) AS n1, count(*) - sum(y) AS n0 FROM r)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS Accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "Precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS Recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS F1,
  round((s - n1 * (n1 + 1) / 2) / (n0 * n1), 6) AS ROC_AUC FROM c, u""")
check("confusion_matrix", "held", _CELLS + """
SELECT 'Active' AS Actual, 'Active' AS Predicted, CAST(tn AS BIGINT) AS Customers FROM c
UNION ALL SELECT 'Active', 'Churned', CAST(fp AS BIGINT) FROM c
UNION ALL SELECT 'Churned', 'Active', CAST(fn AS BIGINT) FROM c
UNION ALL SELECT 'Churned', 'Churned', CAST(tp AS BIGINT) FROM c""")
check("classification_report", "held", _CELLS + """
, k AS (
SELECT 'Active' AS cl, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r,
  coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS n FROM c
UNION ALL SELECT 'Churned', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM c)
SELECT cl AS Class, round(p, 6) AS "Precision", round(r, 6) AS Recall, round(f, 6) AS F1,
  CAST(n AS BIGINT) AS Support FROM k
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
  CAST(sum(n) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6),
  round(sum(f * n) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM k
UNION ALL SELECT 'accuracy', round((tp + tn) / (tp + fp + fn + tn), 6),
  round((tp + tn) / (tp + fp + fn + tn), 6), round((tp + tn) / (tp + fp + fn + tn), 6),
  CAST(tp + fp + fn + tn AS BIGINT) FROM c""")
check("roc_curve", "held", """
SELECT t.p AS Threshold,
  round(CAST((SELECT count(*) FROM held h WHERE h.p >= t.p AND y = 0) AS DOUBLE)
        / (SELECT count(*) FROM held WHERE y = 0), 6) AS FPR,
  round(CAST((SELECT count(*) FROM held h WHERE h.p >= t.p AND y = 1) AS DOUBLE)
        / (SELECT count(*) FROM held WHERE y = 1), 6) AS TPR
FROM (SELECT DISTINCT p FROM held) t
UNION ALL SELECT NULL, 0.0, 0.0""")
check("baseline_accuracy", "held", "SELECT round(1 - avg(y), 6) AS Baseline_Accuracy FROM held")
check("tier_calibration", "held", """
, t AS (SELECT o, v.Risk_Category, count(y) AS n, round(avg(y) * 100, 1) AS rate
        FROM (VALUES (1, 'Low'), (2, 'Medium'), (3, 'High'), (4, 'Critical')) v(o, Risk_Category)
        LEFT JOIN held ON held.Risk_Category = v.Risk_Category GROUP BY 1, 2)
SELECT Risk_Category, n AS Customers, rate AS Actual_Churn_Rate,
  CASE WHEN rate IS NOT NULL THEN coalesce(rate >= max(rate) OVER (
    ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) END AS Not_Lower FROM t""")
