"""Shared table expressions of the check statements."""

ACCOUNT = """
o AS (
  SELECT o_custkey AS k, count(*) AS n_orders,
         sum(CAST(o_totalprice AS DECIMAL(14,2))) AS acv,
         min(CAST(o_orderdate AS DATE)) AS first_dt, max(CAST(o_orderdate AS DATE)) AS last_dt
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT o_custkey AS k, count(*) AS n_lines,
         count(DISTINCT p_brand) AS nsvc, min(p_brand) AS main_svc,
         CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS complaints,
         CAST(sum(CASE WHEN l_returnflag IN ('R','A') THEN 1 ELSE 0 END) AS BIGINT) AS tickets,
         CAST(sum(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN l_quantity ELSE 0 END) AS BIGINT) AS dq,
         CAST(sum(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS outages,
         CAST(sum(CASE WHEN date_diff('day',o_orderdate,l_shipdate) > 1200 THEN 1 ELSE 0 END) AS BIGINT) AS late,
         CAST(sum(abs(date_diff('day',o_orderdate,l_shipdate))) AS BIGINT) AS lag_days,
         CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bill,
         CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS disc_pct
  FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN part ON p_partkey=l_partkey
  GROUP BY o_custkey),
m AS (SELECT max(CAST(o_orderdate AS DATE)) AS as_of FROM orders),
b AS (
  SELECT c.*, n_name, r_name, o.*, l.n_lines, l.nsvc, l.main_svc, l.complaints, l.tickets, l.dq, l.outages, l.late, l.lag_days, l.bill, l.disc_pct, m.as_of,
         CASE WHEN c_acctbal<2500 THEN 'Small' WHEN c_acctbal<5500 THEN 'Medium' WHEN c_acctbal<8500 THEN 'Large' ELSE 'Enterprise' END AS size_,
         CASE WHEN date_diff('day',last_dt,as_of) > 300 THEN 1 ELSE 0 END AS churn_,
         CASE WHEN disc_pct > 5*n_lines THEN 1 ELSE 0 END AS cons_,
         greatest(CAST(1 AS DOUBLE), CAST((200*(n_lines-complaints) + n_lines) // (2*n_lines) AS DOUBLE)/10) AS csat_,
         CAST((20*lag_days + 24*n_lines) // (48*n_lines) AS DOUBLE)/10 AS resp_
  FROM customer c JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey
  JOIN o ON o.k=c_custkey JOIN l ON l.k=c_custkey CROSS JOIN m),
account AS MATERIALIZED (
SELECT c_custkey AS Customer_ID, c_name AS Company_Name, size_ AS Company_Size, c_mktsegment AS Industry,
  CASE c_custkey%3 WHEN 0 THEN 'New Business' WHEN 1 THEN 'Existing Business' ELSE 'Upsell/Expansion' END AS Customer_Type,
  CASE size_ WHEN 'Small' THEN 'SMB' WHEN 'Medium' THEN 'Mid-Market' WHEN 'Large' THEN 'Large Enterprise' ELSE 'Strategic/Key Account' END AS Customer_Segment,
  CAST(round(CAST(date_diff('day',first_dt,as_of) AS DOUBLE)/365.25,1) AS DOUBLE) AS Years_With_Provider,
  n_name AS State, concat(n_name,'-C',CAST(c_custkey%2 AS VARCHAR(2))) AS City, r_name AS Region,
  nsvc AS Number_of_Services, main_svc AS Primary_Service,
  CAST(floor(CAST(acv AS DOUBLE)/12) AS DOUBLE) AS Monthly_Bill, CAST(acv AS DECIMAL(14,2)) AS Annual_Contract_Value,
  CASE c_custkey%3 WHEN 0 THEN 'Monthly' WHEN 1 THEN 'Annual' ELSE 'Multi-Year' END AS Contract_Type,
  c_custkey%37 AS Contract_Remaining_Months,
  greatest(CAST(90 AS DOUBLE), 100 - CAST(outages AS DOUBLE)/2) AS Network_Uptime,
  round(CAST(dq AS DOUBLE)/5,1) AS Downtime_Hours, outages AS Number_of_Outages,
  CAST(5 + c_custkey%60 AS DOUBLE) AS Average_Latency_ms, CAST(bill AS DOUBLE)/4 AS Packet_Loss_Percentage,
  resp_ AS Support_Response_Hours, resp_*4 AS Support_Resolution_Hours,
  complaints AS Number_of_Complaints, tickets AS Number_of_Service_Tickets, least(6,late) AS SLA_Breaches, bill AS Billing_Issues,
  csat_ AS Customer_Satisfaction_Score, CAST(round((csat_-5.5)*22) AS INT) AS NPS_Score,
  CAST(greatest(1, 10 - floor((resp_-18)/6)) AS DOUBLE) AS Support_Satisfaction,
  CAST(greatest(1, 10 - floor(CAST(outages AS DOUBLE)/2)) AS DOUBLE) AS Network_Satisfaction,
  CAST(greatest(1, 10 - bill) AS DOUBLE) AS Billing_Satisfaction, csat_ AS Service_Satisfaction,
  cons_ AS Competitor_Considered,
  CASE WHEN cons_=1 THEN -CAST((80*disc_pct + n_lines) // (2*n_lines) AS DOUBLE)/10 ELSE CAST(0 AS DOUBLE) END AS Competitor_Price_Difference,
  CASE WHEN cons_=1 THEN CAST(55+c_custkey%36 AS DOUBLE)/10 ELSE CAST(0 AS DOUBLE) END AS Competitor_Service_Rating,
  CASE WHEN cons_=1 THEN CASE c_custkey%4 WHEN 0 THEN 'Rival A' WHEN 1 THEN 'Rival B' WHEN 2 THEN 'Rival C' ELSE 'Rival D' END END AS Competitor_Offer,
  CASE WHEN cons_=0 THEN 'Low' WHEN csat_>=7.5 THEN 'Medium' WHEN csat_>=6 THEN 'High' ELSE 'Critical' END AS Competitor_Threat_Level,
  churn_ AS Churn, CASE WHEN churn_=1 THEN last_dt END AS Churn_Date,
  CASE WHEN churn_=1 THEN CASE c_custkey%15 WHEN 0 THEN 'Poor Network Quality' WHEN 1 THEN 'Frequent Downtime' WHEN 2 THEN 'Service Reliability'
    WHEN 3 THEN 'Slow Customer Support' WHEN 4 THEN 'Poor Service Quality' WHEN 5 THEN 'High Pricing' WHEN 6 THEN 'Billing Problems' WHEN 7 THEN 'Contract Issues'
    WHEN 8 THEN 'Competitor Offer' WHEN 9 THEN 'Better Technology Elsewhere' WHEN 10 THEN 'Lack of Features' WHEN 11 THEN 'Migration to Cloud Provider'
    WHEN 12 THEN 'Internal IT Transformation' WHEN 13 THEN 'Business Closure' ELSE 'Other' END END AS Churn_Reason
FROM b)
"""

BRIDGE = """
bridge AS (
SELECT DISTINCT o_custkey AS Customer_ID, p_brand AS Service_Name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
"""

CATALOG = """
catalog_ AS (
SELECT DISTINCT p_brand AS Service_Name,
  CASE CAST(substr(p_brand, 7) AS INT) % 5 WHEN 0 THEN 'Connectivity' WHEN 1 THEN 'Cloud'
    WHEN 2 THEN 'Security' WHEN 3 THEN 'Communication' ELSE 'IoT' END AS Service_Category
FROM part)
"""

# Accounts with the two derived columns of the full customer contract.
FULL = """
acct AS (
SELECT *,
  CAST(round(greatest(CAST(20 AS DECIMAL(6,2)), least(CAST(100 AS DECIMAL(6,2)),
      CAST(Network_Uptime AS DECIMAL(6,3)) * CAST(0.5 AS DECIMAL(6,2))
    + (100 - greatest(0, least(100, CAST(Average_Latency_ms AS DECIMAL(8,1))))) * CAST(0.15 AS DECIMAL(6,2))
    + (100 - CAST(Packet_Loss_Percentage AS DECIMAL(5,2)) * 8) * CAST(0.15 AS DECIMAL(6,2))
    + (100 - greatest(0, least(100, CAST(Support_Response_Hours AS DECIMAL(6,1))))) * CAST(0.2 AS DECIMAL(6,2))
  )), 1) AS DOUBLE) AS Service_Quality_Score,
  CASE WHEN Churn_Reason IN ('Poor Network Quality','Frequent Downtime','Service Reliability')
         THEN 'Network & Reliability'
       WHEN Churn_Reason IN ('Slow Customer Support','Poor Service Quality') THEN 'Support & Service'
       WHEN Churn_Reason IN ('High Pricing','Billing Problems','Contract Issues') THEN 'Commercial'
       WHEN Churn_Reason IN ('Competitor Offer','Better Technology Elsewhere') THEN 'Competitive'
       WHEN Churn_Reason IN ('Lack of Features','Migration to Cloud Provider') THEN 'Product Fit'
       WHEN Churn_Reason IS NOT NULL THEN 'Other' END AS Churn_Category
FROM account)
"""

DIRTY = """
dirty AS (
SELECT * REPLACE (
    CASE WHEN SLA_Breaches = 0 THEN 101.0::DOUBLE ELSE Network_Uptime END AS Network_Uptime,
    CASE WHEN Competitor_Considered = 0 THEN State END AS State)
FROM (SELECT *, 1 AS Ingest_Order FROM acct
      UNION ALL SELECT *, 2 FROM acct WHERE Contract_Remaining_Months = 0))
"""

# One flag per service; the catalog lists Brand#1 to Brand#25.
SERVICE_NUMBERS = range(1, 26)
WIDE = """
wide AS (
SELECT a.*, """ + ", ".join(
    f"CAST(EXISTS (FROM bridge b WHERE b.Customer_ID = a.Customer_ID AND b.Service_Name = 'Brand#{i}')"
    f" AS INTEGER) AS Service_{i}" for i in SERVICE_NUMBERS) + """
FROM account a)
"""

# Population statistics of the scorecard's standardized inputs.
STATS = """
sized AS (
SELECT *, CASE Company_Size WHEN 'Small' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Large' THEN 2
                            WHEN 'Enterprise' THEN 3 END AS size_rank,
  CASE WHEN Contract_Remaining_Months <= 2 THEN 1 ELSE 0 END AS window_
FROM account),
st AS (
SELECT avg(Downtime_Hours) AS m1, stddev_pop(Downtime_Hours) AS s1,
  avg(Number_of_Outages) AS m2, stddev_pop(Number_of_Outages) AS s2,
  avg(SLA_Breaches) AS m3, stddev_pop(SLA_Breaches) AS s3,
  avg(Support_Response_Hours) AS m4, stddev_pop(Support_Response_Hours) AS s4,
  avg(Number_of_Complaints) AS m5, stddev_pop(Number_of_Complaints) AS s5,
  avg(Billing_Issues) AS m6, stddev_pop(Billing_Issues) AS s6,
  avg(Packet_Loss_Percentage) AS m7, stddev_pop(Packet_Loss_Percentage) AS s7,
  avg(Customer_Satisfaction_Score) AS m8, stddev_pop(Customer_Satisfaction_Score) AS s8,
  avg(NPS_Score) AS m9, stddev_pop(NPS_Score) AS s9,
  avg(Network_Uptime) AS m10, stddev_pop(Network_Uptime) AS s10,
  avg(Years_With_Provider) AS m11, stddev_pop(Years_With_Provider) AS s11,
  avg(Number_of_Services) AS m12, stddev_pop(Number_of_Services) AS s12,
  avg(size_rank) AS m13, stddev_pop(size_rank) AS s13,
  avg(window_) AS m14, stddev_pop(window_) AS s14
FROM sized)
"""

_TERMS = [
    ("Downtime_Hours", 0.55, "Downtime_Hours"), ("Number_of_Outages", 0.35, "Number_of_Outages"),
    ("SLA_Breaches", 0.30, "SLA_Breaches"), ("Support_Response_Hours", 0.30, "Support_Response_Hours"),
    ("Number_of_Complaints", 0.25, "Number_of_Complaints"), ("Billing_Issues", 0.20, "Billing_Issues"),
    ("Packet_Loss_Percentage", 0.20, "Packet_Loss_Percentage"),
    ("Customer_Satisfaction_Score", -0.55, "Customer_Satisfaction_Score"),
    ("NPS_Score", -0.30, "NPS_Score"), ("Network_Uptime", -0.35, "Network_Uptime"),
    ("Years_With_Provider", -0.20, "Years_With_Provider"),
    ("Number_of_Services", -0.12, "Number_of_Services"), ("Company_Size_Rank", -0.18, "size_rank"),
    ("Contract_Window", 0.15, "window_"),
]


def term_columns(replaced: dict[str, str] | None = None) -> str:
    """The scorecard terms as t_<input>, with inputs optionally replaced by SQL."""
    replaced = replaced or {}
    parts = [f"{w} * (({replaced.get(c, c)} - m{i}) / (s{i} + 1e-9)) AS t_{n}"
             for i, (n, w, c) in enumerate(_TERMS, 1)]
    diff = replaced.get("Competitor_Price_Difference", "Competitor_Price_Difference")
    parts.append(f"0.40 * Competitor_Considered * (1 - ({diff}) / 100) AS t_Competitor_Pressure")
    return ",\n  ".join(parts)


TERM_NAMES = [n for n, _, _ in _TERMS] + ["Competitor_Pressure"]
LOGIT = "(-2.35 + " + " + ".join(f"t_{n}" for n in TERM_NAMES) + ")"

# Lifetime value to the cent, rounded half up on integers.
_A = ("CAST(round(100 * Years_With_Provider + 100 * greatest(0.5, "
      "least(5, Customer_Satisfaction_Score / 2))) AS HUGEINT)")
_B = "CAST(round(100 * (Years_With_Provider + 1)) AS HUGEINT)"
CLV = (f"CAST((2 * CAST(Annual_Contract_Value * 100 AS HUGEINT) * {_A} + {_B}) // (2 * {_B}) "
       "AS DOUBLE) / 100")

SCORED = STATS + f""",
scored AS (
SELECT *, round(1 / (1 + exp(-{LOGIT})), 4) AS Churn_Probability, {CLV} AS clv_
FROM (SELECT sized.*, {term_columns()} FROM sized CROSS JOIN st))
"""

FACTORS = """
factor AS (
SELECT Customer_ID, name, row_number() OVER (PARTITION BY Customer_ID
                                             ORDER BY round(c, 6) DESC, name) AS rn
FROM (""" + "\n  UNION ALL ".join(
    f"SELECT Customer_ID, '{n}' AS name, t_{n} AS c FROM scored" for n in TERM_NAMES) + """)
WHERE round(c, 6) > 0),
named AS (
SELECT *, CASE name
    WHEN 'Downtime_Hours' THEN 'High network downtime'
    WHEN 'Number_of_Outages' THEN 'Frequent service outages'
    WHEN 'SLA_Breaches' THEN 'Repeated SLA breaches'
    WHEN 'Support_Response_Hours' THEN 'Slow support response time'
    WHEN 'Number_of_Complaints' THEN 'High complaint volume'
    WHEN 'Billing_Issues' THEN 'Recurring billing issues'
    WHEN 'Packet_Loss_Percentage' THEN 'High packet loss'
    WHEN 'Network_Uptime' THEN 'Below-average network uptime'
    WHEN 'Customer_Satisfaction_Score' THEN 'Low overall satisfaction'
    WHEN 'NPS_Score' THEN 'Low NPS / low willingness to recommend'
    ELSE replace(name, '_', ' ') END AS readable
FROM factor WHERE rn <= 3),
shown AS (
SELECT Customer_ID, string_agg(readable, ', ' ORDER BY rn) AS tops, min_by(readable, rn) AS main,
       string_agg(name, ',' ORDER BY rn) AS raw
FROM named GROUP BY Customer_ID)
"""

PREDICTION = SCORED + "," + FACTORS + """,
pop AS (
SELECT max(CAST(Annual_Contract_Value AS DOUBLE)) AS max_acv, max(Number_of_Services) AS max_svc,
  quantile_cont(CAST(Annual_Contract_Value AS DOUBLE), 0.75) AS p75, count(*) AS n,
  max(clv_) AS max_clv
FROM scored),
valued AS (
SELECT scored.*, pop.*,
  CAST(Annual_Contract_Value AS DOUBLE) AS acv_,
  CASE WHEN Churn_Probability < 0.3 THEN 'Low' WHEN Churn_Probability < 0.6 THEN 'Medium'
       WHEN Churn_Probability < 0.8 THEN 'High' ELSE 'Critical' END AS Risk_Category,
  round(Annual_Contract_Value * CAST(Churn_Probability AS DECIMAL(6,4)), 2) AS rar,
  clv_ AS CLV,
  (rank() OVER (ORDER BY Annual_Contract_Value)
   + (count(*) OVER (PARTITION BY Annual_Contract_Value) - 1) / 2) / n AS pct
FROM scored CROSS JOIN pop),
prediction AS MATERIALIZED (
SELECT v.Customer_ID, Company_Name, Industry, State, City, acv_ AS Annual_Contract_Value,
  Churn_Probability, Risk_Category, CAST(rar AS DOUBLE) AS Revenue_at_Risk, CLV,
  round(100 * (0.45 * Churn_Probability + 0.25 * (ln(1 + acv_) / ln(1 + max_acv))
    + 0.15 * (ln(1 + CLV) / ln(1 + max_clv)) + 0.05 * (Number_of_Services / max_svc)
    + 0.10 * CASE WHEN Contract_Remaining_Months <= 3 THEN 1.0 WHEN Contract_Remaining_Months <= 6 THEN 0.6 ELSE 0.2 END), 1) AS Retention_Priority_Score,
  CASE WHEN Churn_Probability >= 0.6 AND pct >= 0.7 THEN 'Critical'
       WHEN Churn_Probability >= 0.6 AND pct >= 0.4 THEN 'High'
       WHEN Churn_Probability >= 0.3 THEN 'Medium' ELSE 'Low' END AS Retention_Priority_Bucket,
  coalesce(main, 'No dominant single risk factor — profile is broadly healthy') AS Main_Risk_Factor,
  coalesce(tops, 'No dominant single risk factor — profile is broadly healthy') AS Top_Risk_Factors,
  CASE WHEN Risk_Category = 'Low' THEN 'No action needed — monitor at standard cadence'
  ELSE coalesce(nullif(array_to_string(list_filter([
    CASE WHEN Downtime_Hours > 40 AND acv_ > p75 THEN 'Priority network-quality intervention (dedicated NOC escalation)' END,
    CASE WHEN Competitor_Considered = 1 AND Competitor_Price_Difference < -10 THEN 'Pricing / contract review with retention desk' END,
    CASE WHEN Support_Satisfaction < 5 THEN 'Assign dedicated account manager' END,
    CASE WHEN SLA_Breaches >= 2 THEN 'Technical escalation + SLA credit review' END,
    CASE WHEN Number_of_Services <= 1 THEN 'Product adoption / cross-sell campaign' END,
    CASE WHEN Contract_Remaining_Months <= 3 AND Risk_Category IN ('High','Critical') THEN 'Proactive renewal outreach with retention offer' END
  ], lambda x: x IS NOT NULL)[1:2], '; '), ''), 'Standard retention call — reassess satisfaction drivers') END AS Recommended_Action
FROM valued v LEFT JOIN shown s ON s.Customer_ID = v.Customer_ID)
"""

# Customers with their predictions.
RISK = """
risk AS (
SELECT a.*, p.Churn_Probability, p.Risk_Category, p.Revenue_at_Risk, p.CLV,
  p.Retention_Priority_Score, p.Retention_Priority_Bucket, p.Main_Risk_Factor, p.Recommended_Action
FROM acct a LEFT JOIN prediction p ON p.Customer_ID = a.Customer_ID)
"""

# The first fifth of each label by hash position is the test part (label 0/1, exact shares).
SPLIT = """
positions AS (
SELECT Customer_ID, Churn,
  ((Customer_ID % 2147483647) * 1327217885 + 42 * 1000003) % 2147483647 AS x
FROM account),
squares AS (SELECT *, x * x % 2147483647 AS x2 FROM positions),
hashed AS (
SELECT Customer_ID, Churn, (x2 * x2 % 2147483647) * x % 2147483647 AS h FROM squares),
split AS (
SELECT Customer_ID, Churn,
  row_number() OVER (PARTITION BY Churn ORDER BY h)
    <= floor(0.2 * count(*) OVER (PARTITION BY Churn) + 0.5) AS Is_Test
FROM hashed)
"""

HELD = """
held AS (
SELECT s.Churn AS y, p.Churn_Probability AS p, p.Risk_Category
FROM split s JOIN prediction p ON p.Customer_ID = s.Customer_ID WHERE Is_Test)
"""

_VIEWS = {
    "account": (ACCOUNT, ()), "bridge": (BRIDGE, ()), "catalog_": (CATALOG, ()),
    "acct": (FULL, ("account",)), "dirty": (DIRTY, ("acct",)),
    "wide": (WIDE, ("account", "bridge")), "scored": (SCORED, ("account",)),
    "shown": (SCORED + "," + FACTORS, ("account",)),
    "prediction": (PREDICTION, ("account",)), "risk": (RISK, ("acct", "prediction")),
    "split": (SPLIT, ("account",)), "held": (HELD, ("split", "prediction")),
}


def using(names: str, body: str) -> str:
    """``body`` with the named views and everything they need in front of it."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _VIEWS[name][1]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",".join(_VIEWS[n][0] for n in order) + body
