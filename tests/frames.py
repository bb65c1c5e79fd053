"""Small hand-built account frames."""

from pyspark.sql import functions as F

BASE = {
    "Company_Name": ("Acme", "string"),
    "Company_Size": ("Small", "string"), "Industry": ("IT", "string"),
    "Customer_Type": ("New Business", "string"), "Customer_Segment": ("SMB", "string"),
    "Years_With_Provider": (3.0, "double"), "State": ("S1", "string"), "City": ("C1", "string"),
    "Region": ("R1", "string"), "Number_of_Services": (4, "int"),
    "Primary_Service": ("Broadband", "string"), "Monthly_Bill": ("100.00", "decimal(14,2)"),
    "Annual_Contract_Value": ("1200.00", "decimal(14,2)"), "Contract_Type": ("Annual", "string"),
    "Contract_Remaining_Months": (12, "int"), "Network_Uptime": (98.0, "double"),
    "Downtime_Hours": (10.0, "double"), "Number_of_Outages": (2, "int"),
    "Average_Latency_ms": (20.0, "double"), "Packet_Loss_Percentage": (0.5, "double"),
    "Support_Response_Hours": (6.0, "double"), "Support_Resolution_Hours": (18.0, "double"),
    "Number_of_Complaints": (2, "int"), "Number_of_Service_Tickets": (3, "int"),
    "SLA_Breaches": (0, "int"), "Billing_Issues": (0, "int"),
    "Customer_Satisfaction_Score": (7.5, "double"), "NPS_Score": (40, "int"),
    "Support_Satisfaction": (8.0, "double"), "Network_Satisfaction": (8.0, "double"),
    "Billing_Satisfaction": (8.0, "double"), "Service_Satisfaction": (8.0, "double"),
    "Competitor_Considered": (0, "int"), "Competitor_Price_Difference": (0.0, "double"),
    "Competitor_Service_Rating": (0.0, "double"), "Competitor_Offer": (None, "string"),
    "Competitor_Threat_Level": ("Low", "string"), "Churn": (0, "int"),
    "Churn_Date": (None, "date"), "Churn_Reason": (None, "string"),
    "Churn_Category": (None, "string"),
}


def accounts(spark, rows):
    """Accounts with defaults from BASE and the given overrides, keyed 1, 2, 3, ..."""
    frames = []
    for i, row in enumerate(rows, 1):
        values = {**{k: v for k, (v, _) in BASE.items()}, "Customer_ID": i, **row}
        kinds = {**{k: t for k, (_, t) in BASE.items()}, "Customer_ID": "bigint"}
        kinds.update({k: "double" for k in row if k not in kinds})
        frames.append((values, kinds))
    kinds = {k: t for _, ks in frames for k, t in ks.items()}
    names = list(kinds)
    data = [tuple(None if v.get(n) is None else str(v[n]) for n in names) for v, _ in frames]
    text = spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))
    return text.select(*[F.col(n).cast(t).alias(n) for n, t in kinds.items()])


def column(df, name, order="Customer_ID"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
