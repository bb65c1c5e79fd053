"""Table contracts (as DDL) and the fixed column lists of the churn data model."""

from __future__ import annotations

# Service flags per category, in file order.
SERVICES_BY_CATEGORY = {
    "Connectivity": ["Internet_Leased_Line", "Dedicated_Internet", "MPLS_VPN", "SD_WAN",
                     "Broadband", "International_Private_Line"],
    "Cloud": ["Provider_Cloud", "Multi_Cloud_Connect", "Cloud_Backup", "Disaster_Recovery"],
    "Security": ["Managed_Firewall", "DDoS_Protection", "Network_Security", "Secure_Internet",
                 "Zero_Trust"],
    "Communication": ["Business_Voice", "CPaaS", "Enterprise_Messaging", "Collaboration_Services"],
    "IoT": ["IoT_Services"],
}
SERVICES = [s for group in SERVICES_BY_CATEGORY.values() for s in group]

_FLAGS = ", ".join(f"{s} INT" for s in SERVICES)

# The wide customer file, by position. Money is DECIMAL so that sums are exact.
CUSTOMERS = f"""
    Customer_ID STRING, Company_Name STRING, Company_Size STRING, Industry STRING,
    Customer_Type STRING, Customer_Segment STRING, Years_With_Provider DOUBLE,
    State STRING, City STRING, Region STRING, Pincode_Zone INT, {_FLAGS},
    Number_of_IoT_Devices INT, Number_of_Services INT, Primary_Service STRING,
    Service_Tenure DOUBLE, Monthly_Data_Usage_GB DOUBLE, Bandwidth_Mbps DOUBLE,
    Monthly_Bill DECIMAL(14,2), Annual_Contract_Value DECIMAL(14,2), Contract_Type STRING,
    Contract_Remaining_Months INT, Network_Uptime DOUBLE, Downtime_Hours DOUBLE,
    Number_of_Outages INT, Average_Latency_ms DOUBLE, Packet_Loss_Percentage DOUBLE,
    Service_Quality_Score DOUBLE, Support_Response_Hours DOUBLE, Support_Resolution_Hours DOUBLE,
    Number_of_Complaints INT, Number_of_Service_Tickets INT, SLA_Breaches INT,
    Billing_Issues INT, Installation_Delay_Days DOUBLE, Customer_Satisfaction_Score DOUBLE,
    NPS_Score INT, Support_Satisfaction DOUBLE, Network_Satisfaction DOUBLE,
    Billing_Satisfaction DOUBLE, Service_Satisfaction DOUBLE, Competitor_Considered INT,
    Competitor_Price_Difference DOUBLE, Competitor_Service_Rating DOUBLE,
    Competitor_Offer STRING, Competitor_Threat_Level STRING, Churn INT, Churn_Date DATE,
    Churn_Reason STRING, Churn_Category STRING
"""

SERVICE_CATALOG = "Service_Name STRING, Service_Category STRING"
CUSTOMER_SERVICES = "Customer_ID STRING, Service_Name STRING"

PREDICTIONS_SQL = """
    Customer_ID STRING, Churn_Probability DECIMAL(6,4), Risk_Category STRING,
    Revenue_at_Risk DECIMAL(14,2), Main_Risk_Factor STRING, Recommended_Action STRING
"""

# Column names and order of the two prediction exports.
PREDICTION_COLUMNS = [
    "Customer_ID", "Company_Name", "Industry", "State", "City", "Annual_Contract_Value",
    "Churn_Probability", "Risk_Category", "Revenue_at_Risk", "CLV", "Retention_Priority_Score",
    "Retention_Priority_Bucket", "Main_Risk_Factor", "Top_Risk_Factors", "Recommended_Action",
]
PREDICTION_SQL_COLUMNS = ["Customer_ID", "Churn_Probability", "Risk_Category", "Revenue_at_Risk",
                          "Main_Risk_Factor", "Recommended_Action"]

# Columns that are empty by design; '' and 'None' in files mean NULL here.
STRUCTURAL_NULLS = ["Churn_Date", "Churn_Reason", "Churn_Category", "Competitor_Offer"]

# Inclusive bounds of the bounded metrics.
VALUE_RANGES = {
    "Network_Uptime": (90.0, 100.0),
    "Customer_Satisfaction_Score": (1.0, 10.0),
    "NPS_Score": (-100.0, 100.0),
    "Support_Satisfaction": (1.0, 10.0),
    "Network_Satisfaction": (1.0, 10.0),
    "Billing_Satisfaction": (1.0, 10.0),
    "Service_Satisfaction": (1.0, 10.0),
}

# Labels that replace structural nulls.
NULL_LABELS = {"Churn_Reason": "Not Churned", "Churn_Category": "Not Churned",
               "Competitor_Offer": "None"}

# The seven documented column groups.
COLUMN_GROUPS = {
    "Customer Info": ["Customer_ID", "Company_Name", "Company_Size", "Industry", "Customer_Type",
                      "Customer_Segment", "Years_With_Provider"],
    "Geography": ["State", "City", "Region", "Pincode_Zone"],
    "Service Usage": ["Number_of_Services", "Primary_Service", "Monthly_Bill",
                      "Annual_Contract_Value", "Contract_Type"],
    "Service Quality": ["Network_Uptime", "Downtime_Hours", "SLA_Breaches",
                        "Support_Response_Hours"],
    "Experience": ["Customer_Satisfaction_Score", "NPS_Score"],
    "Competitor": ["Competitor_Considered", "Competitor_Threat_Level"],
    "Churn": ["Churn", "Churn_Date", "Churn_Reason", "Churn_Category"],
}

# Columns kept out of the model (identifiers, outcome leakage, collinear halves).
MODEL_DROPS = [
    "Customer_ID", "Company_Name", "Churn_Date", "Churn_Reason", "Churn_Category",
    "Primary_Service", "Competitor_Offer", "Monthly_Bill", "Monthly_Data_Usage_GB",
    "Number_of_Service_Tickets", "Support_Resolution_Hours",
]
CATEGORICALS = ["Company_Size", "Industry", "Customer_Type", "Customer_Segment", "State", "City",
                "Region", "Contract_Type", "Competitor_Threat_Level"]
TARGET = "Churn"

# Column sets of the descriptive reports.
KEY_NUMERIC = ["Years_With_Provider", "Monthly_Bill", "Annual_Contract_Value", "Network_Uptime",
               "Downtime_Hours", "Support_Response_Hours", "Customer_Satisfaction_Score",
               "NPS_Score"]
CHURN_DRIVERS = ["Downtime_Hours", "Number_of_Outages", "SLA_Breaches", "Support_Response_Hours",
                 "Support_Resolution_Hours", "Number_of_Complaints", "Billing_Issues",
                 "Packet_Loss_Percentage", "Average_Latency_ms", "Customer_Satisfaction_Score",
                 "NPS_Score", "Network_Uptime", "Years_With_Provider", "Number_of_Services",
                 "Service_Quality_Score", "Churn"]
COLLINEAR_CANDIDATES = ["Annual_Contract_Value", "Monthly_Bill", "Bandwidth_Mbps",
                        "Monthly_Data_Usage_GB", "Number_of_Complaints",
                        "Number_of_Service_Tickets", "Support_Response_Hours",
                        "Support_Resolution_Hours"]

RISK_LEVELS = ["Low", "Medium", "High", "Critical"]
