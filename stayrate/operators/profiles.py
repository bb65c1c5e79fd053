"""Scoring of hypothetical profiles: fill what was not asked, score, explain.

Stateless per row, so the same functions serve a batch and a stream of profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate import schemas
from stayrate.functions import rules
from stayrate.operators.models import ChurnModel
from stayrate.operators.scorecard import Scorecard

# The inputs a profile states.
PROFILE = """
    Profile_ID BIGINT, Years_With_Provider DOUBLE, Monthly_Bill DOUBLE, Network_Uptime DOUBLE,
    Downtime_Hours DOUBLE, Number_of_Complaints INT, Customer_Satisfaction_Score DOUBLE,
    Support_Response_Hours DOUBLE, SLA_Breaches INT, Number_of_Services INT,
    Contract_Remaining_Months INT, Company_Size STRING, Competitor_Considered INT
"""

# Form presets used where a profile leaves an input empty.
INPUT_DEFAULTS = {
    "Years_With_Provider": 3.0, "Monthly_Bill": 80000.0, "Network_Uptime": 98.5,
    "Downtime_Hours": 25.0, "Number_of_Complaints": 2, "Customer_Satisfaction_Score": 7.5,
    "Support_Response_Hours": 6.0, "SLA_Breaches": 0, "Number_of_Services": 4,
    "Contract_Remaining_Months": 12, "Company_Size": "Small", "Competitor_Considered": 0,
}

# Inputs a profile never states.
OTHER_DEFAULTS = {
    "Industry": "IT", "Customer_Type": "Existing Business", "Customer_Segment": "Mid-Market",
    "State": "Maharashtra", "City": "Mumbai", "Region": "West", "Contract_Type": "Annual",
    "Billing_Issues": 0, "Average_Latency_ms": 20.0, "Packet_Loss_Percentage": 0.5,
    "Installation_Delay_Days": 3.0, "Bandwidth_Mbps": 200.0, "Monthly_Data_Usage_GB": 40000.0,
    "Number_of_IoT_Devices": 0, "Pincode_Zone": 400001,
}


def _derived() -> dict[str, Column]:
    csat, complaints = F.col("Customer_Satisfaction_Score"), F.col("Number_of_Complaints")
    response = F.col("Support_Response_Hours")
    considering = F.col("Competitor_Considered") == 1
    # Whole numbers are truncated toward zero, as an integer conversion does.
    return {
        "Annual_Contract_Value": (F.col("Monthly_Bill").cast("decimal(14,2)") * 12).cast("decimal(14,2)"),
        "Competitor_Price_Difference": F.when(considering, -12.0).otherwise(0.0),
        "Competitor_Service_Rating": F.when(considering, 7.0).otherwise(0.0),
        "Competitor_Threat_Level": F.when(considering, "Medium").otherwise("Low"),
        "Support_Satisfaction": csat, "Network_Satisfaction": csat,
        "Billing_Satisfaction": csat, "Service_Satisfaction": csat,
        "NPS_Score": ((csat - 5.5) * 20).cast("int"),
        "Service_Quality_Score": F.col("Network_Uptime") * 0.6 + (100 - response) * 0.4,
        "Number_of_Service_Tickets": complaints + 1,
        "Support_Resolution_Hours": response * 3,
        "Number_of_Outages": F.greatest(F.lit(1), (F.col("Downtime_Hours") / 8).cast("int")),
        "Service_Tenure": F.col("Years_With_Provider"),
    }


def complete(profiles: DataFrame) -> DataFrame:
    """Profiles with every model input present."""
    filled = profiles.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in profiles.columns else F.lit(value)
        for name, value in INPUT_DEFAULTS.items()})
    filled = filled.withColumns({n: F.lit(v) for n, v in OTHER_DEFAULTS.items()})
    filled = filled.withColumns(_derived())
    absent = [s for s in schemas.SERVICES if s not in filled.columns]
    return filled.withColumns({s: F.lit(0) for s in absent})


def assess(scored: DataFrame) -> DataFrame:
    """Tier, reasons and recommendation of completed profiles with ``Churn_Probability``."""
    tiered = scored.withColumn("Risk_Category", rules.risk_tier(F.col("Churn_Probability")))
    return tiered.withColumns({
        "Main_Risk_Factors": rules.profile_reasons(),
        "Recommended_Action": rules.profile_action(F.col("Risk_Category"))})


def score_profiles(profiles: DataFrame, scorer: Scorecard | ChurnModel) -> DataFrame:
    """Assessment of each profile; the tier is taken from the unrounded probability."""
    done = complete(profiles)
    if isinstance(scorer, Scorecard):
        return assess(done.withColumn("Churn_Probability", scorer.probability()))
    return assess(scorer.score(done, digits=None))
