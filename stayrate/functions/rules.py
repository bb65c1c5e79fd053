"""Business rules as Catalyst expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Churn reason to reporting category; anything else is 'Other'.
REASON_CATEGORY = {
    "Poor Network Quality": "Network & Reliability",
    "Frequent Downtime": "Network & Reliability",
    "Service Reliability": "Network & Reliability",
    "Slow Customer Support": "Support & Service",
    "Poor Service Quality": "Support & Service",
    "High Pricing": "Commercial",
    "Billing Problems": "Commercial",
    "Contract Issues": "Commercial",
    "Competitor Offer": "Competitive",
    "Better Technology Elsewhere": "Competitive",
    "Lack of Features": "Product Fit",
    "Migration to Cloud Provider": "Product Fit",
}

# Display names of risk factors; others read with '_' as ' '.
READABLE_NAMES = {
    "Downtime_Hours": "High network downtime",
    "Number_of_Outages": "Frequent service outages",
    "SLA_Breaches": "Repeated SLA breaches",
    "Support_Response_Hours": "Slow support response time",
    "Support_Resolution_Hours": "Slow issue resolution",
    "Number_of_Complaints": "High complaint volume",
    "Number_of_Service_Tickets": "High support ticket volume",
    "Billing_Issues": "Recurring billing issues",
    "Packet_Loss_Percentage": "High packet loss",
    "Average_Latency_ms": "High network latency",
    "Network_Uptime": "Below-average network uptime",
    "Customer_Satisfaction_Score": "Low overall satisfaction",
    "NPS_Score": "Low NPS / low willingness to recommend",
    "Network_Satisfaction": "Low network satisfaction",
    "Support_Satisfaction": "Low support satisfaction",
    "Service_Quality_Score": "Below-average service quality",
    "Complaint_Satisfaction_Gap": "Complaints despite prior loyalty",
    "Revenue_Weighted_Downtime": "High-value account with high downtime",
    "Tickets_per_Tenure_Year": "Rising ticket rate relative to tenure",
    "Price_Pressure": "Competitor offering a materially lower price",
    "Contract_Ending_Soon": "Contract renewal window approaching",
}
NO_FACTOR = "No dominant single risk factor — profile is broadly healthy"

# Recommendation texts.
NO_ACTION = "No action needed — monitor at standard cadence"
STANDARD_CALL = "Standard retention call — reassess satisfaction drivers"
ACTION_NETWORK = "Priority network-quality intervention (dedicated NOC escalation)"
ACTION_PRICING = "Pricing / contract review with retention desk"
ACTION_MANAGER = "Assign dedicated account manager"
ACTION_SLA = "Technical escalation + SLA credit review"
ACTION_ADOPTION = "Product adoption / cross-sell campaign"
ACTION_RENEWAL = "Proactive renewal outreach with retention offer"

# Texts of the single-profile assessment.
PROFILE_HEALTHY = "no major single risk factor — profile looks healthy"
PROFILE_ACTION_HIGH = ("Immediate account intervention — priority network/support escalation "
                       "and retention outreach.")
PROFILE_ACTION_MEDIUM = "Proactive check-in and satisfaction review."
PROFILE_ACTION_LOW = "Standard monitoring cadence."

# Ordinal rank of company sizes.
SIZE_RANK = {"Small": 0, "Medium": 1, "Large": 2, "Enterprise": 3}


def mapping(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held inside [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def reason_category(reason: Column) -> Column:
    """Category of a churn reason; NULL for accounts that did not churn."""
    return F.when(reason.isNotNull(),
                  F.coalesce(F.try_element_at(mapping(REASON_CATEGORY), reason), F.lit("Other")))


def churn_status(churn: Column) -> Column:
    return F.when(churn == 1, "Churned").otherwise("Active")


def size_rank(size: Column) -> Column:
    """0..3, NULL for an unknown size."""
    return F.try_element_at(mapping(SIZE_RANK), size)


def risk_tier(prob: Column) -> Column:
    return (F.when(prob < 0.30, "Low").when(prob < 0.60, "Medium")
             .when(prob < 0.80, "High").when(prob.isNotNull(), "Critical"))


def revenue_at_risk(acv: Column, prob: Column) -> Column:
    """Contract value times probability, exact in DECIMAL, to the cent."""
    return F.round(acv * prob.cast("decimal(6,4)"), 2).cast("decimal(14,2)")


def urgency(months: Column) -> Column:
    return F.when(months <= 3, 1.0).when(months <= 6, 0.6).otherwise(0.2)


def priority_bucket(prob: Column, acv_rank_70: Column, acv_rank_40: Column) -> Column:
    """Bucket from probability and whether the value rank reaches 0.7 / 0.4."""
    return (F.when((prob >= 0.60) & acv_rank_70, "Critical")
             .when((prob >= 0.60) & acv_rank_40, "High")
             .when(prob >= 0.30, "Medium").otherwise("Low"))


def readable(factor: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping(READABLE_NAMES), factor),
                      F.replace(factor, F.lit("_"), F.lit(" ")))


def first_matching(rules: list[tuple[Column, str]], limit: int | None, separator: str,
                   default: str) -> Column:
    """Texts of the rules that hold, in rule order, joined; ``default`` when none does."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))
    if limit:
        hits = F.slice(hits, 1, limit)
    return F.when(F.size(hits) == 0, F.lit(default)).otherwise(F.concat_ws(separator, hits))


def recommended_action(tier: Column, acv_p75: float) -> Column:
    c = F.col
    rules = [
        ((c("Downtime_Hours") > 40) & (c("Annual_Contract_Value") > F.lit(acv_p75)), ACTION_NETWORK),
        ((c("Competitor_Considered") == 1) & (c("Competitor_Price_Difference") < -10), ACTION_PRICING),
        (c("Support_Satisfaction") < 5, ACTION_MANAGER),
        (c("SLA_Breaches") >= 2, ACTION_SLA),
        (c("Number_of_Services") <= 1, ACTION_ADOPTION),
        ((c("Contract_Remaining_Months") <= 3) & tier.isin("High", "Critical"), ACTION_RENEWAL),
    ]
    return F.when(tier == "Low", F.lit(NO_ACTION)).otherwise(
        first_matching(rules, 2, "; ", STANDARD_CALL))


def profile_reasons() -> Column:
    c = F.col
    # Thresholds and texts, in the order in which reasons are listed.
    rules = [
        (c("Downtime_Hours") > 30, "high downtime"),
        (c("Number_of_Complaints") > 5, "high complaint volume"),
        (c("Customer_Satisfaction_Score") < 6, "low satisfaction"),
        (c("SLA_Breaches") > 1, "repeated SLA breaches"),
        (c("Support_Response_Hours") > 12, "slow support response"),
        (c("Competitor_Considered") == 1, "actively considering a competitor"),
    ]
    return first_matching(rules, None, ", ", PROFILE_HEALTHY)


def profile_action(tier: Column) -> Column:
    return (F.when(tier.isin("High", "Critical"), PROFILE_ACTION_HIGH)
             .when(tier == "Medium", PROFILE_ACTION_MEDIUM).otherwise(PROFILE_ACTION_LOW))


def threat_level(csat: Column) -> Column:
    """Competitor threat banded from satisfaction, with right-closed edges."""
    base = clip(0.15 + (10 - csat) / 20, 0.02, 0.95)
    return (F.when(base <= 0.25, "Low").when(base <= 0.5, "Medium")
             .when(base <= 0.75, "High").when(base.isNotNull(), "Critical"))


def quality_score() -> Column:
    """Composite service quality, 20 to 100, in DECIMAL so that rounding is exact."""
    uptime = F.col("Network_Uptime").cast("decimal(6,3)")
    latency = F.col("Average_Latency_ms").cast("decimal(8,1)")
    loss = F.col("Packet_Loss_Percentage").cast("decimal(5,2)")
    response = F.col("Support_Response_Hours").cast("decimal(6,1)")

    def dec(text: str) -> Column:
        return F.lit(text).cast("decimal(6,2)")

    def percent(x: Column) -> Column:
        return F.greatest(dec("0"), F.least(dec("100"), x))

    score = (uptime * dec("0.50") + (dec("100") - percent(latency)) * dec("0.15")
             + (dec("100") - loss * dec("8")) * dec("0.15")
             + (dec("100") - percent(response)) * dec("0.20"))
    held = F.when(score.isNotNull(), F.greatest(dec("20"), F.least(dec("100"), score)))
    return F.round(held, 1).cast("double")


def nps_from_satisfaction(csat: Column) -> Column:
    return F.round(clip((csat - 5.5) * 22, -100.0, 100.0)).cast("int")


def complaint_bucket(complaints: Column) -> Column:
    return (F.when(complaints <= 0, "0").when(complaints <= 2, "1-2")
             .when(complaints <= 5, "3-5").when(complaints.isNotNull(), "6+"))
