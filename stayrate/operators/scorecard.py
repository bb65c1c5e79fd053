"""The published logistic scorecard: a churn model with fixed weights.

Fitting takes the population mean and deviation of each standardized input in one
aggregation. Scoring is then a narrow expression over literals, so it runs in the scan's
stage, and what-if or profile frames are scored against the baseline's statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions import rules
from stayrate.operators import stats

# Standardized inputs and their signed weights, and the intercept.
WEIGHTS = {
    "Downtime_Hours": 0.55,
    "Number_of_Outages": 0.35,
    "SLA_Breaches": 0.30,
    "Support_Response_Hours": 0.30,
    "Number_of_Complaints": 0.25,
    "Billing_Issues": 0.20,
    "Packet_Loss_Percentage": 0.20,
    "Customer_Satisfaction_Score": -0.55,
    "NPS_Score": -0.30,
    "Network_Uptime": -0.35,
    "Years_With_Provider": -0.20,
    "Number_of_Services": -0.12,
    "Company_Size_Rank": -0.18,
    "Contract_Window": 0.15,
}
COMPETITOR_TERM, COMPETITOR_WEIGHT = "Competitor_Pressure", 0.40
INTERCEPT = -2.35


def _inputs() -> dict[str, Column]:
    """Every column the scorecard reads; the last two make the competitor term."""
    derived = {
        "Company_Size_Rank": rules.size_rank(F.col("Company_Size")),
        "Contract_Window": F.when(F.col("Contract_Remaining_Months") <= 2, 1).otherwise(0),
    }
    names = [*WEIGHTS, "Competitor_Considered", "Competitor_Price_Difference"]
    return {name: derived.get(name, F.col(name)) for name in names}


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


@dataclass(frozen=True)
class Scorecard:
    """Fixed weights with the statistics of the population they were fitted on."""

    moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, population: DataFrame) -> Scorecard:
        inputs = _inputs()
        return cls(stats.moments(population, {name: inputs[name] for name in WEIGHTS}))

    def _term(self, name: str, inputs: dict[str, Column]) -> Column:
        if name == COMPETITOR_TERM:
            return F.lit(COMPETITOR_WEIGHT) * inputs["Competitor_Considered"] * (
                1 - inputs["Competitor_Price_Difference"] / 100)
        mean, std = self.moments[name]
        z = (inputs[name].cast("double") - F.lit(mean)) / F.lit(std + 1e-9)
        return F.lit(WEIGHTS[name]) * z

    def contributions(self) -> dict[str, Column]:
        """Logit contribution of each input; the competitor term is not standardized."""
        inputs = _inputs()
        return {name: self._term(name, inputs) for name in [*WEIGHTS, COMPETITOR_TERM]}

    def logit(self) -> Column:
        total = F.lit(INTERCEPT)
        for term in self.contributions().values():
            total = total + term
        return total

    def logit_change(self, replaced: dict[str, Column]) -> Column:
        """How much the logit moves when inputs are replaced; only their terms are computed."""
        inputs = _inputs()
        moved = {**inputs, **replaced}
        terms = dict.fromkeys(COMPETITOR_TERM if n.startswith("Competitor_") else n for n in replaced)
        change = F.lit(0.0)
        for term in terms:
            if term in WEIGHTS or term == COMPETITOR_TERM:
                change = change + (self._term(term, moved) - self._term(term, inputs))
        return change

    def probability(self) -> Column:
        """Unrounded churn probability."""
        return sigmoid(self.logit())

    def score(self, df: DataFrame, alias: str = "Churn_Probability") -> DataFrame:
        return df.withColumn(alias, F.round(self.probability(), 4))


def reason_scores(moments: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Scores of the deterministic churn reasons, in tie-break order. Names and weights are
    fixed values."""
    def z(name: str) -> Column:
        return stats.zscore(name, *moments[name])

    c = F.col
    return {
        "Poor Network Quality": z("Network_Uptime") * -1 + z("Packet_Loss_Percentage"),
        "Frequent Downtime": z("Downtime_Hours") + z("Number_of_Outages"),
        "Slow Customer Support": z("Support_Response_Hours") + z("Support_Resolution_Hours"),
        "High Pricing": F.when(c("Competitor_Price_Difference") < -10, 2.0).otherwise(0.0),
        "Billing Problems": z("Billing_Issues"),
        "Contract Issues": F.when(c("Contract_Remaining_Months") <= 2, 1.8).otherwise(0.0),
        "Poor Service Quality": (100 - rules.quality_score()) / 20,
        "Competitor Offer": c("Competitor_Considered") * 1.6,
        "Better Technology Elsewhere": F.when(
            c("Competitor_Considered") == 1, c("Competitor_Service_Rating") / 3).otherwise(0.0),
        "Service Reliability": z("SLA_Breaches"),
    }


REASON_INPUTS = ["Network_Uptime", "Packet_Loss_Percentage", "Downtime_Hours",
                 "Number_of_Outages", "Support_Response_Hours", "Support_Resolution_Hours",
                 "Billing_Issues", "SLA_Breaches"]


def dominant_factor(df: DataFrame, alias: str = "Dominant_Factor") -> DataFrame:
    """The highest-scoring reason per row; scores equal at 6 digits go to the first listed."""
    moments = stats.moments(df, {c: F.col(c) for c in REASON_INPUTS})
    ranked = F.array_max(F.array(*[
        F.struct(F.round(score, 6).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, score) in enumerate(reason_scores(moments).items())]))
    return df.withColumn("_best", ranked).withColumns({
        alias: F.col("_best.name"), f"{alias}_Score": F.col("_best.score")}).drop("_best")
