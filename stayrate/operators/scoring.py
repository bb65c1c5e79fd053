"""From churn probability to tiers, value, priority, reasons and actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate import schemas
from stayrate.functions import rules
from stayrate.operators import features, ranks
from stayrate.operators.scorecard import Scorecard


@dataclass(frozen=True)
class Population:
    """The population figures that scoring compares each account with."""

    max_acv: float
    max_clv: float
    max_services: float
    acv_p75: float
    acv_rank_40: float
    acv_rank_70: float

    @classmethod
    def fit(cls, accounts: DataFrame) -> Population:
        """Maxima, the exact 75th percentile, and the contract values where the
        percentage rank reaches 0.4 and 0.7.

        The rank is monotone in the value, so those two cut values place every account
        and no per-row rank has to be computed or joined back.
        """
        top = accounts.agg(
            F.max(F.col("Annual_Contract_Value").cast("double")).alias("acv"),
            F.max(features.lifetime_value_cents()).alias("clv"),
            F.max(F.col("Number_of_Services").cast("double")).alias("services")).first()
        pct = ranks.average_rank_pct()
        cuts = ranks.running_counts(accounts, ["Annual_Contract_Value"]).agg(
            ranks.quantile(0.75).alias("p75"), ranks.value_reaching(pct, 0.4).alias("r40"),
            ranks.value_reaching(pct, 0.7).alias("r70")).first()
        if top["acv"] is None:
            return cls(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        return cls(top["acv"], top["clv"], top["services"], cuts["p75"], cuts["r40"], cuts["r70"])


def _log_share(x: Column, largest: float) -> Column:
    if not largest:
        return F.lit(0.0)
    return rules.clip(F.log1p(x) / F.log1p(F.lit(float(largest))), 0.0, 1.0)


def priority_score(pop: Population, prob: Column, acv: Column, clv: Column) -> Column:
    """0 to 100, one decimal: probability, value, lifetime value, breadth and urgency."""
    breadth = (rules.clip(F.col("Number_of_Services") / pop.max_services, 0.0, 1.0)
               if pop.max_services else F.lit(0.0))
    score = (0.45 * prob + 0.25 * _log_share(acv, pop.max_acv) + 0.15 * _log_share(clv, pop.max_clv)
             + 0.05 * breadth + 0.10 * rules.urgency(F.col("Contract_Remaining_Months")))
    return F.round(score * 100, 1)


def top_factors(contributions: dict[str, Column], top: int = 3) -> Column:
    """Names of the inputs that push risk up most, strongest first.

    Contributions are compared at 6 digits, so floating-point noise does not order equal
    drivers; equal ones go by name. Only raising inputs are sorted, by the order of structs,
    which ``array_sort`` would ask of an expression for each two of them.
    """
    pushes = F.array(*[
        F.struct((-F.round(value, 6)).alias("down"), F.lit(name).alias("name"))
        for name, value in contributions.items()])
    raising = F.sort_array(F.filter(pushes, lambda s: s["down"] < 0))
    return F.transform(F.slice(raising, 1, top), lambda s: s["name"])


def explain(df: DataFrame, contributions: dict[str, Column]) -> DataFrame:
    """Add the readable ``Top_Risk_Factors`` list and ``Main_Risk_Factor``."""
    names = F.transform(top_factors(contributions), rules.readable)
    shown = F.when(F.size(names) == 0, F.array(F.lit(rules.NO_FACTOR))).otherwise(names)
    return df.withColumn("_shown", shown).withColumns({
        "Top_Risk_Factors": F.concat_ws(", ", "_shown"),
        "Main_Risk_Factor": F.element_at("_shown", 1)}).drop("_shown")


def enrich(scored: DataFrame, contributions: dict[str, Column], pop: Population) -> DataFrame:
    """Tier, revenue at risk, lifetime value, priority, reasons and action per account.

    ``scored`` carries ``Churn_Probability`` rounded to four digits; tiers use that.
    """
    prob, acv = F.col("Churn_Probability"), F.col("Annual_Contract_Value").cast("double")
    df = scored.withColumns({
        "Risk_Category": rules.risk_tier(prob),
        "Revenue_at_Risk": rules.revenue_at_risk(F.col("Annual_Contract_Value"), prob),
        "CLV": features.lifetime_value_cents(),
    })
    df = df.withColumns({
        "Retention_Priority_Score": priority_score(pop, prob, acv, F.col("CLV")),
        "Retention_Priority_Bucket": rules.priority_bucket(
            prob, acv >= pop.acv_rank_70, acv >= pop.acv_rank_40),
    })
    df = explain(df, contributions)
    return df.withColumn("Recommended_Action",
                         rules.recommended_action(F.col("Risk_Category"), pop.acv_p75))


def score_accounts(accounts: DataFrame, card: Scorecard | None = None,
                   pop: Population | None = None) -> DataFrame:
    """Scorecard-scored accounts with every derived prediction column."""
    card = card or Scorecard.fit(accounts)
    pop = pop or Population.fit(accounts)
    return enrich(card.score(accounts), card.contributions(), pop)


def export(scored: DataFrame) -> DataFrame:
    return scored.select(*schemas.PREDICTION_COLUMNS)


def score_summary(predictions: DataFrame) -> DataFrame:
    """Accounts and revenue at risk per tier, per priority bucket, and in total."""
    label = F.inline(F.array(
        F.struct(F.lit("risk").alias("Section"), F.col("Risk_Category").alias("Label")),
        F.struct(F.lit("priority").alias("Section"),
                 F.col("Retention_Priority_Bucket").alias("Label")),
        F.struct(F.lit("total").alias("Section"), F.lit("all").alias("Label"))))
    return (predictions.select("Revenue_at_Risk", label).groupBy("Section", "Label")
            .agg(F.count(F.lit(1)).alias("Customers"),
                 F.sum("Revenue_at_Risk").alias("Revenue_at_Risk")))


def top_critical(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The critical-priority accounts with the highest priority score."""
    return (predictions.filter(F.col("Retention_Priority_Bucket") == "Critical")
            .orderBy(F.desc("Retention_Priority_Score"), "Customer_ID").limit(n)
            .select("Customer_ID", "Company_Name", "Churn_Probability", "Annual_Contract_Value",
                    "Main_Risk_Factor", "Recommended_Action"))
