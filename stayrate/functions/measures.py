"""Aggregate columns shared by the reports, and the named-measure layer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total() -> Column:
    return F.count(F.lit(1))


def churned() -> Column:
    return F.sum("Churn").cast("bigint")


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is zero."""
    return F.round(F.try_divide((part * 100).cast("double"), whole.cast("double")), digits)


def churn_rate(digits: int = 2) -> Column:
    return share(F.sum("Churn"), total(), digits)


def churned_revenue() -> Column:
    """Contract value of churned accounts; 0.00 where a group has none."""
    return F.sum(F.when(F.col("Churn") == 1, F.col("Annual_Contract_Value"))
                  .otherwise(F.lit(0).cast("decimal(14,2)")))


def churn_summary(df: DataFrame, *by: str, revenue: bool = True) -> DataFrame:
    """Accounts, churned accounts, rate and (optionally) churned revenue per group."""
    columns = [total().alias("Total_Customers"), churned().alias("Churned_Customers"),
               churn_rate().alias("Churn_Rate_Pct")]
    if revenue:
        columns.append(churned_revenue().alias("Revenue_at_Risk"))
    return df.groupBy(*by).agg(*columns)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _high_risk() -> Column:
    return F.col("Risk_Category").isin("High", "Critical")


_BUILDERS = {
    "Total_Customers": total,
    "Churned_Customers": lambda: F.count_if(F.col("Churn") == 1),
    "Active_Customers": lambda: F.count_if(F.col("Churn") == 0),
    "Churn_Rate": lambda: _ratio(F.count_if(F.col("Churn") == 1), total()),
    "Revenue_at_Risk_Actual": churned_revenue,
    "Revenue_at_Risk_Predicted": lambda: F.sum("Revenue_at_Risk"),
    "Total_Portfolio_ACV": lambda: F.sum("Annual_Contract_Value"),
    "Pct_Revenue_at_Risk": lambda: _ratio(churned_revenue(), F.sum("Annual_Contract_Value")),
    "Avg_Customer_Lifetime": lambda: F.avg("Years_With_Provider"),
    "Avg_Satisfaction": lambda: F.avg("Customer_Satisfaction_Score"),
    "High_Risk_Customers": lambda: F.count_if(_high_risk()),
    "Critical_Risk_Revenue": lambda: F.sum(
        F.when(F.col("Risk_Category") == "Critical", F.col("Revenue_at_Risk"))
         .otherwise(F.lit(0).cast("decimal(14,2)"))),
}
MEASURES = list(_BUILDERS)


def measure(df: DataFrame, names: Iterable[str] = MEASURES, by: Iterable[str] = (),
            where: Column | None = None) -> DataFrame:
    """Evaluate named measures under a filter context, optionally per group."""
    names = list(names)
    unknown = [n for n in names if n not in _BUILDERS]
    if unknown:
        raise ValueError(f"unknown measures: {unknown}")
    scope = df if where is None else df.filter(where)
    return scope.groupBy(*by).agg(*[_BUILDERS[n]().alias(n) for n in names])
