"""The scoring job and the training artifacts it can use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate import schemas
from stayrate.functions import rules
from stayrate.operators import features, quality, scoring
from stayrate.operators.models import ChurnModel
from stayrate.operators.scorecard import Scorecard
from stayrate.sources import files, staging


def validated_customers(spark: SparkSession, path: str, schema: str | T.StructType = schemas.CUSTOMERS,
                        **options) -> tuple[DataFrame, DataFrame]:
    """(clean customers, report) of a customer CSV: checks, labels, first row per key."""
    raw = files.scan_csv(spark, path, schema, ingest_order="_order", **options)
    # Parsed once: the checks and the deduplication read the written rows.
    return quality.validate(staging.materialized(raw, "parsed"), order="_order")


def complete_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts with the derived quality score and churn category columns."""
    return accounts.withColumns({
        "Service_Quality_Score": rules.quality_score(),
        "Churn_Category": rules.reason_category(F.col("Churn_Reason"))})


def score_with_scorecard(accounts: DataFrame) -> DataFrame:
    """Clean the accounts, score them, and derive every prediction column.

    Where rows had to go, the clean ones are written once: three statistics passes and the
    scoring read them.
    """
    filled = quality.fill_structural_nulls(complete_accounts(accounts))
    clean = quality.keep_first(filled)
    if clean is not filled:
        clean = staging.materialized(clean, "clean")
    return scoring.score_accounts(clean, Scorecard.fit(clean), scoring.Population.fit(clean))


def score_with_model(accounts: DataFrame, model: ChurnModel) -> DataFrame:
    """The same derivation on a trained classifier; reasons may name engineered inputs."""
    inputs = features.engineer(accounts)
    return scoring.enrich(model.score(inputs), model.contributions(accounts),
                          scoring.Population.fit(accounts))


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written prediction table of the scorecard job, one row per account."""
    return staging.written(
        spark, sf_dir, "prediction",
        lambda: scoring.export(scoring.score_accounts(staging.account(spark, sf_dir))))
