"""Every registered query, as name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate import schemas
from stayrate.functions import measures as m
from stayrate.functions import rules
from stayrate.operators import (evaluation, features, filters, models, profiles, quality, ranks,
                                scorecard, scoring, stats, whatif)
from stayrate.plans import bi, eda, reports, retention
from stayrate.session import new_folder
from stayrate.sources import accounts as derived
from stayrate.sources import files, staging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result types every engine shares: BIGINT, DOUBLE (6 digits), text, dates, booleans."""
    columns = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            value = value.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), 6)
        columns.append(value.alias(f.name))
    return df.select(*columns)


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        return fn
    return register


def on_accounts(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    query(name)(lambda spark, sf_dir: fn(full_account(spark, sf_dir)))


def on_predictions(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    query(name)(lambda spark, sf_dir: fn(
        full_account(spark, sf_dir), retention.prediction(spark, sf_dir)))


def full_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.complete_accounts(staging.account(spark, sf_dir))


def with_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.customers_with_risk(full_account(spark, sf_dir),
                                       retention.prediction(spark, sf_dir))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score, Risk_Category) of the test rows, scored by the scorecard."""
    marked = features.stratified_split(staging.account(spark, sf_dir).select("Customer_ID", "Churn"))
    scored = retention.prediction(spark, sf_dir).select("Customer_ID", "Churn_Probability",
                                                        "Risk_Category")
    return (marked.filter("Is_Test").join(scored, "Customer_ID")
            .select(F.col("Churn").alias("label"), F.col("Churn_Probability").alias("score"),
                    "Risk_Category"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.with_defects(full_account(spark, sf_dir))


# --- Scans, loads and sinks ---------------------------------------------------------------

def _csv_copy(spark: SparkSession, sf_dir: str, compression: str | None) -> DataFrame:
    """Accounts written as CSV (or .csv.gz) and scanned back under their schema."""
    source = full_account(spark, sf_dir)
    path = new_folder(spark, "accounts-csv")
    files.write_csv(source, path, compression)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.scan_csv(spark, path, source.schema, width if compression else None)


@query("scan_csv")
def scan_csv(spark, sf_dir):
    return _csv_copy(spark, sf_dir, None)


@query("scan_csv_gz")
def scan_csv_gz(spark, sf_dir):
    return _csv_copy(spark, sf_dir, "gzip")


@query("load_customers")
def load_customers(spark, sf_dir):
    wide = staging.account_wide(spark, sf_dir)
    path = new_folder(spark, "wide-csv")
    files.write_csv(wide, path)
    return files.load_customers(spark, path, wide.schema, staging.flag_services(spark, sf_dir))


@query("load_catalog")
def load_catalog(spark, sf_dir):
    path = new_folder(spark, "catalog-csv")
    files.write_csv(staging.catalog(spark, sf_dir), path)
    return files.load_catalog(spark, path)


@query("load_bridge")
def load_bridge(spark, sf_dir):
    path = new_folder(spark, "bridge-csv")
    files.write_csv(staging.bridge(spark, sf_dir), path)
    return files.load_bridge(spark, path, "BIGINT")


@query("load_predictions")
def load_predictions(spark, sf_dir):
    paths = files.write_predictions(retention.prediction(spark, sf_dir),
                                    new_folder(spark, "predictions"))
    return files.load_predictions(spark, paths["table_csv"], "BIGINT")


@query("load_counts")
def load_counts(spark, sf_dir):
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(m.total().alias("Rows")).select(F.lit(name).alias("Table_Name"), "Rows")
    return (counted(staging.account(spark, sf_dir), "customers")
            .unionByName(counted(staging.bridge(spark, sf_dir), "customer_services"))
            .unionByName(counted(staging.catalog(spark, sf_dir), "service_catalog"))
            .unionByName(counted(retention.prediction(spark, sf_dir), "churn_predictions")))


@query("sink_predictions")
def sink_predictions(spark, sf_dir):
    folder = new_folder(spark, "predictions")
    files.write_predictions(retention.prediction(spark, sf_dir), folder)
    return spark.read.parquet(f"{folder}/full")


@query("scan_optional")
def scan_optional(spark, sf_dir):
    """Customers joined with predictions where some have been written: here, none yet."""
    found = files.optional_table(spark, new_folder(spark, "not-written-yet"))
    return reports.customers_with_risk(full_account(spark, sf_dir), found)


# --- Filters and mappings ------------------------------------------------------------------

on_accounts("filter_churned", lambda a: a.filter(F.col("Churn") == 1).select(
    "Customer_ID", "State", "Annual_Contract_Value", "Churn_Date", "Churn_Reason"))
on_predictions("filter_in", lambda a, p: p.filter(
    F.col("Risk_Category").isin("High", "Critical")).select(
    "Customer_ID", "Risk_Category", "Churn_Probability", "Revenue_at_Risk"))


@query("slice_filter")
def slice_filter(spark, sf_dir):
    choices = {"State": [], "City": [], "Industry": ["BUILDING", "MACHINERY"],
               "Customer_Segment": ["SMB", "Mid-Market"], "Risk_Category": ["Medium", "High"]}
    return filters.slice_by(with_risk(spark, sf_dir), choices).select(
        "Customer_ID", "Industry", "Customer_Segment", "Risk_Category", "Annual_Contract_Value")


@query("filter_all_services")
def filter_all_services(spark, sf_dir):
    return filters.with_all_services(
        staging.account(spark, sf_dir), staging.bridge(spark, sf_dir),
        ["Brand#11", "Brand#23"]).select("Customer_ID", "State", "Number_of_Services")


@query("filter_all_flags")
def filter_all_flags(spark, sf_dir):
    return filters.with_all_flags(staging.account_wide(spark, sf_dir),
                                  ["Service_1", "Service_2"]).select("Customer_ID", "Churn")


@query("slicer_values")
def slicer_values(spark, sf_dir):
    return filters.slicer_values(with_risk(spark, sf_dir), [
        "State", "City", "Industry", "Customer_Segment", "Churn_Reason", "Contract_Type",
        "Risk_Category"])


on_accounts("reason_category", eda.reason_table)
on_accounts("column_groups", eda.column_groups)

# --- Joins ---------------------------------------------------------------------------------

query("customers_with_risk")(lambda spark, sf_dir: with_risk(spark, sf_dir).select(
    "Customer_ID", "State", "Churn", "Churn_Probability", "Risk_Category", "Revenue_at_Risk", "CLV",
    "Retention_Priority_Score", "Retention_Priority_Bucket", "Main_Risk_Factor",
    "Recommended_Action"))
query("risk_distribution")(lambda spark, sf_dir: bi.risk_distribution(with_risk(spark, sf_dir)))

# --- Business reports ----------------------------------------------------------------------

on_accounts("total_customers", reports.total_customers)
on_accounts("total_churn", reports.total_churn)
on_accounts("churn_rate", reports.churn_rate)
on_accounts("churn_by_state", reports.churn_by_state)
on_accounts("churn_by_city", lambda a: reports.churn_by_city(a, min_customers=25))
on_accounts("churn_by_industry", reports.churn_by_industry)
on_accounts("churn_by_segment", reports.churn_by_segment)
on_accounts("churn_by_contract", reports.churn_by_contract)
on_accounts("churn_by_size", reports.churn_by_size)
on_accounts("churn_by_reason", reports.churn_by_reason)
on_accounts("churn_by_category", reports.churn_by_category)
on_accounts("revenue_lost", reports.revenue_lost)
on_accounts("top_churned_accounts", reports.top_churned_accounts)
on_accounts("active_profile", reports.active_profile)
on_accounts("complaints_p75", reports.complaints_p75)
on_accounts("churn_by_sla", reports.churn_by_sla)
on_accounts("churned_vs_active", reports.churned_vs_active)
on_predictions("high_risk_customers", reports.high_risk_customers)
on_predictions("retention_top3_by_state", reports.retention_top_by_state)
on_predictions("priority_list", reports.priority_list)


@query("churn_by_service")
def churn_by_service(spark, sf_dir):
    return reports.churn_by_service(staging.account(spark, sf_dir), staging.bridge(spark, sf_dir),
                                    staging.catalog(spark, sf_dir))


# --- Exploration ---------------------------------------------------------------------------

on_accounts("state_rate_vs_volume", lambda a: eda.rate_vs_volume(a, "State", 10))
on_accounts("city_rate_vs_volume", lambda a: eda.rate_vs_volume(a, "City", 15, min_customers=25))
query("service_churn_wide")(lambda spark, sf_dir: eda.service_churn_wide(
    staging.account_wide(spark, sf_dir), list(staging.flag_services(spark, sf_dir))))
on_accounts("value_counts", lambda a: eda.value_counts(a, {
    "Company_Size": None, "Customer_Segment": None, "Industry": 10, "Contract_Type": None,
    "Churn": None}))
on_accounts("class_balance", eda.class_balance)
on_accounts("describe_numeric", lambda a: stats.describe(a, schemas.KEY_NUMERIC))
on_accounts("profile_schema", stats.profile_schema)
on_accounts("histogram", lambda a: stats.histogram(
    a, {"Network_Uptime": 40, "Customer_Satisfaction_Score": 20}))
on_accounts("boxplot_stats", lambda a: stats.boxplot(
    a, ["Downtime_Hours", "Customer_Satisfaction_Score"], "Churn"))
on_accounts("corr_matrix", lambda a: stats.correlation_matrix(a, schemas.CHURN_DRIVERS))
on_accounts("corr_with_churn", eda.corr_with_churn)
on_accounts("collinear_pairs", eda.collinear_pairs)
on_accounts("driver_gap", eda.driver_gap)
on_accounts("segment_value_share", eda.segment_value_share)
on_accounts("loyal_vs_churned", eda.loyal_vs_churned)


@query("insight_summary")
def insight_summary(spark, sf_dir):
    return eda.insight_summary(full_account(spark, sf_dir), churn_by_service(spark, sf_dir))


# --- Data quality --------------------------------------------------------------------------

query("null_profile")(lambda spark, sf_dir: quality.null_profile(dirty(spark, sf_dir)))
query("duplicate_profile")(lambda spark, sf_dir: quality.duplicate_profile(
    dirty(spark, sf_dir).drop("Ingest_Order")))
query("range_violations")(lambda spark, sf_dir: quality.range_violations(dirty(spark, sf_dir)))
query("fill_structural_nulls")(lambda spark, sf_dir: quality.fill_structural_nulls(
    dirty(spark, sf_dir)).select("Customer_ID", "Ingest_Order", "Churn_Reason", "Churn_Category",
                                 "Competitor_Offer", "Churn_Date"))
query("dedupe_keep_first")(lambda spark, sf_dir: quality.keep_first(
    dirty(spark, sf_dir), order="Ingest_Order").select(
    "Customer_ID", "Ingest_Order", "State", "Network_Uptime", "Annual_Contract_Value"))
on_accounts("iqr_outliers", lambda a: quality.iqr_outliers(a, "Annual_Contract_Value").select(
    "Customer_ID", "Annual_Contract_Value", "Is_Outlier"))
query("validation_report")(lambda spark, sf_dir: quality.validation_report(
    dirty(spark, sf_dir).drop("Ingest_Order")))


@query("validated_accounts")
def validated_accounts(spark, sf_dir):
    clean, _ = quality.validate(dirty(spark, sf_dir), order="Ingest_Order")
    return clean.select("Customer_ID", "State", "Network_Uptime", "Churn_Reason", "Churn_Category",
                        "Competitor_Offer")


@query("fk_orphans")
def fk_orphans(spark, sf_dir):
    """Constraint violations of the whole tables with defective rows added to each."""
    return quality.integrity_report(*derived.with_broken_keys(
        staging.account(spark, sf_dir), staging.bridge(spark, sf_dir),
        staging.catalog(spark, sf_dir), retention.prediction(spark, sf_dir)))


# --- Features ------------------------------------------------------------------------------

on_accounts("feature_clv", lambda a: a.select(
    "Customer_ID", features.lifetime_value_cents().alias("CLV")))
on_accounts("features", lambda a: features.engineer(a).select(
    "Customer_ID", *[f for f in features.ENGINEERED if f != "CLV"]))


@query("feature_columns")
def feature_columns(spark, sf_dir):
    """The model input columns and how many accounts have a value in each."""
    return stats.profile_schema(features.model_columns(full_account(spark, sf_dir)))


def _ones(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    names = features.encoded_names(categories)
    encoded = features.one_hot(df.select("Customer_ID", *categories), categories)
    set_cells = F.array_compact(F.array(*[
        F.when(F.col(f"`{n}`") == 1, F.lit(n)) for n in names]))
    return encoded.select("Customer_ID", F.explode(set_cells).alias("Feature"))


@query("one_hot")
def one_hot(spark, sf_dir):
    """The set cells of the one-hot matrix, as (customer, feature) rows."""
    accounts = staging.account(spark, sf_dir)
    return _ones(accounts, features.fit_categories(accounts))


@query("one_hot_unseen")
def one_hot_unseen(spark, sf_dir):
    """Set cells when the encoder was fitted without one region's accounts."""
    accounts = staging.account(spark, sf_dir)
    known = accounts.filter(F.col("Region") != "ASIA")
    return _ones(accounts, features.fit_categories(known, ["State", "City", "Region"]))


@query("one_hot_sparse")
def one_hot_sparse(spark, sf_dir):
    """The same cells read off the sparse vectors that models are given."""
    accounts = staging.account(spark, sf_dir)
    known = features.fit_categories(accounts.filter(F.col("Region") != "ASIA"), ["State", "City", "Region"])
    encoded, vectors = features.one_hot_vectors(accounts, features.category_indexes(known))
    cells = F.concat(*[vector_to_array(v) for v in vectors])
    names = F.array(*map(F.lit, features.encoded_names(known)))
    flagged = F.filter(F.arrays_zip(cells.alias("cell"), names.alias("name")), lambda x: x["cell"] == 1)
    return encoded.select("Customer_ID", F.explode(flagged).alias("f")).select(
        "Customer_ID", F.col("f.name").alias("Feature"))


# --- Standard scores and derived scores ----------------------------------------------------

on_accounts("zscore", lambda a: a.select("Customer_ID", *[
    stats.zscore(c, *moment).alias(c) for c, moment in stats.moments(
        a, {c: F.col(c) for c in ("Downtime_Hours", "NPS_Score")}).items()]))
on_accounts("threat_level", lambda a: a.select("Customer_ID", rules.threat_level(
    F.col("Customer_Satisfaction_Score")).alias("Threat_Level")))
on_accounts("quality_score", lambda a: a.select("Customer_ID", "Service_Quality_Score"))
on_accounts("nps_score", lambda a: a.select("Customer_ID", rules.nps_from_satisfaction(
    F.col("Customer_Satisfaction_Score")).alias("NPS")))


@query("dominant_factor")
def dominant_factor(spark, sf_dir):
    """The strongest deterministic reason of each churned account; scores are standardized
    over the whole population."""
    scored = scorecard.dominant_factor(staging.account(spark, sf_dir))
    return scored.filter(F.col("Churn") == 1).select(
        "Customer_ID", "Dominant_Factor", "Dominant_Factor_Score")


@query("dedupe_names")
def dedupe_names(spark, sf_dir):
    """Repeated names get ' 2', ' 3', ... in customer order."""
    named = staging.account(spark, sf_dir).select(
        "Customer_ID", F.concat_ws(" ", "Industry", "Company_Size").alias("Name"))
    numbered = ranks.ordinal_within(named, "Name", "Customer_ID", "_n")
    return numbered.select("Customer_ID", F.when(F.col("_n") == 1, F.col("Name")).otherwise(
        F.concat_ws(" ", "Name", F.col("_n").cast("string"))).alias("Unique_Name"))


@query("services_bridge")
def services_bridge(spark, sf_dir):
    return files.services_bridge(staging.account_wide(spark, sf_dir), list(staging.flag_services(spark, sf_dir)))


# --- Scoring -------------------------------------------------------------------------------

def _prediction_columns(*columns: str) -> Query:
    return lambda spark, sf_dir: retention.prediction(spark, sf_dir).select("Customer_ID", *columns)


query("scorecard")(lambda spark, sf_dir: scorecard.Scorecard.fit(staging.account(spark, sf_dir)).score(
    staging.account(spark, sf_dir)).select("Customer_ID", "Churn_Probability"))
query("risk_tier")(_prediction_columns("Churn_Probability", "Risk_Category"))
query("revenue_at_risk")(_prediction_columns("Revenue_at_Risk"))
query("priority_score")(_prediction_columns("CLV", "Retention_Priority_Score"))
query("priority_bucket")(_prediction_columns("Retention_Priority_Bucket"))
query("recommended_action")(_prediction_columns("Recommended_Action"))
query("readable_factors")(_prediction_columns("Top_Risk_Factors", "Main_Risk_Factor"))
on_predictions("score_summary", lambda a, p: scoring.score_summary(p))
on_predictions("top_critical", lambda a, p: scoring.top_critical(p))


@query("risk_factors")
def risk_factors(spark, sf_dir):
    """Raw names of up to three inputs that push an account's risk up, in order."""
    accounts = staging.account(spark, sf_dir)
    names = scoring.top_factors(scorecard.Scorecard.fit(accounts).contributions())
    return accounts.select("Customer_ID", F.concat_ws(",", names).alias("Risk_Factors"))


@query("acv_percentile_rank")
def acv_percentile_rank(spark, sf_dir):
    slim = staging.account(spark, sf_dir).select("Customer_ID", "Annual_Contract_Value")
    return ranks.attach_rank_pct(slim, "Annual_Contract_Value", "Rank_Pct").select(
        "Customer_ID", "Rank_Pct")


@query("retention_scores")
def retention_scores(spark, sf_dir):
    """The whole scoring job on the account table: clean, score, explain, recommend."""
    return scoring.export(retention.score_with_scorecard(staging.account(spark, sf_dir)))


@query("retention_from_csv")
def retention_from_csv(spark, sf_dir):
    """The job over its real entry: a CSV that lists churned accounts a second time, under
    another state, is validated and scored, and the full export is read back."""
    accounts = full_account(spark, sf_dir)
    again = accounts.filter(F.col("Churn") == 1).withColumn("State", F.lit("Elsewhere"))
    path = new_folder(spark, "customers-csv")
    files.write_csv(accounts.unionByName(again), path)
    clean, _ = retention.validated_customers(spark, path, accounts.schema)
    exported = files.write_predictions(retention.score_with_scorecard(clean),
                                       new_folder(spark, "predictions"))
    return spark.read.parquet(exported["full"])


def _profile_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypothetical profile per account; inputs that were not asked stay empty."""
    accounts = staging.account(spark, sf_dir)
    return accounts.select(
        F.col("Customer_ID").alias("Profile_ID"), "Years_With_Provider", "Monthly_Bill",
        "Network_Uptime", "Downtime_Hours", "Number_of_Complaints", "Customer_Satisfaction_Score",
        "Support_Response_Hours", "SLA_Breaches", "Number_of_Services",
        F.when(F.col("Contract_Type") != "Monthly", F.col("Contract_Remaining_Months"))
         .alias("Contract_Remaining_Months"),
        F.when(F.col("Company_Size") != "Small", F.col("Company_Size")).alias("Company_Size"),
        "Competitor_Considered")


def _scored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = scorecard.Scorecard.fit(staging.account(spark, sf_dir))
    return profiles.score_profiles(_profile_inputs(spark, sf_dir), card)


query("score_profiles")(lambda spark, sf_dir: _scored_profiles(spark, sf_dir).select(
    "Profile_ID", "Contract_Remaining_Months", "Company_Size", "NPS_Score", "Number_of_Outages",
    "Annual_Contract_Value", "Churn_Probability", "Risk_Category"))
query("profile_reasons")(lambda spark, sf_dir: _scored_profiles(spark, sf_dir).select(
    "Profile_ID", "Main_Risk_Factors", "Recommended_Action"))


# --- What-if -------------------------------------------------------------------------------

def _scenario(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        card = scorecard.Scorecard.fit(staging.account(spark, sf_dir))
        return whatif.what_if(with_risk(spark, sf_dir), card, [(name, 0.2), (name, 0.5)])
    return run


query("whatif_downtime")(_scenario("reduce_downtime"))
query("whatif_support")(_scenario("improve_support_response"))
query("whatif_offer")(_scenario("retention_offer_high_risk"))


@query("whatif_grid")
def whatif_grid(spark, sf_dir):
    card = scorecard.Scorecard.fit(staging.account(spark, sf_dir))
    cases = [(s, g) for s in whatif.SCENARIOS for g in (0.0, 0.1, 0.2, 0.3)]
    return whatif.what_if(with_risk(spark, sf_dir), card, cases).drop("Note")


# --- Dashboard -----------------------------------------------------------------------------

query("measures")(lambda spark, sf_dir: m.measure(with_risk(spark, sf_dir)))
query("measures_sliced")(lambda spark, sf_dir: m.measure(
    with_risk(spark, sf_dir), by=["Region"], where=F.col("Contract_Type") == "Annual"))
on_accounts("monthly_churn_trend", bi.monthly_churn_trend)
on_accounts("city_revenue_lost", bi.city_revenue_lost)
on_accounts("churn_by_downtime_bin", bi.churn_by_downtime_bin)
on_accounts("churn_by_complaint_bucket", bi.churn_by_complaint_bucket)
on_accounts("geo_rollup", bi.geo_rollup)
on_accounts("experience_grid", bi.experience_grid)
on_accounts("kpi_overview", bi.kpi_overview)
query("kpi_risk")(lambda spark, sf_dir: bi.kpi_risk(with_risk(spark, sf_dir)))
query("active_exposure")(lambda spark, sf_dir: bi.active_exposure(with_risk(spark, sf_dir)))

# --- Splitting, evaluation and models ------------------------------------------------------

query("stratified_split")(lambda spark, sf_dir: features.stratified_split(
    staging.account(spark, sf_dir).select("Customer_ID", "Churn")))


@query("standardize")
def standardize(spark, sf_dir):
    """Two inputs standardized with the statistics of the training rows only."""
    columns = ["Downtime_Hours", "Support_Response_Hours"]
    marked = features.stratified_split(
        staging.account(spark, sf_dir).select("Customer_ID", "Churn", *columns))
    return stats.standardize(marked, columns, fit_on=marked.filter(~F.col("Is_Test"))).select(
        "Customer_ID", *columns)


query("eval_metrics")(lambda spark, sf_dir: evaluation.metrics(held_out(spark, sf_dir)))
query("confusion_matrix")(lambda spark, sf_dir: evaluation.confusion_matrix(held_out(spark, sf_dir)))
query("classification_report")(lambda spark, sf_dir: evaluation.classification_report(
    held_out(spark, sf_dir)))
query("roc_curve")(lambda spark, sf_dir: evaluation.roc_curve(held_out(spark, sf_dir)))
query("baseline_accuracy")(lambda spark, sf_dir: evaluation.baseline_accuracy(held_out(spark, sf_dir)))
query("tier_calibration")(lambda spark, sf_dir: evaluation.tier_calibration(held_out(spark, sf_dir)))

_trained: dict[tuple[str, str], models.Training] = {}


def _training(spark: SparkSession, sf_dir: str) -> models.Training:
    """The training run of this application: all four models, fitted on first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        _trained[key] = models.train_and_select(full_account(spark, sf_dir))
    return _trained[key]


def _held_out_metrics(name: str) -> Query:
    return lambda spark, sf_dir: _training(spark, sf_dir).comparison.filter(
        F.col("Model") == name).drop("Selected")


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, sf_dir).comparison


def _selected(spark: SparkSession, sf_dir: str) -> models.ChurnModel:
    return _training(spark, sf_dir).selected


query("model_comparison")(_comparison)
query("model_lr")(_held_out_metrics(models.LOGISTIC))
query("model_dt")(_held_out_metrics(models.TREE))
query("model_gbt")(_held_out_metrics(models.BOOSTED))
query("model_rf_select")(lambda spark, sf_dir: _training(spark, sf_dir).forests)


@query("sink_metrics")
def sink_metrics(spark, sf_dir):
    """The report of the training run written as JSON, and its comparison read back."""
    path = new_folder(spark, "metrics")
    files.write_report(spark, _selected(spark, sf_dir).report, path)
    rows = T.ArrayType(_comparison(spark, sf_dir).schema)
    return (spark.read.schema(T.StructType([T.StructField("models", rows)])).json(path)
            .select(F.inline("models")))


@query("sink_report")
def sink_report(spark, sf_dir):
    """The whole written report read back: sizes, and whether its parts fit together."""
    path = new_folder(spark, "report")
    files.write_report(spark, _selected(spark, sf_dir).report, path)
    figures = T.ArrayType(_comparison(spark, sf_dir).schema)
    schema = T.StructType([T.StructField("models", figures)] + T.StructType.fromDDL(
        "best_model STRING, top_features ARRAY<STRUCT<Feature: STRING, Importance: DOUBLE>>, "
        "train_rows BIGINT, test_rows BIGINT").fields)
    sizes = F.col("top_features.Importance")
    return spark.read.schema(schema).json(path).select(
        F.size("models").cast("bigint").alias("Models"), F.size("top_features").cast("bigint").alias("Features"),
        F.col("train_rows").alias("Train_Rows"), F.col("test_rows").alias("Test_Rows"),
        ((F.col("models")[0]["Model"] == F.col("best_model"))
         & (F.col("models")[0]["ROC_AUC"] == F.array_max("models.ROC_AUC"))
         & (F.size(F.filter("models", lambda m: m["Selected"])) == 1)).alias("Best_Is_First"),
        (sizes == F.sort_array(sizes, asc=False)).alias("Features_Sorted"))


@query("model_lr_optimality")
def model_lr_optimality(spark, sf_dir):
    """Whether each coefficient of the logistic model is at the optimum of its objective."""
    run = _training(spark, sf_dir)
    return run.models[models.LOGISTIC].optimality(run.train).select("Feature", "Is_Optimal")


@query("model_dt_leaves")
def model_dt_leaves(spark, sf_dir):
    """The leaves of the decision tree: together all training rows, each within its limits."""
    run = _training(spark, sf_dir)
    leaves = run.models[models.TREE].leaves(run.train)
    return leaves.agg(F.sum("Rows").alias("Training_Rows"), F.sum("Churned").alias("Training_Churned"),
                      F.round(F.sum("Weight"), 6).alias("Weight"),
                      (F.min("Rows") >= 25).alias("Leaves_Large_Enough"),
                      (F.max("Depth") <= 8).alias("Depth_Allowed"))


@query("feature_importance_checked")
def feature_importance_checked(spark, sf_dir):
    return _selected(spark, sf_dir).encoded_importance(spark).drop("Feature", "Importance")


query("feature_importance")(lambda spark, sf_dir: _selected(spark, sf_dir).importance(spark))
query("score_model")(lambda spark, sf_dir: scoring.export(retention.score_with_model(
    full_account(spark, sf_dir), _selected(spark, sf_dir))))


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Probabilities of the selected model after saving and loading it."""
    folder = new_folder(spark, "model")
    _selected(spark, sf_dir).save(spark, folder)
    loaded = models.ChurnModel.load(spark, folder)
    return loaded.score(full_account(spark, sf_dir)).select("Customer_ID", "Churn_Probability")


@query("model_artifact")
def model_artifact(spark, sf_dir):
    """Whether each account's probability is the same after saving and loading the model."""
    folder = new_folder(spark, "model")
    model = _selected(spark, sf_dir)
    model.save(spark, folder)
    return model.differences(models.ChurnModel.load(spark, folder), full_account(spark, sf_dir))


query("score_profiles_model")(lambda spark, sf_dir: profiles.score_profiles(
    _profile_inputs(spark, sf_dir), _selected(spark, sf_dir)).select(
    "Profile_ID", "Churn_Probability", "Risk_Category", "Main_Risk_Factors", "Recommended_Action"))


@query("whatif_model")
def whatif_model(spark, sf_dir):
    """Two scenarios re-scored by the selected classifier."""
    model = _selected(spark, sf_dir)
    scored = model.score(full_account(spark, sf_dir))
    scored = scored.withColumn("Risk_Category", rules.risk_tier(F.col("Churn_Probability")))
    return whatif.what_if_model(scored, model, [(s, 0.2) for s in whatif.SCENARIOS])
