"""Boundary values of the business rules."""

import pytest
from pyspark.sql import functions as F

from stayrate.functions import measures, rules
from stayrate.operators import features, filters, profiles, scoring, stats, whatif
from stayrate.operators.scorecard import Scorecard
from stayrate.plans import bi, reports
from tests.frames import accounts, column


def values(spark, kind, items, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return column(df.withColumn("y", expr(F.col("x"))), "y", "i")


def test_risk_tier_edges(spark):
    got = values(spark, "double", [0.2999, 0.30, 0.5999, 0.60, 0.7999, 0.80, None], rules.risk_tier)
    assert got == ["Low", "Medium", "Medium", "High", "High", "Critical", None]


def test_urgency_edges(spark):
    assert values(spark, "int", [3, 4, 6, 7], rules.urgency) == [1.0, 0.6, 0.6, 0.2]


def test_threat_level_is_right_closed(spark):
    assert values(spark, "double", [8.0, 7.9, 3.0, 2.9, 1.0], rules.threat_level) == [
        "Low", "Medium", "Medium", "High", "High"]


def test_priority_bucket(spark):
    df = spark.createDataFrame([(0.6, True, True), (0.6, False, True), (0.6, False, False),
                                (0.3, True, True), (0.29, True, True)], "p double, a boolean, b boolean")
    got = [r[0] for r in df.select(rules.priority_bucket(F.col("p"), F.col("a"), F.col("b"))).collect()]
    assert got == ["Critical", "High", "Medium", "Medium", "Low"]


def test_reason_category(spark):
    got = values(spark, "string", ["High Pricing", "Business Closure", "never heard", None],
                 rules.reason_category)
    assert got == ["Commercial", "Other", "Other", None]


def test_readable(spark):
    assert values(spark, "string", ["NPS_Score", "Some_Other_Input"], rules.readable) == [
        "Low NPS / low willingness to recommend", "Some Other Input"]


@pytest.mark.parametrize("change, tier, expected", [
    ({"Downtime_Hours": 40.0, "Annual_Contract_Value": "2000.00"}, "Medium", rules.STANDARD_CALL),
    ({"Downtime_Hours": 40.1, "Annual_Contract_Value": "2000.00"}, "Medium", rules.ACTION_NETWORK),
    ({"Downtime_Hours": 40.1, "Annual_Contract_Value": "1500.00"}, "Medium", rules.STANDARD_CALL),
    ({"Competitor_Considered": 1, "Competitor_Price_Difference": -10.0}, "High", rules.STANDARD_CALL),
    ({"Competitor_Considered": 1, "Competitor_Price_Difference": -10.1}, "High", rules.ACTION_PRICING),
    ({"Support_Satisfaction": 5.0}, "High", rules.STANDARD_CALL),
    ({"Support_Satisfaction": 4.9}, "High", rules.ACTION_MANAGER),
    ({"SLA_Breaches": 1}, "High", rules.STANDARD_CALL),
    ({"SLA_Breaches": 2}, "High", rules.ACTION_SLA),
    ({"Number_of_Services": 2}, "High", rules.STANDARD_CALL),
    ({"Number_of_Services": 1}, "High", rules.ACTION_ADOPTION),
    ({"Contract_Remaining_Months": 3}, "Medium", rules.STANDARD_CALL),
    ({"Contract_Remaining_Months": 3}, "Critical", rules.ACTION_RENEWAL),
    ({"SLA_Breaches": 2, "Number_of_Services": 1, "Contract_Remaining_Months": 1}, "High",
     f"{rules.ACTION_SLA}; {rules.ACTION_ADOPTION}"),
    ({"SLA_Breaches": 2}, "Low", rules.NO_ACTION),
])
def test_recommended_action(spark, change, tier, expected):
    df = accounts(spark, [change]).withColumn("t", F.lit(tier))
    assert column(df.withColumn("a", rules.recommended_action(F.col("t"), 1500.0)), "a") == [expected]


def test_explanation_falls_back_and_breaks_ties_by_name(spark):
    df = spark.range(1).withColumnRenamed("id", "Customer_ID")
    none = scoring.explain(df, {"A": F.lit(-1.0), "B": F.lit(0.0)}).first()
    assert none["Main_Risk_Factor"] == none["Top_Risk_Factors"] == rules.NO_FACTOR
    tied = scoring.explain(df, {"Zeta_X": F.lit(0.5), "Alpha_Y": F.lit(0.5), "Mid": F.lit(0.7),
                                "Low": F.lit(0.1)}).first()
    assert tied["Top_Risk_Factors"] == "Mid, Alpha Y, Zeta X"


def test_only_raising_factors_are_sorted(spark):
    """The array of all inputs was sorted by an expression asked of each two of them. Null, nan,
    lowering and vanishing inputs name no factor; equal ones beyond six digits go by name."""
    df = spark.createDataFrame([(1, 0.2, None), (2, float("nan"), 0.2000000001), (3, -0.1, 1e-9), (4, None, None)],
                               "Customer_ID int, a double, b double")
    out = scoring.explain(df, {"Zed": F.col("a"), "Bee": F.col("b"), "Cat": F.lit(0.2), "Dog": F.lit(0.1),
                               "Ape": F.lit(0.3)})
    assert column(out, "Top_Risk_Factors") == ["Ape, Cat, Zed", "Ape, Bee, Cat", "Ape, Cat, Dog", "Ape, Cat, Dog"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan and "sort_array(filter" in plan


def test_rates_of_empty_and_extreme_slices(spark):
    df = accounts(spark, [{"State": "none"}, {"State": "all", "Churn": 1}])
    rate = {r["State"]: r["Churn_Rate_Pct"] for r in measures.churn_summary(df, "State").collect()}
    assert rate == {"none": 0.0, "all": 100.0}
    empty = df.filter(F.lit(False))
    assert bi.kpi_overview(empty).first().asDict() == {
        "Customers": 0, "Churned": 0, "Churn_Rate_Pct": 0.0, "Revenue_at_Risk_Crore": 0.0}
    assert reports.churn_rate(empty).first()["Churn_Rate_Pct"] is None
    assert reports.complaints_p75(empty).count() == 0


def test_measures_reject_unknown_names(spark):
    with pytest.raises(ValueError):
        measures.measure(accounts(spark, [{}]), ["No_Such_Measure"])


def test_empty_choice_does_not_restrict(spark):
    df = accounts(spark, [{"State": "A"}, {"State": "B"}])
    assert filters.slice_by(df, {"State": [], "Risk_Category": ["High"]}).count() == 2
    assert filters.slice_by(df, {"State": ["A"]}).count() == 1


def test_all_services_means_every_one(spark):
    df = accounts(spark, [{}, {}])
    bridge = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "Customer_ID bigint, Service_Name string")
    assert column(filters.with_all_services(df, bridge, ["x", "y"]), "Customer_ID") == [1]
    assert filters.with_all_services(df, bridge, []).count() == 2


def test_features(spark):
    df = features.engineer(accounts(spark, [
        {"Customer_Satisfaction_Score": 10.0, "Contract_Remaining_Months": 3},
        {"Company_Size": "Unheard", "Competitor_Considered": 1, "Competitor_Price_Difference": -12.0}]))
    assert column(df, "CLV")[0] == pytest.approx(1200 * (3 + 5) / 4)
    assert column(df, "Contract_Ending_Soon") == [1, 0]
    assert column(df, "Price_Pressure") == [0.0, 12.0]
    assert column(df, "Company_Size_Rank") == [0, None]
    assert column(df, "Services_per_Size_Tier") == [4.0, None]


def test_one_hot_unseen_and_null_give_zeros(spark):
    df = accounts(spark, [{"State": "S1"}, {"State": "other"}, {"State": None}])
    coded = features.one_hot(df.select("Customer_ID", "State"), {"State": ["S1", "S2"]})
    assert column(coded, "State_S1") == [1.0, 0.0, 0.0]
    assert column(coded, "State_S2") == [0.0, 0.0, 0.0]


def test_one_hot_vectors_equal_the_wide_form(spark):
    known = {"State": ["S1", "S2"], "City": [], "Region": ["R"]}
    rows = [{"State": s, "City": "c", "Region": r} for s in ("S1", "S2", "other", None) for r in ("R", None, "")]
    df = accounts(spark, rows)
    coded, vectors = features.one_hot_vectors(df, features.category_indexes(known))
    assert coded.columns[:len(df.columns)] == df.columns and len(vectors) == 2
    got = [[*r[0].toArray(), *r[1].toArray()] for r in coded.orderBy("Customer_ID").select(*vectors).collect()]
    wide = features.one_hot(df.select("Customer_ID", *known), known).orderBy("Customer_ID")
    assert got == [[r[f] for f in features.encoded_names(known)] for r in wide.collect()]
    assert features.one_hot_vectors(df, features.category_indexes({"State": []})) == (df, [])


def test_categories_without_limit(spark):
    df = spark.range(100_000).select(F.concat(F.lit("v"), "id").alias("State"))
    found = features.fit_categories(df, ["State"])["State"]
    assert len(found) == 100_000 and found == sorted(found)


def test_neutral_types():
    assert [stats.neutral_type(t) for t in ("int", "bigint", "decimal(14,2)", "double", "string", "date",
                                            "array<int>")] == [
        "integer", "integer", "decimal", "number", "text", "date", "array"]


def test_what_if(spark):
    df = accounts(spark, [{"Downtime_Hours": float(i), "Number_of_Outages": i} for i in range(1, 6)])
    card = Scorecard.fit(df)
    scored = card.score(df).withColumn("Risk_Category", rules.risk_tier(F.col("Churn_Probability")))
    rows = whatif.what_if(scored, card, [("reduce_downtime", 0.0), ("reduce_downtime", 0.5)]).collect()
    assert rows[0]["Avg_Probability_After"] == rows[0]["Avg_Probability_Before"]
    shifted = whatif.shift(scored, "reduce_downtime", 0.5)
    assert column(shifted, "Number_of_Outages") == [0.0, 1.0, 2.0, 2.0, 2.0]  # half to even
    direct = shifted.agg(F.round(F.avg(card.probability()), 4)).first()[0]
    assert rows[1]["Avg_Probability_After"] == direct
    with pytest.raises(ValueError):
        whatif.what_if(scored, card, [("unknown", 0.1)])
    assert whatif.shifted_inputs(df, "retention_offer_high_risk", 0.2) == {}


def test_profiles_take_defaults(spark):
    base = accounts(spark, [{"Downtime_Hours": float(i)} for i in range(1, 6)])
    empty = spark.createDataFrame([(1,)], "Profile_ID bigint")
    row = profiles.score_profiles(empty, Scorecard.fit(base)).first()
    assert row["Monthly_Bill"] == 80000.0 and row["Number_of_Outages"] == 3
    assert row["NPS_Score"] == 40 and row["Main_Risk_Factors"] == rules.PROFILE_HEALTHY


def test_unknown_slicer_is_an_error(spark):
    with pytest.raises(ValueError):
        filters.slice_by(accounts(spark, [{}]), {"Stat": ["A"]})


def test_seeds_split_independently(spark):
    keys = spark.range(1, 5001).select(F.col("id").alias("Customer_ID"), (F.col("id") % 2).alias("Churn"))
    parts = [{r.Customer_ID for r in features.stratified_split(keys, seed=s).where("Is_Test").collect()}
             for s in (42, 43)]
    assert all(len(p) == 1000 for p in parts)
    assert 0.15 < len(parts[0] & parts[1]) / 1000 < 0.25


def test_literal_rows_keep_their_text(spark):
    from stayrate.session import literal_rows
    rows = [("a\\", 1.5), ("it's \\n", float("nan"))]
    got = literal_rows(spark, "name STRING, x DOUBLE", rows).collect()
    assert [r.name for r in got] == ["a\\", "it's \\n"] and got[1].x != got[1].x
