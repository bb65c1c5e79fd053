"""Exact ranks, quantiles and numbering against pandas, with hot values."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrate.operators import ranks, stats


def skewed(n=3000, seed=7):
    rnd = random.Random(seed)
    # One value holds a third of the rows.
    return [5.0 if rnd.random() < 1 / 3 else round(rnd.lognormvariate(2, 1.5), 1) for _ in range(n)]


@pytest.mark.parametrize("values", [skewed(), [3.0] * 50, [1.0], [1.0, 2.0], [-1.5, 0.0, 0.0, 2.5]])
def test_ranks_and_quantiles(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    counts = ranks.running_counts(df, ["x"]).select(
        "value", ranks.average_rank_pct().alias("pct"), ranks.percent_rank().alias("pr"))
    s = pd.Series(values)
    pct = dict(zip(s, s.rank(pct=True)))
    pr = dict(zip(s, (s.rank(method="min") - 1) / max(1, len(s) - 1)))
    got = counts.collect()
    assert len(got) == s.nunique()
    for r in got:
        assert r["pct"] == pytest.approx(pct[r["value"]], abs=1e-12)
        assert r["pr"] == pytest.approx(pr[r["value"]], abs=1e-12)
    q = ranks.running_counts(df, ["x"]).agg(*[
        ranks.quantile(p).alias(str(p)) for p in (0.25, 0.5, 0.75)]).first()
    for p in (0.25, 0.5, 0.75):
        assert q[str(p)] == pytest.approx(s.quantile(p), abs=1e-9)


def test_attach_rank_keeps_every_row(spark):
    values = [*skewed(), None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    got = {r["id"]: r["p"] for r in ranks.attach_rank_pct(df, "x", "p").collect()}
    want = pd.Series(values, dtype=float).rank(pct=True)
    assert len(got) == len(values)
    for i, p in want.items():
        assert (got[i] is None) if np.isnan(p) else got[i] == pytest.approx(p, abs=1e-12)


def test_groups_and_nulls(spark):
    rows = [(g, float(i) if i % 5 else None) for g in (0, 1) for i in range(40 + 10 * g)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: r["m"] for r in ranks.running_counts(df, ["x"], by=("g",)).groupBy("g")
           .agg(ranks.quantile(0.5).alias("m")).collect()}
    want = pd.DataFrame(rows, columns=["g", "x"]).groupby("g")["x"].median()
    assert got == {g: pytest.approx(m) for g, m in want.items()}


def test_numbering_spreads_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(30)}") for i in range(2000)]
    rows += [(2000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, k string")
    got = {r["id"]: r["n"] for r in ranks.ordinal_within(df, "k", "id", "n").collect()}
    pdf = pd.DataFrame(rows, columns=["id", "k"]).fillna({"k": "<null>"})
    want = pdf.sort_values("id").groupby("k").cumcount() + 1
    assert got == dict(zip(pdf["id"], want))
    with pytest.raises(ValueError):
        ranks.ordinal_within(df, "id", "k", "n")


def test_correlations_with_nulls_and_constants(spark):
    rnd = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rnd.normal(size=200), "b": rnd.normal(size=200)})
    pdf["c"] = pdf["a"] + 0.3 * pdf["b"]
    pdf["holes"] = pdf["c"].where(rnd.random(200) > 0.2)
    pdf["flat"] = 2.0
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, holes double, flat double")
    got = {(r["Column_A"], r["Column_B"]): r["Correlation"]
           for r in stats.correlation_matrix(df, list(pdf.columns)).collect()}
    want = pdf.corr()
    assert len(got) == 25
    for (a, b), r in got.items():
        if a == "flat" or b == "flat":
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    empty = stats.correlations(df.filter("false"), [("a", "b")]).first()
    assert empty["Correlation"] is None


def test_no_single_partition_and_no_python(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plan = ranks.attach_rank_pct(df, "x", "p")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "Python" not in plan


@pytest.mark.parametrize("distinct", [4_000, 40_000])
def test_buckets_stay_as_large_as_values_grow(spark, monkeypatch, distinct):
    """A third of the rows is one value; the largest bucket depends on ROWS_PER_BUCKET alone."""
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 100)
    rows = spark.range(distinct * 3 // 2).select(F.when(F.col("id") < distinct, (F.col("id") * 7919 % distinct) / 8)
                                                 .otherwise(5.0).alias("x"))
    cut = ranks._bucketize(rows, ["x"], None).groupBy("_b_x").agg(F.countDistinct("x").alias("n"))
    assert cut.agg(F.max("n")).first()[0] <= 150
    counts = ranks.running_counts(rows, ["x"])
    assert counts.count() == distinct
    low, high = counts.agg(F.min(F.when(F.col("value") > 5, F.col("before_n"))), F.max(F.col("before_n") + F.col("n"))).first()
    assert low == 41 + distinct // 2 and high == distinct * 3 // 2
