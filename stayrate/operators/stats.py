"""Descriptive statistics: moments, quartiles, histograms and correlations."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.operators import ranks
from stayrate.session import literal_rows


def zscore(column: str, mean: float, std: float) -> Column:
    """Standard score with a population deviation; a constant column gives 0."""
    return (F.col(column) - F.lit(mean)) / F.lit(std + 1e-9)


def moments(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per named column, in one pass."""
    aggs = []
    for name, col in columns.items():
        value = col.cast("double")
        aggs += [F.avg(value).alias(f"m_{name}"), F.stddev_pop(value).alias(f"s_{name}")]
    row = df.agg(*aggs).first()
    return {n: (row[f"m_{n}"] or 0.0, row[f"s_{n}"] or 0.0) for n in columns}


def standardize(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace columns by standard scores with statistics of ``fit_on`` (default: itself)."""
    fitted = moments(df if fit_on is None else fit_on, {c: F.col(c) for c in columns})
    scores = {}
    for c, (mean, std) in fitted.items():
        scores[c] = (F.col(c).cast("double") - mean) / (std or 1.0)
    return df.withColumns(scores)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max: one row per column."""
    quartiles = ranks.running_counts(df, columns).groupBy("metric").agg(
        ranks.quantile(0.25).alias("Q25"), ranks.quantile(0.5).alias("Q50"),
        ranks.quantile(0.75).alias("Q75"))
    parts = {"Count": F.count, "Mean": F.avg, "Std": F.stddev_samp, "Min": F.min, "Max": F.max}
    row = df.agg(*[fn(F.col(c).cast("double")).alias(f"{part}_{c}")
                   for c in columns for part, fn in parts.items()])
    simple = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), *[F.col(f"{p}_{c}").alias(p) for p in parts])
        for c in columns])))
    return simple.join(quartiles, "metric", "left").withColumnRenamed("metric", "Column_Name")


# What a column holds, whichever engine names the type.
NEUTRAL_TYPES = {
    **dict.fromkeys(("tinyint", "smallint", "int", "bigint"), "integer"),
    **dict.fromkeys(("float", "double"), "number"),
    **dict.fromkeys(("timestamp", "timestamp_ntz"), "time"),
    "decimal": "decimal", "string": "text", "date": "date", "boolean": "flag"}


def neutral_type(simple: str) -> str:
    """The neutral name of a simple type string; others keep the name without parameters."""
    family = simple.partition("(")[0].partition("<")[0]
    return NEUTRAL_TYPES.get(family, family)


def profile_schema(df: DataFrame) -> DataFrame:
    """Position, name, neutral type and non-null count of every column."""
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("Position"), F.lit(f.name).alias("Column_Name"),
                 F.lit(neutral_type(f.dataType.simpleString())).alias("Data_Type"),
                 F.col(f.name).alias("Non_Null"))
        for i, f in enumerate(df.schema.fields, 1)])))


def histogram(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """Equal-width counts between the minimum and maximum; the last bin is closed."""
    row = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in bins for f in (F.min, F.max)]).first()
    pieces = []
    for c, n in bins.items():
        low, high = row[f"min_{c}"], row[f"max_{c}"]
        if low is None:
            continue
        width = float(high) - float(low)
        x = F.col(c).cast("double")
        index = (F.least(F.lit(n - 1), F.floor((x - float(low)) * n / width)) if width
                 else F.when(x.isNotNull(), F.lit(0)))
        index = F.when(x.isNotNull(), index)
        pieces.append(F.struct(F.lit(c).alias("Column_Name"), index.cast("bigint").alias("Bin"),
                               (float(low) + index * (width / n)).alias("Bin_Start")))
    stacked = df.select(F.inline(F.array(*pieces))).filter(F.col("Bin").isNotNull())
    return stacked.groupBy("Column_Name", "Bin", "Bin_Start").agg(F.count(F.lit(1)).alias("Customers"))


def boxplot(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Quartiles, whiskers (furthest values inside 1.5 IQR) and outlier counts per group."""
    counts = ranks.running_counts(df, columns, by=(by,))
    boxes = counts.groupBy(by, "metric").agg(
        ranks.quantile(0.25).alias("Q1"), ranks.quantile(0.5).alias("Median"),
        ranks.quantile(0.75).alias("Q3"))
    fences = boxes.withColumns({"_low": F.col("Q1") - 1.5 * (F.col("Q3") - F.col("Q1")),
                                "_high": F.col("Q3") + 1.5 * (F.col("Q3") - F.col("Q1"))})
    values = counts.select(by, "metric", "value", "n").join(fences, [by, "metric"])
    inside = F.col("value").between(F.col("_low"), F.col("_high"))
    return (values.groupBy(by, F.col("metric").alias("Column_Name")).agg(
        F.first("Q1").alias("Q1"), F.first("Median").alias("Median"), F.first("Q3").alias("Q3"),
        F.min(F.when(inside, F.col("value"))).alias("Whisker_Low"),
        F.max(F.when(inside, F.col("value"))).alias("Whisker_High"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("Outliers")))


def _pair_correlation(a: Column, b: Column) -> Column:
    """``corr`` that gives NULL, not an error, where either side is constant."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation per column pair over the rows where both are present.

    Columns without NULLs go through one vector pass, which sums the whole matrix per
    task; only pairs with a NULL in one of them need their own aggregate. A constant
    column gives NULL.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    seen = doubles.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in columns], *[
        (F.min(c) == F.max(c)).alias(f"flat_{c}") for c in columns]).first()
    whole = [c for c in columns if not seen[c] and not seen[f"flat_{c}"]]
    found: dict[tuple[str, str], float] = {}
    if whole and seen["_rows"]:
        vectors = VectorAssembler(inputCols=whole, outputCol="_v").transform(doubles).select("_v")
        matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
        place = {c: i for i, c in enumerate(whole)}
        found = {(a, b): float(matrix[place[a], place[b]]) for a, b in pairs
                 if a in place and b in place}
    rest = [pair for pair in pairs if pair not in found]
    if rest:
        row = doubles.agg(*[_pair_correlation(F.col(a), F.col(b)).alias(f"c{i}")
                            for i, (a, b) in enumerate(rest)]).first()
        found.update({pair: row[f"c{i}"] for i, pair in enumerate(rest)})

    def clean(x: float | None) -> float | None:
        return None if x is None or math.isnan(x) else x

    return literal_rows(df.sparkSession, "Column_A STRING, Column_B STRING, Correlation DOUBLE",
                        [(a, b, clean(found[a, b])) for a, b in pairs])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The full symmetric matrix in long form, diagonal included."""
    half = correlations(df, list(combinations_with_replacement(columns, 2)))
    flip = half.filter(F.col("Column_A") != F.col("Column_B")).select(
        F.col("Column_B").alias("Column_A"), F.col("Column_A").alias("Column_B"), "Correlation")
    return half.unionByName(flip)
