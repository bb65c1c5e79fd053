"""Exact ranks and quantiles without a global sort.

A window without PARTITION BY, or the exact ``percentile`` aggregate, gathers every
value in one task. Here the values are first reduced to a histogram of distinct values
(partial aggregation collapses hot values on the map side), the histogram is cut into
value-ordered buckets, and running counts are taken inside each bucket and over the
few bucket totals. Ranks, quantiles, AUC and ROC points all read off those counts.
The bucket edges come from an approximate sketch; they only decide how evenly the
work is spread, never a result.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.sources import staging


# Rows that a bucket of values should hold, but for values that alone hold more.
ROWS_PER_BUCKET = 1 << 20


def _default_buckets(df: DataFrame) -> int:
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _edges(df: DataFrame, columns: list[str], buckets: int | None) -> list[list[float]]:
    """Edges between about evenly filled buckets, as many as the rows ask for. The sketch is
    ten times finer than they are, so a bucket, and with it a window's task, stays as large
    however many values there are."""
    asked = buckets or _default_buckets(df)
    while True:
        probs = [i / asked for i in range(1, asked)]
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *[
            F.percentile_approx(c, probs, max(1000, 10 * asked)).alias(c) for c in columns]).first()
        needed = -(-row["_rows"] // ROWS_PER_BUCKET)
        if buckets or needed <= asked:
            break
        asked = needed
    edges = []
    for c in columns:
        inner = sorted({float(x) for x in row[c] or [] if math.isfinite(x)}) or [0.0]
        edges.append([-math.inf, *inner, math.inf])
    return edges


def even_edges(df: DataFrame, low: float, high: float) -> list[float]:
    """Equal-width edges, for values known to be spread evenly over [low, high)."""
    n = max(_default_buckets(df), -(-df.count() // ROWS_PER_BUCKET))
    return [-math.inf, *[low + (high - low) * i / n for i in range(1, n)], math.inf]


def _bucketize(df: DataFrame, columns: list[str], buckets: int | None,
               edges: list[list[float]] | None = None) -> DataFrame:
    """Add ``_b_<column>``: the ordinal of the value range a value falls in."""
    edges = edges or _edges(df, columns, buckets)
    return Bucketizer(inputCols=columns, outputCols=[f"_b_{c}" for c in columns],
                      splitsArray=edges, handleInvalid="keep").transform(df)


def running_counts(df: DataFrame, columns: list[str], by: tuple[str, ...] = (),
                   weights: dict[str, Column] | None = None,
                   buckets: int | None = None,
                   edges: list[list[float]] | None = None) -> DataFrame:
    """Per distinct value of each column: its count, the count below it and the total.

    Returns ``(*by, metric, value, n, before_n, total_n)``, with three such columns per
    entry of ``weights`` (integer per-row weights; default ``n`` = 1). NULLs do not count.
    ``by`` must be low-cardinality. ``edges`` replaces the sketched bucket edges.
    """
    weights = weights or {"n": F.lit(1)}
    named = [f"_v_{c}" for c in columns]
    work = df.select(*by, *[F.col(c).cast("double").alias(v) for c, v in zip(columns, named)],
                     *[w.cast("bigint").alias(f"_w_{k}") for k, w in weights.items()])
    work = _bucketize(work, named, buckets, edges)
    stacked = work.select(*by, *[f"_w_{k}" for k in weights], F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(v).alias("value"),
                 F.col(f"_b_{v}").cast("int").alias("_bucket"))
        for c, v in zip(columns, named)])))
    keys = [*by, "metric"]
    stacked = stacked.filter(F.col("value").isNotNull())
    sums = [F.sum(f"_w_{k}").alias(k) for k in weights]
    hist = stacked.groupBy(*keys, "_bucket", "value").agg(*sums)

    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = hist.groupBy(*keys, "_bucket").agg(*[F.sum(k).alias(k) for k in weights])
    offsets = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(k).over(below), F.lit(0)).alias(f"_off_{k}") for k in weights],
        *[F.sum(k).over(whole).alias(f"total_{k}") for k in weights])

    inside = (Window.partitionBy(*keys, "_bucket").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = hist.select("*", *[
        F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"_in_{k}") for k in weights])
    joined = ranked.join(offsets, [*keys, "_bucket"])
    measures = [col for k in weights for col in (
        F.col(k), (F.col(f"_off_{k}") + F.col(f"_in_{k}")).alias(f"before_{k}"),
        F.col(f"total_{k}"))]
    return joined.select(*keys, "value", *measures)


def average_rank_pct() -> Column:
    """Average-tie rank divided by the count, from ``running_counts``."""
    return (F.col("before_n") + (F.col("n") + 1) / 2) / F.col("total_n")


def percent_rank() -> Column:
    """SQL PERCENT_RANK, from ``running_counts``; 0 for a single row."""
    return F.coalesce(F.try_divide(F.col("before_n"), F.col("total_n") - 1), F.lit(0.0))


def quantile(prob: float) -> Column:
    """Aggregate over ``running_counts``: the linearly interpolated quantile."""
    position = F.lit(prob) * (F.col("total_n") - 1)

    def value_at(index: Column) -> Column:
        covered = (F.col("before_n") <= index) & (index < F.col("before_n") + F.col("n"))
        return F.max(F.when(covered, F.col("value")))

    low, high = value_at(F.floor(position)), value_at(F.ceil(position))
    fraction = F.max(position - F.floor(position))
    return low + (high - low) * fraction


def value_reaching(rank: Column, share: float) -> Column:
    """Aggregate over ``running_counts``: the smallest value whose rank is >= share."""
    return F.min(F.when(rank >= share, F.col("value")))


def attach_rank_pct(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Add the average-tie percentage rank of ``column`` to every row.

    Values that hold more than a thousandth of the rows are joined by broadcast (there
    are fewer than a thousand such values, whatever the data), so no join task receives
    a hot value; the rest is an equi-join. Rows that have their rank, or no value, pass
    through that join spread by a number of their own. The ranks are written once, so the
    rows are read once more only to receive them.
    """
    ranks = staging.materialized(running_counts(df, [column]).select(
        F.col("value").alias("_value"), average_rank_pct().alias("_rank"),
        (F.col("n") * 1000 > F.col("total_n")).alias("_hot")), "ranks")
    hot = F.broadcast(ranks.filter("_hot").select("_value", F.col("_rank").alias("_hot_rank")))
    marked = df.withColumn("_value", F.col(column).cast("double")).join(hot, "_value", "left")
    waits = F.col("_value").isNotNull() & F.col("_hot_rank").isNull()
    placed = marked.withColumns({
        "_cold": F.when(waits, F.col("_value")),
        "_place": F.when(waits, F.lit(0)).otherwise(F.monotonically_increasing_id())})
    # A literal 0 here would be folded out of the join's keys; a column of them is not.
    cold = ranks.filter(~F.col("_hot")).select(
        F.col("_value").alias("_cold"), F.col("_hot").cast("bigint").alias("_place"), "_rank")
    return placed.join(cold, ["_cold", "_place"], "left").select(
        *df.columns, F.coalesce("_hot_rank", "_rank").alias(alias))


def ordinal_within(df: DataFrame, key: str, order: str, alias: str,
                   buckets: int | None = None) -> DataFrame:
    """1-based position of each row inside its ``key``, by ascending unique ``order``.

    Rows are numbered inside (key, order range) and shifted by the counts of the lower
    ranges, so a key that holds a large share of the rows is spread over many tasks.
    """
    if not isinstance(df.schema[order].dataType, T.NumericType):
        raise ValueError(f"{order} must be numeric, such as an ingest number")
    work = df.withColumn("_order", F.col(order).cast("double"))
    work = _bucketize(work, ["_order"], buckets)
    counts = work.groupBy(key, "_b__order").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(key).orderBy("_b__order").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_key"), F.col("_b__order").alias("_range"),
                            F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(key, "_b__order").orderBy(order)
    numbered = work.withColumn("_in", F.row_number().over(inside))
    joined = numbered.join(offsets, F.col(key).eqNullSafe(F.col("_key"))
                           & (F.col("_b__order") == F.col("_range")))
    return (joined.withColumn(alias, F.col("_off") + F.col("_in"))
            .drop("_key", "_range", "_off", "_in", "_order", "_b__order"))
