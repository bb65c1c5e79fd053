"""Data-quality checks and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate import schemas
from stayrate.operators import ranks
from stayrate.sources import staging


def _tall(df: DataFrame, entries: list[tuple]) -> DataFrame:
    """One row per entry of (label, Column, ...) from a one-row frame."""
    return df.select(F.inline(F.array(*[F.struct(*e) for e in entries])))


def _null_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]


def _range_counts(df: DataFrame) -> list[Column]:
    return [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"range_{c}")
            for c, (lo, hi) in schemas.VALUE_RANGES.items() if c in df.columns]


def null_profile(df: DataFrame) -> DataFrame:
    """Null count, percentage and expectedness of every column that has nulls."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *_null_counts(df))
    rows = _tall(counted, [
        (F.lit(c).alias("Column_Name"), F.col(f"null_{c}").alias("Null_Count"),
         F.round(F.try_divide(F.col(f"null_{c}") * 100.0, F.col("_rows")), 2).alias("Null_Pct"),
         F.lit(c in schemas.STRUCTURAL_NULLS).alias("Expected")) for c in df.columns])
    return rows.filter(F.col("Null_Count") > 0)


def _surplus(df: DataFrame, columns: list[str]) -> DataFrame:
    """One value: rows beyond the first of each combination of ``columns``."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("Duplicates"))


def _repeated_rows(df: DataFrame) -> DataFrame:
    """The rows whose content hash occurs more than once: all duplicates, and hardly others.

    Only hashes cross the exchange. The repeated ones are written, so that the join back
    broadcasts them where their measured size allows and shuffles otherwise.
    """
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    counts = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    repeated = staging.materialized(counts.filter(F.col("_n") > 1).select("_h"), "repeated-rows")
    return hashed.join(repeated, "_h", "left_semi").drop("_h")


def duplicate_profile(df: DataFrame, key: str = "Customer_ID") -> DataFrame:
    """Rows beyond the first per key, and rows beyond the first per full row."""
    by_key = _surplus(df, [key]).select(F.lit("key").alias("Scope"), "Duplicates")
    by_row = _surplus(_repeated_rows(df), df.columns).select(F.lit("row").alias("Scope"), "Duplicates")
    return by_key.unionByName(by_row)


def range_violations(df: DataFrame) -> DataFrame:
    """Rows outside the bounds of each bounded metric; clean metrics are not listed."""
    present = [c for c in schemas.VALUE_RANGES if c in df.columns]
    rows = _tall(df.agg(*_range_counts(df)), [
        (F.lit(c).alias("Metric"), F.col(f"range_{c}").alias("Violations")) for c in present])
    return rows.filter(F.col("Violations") > 0)


def fill_structural_nulls(df: DataFrame) -> DataFrame:
    """Say what a structural null means instead of imputing a value."""
    return df.fillna({c: v for c, v in schemas.NULL_LABELS.items() if c in df.columns})


def keep_first(df: DataFrame, key: str = "Customer_ID", order: str | None = None) -> DataFrame:
    """The first row per key by ``order`` (an ingest-order column).

    Keys are counted first; where none repeats, the rows are returned as they are. Else rows
    of unique keys pass through without an exchange where the repeated keys are few enough
    to broadcast, which their written size decides. Repeated
    keys are settled by a minimum over structs: map-side combining leaves one candidate
    per key and task, however often a key repeats. Without an order column the smallest
    row by column values is kept, so the choice is repeatable.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = staging.materialized(counts.filter(F.col("_n") > 1).select("_key"), "repeated-keys")
    if repeated.isEmpty():
        return df
    same = F.col(key).eqNullSafe(F.col("_key"))
    unique = df.join(repeated, same, "left_anti")
    rest = [c for c in df.columns if c != key]
    order_by = [order] if order else rest
    picked = df.join(repeated, same, "left_semi").groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_row"))
    first = picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
    return unique.unionByName(first)


def iqr_fences(df: DataFrame, column: str, factor: float = 1.5) -> tuple[float, float] | None:
    """(lower, upper) outlier fences from exact quartiles; None for an empty column."""
    row = ranks.running_counts(df, [column]).agg(
        ranks.quantile(0.25).alias("q1"), ranks.quantile(0.75).alias("q3")).first()
    if row is None or row["q1"] is None:
        return None
    reach = factor * (row["q3"] - row["q1"])
    return row["q1"] - reach, row["q3"] + reach


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5,
                 alias: str = "Is_Outlier") -> DataFrame:
    """Mark values strictly outside the interquartile fences."""
    fences = iqr_fences(df, column, factor)
    if fences is None:
        return df.withColumn(alias, F.lit(False))
    outside = (F.col(column) < fences[0]) | (F.col(column) > fences[1])
    return df.withColumn(alias, F.coalesce(outside, F.lit(False)))


def integrity_report(customers: DataFrame, bridge: DataFrame, catalog: DataFrame,
                     predictions: DataFrame) -> DataFrame:
    """Violations of the declared primary and foreign keys, one row per constraint.

    Rows are counted per key, all tables side by side: one aggregation by customer and one
    by service tell repeated keys and those without a parent. A missing key is an orphan.
    """
    def counted(df: DataFrame, key: str, **amounts: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return df.select(key, *[amounts.get(n, zero).cast("bigint").alias(n)
                                for n in ("parent", "child", "other", "extra")])

    def below(parts: list[DataFrame], key: str) -> DataFrame:
        rows = parts[0].unionByName(parts[1])
        for part in parts[2:]:
            rows = rows.unionByName(part)
        return rows.groupBy(key).agg(*[F.sum(n).alias(n) for n in ("parent", "child", "other", "extra")])

    one, n = F.lit(1), F.col("_n")
    pairs = bridge.groupBy("Customer_ID", "Service_Name").agg(F.count(F.lit(1)).alias("_n"))
    by_customer = below([counted(customers, "Customer_ID", parent=one),
                         counted(pairs, "Customer_ID", child=n, extra=n - 1),
                         counted(predictions, "Customer_ID", other=one)], "Customer_ID")
    by_service = below([counted(catalog, "Service_Name", parent=one),
                        counted(bridge.groupBy("Service_Name").agg(F.count(F.lit(1)).alias("_n")),
                                "Service_Name", child=n)], "Service_Name")

    def found(df: DataFrame, key: str, **amounts: Column) -> DataFrame:
        lost = (F.col("parent") == 0) | F.col(key).isNull()
        return df.agg(*[F.coalesce(F.sum(a if name.startswith("pk") else F.when(lost, a)), F.lit(0))
                        .cast("bigint").alias(name) for name, a in amounts.items()])

    def again(count: str) -> Column:
        return F.greatest(F.col(count) - 1, F.lit(0))

    figures = found(by_customer, "Customer_ID", pk_customers=again("parent"),
                    pk_customer_services=F.col("extra"), pk_churn_predictions=again("other"),
                    fk_services_customer=F.col("child"), fk_predictions_customer=F.col("other")).crossJoin(
        found(by_service, "Service_Name", pk_service_catalog=again("parent"),
              fk_services_catalog=F.col("child")))  # one row each
    return _tall(figures, [(F.lit(name).alias("Constraint_Name"), F.col(name).alias("Violations"))
                           for name in figures.columns])


def validation_report(df: DataFrame, key: str = "Customer_ID") -> DataFrame:
    """All checks as (Check_Name, Item, Value) rows.

    Row, null and range counts come from one pass; the duplicate counts need their own.
    """
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *_null_counts(df), *_range_counts(df))

    def entry(check: str, item: str, value: str) -> tuple[Column, Column, Column]:
        return (F.lit(check).alias("Check_Name"), F.lit(item).alias("Item"),
                F.col(value).alias("Value"))

    entries = [entry("rows", "loaded", "_rows")]
    entries += [entry("null_expected" if c in schemas.STRUCTURAL_NULLS else "null_unexpected",
                      c, f"null_{c}") for c in df.columns]
    entries += [entry("range", c, f"range_{c}") for c in schemas.VALUE_RANGES if c in df.columns]
    found = _tall(counted, entries).filter((F.col("Check_Name") == "rows") | (F.col("Value") > 0))
    dupes = duplicate_profile(df, key).select(
        F.lit("duplicate").alias("Check_Name"), F.col("Scope").alias("Item"),
        F.col("Duplicates").alias("Value"))
    return found.unionByName(dupes)


def validate(df: DataFrame, key: str = "Customer_ID",
             order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean frame, report): checks on the raw rows, then labels and the first row per key.

    ``order`` is the column that sorts rows as they came in, such as the one a file scan
    adds; neither result has it. Without one, rows are written and numbered as they are
    read, so that the first one still wins.
    """
    if order is None:
        order = "_row_order"
        df = staging.materialized(df.withColumn(order, F.monotonically_increasing_id()), "ordered")
    clean = keep_first(fill_structural_nulls(df), key, order).drop(order)
    return clean, validation_report(df.drop(order), key)
