"""Slicers: dynamic filters and the value lists behind them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Slicers of columns that a frame has only where predictions have been joined.
OPTIONAL_SLICERS = ("Risk_Category",)


def slice_by(df: DataFrame, choices: Mapping[str, Iterable],
             optional: Iterable[str] = OPTIONAL_SLICERS) -> DataFrame:
    """AND of one IN-list per non-empty choice; an empty choice restricts nothing.

    A choice on an ``optional`` column that the frame lacks is ignored; on any other it is
    an error.
    """
    optional = set(optional)
    for column, values in choices.items():
        values = list(values)
        if column not in df.columns and column not in optional:
            raise ValueError(f"no column {column!r} to slice by")
        if values and column in df.columns:
            df = df.filter(F.col(column).isin(values))
    return df


def with_all_flags(df: DataFrame, flags: Iterable[str]) -> DataFrame:
    """Rows whose every named 0/1 flag is set."""
    for flag in flags:
        df = df.filter(F.col(flag) == 1)
    return df


def with_all_services(df: DataFrame, bridge: DataFrame, services: Iterable[str]) -> DataFrame:
    """Accounts subscribed to every named service, by the subscription table."""
    wanted = sorted(set(services))
    if not wanted:
        return df
    holders = (bridge.filter(F.col("Service_Name").isin(wanted))
               .groupBy("Customer_ID").agg(F.countDistinct("Service_Name").alias("_k"))
               .filter(F.col("_k") == len(wanted)).select("Customer_ID"))
    return df.join(holders, "Customer_ID", "left_semi")


def slicer_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Sorted distinct non-null values of each column, in one pass."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("Slicer"),
                                        F.col(c).cast("string").alias("Value")) for c in columns]))
    return (df.select(pairs).filter(F.col("Value").isNotNull()).distinct()
            .orderBy("Slicer", "Value"))
