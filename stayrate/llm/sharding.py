"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Each shard draws an exponential variate from the hash of (key, shard), divided by its
weight; the smallest draw takes the record. A draw depends on the key and its own shard
alone, so a further shard moves records only into itself, about its share of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import numbered, pick, stored

RECORD_OVERHEAD = 16


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a record key. Null keys share one shard; equal keys always do.
    Shards of weight zero take nothing; at least one weight must be positive."""
    usable = {int(s): float(w) for s, w in weights.items() if w > 0}
    if not usable or any(w < 0 for w in weights.values()):
        raise ValueError("weights must be non-negative and one of them positive")
    draws = []
    for shard, weight in sorted(usable.items()):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.ln(uniform) / F.lit(weight)).alias("draw"),
                              F.lit(shard).alias("shard")))
    if len(draws) == 1:
        return draws[0]["shard"]
    return F.array_min(F.array(*draws))["shard"]


def with_slots(placed: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """Adds ``slot``: the rows of each shard numbered from 0 without gaps.

    The rows are written with the partition they were read in. Counts per (shard,
    partition) give each pair its first slot, and rows are numbered inside the pair, so no
    task sees more of a shard than one input partition holds, whatever key is frequent.
    Ties of ``order`` are numbered in any order.
    """
    rows = stored(placed.withColumn("part", F.spark_partition_id()), "placed")
    before = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy(shard, "part").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy(shard, "part").orderBy(*order)
    return (rows.withColumn("rank", F.row_number().over(inside) - 1)
            .join(first, [shard, "part"])
            .withColumn("slot", (F.col("first") + F.col("rank")).cast("bigint"))
            .drop("part", "rank", "first"))


def shard_table(documents: DataFrame, shards: int) -> DataFrame:
    """Placement of every row over equal shards 0 .. shards-1, and over one shard more.

    A null text counts as empty, a null doc_id as one more key value. Repeated rows keep
    their own slots. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    placed = pick(documents, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + RECORD_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), dict.fromkeys(range(shards), 1.0)).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), dict.fromkeys(range(shards + 1), 1.0)).cast("int")
        .alias("grown_shard"))
    return with_slots(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sharded(documents: DataFrame, shards: int) -> DataFrame:
    """The rows with their ``shard`` as last column; a column of that name is replaced."""
    plain, names, at = numbered(documents)
    kept = [F.col(f"_{i}").alias(n) for i, n in enumerate(names) if n != "shard"]
    return plain.select(*kept, shard_of(F.col(at["doc_id"]), dict.fromkeys(range(shards), 1.0))
                        .cast("int").alias("shard"))


def write_shards(documents: DataFrame, shards: int, path: str) -> None:
    """One folder per shard, ``shard=N``; each input task writes its own files."""
    sharded(documents, shards).write.partitionBy("shard").parquet(path)
