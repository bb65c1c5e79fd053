"""The training-data pipeline: five stages from raw documents to placed training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayrate.llm import decontaminate, mixing, quality, sharding, simhash
from stayrate.llm.common import stored
from stayrate.llm.queries import MIX, SHARDS, table

# No SQL expresses the trained classifier and the fingerprints; the tests hold every stage
# against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints over three-word shingles that are linked
    at three or fewer differing bits."""
    return simhash.kept_documents(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, **MIX)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that their id belongs to."""
    return sharding.sharded(docs, SHARDS)


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies),
          ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", place)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
