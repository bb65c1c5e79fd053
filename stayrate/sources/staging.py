"""Account tables written once per application, bucketed by customer.

Reports read a handful of columns from the customer tables, so deriving those tables
from the raw line items in each report would repeat the largest join. The line items are
summed once per (customer, service), and the tables are written to the shared folder: Parquet, so scans keep column pruning and pushed
filters; bucketed on ``Customer_ID``, so customer-to-subscription and
customer-to-prediction joins need no exchange; and durable, so a lost executor costs a
re-read rather than a recomputation. Without a shared folder the tables stay lazy views.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stayrate.session import new_folder, shared_dir
from stayrate.sources import accounts

SWITCH = "spark.stayrate.stageTables"
BUCKETS = "spark.stayrate.buckets"
# Line-item bytes that feed one bucket; an account row is far smaller than its lines.
BYTES_PER_BUCKET = 4 * 1024**3

_written: dict[tuple[str, str, str], str] = {}
_lock = threading.RLock()


def bucket_count(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of every staged table of ``sf_dir``: one per core up to the shuffle width,
    and more where the input is large."""
    configured = spark.conf.get(BUCKETS, None)
    if configured:
        return int(configured)
    scan = accounts.table(spark, sf_dir, "lineitem")
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = min(width, spark.sparkContext.defaultParallelism)
    return max(base, -(-size // BYTES_PER_BUCKET))


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
            bucket_by: str | None = "Customer_ID") -> DataFrame:
    """``build()``, written on first use by this application and read back from then on."""
    if spark.conf.get(SWITCH, "true") != "true" or shared_dir(spark) is None:
        return build()
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _lock:
        if key not in _written:
            tag = hashlib.sha1(f"{key[0]}{sf_dir}".encode()).hexdigest()[:10]
            stored = f"stayrate_{tag}_{name}"
            frame = build()
            writer = frame.write
            if bucket_by:
                buckets = bucket_count(spark, sf_dir)
                writer = (frame.repartition(buckets, bucket_by).write
                          .bucketBy(buckets, bucket_by).sortBy(bucket_by))
            (writer.mode("overwrite").format("parquet")
                   .option("path", new_folder(spark, name)).saveAsTable(stored))
            _written[key] = stored
    return spark.table(_written[key])


def refresh(spark: SparkSession, sf_dir: str) -> None:
    """Forget the tables written from ``sf_dir``, whose files have changed: they are written
    anew on next use. Frames that were read from them before must be built again."""
    with _lock:
        for key in [k for k in _written if k[:2] == (spark.sparkContext.applicationId, sf_dir)]:
            spark.sql(f"DROP TABLE IF EXISTS {_written.pop(key)}")
    spark.catalog.refreshByPath(sf_dir)


def materialized(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for frames read several times.

    Unlike a cache it survives lost executors, and later passes read only their columns.
    """
    if shared_dir(df.sparkSession) is None:
        return df
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "usage", lambda: accounts.derive_usage(spark, sf_dir))


def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "account", lambda: accounts.derive_accounts(
        spark, sf_dir, usage(spark, sf_dir)))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.subscriptions(usage(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "catalog", lambda: accounts.derive_catalog(spark, sf_dir),
                   bucket_by=None)


def flag_services(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return accounts.flag_services(catalog(spark, sf_dir))


def account_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.with_flags(account(spark, sf_dir), bridge(spark, sf_dir),
                               flag_services(spark, sf_dir))
