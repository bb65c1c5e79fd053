"""Session construction and the shared folder for written intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(master: str | None = None, app: str = "stayrate", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC dates.

    Cluster settings (master, memory, shuffle width, ``spark.checkpoint.dir``) come
    from spark-submit; only ``master`` may be given here, for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Models are fitted side by side; small jobs of one must not wait behind another's.
        "spark.scheduler.mode": "FAIR",
        # Recording a Python call site per expression costs more than planning the query.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str | None:
    """The folder every executor can reach, or None on a cluster that names none.

    ``spark.checkpoint.dir`` decides. Where it is unset, a local-mode session gets a
    temporary folder; a cluster session gets nothing, because a machine-local folder
    would not be visible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        return None
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="stayrate-")
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a sink or a written table."""
    base = shared_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{base}/stayrate/{label}-{uuid.uuid4().hex[:12]}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that it need not be
    installed on them."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip",
                                      package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A handful of fixed rows as a frame."""
    return spark.createDataFrame(rows, schema)
