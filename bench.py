"""Time the registered queries on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (local threads), BENCH_ONLY
(comma-separated query names). Each query writes its full result to the no-op sink. The
written account, subscription and prediction tables are built first and timed as
``stage_tables``. ``model_comparison`` is the whole training run: three forest settings on
the validation slice, four models, held-out metrics. The other queries on trained models
reuse that run.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stayrate.plans import retention  # noqa: E402
from stayrate.plans.catalogue import QUERIES  # noqa: E402
from stayrate.session import build_session  # noqa: E402
from stayrate.sources import staging  # noqa: E402

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(f"local[{cpus}]", "stayrate-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()

    seconds: dict[str, float] = {}
    start = time.perf_counter()
    staging.account(spark, sf_dir)
    staging.bridge(spark, sf_dir)
    staging.catalog(spark, sf_dir)
    retention.prediction(spark, sf_dir)
    seconds["stage_tables"] = round(time.perf_counter() - start, 3)

    for name in only or QUERIES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
