"""Benchmark of the headline queries: one JSON line with seconds per query.

Every query runs whole and its full result is consumed by the no-op sink. The first run of each query includes
planning and code generation; the recorded time is the second run. The given tables are files of one row group each, so
a scan of one would be a single task; outside the timing they are written once as FILES files, as a landing has them.
"""

from __future__ import annotations

import json
import glob
import os
import sys
import tempfile
import time

from tarifold.plans import load_all
from tarifold.plans.registry import QUERIES
from tarifold.session import local_session

HEADLINE = (
    "compare_compute_vm", "compare_storage_object_capped", "lookup_bulk", "search_by_price", "min_price", "price_attach",
    "mixed_units", "terms_hash", "tier_walk", "estimate_compute_vm", "estimate_messaging_queue", "snapshot_diff",
    "delta_chain", "price_drift", "feed_aws_ec2", "feed_aws_s3", "feed_azure_vm", "feed_azure_redis", "feed_gcp_gce",
    "feed_openrouter",
)


FILES = 32


def landed(spark, sf_dir: str) -> str:
    """The tables of the folder, each as many files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        spark.read.parquet(path).repartition(FILES).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    tables = landed(spark, sf_dir)
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "lineitem_rows": rows,
        "lines_estimated_per_sec": round(rows / times["estimate_compute_vm"]),
        "lines_looked_up_per_sec": round(rows / times["lookup_bulk"])}))


if __name__ == "__main__":
    main()
