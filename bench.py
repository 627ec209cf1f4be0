"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs to its last row (a noop sink) twice, the second run counts. msgs_per_sec
has what the published figures measure: messages routed, numbered and appended to the
log, and messages read back from it.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from loomlog import catalog
from loomlog.plans import queries

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "partition_metrics", "route_fnv", "ring_route", "assign_offsets", "produce_results", "consume_batch", "topic_info", "committed_offsets",
    "consume_from_committed", "group_assignment", "batch_by_count", "batch_by_bytes", "throughput", "latency_stats", "partition_histogram", "stream_assign_offsets",
)


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = lambda name=name: catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        run()
        took[name] = round(timed(run), 3)
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        n = queries.routed(spark, SF).count()
        append = lambda: queries.logged(spark, SF).write.mode("overwrite").partitionBy("topic", "partition").parquet(f"{folder}/log")
        append()
        took["produce_append"] = round(timed(append), 3)
        scan = lambda: spark.read.parquet(f"{folder}/log").where("offset >= 0").write.format("noop").mode("overwrite").save()
        scan()
        took["consume_scan"] = round(timed(scan), 3)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    rates = {"produce": round(n / took["produce_append"]), "consume": round(n / took["consume_scan"])}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "msgs_per_sec": rates, "sf": SF.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
