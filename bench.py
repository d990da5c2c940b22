"""Headline timings, printed as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query
runs once to warm up and is then timed as the best of two full runs (every row is
produced; nothing is collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leaksieve import RuleSet, scan_files  # noqa: E402
from workload import model as M  # noqa: E402
from workload import queries as Q  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # no call-site capture per expression while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    stock = Q.STOCK_OPEN
    first = lambda n: RuleSet(stock.rules[55 : 55 + n] if n < 100 else stock.rules)
    runs = {
        "scan_stock_149_rules": lambda: scan_files(M.files(spark, sf), Q.STOCK),
        "scan_stock_10_rules": lambda: scan_files(M.files(spark, sf), first(10)),
        "scan_stock_1_rule": lambda: scan_files(M.files(spark, sf), first(1)),
    }
    for name in (
        "scan_user_rules",
        "scan_stock_catalog",
        "keyword_prefilter",
        "line_split",
        "scan_history_all",
        "scan_history_branch",
        "scan_commit",
        "prune_paths",
        "commit_time_range",
        "snapshot_files",
        "report_sarif",
    ):
        runs[name] = lambda name=name: Q.QUERIES[name](spark, sf)

    times: dict[str, float] = {}
    for name, plan in runs.items():
        took = []
        for _ in range(3):
            start = time.perf_counter()
            plan().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(min(took[1:]), 3)

    size = M.table(spark, sf, "documents").agg(
        F.count(F.lit(1)), F.sum(F.octet_length("text"))
    ).first()
    stock_time = times["scan_stock_149_rules"]
    print(
        json.dumps(
            {
                "metric": "sum of warm query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "stock_files_per_sec": round(size[0] / stock_time, 1),
                "stock_mb_per_sec": round(size[1] / 1e6 / stock_time, 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
