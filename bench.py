"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Every query writes all its rows to Spark's no-op sink, once, after the session
has started; building the plan is part of the time.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from prosegauge.catalog import QUERIES

HEADLINES = (
    "phrase_penalty_by_source",
    "bands_by_source",
    "scores_of_documents",
    "rhythm_hits_of_documents",
    "sentence_measures",
    "repeated_ngrams",
    "signals",
    "sentences_of_documents",
    "phrase_hits_own_list",
    "html_tokens",
    "page_roots",
    "page_markdown",
    "layout_to_text",
    "dedup_phases",
    "latest_readings",
    "first_ready",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("prosegauge-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        # Call sites of every column expression are only of use in error messages.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else sf_dir,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
