"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Every query is run once to
completion with all its columns, on one session, after a small warm-up of the JVM.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from lineseek.plans import catalog, views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "line_ids",
    "corpus_lines",
    "corpus_alphabet",
    "corpus_stats",
    "vocabulary",
    "lookup_prefix",
    "token_choice",
    "contains_filter",
    "pattern_search",
    "fuzzy_topk",
    "no_match_queries",
    "typo_counts",
    "session_text",
    "session_completions",
    "consecutive_dedup",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lineseek-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(views.read(spark, SF_DIR, "benchmark"))
    seconds = {}
    # `line_ids` comes first and includes building the numbered lines that later queries reuse.
    for name in HEADLINE:
        begin = time.perf_counter()
        run(catalog.QUERIES[name](spark, SF_DIR))
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
