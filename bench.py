"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The index is built once, behind a smaller one that warms the JVM; each query runs once unmeasured (which also makes the
stored runs that evaluations read), then three times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "token_counts", "postings", "document_frequency", "bm25_scores", "impacts", "impact_segments", "search_exhaustive", "search_batch", "search_anytime_absolute",
    "search_anytime_relative", "search_u8", "search_oracle", "eval_per_query", "eval_price", "ttest_matrix", "gap_bitwidth_hist", "code_sizes", "bitset_and",
)
TIMES = 3


def main() -> None:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from impactspark.plans import store
    from impactspark.plans.registry import QUERIES

    few = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").limit(500)
    store.store(few, store.scratch(spark, "warm"))
    took = {}

    def timed(run) -> float:
        began = time.perf_counter()
        run()
        return time.perf_counter() - began

    took["build_index"] = round(timed(lambda: store.index(spark, SF_DIR)), 3)
    for name in HEADLINE:
        run = lambda q=QUERIES[name]: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        run()
        took[name] = round(statistics.median(timed(run) for _ in range(TIMES)), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
