"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from veinstone import queries as core

HEADLINE = (
    "term_counts", "sparse_topk_bm25", "dense_topk_cosine", "cascade_rrf_branch", "max_weighted_agg", "final_rank", "filter_nested_exists", "filter_recency_pool",
    "points_explode", "evidence_score", "evidence_quota", "gate_order_topk", "reason_validator", "search_pipeline", "recommend_pipeline",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    began = time.perf_counter()
    spark.range(300_000_000).selectExpr("sum(id * id % 7)").collect()
    speed = round(time.perf_counter() - began, 3)  # the same work everywhere: what this machine does in a second
    took = {}
    began = time.perf_counter()
    core.engine(spark, folder)  # stored postings: built once, then read by every search
    took["index_build"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        core.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")), "calibration_sec": speed}))


if __name__ == "__main__":
    main()
