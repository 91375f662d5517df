"""`python -m veinstone.report <folder> [text]` prints readiness as JSON (exit code 1 if not ready), or a text's response;
`python -m veinstone.report <folder> --evaluate <queries> [<judgements>]` what is found for each query of a table (query_id, text), and
means of the ranking metrics where a table of judgements (query_id, expert_id, gain) is given.

The folder holds points.parquet, people.parquet and items.parquet, and index/ if one is stored.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.metrics import mean_metrics, ranking_metrics
from .operators.retrieval import open_index
from .operators.segments import open_segments
from .plans.engine import Engine
from .sources.files import names


def engine_of(spark: SparkSession, folder: str) -> Engine:
    """An engine over a folder's tables; a missing table is an error, a missing index is not."""
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("points", "people", "items")]
    if names(spark, f"{folder}/index/manifests"):
        return Engine(spark, *tables, index=open_segments(spark, f"{folder}/index"))
    try:
        index = open_index(spark, f"{folder}/index")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        index = None
    return Engine(spark, *tables, index=index)


def evaluate(engine: Engine, queries: DataFrame, judgements: DataFrame | None = None, k: int = 10) -> DataFrame:
    """A row for each query (query_id, text), answered by one plan: retrieved, top_id, top_name, top_score; with judgements also the metrics at k (null for a query that has none)."""
    found = engine.search_many(queries)
    first = F.col("rank") == 1
    own = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"), *(F.max(F.when(first, F.col(c))).alias(n) for c, n in (("expert_id", "top_id"), ("name", "top_name"), ("score", "top_score"))))
    out = queries.select("query_id").distinct().join(own, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))
    return out if judgements is None else out.join(ranking_metrics(found, judgements, k), "query_id", "left")


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args:
        print(__doc__)
        return 2
    engine = engine_of(spark or SparkSession.builder.getOrCreate(), args[0])
    if len(args) > 2 and args[1] == "--evaluate":
        told = [engine.spark.read.parquet(a) for a in args[2:4]]
        for r in evaluate(engine, *told).orderBy("query_id").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False, default=str))
        if len(told) > 1:
            print(json.dumps(mean_metrics(ranking_metrics(engine.search_many(told[0]), told[1])).first().asDict()))
        return 0
    if len(args) > 1:
        print(json.dumps(engine.respond(" ".join(args[1:])), ensure_ascii=False, default=str))
        return 0
    out = engine.ready()
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0 if out["ready"] else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
