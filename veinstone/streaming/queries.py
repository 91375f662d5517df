"""Structured Streaming: a stream of queries answered against the static corpus, and a windowed count of feedback."""

from __future__ import annotations

from functools import reduce
from itertools import count, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.engine import Engine


def answer_stream(engine: Engine, queries: DataFrame, path: str, checkpoint: str, most: int = 100):
    """queries (query_id, text), a streaming DataFrame: each micro-batch's answers are written below path.

    A micro-batch may hold any number of queries. The driver plans up to most of them at a time and answers these by
    one job; its files replace those of path/epoch=<n>/part=<i>, so a batch that runs again leaves no answer twice.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.toLocalIterator()
        for part in count():
            group = list(islice(rows, most))
            if not group:
                return
            answers = [engine.recommend(r.text).select(F.lit(r.query_id).alias("query_id"), "rank", "expert_id", "reason") for r in group]
            reduce(DataFrame.union, answers).write.mode("overwrite").parquet(f"{path}/epoch={epoch}/part={part}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_stream(engine: Engine, queries: DataFrame, path: str, checkpoint: str, **request):
    """queries (query_id, text), a streaming DataFrame: the candidates of a micro-batch's queries by one plan, however many they are, below path/epoch=<n>.

    A micro-batch that runs again replaces its own files. Needs an engine with a segmented index (Engine.search_many).
    """

    def each(batch: DataFrame, epoch: int) -> None:
        found = engine.search_many(batch, **request).select("query_id", "rank", "expert_id", "score", "stable_hits", "expanded_hits")
        found.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """events (ts, event_type): counts by window and type; works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
