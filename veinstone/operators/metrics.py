"""Ranking metrics over judgements: precision, recall, nDCG and reciprocal rank at k, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(results: DataFrame, judgements: DataFrame, k: int = 10, query: str = "query_id", item: str = "expert_id") -> DataFrame:
    """query, relevant (judged above 0), precision, recall, ndcg, mrr, each at k; a row for each query that has a judgement above 0.

    results: query, item, rank (from 1, no repeats); judgements: query, item, gain (0 or more; repeats: the largest counts).
    A query without results has zeros. The ideal order is that of all judged items by gain. Only k rows of a query meet its judgements.
    """
    judged = judgements.groupBy(query, item).agg(F.max("gain").cast("double").alias("gain")).where("gain > 0")
    discount = lambda rank: 1 / F.log2(rank + 1)
    found = results.where(F.col("rank") <= k).select(query, item, "rank").join(judged, [query, item])
    got = found.groupBy(query).agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("gain") * discount(F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    order = Window.partitionBy(query).orderBy(F.desc("gain"))
    best = judged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy(query).agg(F.sum(F.col("gain") * discount(F.col("rank"))).alias("ideal"))
    total = judged.groupBy(query).agg(F.count(F.lit(1)).alias("relevant"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(best, query).join(got, query, "left").select(
        query, "relevant", none(F.col("hits") / k).alias("precision"), none(F.col("hits") / F.col("relevant")).alias("recall"), none(F.col("dcg") / F.col("ideal")).alias("ndcg"), none(1 / F.col("first")).alias("mrr"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over queries: n, precision, recall, ndcg, mrr."""
    return metrics.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("precision", "recall", "ndcg", "mrr")))
