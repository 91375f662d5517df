"""Row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(frame: DataFrame, key: Column, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """frame with name: 1-based (from first) by order, which must tell rows apart. key: a number that never falls along the order.

    Quantiles of the key cut the table into ranges; a row's number is its place in its range plus the rows of the ranges
    before. One count for each range comes to the driver.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(key.cast("double"), F.lit(float("-inf")))
    bounds = sorted(set(frame.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []))
    cuts = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    placed = frame.withColumn("__range", F.size(F.filter(cuts, lambda b: b < key)))
    counts = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], first
    for i in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(i, 0)
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn(name, F.get(F.lit(before), F.col("__range")) + at - 1).drop("__range")
