"""Mixing sources to target weights (operator 1), with DataFrame functions only.

Every source is given a target number of words. Of a source that is to be taken `target / size` times,
each document counts the whole part as often; the remainder goes to the documents whose hash lies below
a threshold. Thresholds are found from histograms: words by source and hash bucket, then finer ones of
the boundary bucket alone, then a filter on the hash; nothing is sorted but 4096 buckets of a source.
Documents in the last boundary bucket (in practice one document, and its repeats) share what is left in
proportion to their sizes, so a source's words meet its target to within rounding. A smaller target
takes a subset of what a larger one takes. The hash depends on doc_id alone: reruns agree.

Null texts count as size 0, very long ones whole. A null source is a source of its own, last in order. Repeated rows
hash alike and share. Documents of size 0 are never taken. Other columns are ignored by mix and kept by mixed, which
judges every row by its own source and size. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, read, save, small

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash a histogram adds, and how many histograms there are.
BITS, LEVELS = 12, 3
WEIGHTS = (5.0, 2.0, 1.0)


def hash_bits(doc_id: Column) -> Column:
    """The first BITS * LEVELS bits of the MD5 digest of doc_id as text; a null doc_id hashes like an empty one."""
    digits = BITS * LEVELS // 4
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> with target: budget times all words shared by weight, none above cap times its source.

    Sharing the excess again until none is above ends where target = min(cap * size, level * weight);
    the level is found from running sums over the sources in the order in which they reach their cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    t = t.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("total", F.sum("source_size").over(every) * F.lit(budget))
    t = t.withColumn("capped", F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    t = t.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return t.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def sizes(docs: DataFrame) -> tuple[Column, Column, Column]:
    """source, size and hash of rows (doc_id, text, source)."""
    size = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs["source"].cast("string"), size, hash_bits(docs["doc_id"])


def edges(sized: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """sized (source, size, h) -> a row for each source: s, source_size, target, whole (times that all is taken), rest (words beyond), low (boundary bucket), inside (its words)."""
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    # rest: words to be taken beyond the whole times; low, high: the boundary bucket's range of hashes.
    edge = save(totals.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("low", F.lit(0).cast("long")).withColumn("inside", F.lit(None).cast("long")), "edges")
    keep = ["source", "source_size", "target", "whole"]
    for level in range(1, LEVELS + 1):
        wide = 1 << (BITS * (LEVELS - level))
        live = edge.select(F.col("source").alias("s"), "low", "rest")
        near = sized.join(small(live), F.col("source").eqNullSafe(F.col("s")) & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + wide * (1 << BITS)))
        cells = near.groupBy("source", "low", "rest", F.floor((F.col("h") - F.col("low")) / wide).alias("cell")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        found = cells.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        found = found.select(F.col("source").alias("s"), (F.col("low") + F.col("cell") * wide).alias("low_2"), (F.col("rest") - F.col("before")).alias("rest_2"), F.col("words").alias("inside_2"))
        edge = edge.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(*keep, F.coalesce("low_2", "low").alias("low"), F.coalesce("rest_2", "rest").alias("rest"), F.coalesce("inside_2", "inside").alias("inside"))
        edge = save(edge, "edges")
    return edge.withColumnRenamed("source", "s")


def taken(size: Column, h: Column, edge: DataFrame) -> Column:
    """Words that the mix takes of a row that is joined with its source's edge."""
    part = F.floor(size * edge["rest"] / edge["inside"])
    extra = F.when(h < edge["low"], size).when((h == edge["low"]) & (edge["inside"] > 0), part).otherwise(0)
    return (edge["whole"] * size + extra).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source; others are ignored)."""
    source, size, h = sizes(docs)
    sized = save(docs.select("doc_id", source.alias("source"), size.alias("size"), h.alias("h")), "sized")
    edge = edges(sized, weights, budget, cap)
    out = sized.join(small(edge), sized["source"].eqNullSafe(edge["s"]))
    return out.select("doc_id", "source", "size", "source_size", "target", taken(F.col("size"), F.col("h"), edge).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix as rows of docs: each as often as taken / size says, rounded to whole documents."""
    source, size, h = sizes(docs)
    sized = docs.select(source.alias("source"), size.alias("size"), h.alias("h"))
    edge = edges(save(sized, "sized"), weights, budget, cap)
    times = F.when(size > 0, F.round(taken(size, h, edge) / size)).otherwise(0).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    name = free(docs, "copy")
    out = docs.join(small(edge), source.eqNullSafe(edge["s"])).select(*(docs[f"`{c}`"] for c in docs.columns), F.explode(copies).alias(name))
    return out.drop(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9)) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), r AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - (sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (SELECT *, least(most, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, most)) AS target FROM l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS inside, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS BIGINT) AS before
  FROM d GROUP BY source, h
)
SELECT d.doc_id, d.size, w.source_size, w.target,
  CAST(w.whole * d.size + CASE
    WHEN g.inside + g.before <= w.target - w.whole * w.source_size THEN d.size
    WHEN g.before <= w.target - w.whole * w.source_size THEN floor(d.size * (w.target - w.whole * w.source_size - g.before) / g.inside)
    ELSE 0 END AS BIGINT) AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""
