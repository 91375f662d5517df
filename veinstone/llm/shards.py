"""Sharding (operator 12), with DataFrame functions only: contiguous shards of near equal bytes in the table's own order.

Documents keep the order in which they are stored: by file, then by row in the file. The order is cut into partitions
of at most BLOCK rows of one file, whatever splits a scan uses. Each partition's bytes are added up, a running sum over
the partitions' totals gives every partition the bytes and rows before it, and a running sum inside the partition does
so for every document. The total is cut at equal targets: a document belongs to the shard in which its middle byte lies.
So shards are contiguous and each differs from its target by half a document at each end at most.

Only key, size and place of a document are shuffled, by partition, and no partition can hold more than BLOCK rows however often a
key, source or text repeats. The single task with the partitions' totals holds one row for BLOCK documents or for a file.
write_shards() moves no text at all: a task writes the rows it reads to the few shards they belong to.

Reruns over the same files agree. A table that is no plain scan of Parquet files is written first. Null keys and
texts are rows like others, very long ones too; repeated rows are told apart by their place; an empty table gives an
empty result; other columns are ignored or kept as the caller selects. Law of the contract: `bytes`. Equal texts may lie
in different shards: a group of copies with a third of all rows fits in none.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, read, save, small

#: Rows of a file that are one partition.
BLOCK = 1 << 16
SHARDS = 24


def _is_scan(plan: JavaObject) -> bool:
    """Whether a logical plan only selects from and filters Parquet files, deterministically."""
    if plan.nodeName() == "LogicalRelation":
        relation = plan.relation()
        return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet"
    below = plan.children()
    return plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic() and _is_scan(below.head())


def placed(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """docs with columns for file, partition within the file and row, and the columns' names."""
    plain = docs if _is_scan(docs._jdf.queryExecution().analyzed()) else save(docs, "sharded")
    file, part, row = free(docs, "file"), free(docs, "part"), free(docs, "row")
    meta = plain.metadataColumn("_metadata")
    found = plain.select(*(plain[f"`{c}`"] for c in plain.columns), meta["file_path"].alias(file), meta["row_index"].alias(row))
    return found.withColumn(part, F.shiftright(row, BLOCK.bit_length() - 1)), file, part, row


def _shard(before: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard in which the middle byte lies; exact for any total."""
    wide = lambda c: c.cast("decimal(30,0)")
    middle = (wide(before) * 2 + wide(size)) * F.lit(shards).cast("decimal(8,0)")
    return F.least(F.lit(shards - 1), F.coalesce(F.floor(middle / F.nullif(wide(total) * 2, F.lit(0).cast("decimal(30,0)"))), F.lit(0))).cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, size: str = "size") -> DataFrame:
    """docs with shard int and slot long (0, 1, ... in each shard, in the table's order). size: the column of a row's bytes, no nulls."""
    own, file, part, row = placed(docs)
    own = save(own, "placed")
    n_bytes, n_rows, total, rank = (free(own, c) for c in ("bytes_before", "rows_before", "total", "rank"))
    key = Window.orderBy(file, part)  # one row for each partition
    parts = own.groupBy(file, part).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
    parts = parts.select(file, part, (F.sum("b").over(key) - F.col("b")).alias(n_bytes), (F.sum("n").over(key) - F.col("n")).alias(n_rows), F.sum("b").over(Window.partitionBy()).alias(total))
    run = Window.partitionBy(file, part).orderBy(row)
    ranked = own.withColumns({"__b": F.sum(size).over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size), "__n": F.row_number().over(run) - 1}).join(parts, [file, part])
    ranked = ranked.withColumn("shard", _shard(F.col(n_bytes) + F.col("__b"), F.col(size), F.col(total), shards)).withColumn(rank, F.col(n_rows) + F.col("__n"))
    first = ranked.groupBy("shard").agg(F.min(rank).alias("__first"))
    out = ranked.join(F.broadcast(first), "shard")  # a row for each shard
    return out.select(*(f"`{c}`" for c in docs.columns), "shard", (F.col(rank) - F.col("__first")).alias("slot"))


def bounds(docs: DataFrame, shards: int, size: Column) -> DataFrame:
    """A row for each partition of docs: file, part, shard (of its first row), cuts (row, shard): where another shard begins."""
    own, file, part, row = placed(docs.withColumn(free(docs, "size"), size).select(free(docs, "size")))
    held = save(own.select(F.col(file).alias("file"), F.col(part).alias("part"), F.col(row).alias("row"), F.col(own.columns[0]).alias("size")), "placed")
    key = Window.orderBy("file", "part")
    parts = held.groupBy("file", "part").agg(F.sum("size").alias("b"))
    parts = parts.select("file", "part", (F.sum("b").over(key) - F.col("b")).alias("before"), F.sum("b").over(Window.partitionBy()).alias("total"))
    run = Window.partitionBy("file", "part").orderBy("row")
    rows = held.withColumn("run", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(parts, ["file", "part"])
    rows = rows.withColumn("shard", _shard(F.col("before") + F.col("run"), F.col("size"), F.col("total"), shards))
    starts = rows.groupBy("file", "part", "shard").agg(F.min("row").alias("row"))
    return starts.groupBy("file", "part").agg(F.min("shard").alias("shard"), F.array_sort(F.collect_list(F.struct("row", "shard"))).alias("cuts"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, size: Column | None = None) -> None:
    """Write docs, a plain scan, to path/shard=0, 1, ...: each task the rows it reads. size: bytes of a row, by default those of its text."""
    if not _is_scan(docs._jdf.queryExecution().analyzed()):
        docs = save(docs, "sharded")
    known = bounds(docs, shards, text_bytes(docs["text"]) if size is None else size)
    own, file, part, row = placed(docs)
    known = known.select(F.col("file").alias(file), F.col("part").alias(part), F.col("shard").alias("__first"), F.col("cuts").alias("__cuts"))
    here = F.element_at(F.filter("__cuts", lambda c: c["row"] <= F.col(row)), -1)["shard"]
    own.join(small(known), [file, part]).select(*(F.col(f"`{c}`") for c in docs.columns), here.alias("shard")).write.partitionBy("shard").parquet(path)


def text_bytes(text: Column) -> Column:
    """A document's size: the bytes of its text and 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    out = sharded(docs.select("doc_id", text_bytes(docs["text"]).alias("size"), crc.alias("text_crc32")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
