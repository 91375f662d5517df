"""Blocks of vectors: candidates in hash shards of bounded size, queries in blocks, every block meeting every shard.

A vector takes part if it is not null, not empty and all its components are finite; rows without vec_id
do not. Vectors of another length are no candidates for a query. Candidates are rows: one that is repeated
is found as often. A query never meets rows of its own vec_id; a repeated query is asked once, two
vectors of one vec_id are two queries. Extra columns are ignored; very long vectors make smaller shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

#: Bytes of components (8 each) that a shard of candidates and a block of queries hold on average.
SHARD, QUERIES = 8 << 20, 1 << 18


def usable(df: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v (array<double>), dim, ask (tells queries apart); with zero, vectors of zeros take part too."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & good).withColumns({"dim": F.size("v"), "ask": F.xxhash64("vec_id", "v")})
    return rows if zero else rows.filter(F.exists("v", lambda x: x != 0))


def packed(vectors: DataFrame, size: int, build: Callable[[np.ndarray, np.ndarray], dict[str, bytes]], copies: int) -> tuple[DataFrame, int]:
    """Rows (dim, block, ids, asks, and build's binary columns), each of about size bytes; and the number of blocks.

    Repeated rows are counted before they are dealt out, so a frequent one is no hot key; copies of each are kept at most
    (no result can hold more than k).
    """
    held = vectors
    vectors = vectors.groupBy("dim", "vec_id", "ask").agg(F.first("v").alias("v"), F.least(F.count(F.lit(1)), F.lit(copies)).alias("times"))
    blocks = max(1, -(-8 * (held.agg(F.sum("dim")).first()[0] or 0) // size))
    names = sorted(build(np.zeros(1, np.int64), np.ones((1, 2))))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.loc[rows.index.repeat(rows["times"])].sort_values(["vec_id", "ask"], kind="stable")
        ids, asks, mat = order["vec_id"].to_numpy(np.int64), order["ask"].to_numpy(np.int64), np.stack(order["v"].to_numpy())
        parts = build(ids, mat)
        at = np.frombuffer(parts.get("order", np.arange(len(ids)).tobytes()), np.int64)
        return pd.DataFrame({"dim": [int(key[0])], "block": [int(key[1])], "ids": [ids[at].tobytes()], "asks": [asks[at].tobytes()], **{c: [parts[c]] for c in names}})

    schema = "dim int, block long, ids binary, asks binary, " + ", ".join(f"{c} binary" for c in names)
    return vectors.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks))).groupBy("dim", "block").applyInPandas(pack, schema), blocks


def search(queries: DataFrame, shards: DataFrame, n_shards: int, k: int, find: Callable[[dict, dict, int], list[tuple[np.ndarray, np.ndarray]]], kind: str = "double") -> DataFrame:
    """query_id, rank, vec_id, score. find(query block, shard, dim): for each query (ids, scores) of at least the shard's k best."""
    cols = [c for c in shards.columns if c not in ("dim", "block")]
    asked = [c for c in queries.columns if c not in ("dim", "block")]
    left = queries.select("dim", *(F.col(c).alias(f"q_{c}") for c in asked), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("block"))
    rows = left.join(shards, ["dim", "block"])
    number = np.int64 if kind == "long" else np.float64

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                got = find({c: r[f"q_{c}"] for c in asked}, {c: r[c] for c in cols}, r["dim"])
                many = [len(v) for v, _ in got]
                yield pd.DataFrame({
                    "query_id": np.repeat(np.frombuffer(r["q_ids"], np.int64), many),
                    "ask": np.repeat(np.frombuffer(r["q_asks"], np.int64), many),
                    "vec_id": np.concatenate([v for v, _ in got]).astype(np.int64),
                    "score": np.concatenate([s for _, s in got]).astype(number),
                })

    near = rows.mapInPandas(tidy(run), f"query_id long, ask long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
