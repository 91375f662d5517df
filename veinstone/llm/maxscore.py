"""Exact top-k search (operator 5): MaxScore over dimension postings, shard by shard.

A vector's components become floor(256 * x). A query's terms are its dimensions; a term's contributions
are shifted to start at 0 with the shard's bounds of that dimension. Terms whose bounds together cannot
reach the k-th best score so far are non-essential: the postings of the others are traversed, and the
non-essential ones are probed, largest bound first, only for vectors that are still competitive. Each
shard's k best are merged. Scores are exact: in doubles where all sums stay below 2**53, in 64-bit integers below
2**62, else in Python integers over all vectors of the shard; a score beyond a long's range becomes its bound.

See vectors.py for which vectors take part and for repeated rows. Ties go to the smaller vec_id. Empty tables give
no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .vectors import QUERIES, SHARD, first_k, packed, search, usable

#: Non-essential terms are probed so many at a time.
PROBE = 8


def _build(ids: np.ndarray, mat: np.ndarray) -> dict[str, bytes]:
    """Postings: a row for each dimension."""
    return {"mat": np.ascontiguousarray(mat.T).tobytes()}


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as Python integers, whatever their size."""
    return np.array([int(c) * 256 if abs(c) >= 2.0**53 else math.floor(256 * c) for c in x.ravel().tolist()], object).reshape(x.shape)


def wide_top(q: np.ndarray, own: int, ids: np.ndarray, post: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """top for scores that may not fit in 64 bits: every vector in full, by Python integers; results beyond a long become its bounds."""
    score = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in (q @ post).tolist()]
    pick = sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-score[i], ids[i]))[:k]
    return ids[pick], np.array([score[i] for i in pick], np.int64)


def top(q: np.ndarray, own: int, ids: np.ndarray, post: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best among the postings post (dims x vectors), whose rows lie between low and high."""
    ends = np.sort(np.stack([q * high, q * low]), axis=0)
    span = ends[1] - ends[0]
    order = np.argsort(-span, kind="stable")
    left = np.concatenate([np.cumsum(span[order][::-1])[::-1], [0]])  # bound of all terms from i on
    floor = ends[0].sum()
    others = np.flatnonzero(ids != own)
    # A first threshold: score the vectors in full that lead in the first terms.
    lead = order[: max(1, len(q) // 4)]
    part = q[lead] @ post[lead]
    if len(others) > 4 * k:
        seen = others[np.argpartition(-part[others], 4 * k)[: 4 * k]]
        at = np.partition(q @ post[:, seen], len(seen) - k)[len(seen) - k]
    else:
        at = -np.inf
    essential = int(np.argmax(left + floor < at)) if (left + floor < at).any() else len(q)
    essential = max(essential, len(lead))
    rest = order[len(lead) : essential]
    part = part + q[rest] @ post[rest]
    shift = ends[0][order]
    done = shift[:essential].sum()
    live = others[part[others] - done + left[essential] + floor >= at]
    part = part[live]
    for i in range(essential, len(q), PROBE):
        terms = order[i : i + PROBE]
        part = part + q[terms] @ post[np.ix_(terms, live)]
        done += shift[i : i + PROBE].sum()
        if len(live) > k:
            at = max(at, np.partition(part, len(part) - k)[len(part) - k] + floor - done)
        keep = part - done + left[min(i + PROBE, len(q))] + floor >= at
        live, part = live[keep], part[keep]
    pick = first_k(ids[live], part, k)
    return ids[live][pick], part[pick]


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (long) of each query's k highest integer inner products among vectors."""

    def find(asked: dict, shard: dict, dim: int) -> list:
        ids, post = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["mat"], np.float64).reshape(dim, -1)
        names, q = np.frombuffer(asked["ids"], np.int64), np.frombuffer(asked["mat"], np.float64).reshape(dim, -1).T
        bound = dim * (256 * float(np.abs(post).max()) + 1) * (256 * float(np.abs(q).max()) + 1)
        if not bound < 2.0**62:
            post, q = integers(post), integers(q)
            return [wide_top(one, name, ids, post, k) for name, one in zip(names, q, strict=True)]
        post, q = np.floor(256.0 * post), np.floor(256.0 * q)
        if bound >= 2.0**53:
            post, q = post.astype(np.int64), q.astype(np.int64)
        high, low = post.max(axis=1), post.min(axis=1)
        return [top(one, name, ids, post, high, low, k) for name, one in zip(names, q, strict=True)]

    shards, n = packed(usable(vectors, zero=True), SHARD, _build, k)
    blocks, _ = packed(usable(queries, zero=True), QUERIES, _build, 1)
    return search(blocks, shards, n, k, find, "long")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(e, e.filter(F.col("vec_id") % 50 == 0), k=5)


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT row_number() OVER () AS n, vec_id, v FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0)),
t AS (SELECT r, vec_id, len(v) AS dim, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
u AS (SELECT n, vec_id, len(v) AS dim, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM q),
s AS (SELECT a.n, a.vec_id AS query_id, b.r, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM u a JOIN t b ON a.i = b.i AND a.dim = b.dim AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
