"""Approximate nearest neighbours (operator 3): few stable projections in a kd-tree, verified until a chi-square test.

Largest inner product becomes least distance by one added component (sqrt(M^2 - |x|^2), M the shard's
largest norm; 0 for queries). Gaussian projections to M_DIMS dimensions are 2-stable: the squared
projected distance over the squared true one is chi-square with M_DIMS degrees of freedom. Each shard
keeps all its vectors in the leaves of a kd-tree over the projections. Queries meet leaves in blocks, each its nearest ones
first. A vector is verified exactly unless its projected distance is so large that one nearer than the query's k-th best so
far would have a smaller one with probability CONFIDENCE; a leaf whose whole box is that far is left out. The k-th
best only improves, so all that a walk in order of projected distance verifies is verified. A confidence above 1 leaves out nothing: the exact way.

Nothing is sampled: every vector is indexed; of equal vectors in a shard the 2 k first by vec_id can be among a query's k. On random unit vectors of 64 dimensions, where distances differ least,
the test skips about a third of the vectors; clustered ones let it skip more. `nearest`
returns how many it verified.

Scores are inner products in double precision on the original vectors, added in a fixed order. See
vectors.py for which vectors take part (zero vectors do not) and for repeated rows. Ties go to the smaller vec_id.
Empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .vectors import QUERIES, SHARD, first_k, packed, search, usable

#: Projected dimensions (even), vectors in a leaf, the test's confidence, the projections' seed.
M_DIMS, LEAF, CONFIDENCE, SEED = 16, 64, 0.94, 11
#: A query's nearest leaves, which give its test a first radius.
FIRST = 4
#: Bytes of components that a block of queries holds.
ASKED = 4 * QUERIES


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, M_DIMS))


def chi_square(x: float, m: int) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half = x / 2
    if half > 300:
        return 1.0
    term = total = 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def kd_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in leaf order, nodes as (left, right, begin, end) with -1 for a leaf's children, boxes) split at the median of the widest dimension."""
    order = np.arange(len(points))
    nodes, boxes, todo = [], [], [(0, len(points), -1, 0)]
    while todo:
        begin, end, parent, side = todo.pop()
        part = points[order[begin:end]]
        low, high = part.min(axis=0), part.max(axis=0)
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        axis = int(np.argmax(high - low))
        if end - begin > leaf and high[axis] > low[axis]:
            half = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(part[:, axis], half)]
            todo += [(begin + half, end, len(nodes), 1), (begin, begin + half, len(nodes), 0)]
        nodes.append([-1, -1, begin, end])
        boxes.append(np.concatenate([low, high]))
    return order, np.array(nodes, np.int64), np.stack(boxes)


def build(ids: np.ndarray, mat: np.ndarray, copies: int | None = None) -> dict[str, bytes]:
    """A shard: vectors and their projections in leaf order, the tree and the largest squared norm. copies: rows kept of equal vectors, in order of ids."""
    kept = np.arange(len(ids))
    if copies is not None:
        _, group = np.unique(mat, axis=0, return_inverse=True)
        rows = np.lexsort((ids, group.ravel()))
        ends = np.flatnonzero(np.diff(group.ravel()[rows], prepend=-1))
        kept = np.sort(rows[np.arange(len(rows)) - np.repeat(ends, np.diff(ends, append=len(rows))) < copies])
        mat = mat[kept]
    norm = (mat * mat).sum(axis=1)
    most = float(norm.max())
    points = np.hstack([mat, np.sqrt(np.maximum(0, most - norm))[:, None]]) @ projections(mat.shape[1])
    order, nodes, boxes = kd_tree(points, LEAF)
    return {"order": kept[order].astype(np.int64).tobytes(), "mat": mat[order].tobytes(), "points": points[order].tobytes(), "nodes": nodes.tobytes(), "boxes": boxes.tobytes(), "most": np.float64(most).tobytes()}


def _plain(ids: np.ndarray, mat: np.ndarray) -> dict[str, bytes]:
    return {"mat": mat.tobytes()}


def _limit(confidence: float) -> float:
    """The quotient of squared distances at which the chi-square test holds."""
    if confidence >= 1:
        return math.inf
    low, high = 0.0, 600.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, M_DIMS) < confidence else (low, mid)
    return high


def _leaves(nodes: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) and boxes of the tree's leaves in order of their vectors."""
    own = np.flatnonzero(nodes[:, 0] < 0)
    own = own[np.argsort(nodes[own, 2], kind="stable")]
    return nodes[own, 2:], boxes[own]


def nearest(names: np.ndarray, q: np.ndarray, shard: dict, dim: int, k: int, confidence: float = CONFIDENCE) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(ids, scores) of each query's k best found, and how many vectors were verified.

    All queries walk together: a leaf is met with those whose test does not yet exclude its box, each query's nearest
    leaves first, and of its vectors a query takes those that its test does not exclude at that time.
    """
    ids, mat = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["mat"], np.float64).reshape(-1, dim)
    points, boxes = np.frombuffer(shard["points"], np.float64).reshape(-1, M_DIMS), np.frombuffer(shard["boxes"], np.float64).reshape(-1, 2, M_DIMS)
    spans, boxes = _leaves(np.frombuffer(shard["nodes"], np.int64).reshape(-1, 4), boxes)
    most = float(np.frombuffer(shard["most"], np.float64)[0])
    p = np.hstack([q, np.zeros((len(q), 1))]) @ projections(dim)
    own = (q * q).sum(axis=1)
    # Products of blocks are rounded otherwise than the scores, which are added in a fixed order.
    slack = 1e-14 * dim * np.sqrt(most * own)
    p_own, points_own = (p * p).sum(axis=1), (points * points).sum(axis=1)
    box = np.empty((len(q), len(spans)))
    for i, (low, high) in enumerate(boxes):
        gap = np.maximum(0, np.maximum(low - p, p - high))
        box[:, i] = (gap * gap).sum(axis=1)
    factor = _limit(confidence)
    best = np.full((len(q), k), -math.inf)
    least, within = best[:, 0].copy(), np.full(len(q), math.inf)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    verified = 0

    def meet(asked: np.ndarray, leaf: int) -> None:
        nonlocal verified
        begin, end = spans[leaf]
        far = p_own[asked, None] + points_own[begin:end] - 2 * (p[asked] @ points[begin:end].T)
        take = far <= within[asked, None]
        verified += int(take.sum())
        score = np.where(take & (names[asked, None] != ids[begin:end]), q[asked] @ mat[begin:end].T, -math.inf)
        row, at = np.nonzero((score >= (least - slack)[asked, None]) & (score > -math.inf))
        if not len(row):
            return
        hits.append((asked[row], at + begin, score[row, at]))
        some = np.unique(row)
        who = asked[some]
        both = np.hstack([best[who], score[some]])
        best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        least[who] = best[who, 0]
        within[who] = factor * np.maximum(own[who] + most - 2 * least[who], 1e-300)

    met = np.zeros(box.shape, bool)
    first = np.argsort(box, axis=1, kind="stable")[:, :FIRST]
    for turn in first.T:
        for leaf in np.unique(turn):
            meet(np.flatnonzero(turn == leaf), leaf)
        met[np.arange(len(q)), turn] = True
    for leaf in np.argsort(box.mean(axis=0), kind="stable"):
        asked = np.flatnonzero(~met[:, leaf] & (box[:, leaf] <= within))
        if len(asked):
            meet(asked, leaf)
    who, at, score = (np.concatenate(c) for c in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 3
    good = score >= (least - 2 * slack)[who]
    who, at = who[good], at[good]
    order = np.argsort(who, kind="stable")
    ends = np.searchsorted(who[order], np.arange(len(q) + 1))
    out = []
    for i, one in enumerate(q):
        seen = at[order[ends[i] : ends[i + 1]]]
        score = (mat[seen] * one).sum(axis=1)
        kept = first_k(ids[seen], score, k)
        out.append((ids[seen][kept], score[kept]))
    return out, verified


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, confidence: float = CONFIDENCE, shard_bytes: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found among vectors."""

    def find(asked: dict, shard: dict, dim: int) -> list:
        names, q = np.frombuffer(asked["ids"], np.int64), np.frombuffer(asked["mat"], np.float64).reshape(-1, dim)
        return nearest(names, q, shard, dim, k, confidence)[0]

    shards, n = packed(usable(vectors, zero=False), shard_bytes, partial(build, copies=2 * k), k)
    blocks, _ = packed(usable(queries, zero=False), ASKED, _plain, 1)
    return search(blocks, shards, n, k, find)


def op3_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(e, e.filter(F.col("vec_id") % 20 == 0), k=20)
