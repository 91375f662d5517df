"""In how many texts a hash occurs, asked of shards by block: nothing is broadcast or sent to the driver, at any input.

A block of documents sends its distinct hashes, cut to some leading bits, sorted and delta-coded, to shards by range.
A shard adds up the blocks' counts and answers with a level for each hash: the binary logarithm of the number of
texts (0: one text alone). Block and answers meet. The number of bits grows with the input, so that about one hash in
a thousand at most shares its bits with another one; such a collision can only raise a level, never hide a shared hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch_of, meet, packed, squeeze, unpacked, unsqueeze
from .common import lean

#: Bytes of text in a block at least, and for each hash (about); bits beyond the logarithm of the text's bytes.
BLOCK, PER_HASH, SPARE = 8 << 20, 6, 8
#: Hashes that a shard holds at once; shards at most (beyond it shards grow); hashes that a block sends to a shard, on average.
SHARD, MOST_SHARDS, SENT = 1 << 19, 1 << 18, 64

Hashes = Callable[[pa.Array], Iterator[np.ndarray]]


class Levels:
    """Lookups of a block's own hashes."""

    def __init__(self, values: np.ndarray, levels: np.ndarray, bits: int):
        self.values, self.levels, self.shift = values, levels, np.uint64(64 - bits)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.values, hashes >> self.shift)]


def _values(texts: pa.Array, hashes_of: Hashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes cut to bits, in how many of the texts each occurs)."""
    cut = [h >> np.uint64(64 - bits) for h in hashes_of(texts)]
    return np.unique(np.concatenate(cut), return_counts=True) if cut else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _cuts(values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    return np.searchsorted(values, np.arange(parts + 1, dtype=np.uint64) << np.uint64(bits - parts.bit_length() + 1))


ASKED = "part int, block long, size int, steps binary, counts binary"
ANSWERS = "block long, part int, size int, levels binary"


def logarithm(counts: np.ndarray) -> np.ndarray:
    return np.log2(counts)


def with_levels(docs: DataFrame, hashes_of: Hashes, use: Callable[[pa.Array, pa.Table, Levels], pa.Table], schema: str, level: Callable[[np.ndarray], np.ndarray] = logarithm, block: int = BLOCK) -> DataFrame:
    """use(texts, other columns, levels) -> rows of schema, for every block of docs (text first; a plain scan).

    hashes_of: arrays of 64-bit hashes, each text's own ones distinct (where they are not, occurrences are counted). level:
    counts to numbers below 256, not decreasing. block: bytes of text in a block at least. The number of shards follows the text, so a shard's
    memory does not; blocks grow with it where a block would else send a shard next to nothing.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(docs.columns[0]))).first()[0] or 0
    bits = min(64, max(24, int(n_bytes).bit_length() + SPARE))
    parts = min(MOST_SHARDS, 1 << (int(n_bytes) // (PER_HASH * SHARD)).bit_length())
    size = max(block, parts * SENT * PER_HASH)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, counts = _values(unpacked(r)[0], hashes_of, bits)
                cuts = _cuts(values, bits, parts)
                low = np.arange(parts, dtype=np.uint64) << np.uint64(bits - parts.bit_length() + 1)
                yield batch_of(ASKED, [
                    (p, r["block"], int(b - a), squeeze(np.diff(values[a:b], prepend=low[p])), squeeze(counts[a:b].astype(np.uint32)))
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a
                ])

    def answer(rows: pa.Table) -> pa.Table:
        lean()
        rows = rows.to_pylist()
        low = np.uint64(rows[0]["part"]) << np.uint64(bits - parts.bit_length() + 1)
        values = np.concatenate([low + np.cumsum(unsqueeze(r["steps"], r["size"], np.uint64), dtype=np.uint64) for r in rows])
        counts = np.concatenate([unsqueeze(r["counts"], r["size"], np.uint32) for r in rows])
        _, which = np.unique(values, return_inverse=True)
        levels = level(np.bincount(which, weights=counts)).astype(np.uint8)[which]
        ends = np.cumsum([r["size"] for r in rows])
        return pa.Table.from_batches([batch_of(ANSWERS, [(r["block"], r["part"], r["size"], squeeze(levels[e - r["size"] : e])) for r, e in zip(rows, ends, strict=True)])])

    def finish(block: dict, told: list[dict]) -> pa.Table:
        texts, others = unpacked(block)
        values, _ = _values(texts, hashes_of, bits)
        cuts = _cuts(values, bits, parts)
        levels = np.zeros(len(values), np.uint8)
        given = {a["part"]: a for a in told}
        for p in np.flatnonzero(np.diff(cuts)):
            a = given.get(int(p))
            if a is None or a["size"] != cuts[p + 1] - cuts[p]:
                raise RuntimeError("the documents changed between two reads")
            levels[cuts[p] : cuts[p + 1]] = unsqueeze(a["levels"], a["size"], np.uint8)
        return use(texts, others, Levels(values, levels, bits))

    asked = packed(docs, size, then=(ask, ASKED))
    return meet(packed(docs, size), asked.groupBy("part").applyInArrow(answer, ANSWERS), finish, schema)


def empty(df: DataFrame) -> bool:
    return df.select(F.lit(1)).limit(1).count() == 0
