"""Substring dedup (operator 7): shared k-mer seeds, collinear chains through a Fenwick tree, alignment.

Texts are cut into words; of every WINDOW consecutive K-word hashes the least is a seed, so any run of
K + WINDOW - 1 equal words shares one. Shards tell which seeds occur in one text alone (shared.py); those are dropped.
Every other seed has an owner, the least document that holds it, and each other holder is matched with the owner's
first occurrence. Seeds of one passage may have several owners, none of which holds the passage; so runs of
MIN_WORDS words have owners too: the least hash of every RUN_WINDOW consecutive ones, wherever no seed inside is known to be
in one text alone. An exact passage of MIN_WORDS + RUN_WINDOW - 1 words or more is therefore always met with a document
that holds MIN_WORDS words of it, whatever earlier documents hold parts of it. A fuzzy passage is met with an owner of its
seeds; it is missed if those owners hold only short parts of it.

A document's matches with one owner are chained in order with gap costs, chains are extended word by word and
aligned, and those of at least MIN_WORDS words and IDENTITY equal ones are passages; others are split at their
costliest gaps and their parts tried. AROUND words in a row without a shared seed end a passage. The owner keeps its copy.

A seed that very many documents hold is dealt out by salt: in each of its groups of about 2**HEAVY documents the
least one is owner, and the owners of the groups are matched with the least of them.

Null and short texts have no passages. Passages that repeat only inside one document are none. Documents are told
apart by doc_id and text together: rows that repeat both are one document; the least is by doc_id (nulls first), then
a hash of the text. Rows with equal doc_id and other texts are other documents. Very long texts count whole; bytes
that are no valid UTF-8 are parts of words like any others. Other columns are kept by cut_passages, ignored else. An
empty table gives no rows. Alignment compares 16 bits of each word's hash: one in 65,536 unequal words seems equal.
docs is read twice: a table that is no plain scan is written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .blocks import batch_of
from .common import discard, forget_shuffles, free, read, save, stored, tidy
from .shared import Levels, with_levels

K, WINDOW, MIN_WORDS, IDENTITY = 4, 4, 45, 0.8
#: Runs of MIN_WORDS words of which one is kept; logarithm of the texts that a salted seed's group has; words of a hit near another.
RUN_WINDOW, HEAVY, NEAR = 6, 9, 48
#: Cost of a gap's word; words around the seeds that alignment sees.
GAP_COST, AROUND = 0.2, 96
#: Score of an equal and an unequal word and the drop that ends an extension.
EQUAL, UNEQUAL, DROP = 1, -2, 8


def seeds(hashes: np.ndarray, row: np.ndarray, rows: int, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word index in the row) of each row's minimisers; a row of fewer than window k-mers has all of them."""
    counts = np.bincount(row, minlength=rows)
    starts = np.cumsum(counts) - counts
    n = len(hashes)
    if n < k:
        return hashes[:0], row[:0], row[:0]
    sums = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        sums += hashes[j : n - k + 1 + j] * W._ODD[j]
    sums = W.mix64(sums)
    valid = row[: n - k + 1] == row[k - 1 :]
    if len(sums) >= window:
        view = np.lib.stride_tricks.sliding_window_view(sums, window)
        whole = row[: len(view)] == row[k + window - 2 :]
        at = np.flatnonzero(whole)
        picked = at + view[at].argmin(axis=1)
    else:
        picked = np.zeros(0, np.int64)
    few = (counts >= k) & (counts < k + window - 1)
    short = np.flatnonzero(valid & few[row[: n - k + 1]])
    where = np.unique(np.concatenate([picked, short]))
    return sums[where], row[where], where - starts[row[where]]


def _distinct_seeds(texts: pa.Array) -> Iterator[np.ndarray]:
    for start, stop, buf, offsets in W.chunks(texts):
        hashes, row, _, _ = W.words(buf, offsets)
        found, row, _ = seeds(hashes, row, stop - start)
        yield W.distinct(found, row)[0]


def open_starts(words: int, single: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of size words that other texts may have: those in which no seed of one text alone (word indexes) is sure.

    A seed is picked again in any text that has all windows around it.
    """
    if words < size:
        return np.zeros(0, np.int32)
    change = np.zeros(words + 1, np.int64)
    low, high = np.maximum(single + K + WINDOW - 1 - size, 0), single - WINDOW + 2
    some = low < high
    np.add.at(change, low[some], 1)
    np.add.at(change, high[some], -1)
    return np.flatnonzero(np.cumsum(change)[: words - size + 1] == 0).astype(np.int32)


_POWER = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words (32-bit hashes) from starts: equal for equal words wherever they stand."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix64(words.astype(np.uint64)) * _powers(_POWER, len(words)), dtype=np.uint64)])
    back = _powers(pow(_POWER, -1, 1 << 64), len(words))
    return W.mix64((sums[starts + size] - sums[starts]) * back[starts])


def picked_runs(words: np.ndarray, starts: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the open runs that are least among window consecutive open ones; of fewer, of all."""
    hashes = run_hashes(words, starts, size)
    if not len(starts):
        return hashes, starts
    pieces = np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > 1) + 1)
    keep = []
    for piece in pieces:
        if len(piece) <= window:
            keep.append(piece[[hashes[piece].argmin()]])
        else:
            view = np.lib.stride_tricks.sliding_window_view(hashes[piece], window)
            keep.append(np.unique(piece[np.arange(len(view)) + view.argmin(axis=1)]))
    at = np.concatenate(keep)
    return hashes[at], starts[at]


def salts(key: int, levels: np.ndarray, heavy_from: int) -> np.ndarray:
    """The group of a document among those that hold seeds of these levels; -1 for seeds with one group."""
    heavy = np.maximum(levels.astype(np.int64) - heavy_from, 0)
    return np.where(heavy > 0, np.int64(key & 0x7FFFFFFF) & ((np.int64(1) << heavy) - 1), -1)


FOUND = "key long, doc_id long, seeds array<long>, at array<int>, salt array<int>, more array<array<int>>, words binary"


def first_places(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list | None]:
    """(positions of each hash's first place, each one's further places or None); the second is None if no hash repeats."""
    found, first = np.unique(hashes, return_index=True)
    if len(found) == len(hashes):
        return np.arange(len(hashes)), None
    order = np.lexsort((at, hashes))
    begin = np.searchsorted(hashes[order], found)
    end = np.append(begin[1:], len(order))
    return order[begin], [at[order[a + 1 : b]].astype(np.int32) if b - a > 1 else None for a, b in zip(begin, end, strict=True)]


def shared_seeds(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """docs (text, key, doc_id) -> FOUND, of documents with two shared seeds at least: distinct hashes of seeds and picked runs, 2 * word index (+ 1 for a run) of their first places, group (-1: one), further places, words (16-bit hashes)."""

    heavy = HEAVY

    def use(texts: pa.Array, others: pa.Table, look: Levels) -> pa.Table:
        keys = others.column("key").to_numpy()
        rows: list[tuple] = []
        done = set()
        for start, stop, buf, offsets in W.chunks(texts):
            hashes, row, _, _ = W.words(buf, offsets)
            found, of, at = seeds(hashes, row, stop - start)
            level = look.level(found)
            cut = np.searchsorted(of, np.arange(stop - start + 1))
            ends = np.searchsorted(row, np.arange(stop - start + 1))
            short = (hashes >> np.uint64(32)).astype("<u4")
            for i in np.flatnonzero(np.add.reduceat(np.append(level > 0, False), cut[:-1]) * (np.diff(cut) > 0) >= 2):
                key = int(keys[start + i])
                if key in done:  # a repeated row
                    continue
                done.add(key)
                mine = slice(cut[i], cut[i + 1])
                hit = level[mine] > 0
                words = short[ends[i] : ends[i + 1]]
                some, some_at, some_level = found[mine][hit], at[mine][hit], level[mine][hit]
                runs, starts = picked_runs(words, open_starts(len(words), at[mine][~hit], size), size, RUN_WINDOW)
                # A run is no more frequent than the first seed that is sure to lie inside it.
                inside = np.minimum(np.searchsorted(some_at, starts + WINDOW - 1), len(some_at) - 1)
                run_level = np.where(some_at[inside] <= starts + size - K, some_level[inside], 0) if len(starts) else some_level[:0]
                every, places = np.concatenate([some, runs]), np.concatenate([2 * some_at, 2 * starts + 1])
                salt = np.concatenate([salts(key, some_level, heavy), salts(key, run_level, heavy)])
                first, more = first_places(every, places)
                rows.append((
                    key,
                    others.column("doc_id")[int(start + i)].as_py(),
                    every[first].view(np.int64),
                    places[first].astype(np.int32),
                    salt[first].astype(np.int32),
                    more,
                    (words >> 16).astype("<u2").tobytes(),
                ))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "doc_id", "seeds", "at", "salt", "more", "words"])

    return with_levels(docs, _distinct_seeds, use, FOUND)


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def get(self, end: int) -> tuple[float, int]:
        """The greatest value at positions below end."""
        out = (-np.inf, -1)
        while end:
            out = max(out, self.best[end])
            end -= end & -end
        return out


def segments(hits: np.ndarray, k: int = K) -> np.ndarray:
    """hits (word, owner's word) -> runs (a, a_end, b, b_end) of hits on one diagonal without gaps of over WINDOW words."""
    hits = hits[np.lexsort((hits[:, 0], hits[:, 0] - hits[:, 1]))]
    diagonal = hits[:, 0] - hits[:, 1]
    new = np.ones(len(hits), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (hits[1:, 0] - hits[:-1, 0] > k + WINDOW)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(hits) - 1]])
    return np.stack([hits[first, 0], hits[last, 0] + k, hits[first, 1], hits[last, 1] + k], axis=1)


def chains(runs: np.ndarray) -> list[list[int]]:
    """Collinear chains of runs, best first, each run in one chain at most.

    A run scores its words; a link from j to i costs GAP_COST for each word between them in either text.
    Sweeping over starts in the document, runs that have ended there lie in a Fenwick tree over their ends
    in the owner, so the best predecessor is a prefix maximum.
    """
    order = np.argsort(runs[:, 0], kind="stable")
    ends = np.argsort(runs[:, 1], kind="stable")
    places = np.unique(runs[:, 3])
    rank = np.searchsorted(places, runs[:, 3])
    tree = Fenwick(len(places))
    score, before, done = np.zeros(len(runs)), np.full(len(runs), -1), 0
    for i in order:
        while done < len(ends) and runs[ends[done], 1] <= runs[i, 0]:
            j = ends[done]
            tree.put(int(rank[j]), (score[j] + GAP_COST * (runs[j, 1] + runs[j, 3]), int(j)))
            done += 1
        own = float(runs[i, 1] - runs[i, 0])
        reach, j = tree.get(int(np.searchsorted(places, runs[i, 2], "right")))
        gain = reach - GAP_COST * (runs[i, 0] + runs[i, 2])
        if j >= 0 and gain > 0:
            score[i], before[i] = own + gain, j
        else:
            score[i] = own
    used = np.zeros(len(runs), bool)
    out = []
    for i in np.argsort(-score, kind="stable"):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(int(i))
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _extend(a: np.ndarray, b: np.ndarray) -> int:
    """How many words to take from the fronts of a and b until the score has dropped too far."""
    n = min(len(a), len(b))
    if not n:
        return 0
    run = np.cumsum(np.where(a[:n] == b[:n], EQUAL, UNEQUAL))
    best = np.maximum.accumulate(np.maximum(run, 0))
    stop = np.flatnonzero(best - run > DROP)
    run = run[: stop[0]] if len(stop) else run
    return int(run.argmax()) + 1 if len(run) and run.max() > 0 else 0


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def _inner(runs: np.ndarray, chain: list[int], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chain: equal words in each run, equal words in each gap behind a run, and the unequal words of that gap."""
    own = np.array([np.count_nonzero(a[x:x1] == b[y:y1]) for x, x1, y, y1 in runs[chain]], np.int64)
    gaps = [(runs[i, 1], runs[j, 0], runs[i, 3], runs[j, 2]) for i, j in zip(chain, chain[1:])]
    between = np.array([_common(a[x:x1], b[y:y1]) for x, x1, y, y1 in gaps], np.int64)
    lost = np.array([max(x1 - x, y1 - y) for x, x1, y, y1 in gaps], np.int64) - between
    return own, between, lost


def _ends(first: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end, owner's start, owner's end, equal words outside) of what lies from a first run to a last one, extended."""
    left = _extend(a[: first[0]][::-1], b[: first[2]][::-1])
    right = _extend(a[last[1] :], b[last[3] :])
    a0, b0, a1, b1 = first[0] - left, first[2] - left, last[1] + right, last[3] + right
    equal = int((a[a0 : first[0]] == b[b0 : first[2]]).sum()) + int((a[last[1] : a1] == b[last[3] : b1]).sum())
    return int(a0), int(a1), int(b0), int(b1), equal


def _dense(same: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int]]:
    """Disjoint stretches of at least min_words words of which identity are equal, longest first in each remaining part."""
    out, todo = [], [(0, len(same))]
    while todo:
        low, high = todo.pop()
        if high - low < min_words:
            continue
        sums = np.concatenate([[0.0], np.cumsum(same[low:high] - identity)]) + 1e-9 * np.arange(high - low + 1)
        # The farthest end whose sum is not below that of a start: ends by their greatest sum from there on.
        best = np.maximum.accumulate(sums[::-1])[::-1]
        end = np.searchsorted(-best, -sums, "right") - 1
        at = int((end - np.arange(len(end))).argmax())
        if end[at] - at < min_words:
            continue
        out.append((low + at, low + int(end[at])))
        todo += [(low, low + at), (low + int(end[at]), high)]
    return out


def passages(hits: np.ndarray, a: np.ndarray, b: np.ndarray, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> list[tuple[int, int, int, int, float]]:
    """(start, end, owner's start, owner's end, identity) of the passages that words a share with the owner's words b.

    Chains come best first; one whose words all lie in passages found before adds none. In text that repeats
    itself every seed is a chain of its own, and all of them extend to the same words. A chain of too few
    equal words is split at the gap with the most unequal ones and its parts are tried, down to single runs;
    of a single run, which has one diagonal, the stretches with enough equal words are taken.
    """
    runs = segments(hits)
    out = []
    # Of a passage around a single run at least so many words within AROUND of it are equal: its extensions never fall by more than DROP.
    least = (2 * min_words - 2 * DROP) // 3
    held = np.zeros(len(a), bool)

    def take(a0: int, a1: int, b0: int, b1: int, equal: int) -> bool:
        longest = max(a1 - a0, b1 - b0)
        if min(a1 - a0, b1 - b0) < min_words or equal < identity * longest:
            return False
        out.append((a0, a1, b0, b1, equal / longest))
        held[a0:a1] = True
        return True

    for chain in chains(runs):
        if held[runs[chain[0], 0] : runs[chain[-1], 1]].all():
            continue
        if len(chain) == 1:
            x, x1, y, _ = runs[chain[0]].tolist()
            back, ahead = min(x, y, AROUND), x1 + AROUND
            if np.count_nonzero(a[x - back : ahead][: len(b) - y + back] == b[y - back : y + ahead - x][: len(a) - x + back]) < least:
                continue
        own, between, lost = _inner(runs, chain, a, b)
        todo = [(0, len(chain))]
        while todo:
            low, high = todo.pop()
            first, last = runs[chain[low]], runs[chain[high - 1]]
            if held[first[0] : last[1]].all():
                continue
            a0, a1, b0, b1, outside = _ends(first, last, a, b)
            if take(a0, a1, b0, b1, outside + int(own[low:high].sum() + between[low : high - 1].sum())):
                continue
            if high - low > 1:
                cut = low + 1 + int(lost[low : high - 1].argmax())
                todo += [(cut, high), (low, cut)]
            else:
                same = a[a0:a1] == b[b0:b1]
                for x, x1 in _dense(same, min_words, identity):
                    take(a0 + x, a0 + x1, b0 + x, b0 + x1, int(same[x:x1].sum()))
    return out


SPANS = "key long, doc_id long, start_word int, end_word int, src_doc_id long, src_start int, src_end int, identity double"


def matched(found: DataFrame) -> DataFrame:
    """FOUND -> key, src, hit (word index << 32 | owner's word index << 1 | a whole run) for each hash that an earlier document has too."""
    more = F.coalesce("more", F.array_repeat(F.lit(None).cast("array<int>"), F.size("seeds")))
    posts = found.select("key", "doc_id", F.explode(F.arrays_zip("seeds", "at", "salt", more.alias("more"))).alias("s"))
    group = F.when(F.col("s.salt") >= 0, F.xxhash64("s.seeds", "s.salt")).otherwise(F.col("s.seeds"))
    posts = posts.select(group.alias("g"), "doc_id", "key", F.col("s.at").alias("at"), F.col("s.more").alias("more"), F.when(F.col("s.salt") >= 0, F.col("s.seeds")).alias("seed"))
    first = F.first(F.struct("key", "at"))
    hit = lambda at: F.shiftleft(F.shiftright(at, 1).cast("long"), 32).bitwiseOR(F.col("own.at").cast("long"))
    hits = F.when(F.col("more").isNull(), F.array(hit(F.col("at")))).otherwise(F.transform(F.concat(F.array("at"), "more"), hit))

    def with_owners(rows: DataFrame, by: str) -> DataFrame:
        window = Window.partitionBy(by).orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("own", first.over(window)).filter("key <> own.key").select("key", F.col("own.key").alias("src"), F.explode(hits).alias("hit"))

    # The least holders of a salted seed's groups: one row a group.
    heads = posts.filter("seed is not null").groupBy("g", "seed").agg(F.min(F.struct("doc_id", "key", "at", "more")).alias("h")).select("seed", "h.*")
    return with_owners(posts.drop("seed"), "g").union(with_owners(heads, "seed"))


def promising(pairs: DataFrame) -> DataFrame:
    """pairs (key, src, hits, a0, b0) with a whole run, or two hits near each other on nearly one diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            flat, cut = hits.flatten().to_numpy(), np.concatenate([[0], np.cumsum(hits.value_lengths().to_numpy())])
            pair = np.repeat(np.arange(len(batch)), np.diff(cut))
            a, b = flat >> 32, (flat & 0xFFFFFFFF) >> 1
            good = np.zeros(len(batch), bool)
            good[pair[flat & 1 == 1]] = True
            for lag in (1, 2, 3):  # hits are in order
                near = (pair[lag:] == pair[:-lag]) & (a[lag:] - a[:-lag] <= NEAR) & (np.abs((a[lag:] - a[:-lag]) - (b[lag:] - b[:-lag])) <= NEAR // 4)
                good[pair[lag:][near]] = True
            yield batch.filter(pa.array(good))

    return pairs.mapInArrow(tidy(run), pairs.schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """docs (key, doc_id, text) -> SPANS: each passage of a document that an earlier document has too."""
    found = save(shared_seeds(stored(docs).select("text", "key", "doc_id"), min_words), "seeds")
    forget_shuffles(docs.sparkSession)
    pairs = matched(found).groupBy("key", "src").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    at, src_at = (lambda h: F.shiftright(h, 32)), (lambda h: F.shiftright(h.bitwiseAND(F.lit(0xFFFFFFFF)), 1))
    size = lambda h: F.when(h.bitwiseAND(F.lit(1)) == 1, min_words).otherwise(K)
    low = lambda of: F.greatest(F.lit(0), F.array_min(F.transform("hits", of)) - AROUND).cast("int")
    wide = lambda of: (F.array_max(F.transform("hits", lambda h: of(h) + size(h))) + AROUND).cast("int")
    pairs = promising(pairs.filter((F.size("hits") >= 2) | (F.col("hits")[0].bitwiseAND(F.lit(1)) == 1)))
    pairs = pairs.select("key", "src", "hits", low(at).alias("a0"), wide(at).alias("a1"), low(src_at).alias("b0"), wide(src_at).alias("b1"))
    # Repeated rows are one document; both joins read the same exchange.
    texts = found.groupBy("key").agg(F.first(F.struct("doc_id", "words")).alias("t"))
    kept = ["key", "src", "hits", "a0", "a1", "b0"]
    words = lambda low, high: F.substring(F.col("t.t.words"), 2 * F.col(low) + 1, 2 * (F.col(high) - F.col(low)))
    pairs = pairs.alias("p").join(texts.alias("t"), F.col("p.src") == F.col("t.key")).select(*(f"p.{c}" for c in kept), F.col("t.t.doc_id").alias("src_doc_id"), words("b0", "b1").alias("b"))
    pairs = pairs.alias("p").join(texts.alias("t"), F.col("p.key") == F.col("t.key")).select("p.key", "t.t.doc_id", "a0", "b0", "src_doc_id", "hits", words("a0", "a1").alias("a"), "b")
    steps = np.unique([*range(0, min_words - K, K + WINDOW - 1), max(0, min_words - K)])[:, None]  # a whole run's hits of K words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, doc_id, a_low, b_low, src, hits, a, b in zip(*batch.columns, strict=True):
                a0, b0 = a_low.as_py(), b_low.as_py()
                flat = hits.values.to_numpy()
                both = np.stack([(flat >> 32) - a0, ((flat & 0xFFFFFFFF) >> 1) - b0], axis=1)
                whole = flat & 1 == 1
                if whole.any():
                    both = np.unique(np.concatenate([both[~whole], (both[whole][:, None, :] + steps).reshape(-1, 2)]), axis=0)
                for x0, x1, y0, y1, same in passages(both, np.frombuffer(a.as_py(), "<u2"), np.frombuffer(b.as_py(), "<u2"), min_words, identity):
                    out.append((key.as_py(), doc_id.as_py(), x0 + a0, x1 + a0, src.as_py(), y0 + b0, y1 + b0, same))
            yield batch_of(SPANS, out)

    # A row holds two stretches of words, up to whole texts.
    spans = save(pairs.mapInArrow(tidy(run), SPANS), "spans", 256)
    discard(found)
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text of docs; the key tells documents apart."""
    return docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def cut_passages(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of all but their owners; texts of which no word is left go, others stay as they are."""
    key, cut_key, cut = free(docs, "key"), free(docs, "cut_key"), free(docs, "cut")
    spans = repeated_passages(keyed(docs)).groupBy(F.col("key").alias(cut_key)).agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias(cut))
    rows = docs.withColumn(key, row_key(docs)).join(spans, F.col(key) == F.col(cut_key), "left").select(*(docs[f"`{c}`"] for c in docs.columns), cut)
    names = list(docs.columns)
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(place), batch.column(len(batch.columns) - 1)
            some = np.flatnonzero(~cuts.is_null().to_numpy(zero_copy_only=False))
            if not len(some):
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names)
                continue
            raw = texts.cast(pa.binary())
            out, keep = raw.to_pylist(), np.ones(len(batch), bool)
            for i in some:
                if out[i] is not None:
                    out[i] = without(out[i], [(c["start_word"], c["end_word"]) for c in cuts[int(i)].as_py()])
                    keep[i] = bool(out[i].split())
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(out, pa.binary()).view(pa.string()).cast(batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    out = rows.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text's bytes without the words of the spans (starts ascending) and the space after them."""
    text = np.frombuffer(raw, np.uint8)
    _, _, first, _ = W.words(text, np.array([0, len(text)]))
    first = np.append(first, len(text))
    out, at = [], 0
    for start, end in spans:
        end = min(end, len(first) - 1)
        if first[start] > at:
            out.append(raw[at : first[start]])
        at = max(at, int(first[end]))
    out.append(raw[at:])
    return b"".join(out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(keyed(read(spark, sf_dir, "documents"))).drop("key")
