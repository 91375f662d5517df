"""Periodic run detection (operator 11): maximal runs of repeating words by branching tandem repeats of suffix trees.

A run is a stretch of consecutive words with smallest period q, at least 2 q (and `least`) words long, that no neighbouring
word extends. The method is Stoye and Gusfield's: a branching tandem repeat is two equal neighbouring stretches whose
next words differ, so both start below one inner node of the suffix tree, as deep as the stretch is long, in different
children. Going through all leaves of a node but those of its largest child finds them all (each word is met at most
log2(n) times). A branching repeat is the last rotation of a run's repeats; rotating it to the left as far as words agree
gives the run, and repeats that give one stretch are merged, the smallest period counting.

The trees of all texts of about a MB are built at once, as suffix array, lengths of common prefixes and intervals, from
ranks of stretches of 1, 2, 4, ... words. Ranks of different texts never equal, so no repeat spans texts; they are exact,
and the same ranks give the lengths by which repeats rotate. Words are compared by 64-bit hashes.

Every text is work of its own: nothing is shuffled. A null text has no words; without words there is no run and the
collapsed text is empty. A very long text is a piece of work of its own, with memory in proportion to it (times the
logarithm of its longest repeat). Repeated rows give repeated results, null keys stay null, an empty table gives an empty
result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import clean, read, tidy

#: Leaves that are looked at together.
LEAVES = 1 << 20
ROUNDS = 24


def _ranks(hashes: np.ndarray, row: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks): ranks[k][i] is equal for equal stretches of 2**k words of one text; a last -1 stands behind all words."""
    n = len(hashes)
    _, ids = np.unique(hashes, return_inverse=True)
    key = row.astype(np.int64) * (int(ids.max()) + 1) + ids
    sa = np.argsort(key, kind="stable")
    place = np.arange(n)
    opens = np.ones(n, bool)
    opens[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.full(n + 1, -1, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(opens, place, 0))
    levels, step = [rank], 1
    closes = np.append(opens[1:], True)
    slots = np.flatnonzero(~(opens & closes))  # of suffixes that share their rank with others
    while len(slots):
        own = sa[slots]
        first = rank[own].astype(np.int64)
        after = own + step
        second = np.where(after < ends[own], rank[np.minimum(after, n)], -1).astype(np.int64) + 1
        order = np.argsort(first * (n + 1) + second, kind="stable")
        own, first, second = own[order], first[order], second[order]
        sa[slots] = own
        opens = np.ones(len(own), bool)
        opens[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(opens, slots, 0))
        levels.append(rank)
        closes = np.append(opens[1:], True)
        slots = slots[~(opens & closes)]
        step *= 2
    return sa, levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes a and b (of one text each pair) have in common at their starts."""
    n, out = len(levels[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        left, right = np.minimum(a + out, n), np.minimum(b + out, n)
        out += np.where((levels[k][left] == levels[k][right]) & (left < n) & (right < n), 1 << k, 0)
    return out


def _rotated(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How far to the left of at the words agree with those a period later, within the text that starts at low."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        back = at - (1 << k)
        safe = np.maximum(back, 0)
        at = np.where((back >= low) & (levels[k][safe] == levels[k][safe + period]), back, at)
    return at


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place with a value above 0 the last one before it with a smaller value; values[0] is 0."""
    out = np.arange(-1, len(values) - 1)
    live = np.flatnonzero(values)
    for _ in range(ROUNDS):
        live = live[values[out[live]] >= values[live]]
        if not len(live):
            return out
        out[live] = out[out[live]]
    told, known = out.tolist(), values.tolist()  # long chains, from left to right: each link is passed once
    for i in live.tolist():
        j = told[i]
        while known[j] >= known[i]:
            j = told[j]
        told[i] = j
    return np.array(told)


def _inner_nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the inner nodes: first and last slot, depth; of their children but the largest of each: node, first slot, end."""
    n = len(lcp)
    before = _smaller_before(lcp)
    turned = _smaller_before(np.concatenate([[0], lcp[:0:-1], [0]]))
    # turned[m] belongs to slot n - m; its answer is the next smaller slot, also counted from the end.
    inner = np.flatnonzero(lcp)
    low = before[inner]
    high = n - turned[n - inner]
    order = np.lexsort((inner, high, low))
    inner, low, high = inner[order], low[order], high[order]
    opens = np.ones(len(inner), bool)
    opens[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    node = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    n_low, n_high, depth = low[first], high[first] - 1, lcp[inner[first]]
    # Children start at the node's first slot and at every inner slot of the node's own depth.
    who = np.concatenate([np.arange(len(first)), node])
    start = np.concatenate([n_low, inner])
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    end = np.append(start[1:], 0)
    last = np.append(who[1:] != who[:-1], True)
    end[last] = n_high[who[last]] + 1
    order = np.lexsort((end - start, who))
    largest = np.append(who[order][1:] != who[order][:-1], True)
    rest = order[~largest]
    return n_low, n_high, depth, who[rest], start[rest], end[rest]


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Stretches of about LEAVES in all."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + LEAVES, "right")))
        yield slice(start, stop)
        start = stop


def _branching(word: np.ndarray, sa: np.ndarray, rank: np.ndarray, lcp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, period) of branching tandem repeats, by the smaller-half traversal."""
    low, high, depth, who, first, end = _inner_nodes(lcp)
    firsts, periods = [], []
    sizes = end - first
    for part in _slices(sizes):
        own = sizes[part]
        node = np.repeat(who[part], own)
        slot = np.repeat(first[part] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        leaf, d = sa[slot], depth[node]
        for square, other in ((leaf, leaf + d), (leaf - d, leaf - d)):  # the leaf opens the repeat, or its second half does
            ok = (other < ends[leaf]) & (other >= starts[leaf])
            at = rank[np.where(ok, other, leaf)]
            ok &= (at >= low[node]) & (at <= high[node])
            square, step, stop = square[ok], d[ok], ends[leaf[ok]]
            after = square + 2 * step
            ok = (after >= stop) | (word[np.minimum(square + step, len(word) - 1)] != word[np.minimum(after, len(word) - 1)])
            firsts.append(square[ok])
            periods.append(step[ok])
    return (np.concatenate(firsts), np.concatenate(periods)) if firsts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def maximal_runs(hashes: np.ndarray, row: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs, in order; words are hashes, row says (in ascending order) whose each is."""
    none = np.zeros(0, np.int64)
    if len(hashes) < least:
        return none, none, none
    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n_words = np.diff(np.append(edge, len(row)))
    starts, ends = np.repeat(edge, n_words), np.repeat(edge + n_words, n_words)
    sa, levels = _ranks(hashes, row, ends)
    same = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    if not len(same):
        return none, none, none
    lcp = np.zeros(len(sa), np.int64)
    lcp[same] = _common(levels, sa[same - 1], sa[same])
    at, period = _branching(levels[0], sa, levels[-1], lcp, starts, ends)
    low = _rotated(levels, at, period, starts[at])
    stop = at + 2 * period
    long = stop - low >= least
    low, stop, period = low[long], stop[long], period[long]
    order = np.lexsort((period, stop, low))
    low, stop, period = low[order], stop[order], period[order]
    opens = np.ones(len(low), bool)
    opens[1:] = (low[1:] != low[:-1]) | (stop[1:] != stop[:-1])
    low, stop, period = low[opens], stop[opens], period[opens]
    order = np.lexsort((period, low))
    return low[order], (stop - low)[order], period[order]


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), least: int = 12) -> DataFrame:
    """keys, n_words long, runs (start, length, period; by start, then period), collapsed: the words no run repeats, joined by one space."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, sizes, parts, kept = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [], []
        for start, stop, buf, offsets in W.chunks(batch.column(0)):
            hashes, row, first, end = W.words(buf, offsets)
            low, length, period = maximal_runs(hashes, row, least)
            count = np.bincount(row, minlength=stop - start)
            n_words[start:stop] = count
            opens = np.cumsum(count) - count
            whose = row[low]
            sizes[start:stop] = np.bincount(whose, minlength=stop - start)
            parts.append((low - opens[whose], length, period))
            again = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(again, low + period, 1)
            np.add.at(again, low + length, -1)
            stays = np.cumsum(again[:-1]) == 0
            texts, raw = [], buf.tobytes()
            for r in range(stop - start):
                text = raw[offsets[r] : offsets[r + 1]].split()  # splits at the same six bytes
                if sizes[start + r]:
                    own = stays[opens[r] : opens[r] + count[r]]
                    text = [text[i] for i in np.flatnonzero(own).tolist()]
                texts.append(b" ".join(text))
            kept.append(pa.array(texts, pa.binary()).cast(pa.string()))
        columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in range(3)]
        found = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found)
        collapsed = pa.concat_arrays(kept) if kept else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n_words), runs, collapsed], names=[*keys, "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield of(batch)

    own = docs.select(clean(docs["text"]).alias("text"), *(docs[k] for k in keys))
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return own.mapInArrow(tidy(run), f"{kinds}, n_words long, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> Column:
    """The contract's text: of one document in ten, by the checksum of doc_id, the words from some word on repeat."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " "))

    # The words are bound to a lambda's variable: an expression would be computed anew for every word.
    found = F.regexp_extract_all(clean(docs["text"]), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    repeated = F.get(F.transform(F.array(found), again), 0)
    return F.when(h % 10 == 0, repeated).otherwise(docs["text"])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_repeats(docs).alias("text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("top", top)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.l").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.l") / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )
