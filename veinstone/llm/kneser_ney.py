"""Quality classifier (operator 9): an interpolated modified Kneser-Ney model of trusted text.

Symbols are characters (code points), n-grams are runs of ORDER of them with all their suffixes, and nothing
is folded into classes, so the model grows with the text. It never lies in one place:

1. Mappers count the distinct n-grams of trusted text, shards (by hash of the context) sum them. Each level's
   shards give the next lower level its continuation counts, down to single characters.
2. Documents are packed in blocks of about BLOCK bytes. A block asks the shards for its distinct n-grams of
   every level, once each however often they occur, and each shard answers with the discounted share of the
   n-gram and the weight that its context leaves to the lower order, by Chen and Goodman's three discounts.
3. A block and its answers meet; probabilities are put together from the lowest level up and looked up for
   each character.

Both joins are on hashes of n-grams that a mapper or block sends once, so no frequent n-gram, language or source
is a hot key; shards follow the input, and levels with few n-grams are copied, so no group meets all blocks. Text and models are halved by a hash of the text: what one half teaches judges the other, so no
document is judged by a model that has seen it, and trusted and unknown text are measured alike.

A document is kept if its mean negative log-probability lies between two quantiles of its language's trusted
documents. Short texts differ more from the mean: scores are compared as deviations from the language's median,
times a weight that grows with the root of the length and levels off around LONG characters (a smooth
curve, the same for every text). A null language or one with fewer than MIN_TRUSTED trusted documents uses all
languages' median and quantiles.

Trusted are documents whose label says quality 1. Null and empty texts have no perplexity and are rejected; bytes
that are no valid UTF-8 are read as U+FFFD; very long texts count whole. Ties at a quantile are kept. Repeated rows
are judged alike, rows that share a doc_id each by their own text; a null doc_id is judged but never trusted. If a
half has no trusted text, every document with text is kept. Extra columns are ignored. docs is read
twice and must give the same rows both times: a table that is no plain scan is written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .blocks import batch_of, columns, meet, packed, squeeze, unpacked, unsqueeze
from .common import clean, free, lean, read, save, small, stored, tidy

ORDER = 5
LEAST = 0.05
#: Stands before each text; no code point.
PAD = 0x110000
#: Bytes of text in a block, and handled at once; distinct n-grams that a counting mapper holds.
BLOCK, CHUNK, HOLD = 8 << 20, 1 << 18, 1 << 19
#: Bytes of text for which there is one shard of the highest level, and so many groups of every level.
PART = 16 << 20
#: Lower and upper quantiles of trusted documents' deviations; trusted documents a language needs for its own; see above.
LOW, HIGH, MIN_TRUSTED, LONG = 0.001, 0.999, 50, 4000


def squeeze_share(values: np.ndarray) -> bytes:
    """Floats of 24 bits."""
    bits = values.astype(np.float32).view(np.uint32) + np.uint32(128)
    return squeeze(bits & np.uint32(0xFFFFFF00))


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, the place of each hash among them, a position of each distinct one)."""
    found = np.unique(hashes)
    bits = max(8, len(found).bit_length() + 2)
    first = np.searchsorted(found, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    at = first[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
    off = np.flatnonzero(found[at] != hashes) if len(hashes) else at
    while len(off):
        at[off] += 1
        off = off[found[at[off]] != hashes[off]]
    where = np.empty(len(found), np.int64)
    where[at] = np.arange(len(hashes))
    return found, at, where


def _mixed(symbols: np.ndarray) -> np.ndarray:
    return W.mix64(symbols.astype(np.uint64) + np.uint64(1))


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams (n rows of symbols, a column for each n-gram)."""
    out = np.zeros(grams.shape[1], np.uint64)
    for j, symbols in enumerate(grams[::-1]):
        out += _mixed(symbols) * W._ODD[j]
    return W.mix64(out)


def coded(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each character's n-gram, symbols of all texts, each character's place among them, characters before each text)."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    place = np.arange(len(points)) + (order - 1) * (np.repeat(np.arange(len(offsets) - 1), np.diff(at)) + 1)
    symbols = np.full(len(points) + (order - 1) * (len(offsets) - 1), PAD, np.uint32)
    symbols[place] = points
    mixed = _mixed(symbols)
    hashes = np.zeros(len(points), np.uint64)
    for j in range(order):
        hashes += mixed[place - j] * W._ODD[j]
    return W.mix64(hashes), symbols, place, at


def distinct_grams(texts: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk of texts: (first, end, distinct hashes, their n-grams, each character's place among them, characters before each text)."""
    for start, stop, buf, offsets in W.chunks(texts, CHUNK):
        hashes, symbols, place, at = coded(buf, offsets, order)
        found, which, where = grouped(hashes)
        yield start, stop, found, np.stack([symbols[place[where] - j] for j in range(order - 1, -1, -1)]), which, at


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams with the sums of their counts."""
    _, which, where = grouped(gram_hash(grams))
    return grams[:, where], np.bincount(which, weights=counts, minlength=len(where)).astype(np.int64)


def n_parts(parts: int, level: int, order: int) -> int:
    """Shards of a level: lower levels have fewer n-grams; single characters one shard (there are 0x110000 at most)."""
    return max(1, parts >> 2 * (order - level)) if level > 1 else 1


def n_copies(parts: int, level: int, order: int) -> int:
    """Copies of a level's shards: blocks are dealt out to them, so that levels with few n-grams have as many groups as the highest one."""
    return -(-parts // n_parts(parts, level, order))


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The shards of n-grams: all of one context in one."""
    return (gram_hash(grams[:-1]) % np.uint64(parts)).astype(np.int32)


def by_part(grams: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, the positions of its n-grams) of each shard that has some."""
    part = part_of(grams, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


COUNTS = "fold int, part int, size int, grams binary, counts binary"


def _count_rows(fold: int, grams: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    return batch_of(COUNTS, [(fold, p, len(at), squeeze(grams[:, at]), squeeze(counts[at])) for p, at in by_part(grams, parts)])


def count_texts(texts: DataFrame, parts: int, order: int) -> DataFrame:
    """texts (text, fold) -> COUNTS of the highest level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def merged(fold: int) -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([g for g, _ in held[fold]], axis=1), np.concatenate([c for _, c in held[fold]]))

        for batch in batches:
            for fold, mine in held.items():
                some = batch.column(0).filter(pc.equal(batch.column(1), fold))
                for _, _, _, grams, which, _ in distinct_grams(some, order):
                    mine.append((grams, np.bincount(which, minlength=grams.shape[1])))
                    if sum(g.shape[1] for g, _ in mine) > HOLD:
                        mine[:] = [merged(fold)]
                        if mine[0][0].shape[1] > HOLD // 2:
                            yield _count_rows(fold, *mine[0], parts)
                            mine.clear()
        for fold, mine in held.items():
            if mine:
                yield _count_rows(fold, *merged(fold), parts)

    return texts.mapInArrow(tidy(run), COUNTS)


LEVEL = COUNTS + ", n1 long, n2 long, n3 long, n4 long"


def shards(counts: DataFrame, level: int) -> DataFrame:
    """COUNTS -> LEVEL: a row for each fold and shard, with how many n-grams have counts 1 to 4."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lean()
        grams = np.concatenate([unsqueeze(g, n * level, np.uint32).reshape(level, n) for g, n in zip(rows["grams"], rows["size"], strict=True)], axis=1)
        grams, counts = summed(grams, np.concatenate([unsqueeze(c, n, np.int64) for c, n in zip(rows["counts"], rows["size"], strict=True)]))
        few = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        return pd.DataFrame([(int(key[0]), int(key[1]), len(counts), squeeze(grams), squeeze(counts), *few)], columns=columns(LEVEL))

    return counts.groupBy("fold", "part").applyInPandas(run, LEVEL)


def continuations(shard: DataFrame, level: int, parts: int) -> DataFrame:
    """LEVEL of a level -> COUNTS of the next lower one: how many different symbols precede an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                grams = unsqueeze(blob, n * level, np.uint32).reshape(level, n)
                yield _count_rows(fold, *summed(grams[1:], np.ones(n)), parts)

    return shard.select("fold", "size", "grams").mapInArrow(tidy(run), COUNTS)


def discounts(few: tuple[int, int, int, int]) -> np.ndarray:
    """Chen and Goodman's discounts of counts 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4.

    At least LEAST, so that every context leaves something to symbols never seen in it.
    """
    ones, twos, threes, fours = few
    y = ones / (ones + 2 * twos) if ones and twos else 0.5
    cut = [0.0, 1 - 2 * y * twos / ones if ones else 0.5, 2 - 3 * y * threes / twos if twos else 1.0, 3 - 4 * y * fours / threes if threes else 1.5]
    return np.clip(cut, [0, LEAST, LEAST, LEAST], [0, 1, 2, 3])


class Model:
    """The shards' saved tables by level, and the discounts by fold and level."""

    def __init__(self, levels: dict[int, DataFrame], cuts: dict[tuple[int, int], np.ndarray], parts: int, order: int):
        self.levels, self.cuts, self.parts, self.order = levels, cuts, parts, order


def train(texts: DataFrame, order: int = ORDER, parts: int = 8) -> Model | None:
    """texts (text, fold 0 or 1); None unless both folds have text. parts: shards of the highest level."""
    counts = count_texts(texts, n_parts(parts, order, order), order)
    levels, cuts = {}, {}
    for level in range(order, 0, -1):
        shard = levels[level] = save(shards(counts, level), f"level{level}")
        for r in shard.groupBy("fold").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4))).collect():  # two rows
            cuts[r.fold, level] = discounts((r.n1, r.n2, r.n3, r.n4))
        if len([f for f, n in cuts if n == level]) < 2:
            return None
        if level > 1:
            counts = continuations(shard, level, n_parts(parts, level - 1, order))
    return Model(levels, cuts, parts, order)


class Shard:
    """One shard's n-grams of a level: answers with (share of an n-gram, weight left to the lower order)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, cut: np.ndarray):
        self.hashes, _, where = grouped(gram_hash(grams))
        counts = counts[where].astype(np.float64)
        self.contexts, which, _ = grouped(gram_hash(grams[:-1, where]))
        total = np.bincount(which, weights=counts, minlength=len(self.contexts))
        off = cut[np.minimum(counts, 3).astype(np.int8)]
        self.share = (counts - off) / total[which]
        self.weight = np.bincount(which, weights=off, minlength=len(self.contexts)) / total

    def ask(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for hashes, known, values, other in ((gram_hash(grams), self.hashes, self.share, 0.0), (gram_hash(grams[:-1]), self.contexts, self.weight, 1.0)):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            out.append(np.where(known[at] == hashes, values[at], other))
        return out[0], out[1]


def suffixes(grams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the level of grams down to single characters: (distinct n-grams, the place of each one of the level above among them)."""
    out = [(grams, np.arange(grams.shape[1]))]
    while len(grams) > 1:
        _, which, where = grouped(gram_hash(grams[1:]))
        grams = grams[1:, where]
        out.append((grams, which))
    return out


def _block_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(distinct hashes, their n-grams, the chunks' own distinct hashes, places and bounds) of a block."""
    chunks, all_grams = [], []
    for start, stop, found, grams, which, at in distinct_grams(texts, order):
        chunks.append((start, stop, found, which, at))
        all_grams.append((found, grams))
    if not chunks:
        return np.zeros(0, np.uint64), np.zeros((order, 0), np.uint32), []
    found, _, where = grouped(np.concatenate([f for f, _ in all_grams]))
    return found, np.concatenate([g for _, g in all_grams], axis=1)[:, where], chunks


ASKED = "fold int, level int, part int, copy int, block long, size int, grams binary, counts binary"


def requests(parts: int, order: int):
    """BLOCKS -> ASKED (counts null), batch by batch: each block's distinct n-grams by level and shard; the fold is the model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                for grams, _ in suffixes(_block_grams(unpacked(r)[0], order)[1]):
                    level = len(grams)
                    copy = r["block"] % n_copies(parts, level, order)
                    rows += [(1 - r["fold"], level, p, copy, r["block"], len(at), squeeze(grams[:, at]), None) for p, at in by_part(grams, n_parts(parts, level, order))]
                yield batch_of(ASKED, rows)

    return run


ANSWERS = "block long, level int, part int, size int, share binary, weight binary"


def answers(asked: DataFrame, model: Model) -> DataFrame:
    cuts = model.cuts
    known = None
    for level, shard in model.levels.items():
        copies = F.explode(F.sequence(F.lit(0), F.lit(n_copies(model.parts, level, model.order) - 1))).alias("copy")
        rows = shard.select("fold", F.lit(level).alias("level"), "part", copies, F.lit(None).cast("long").alias("block"), "size", "grams", "counts")
        known = rows if known is None else known.union(rows)

    def run(rows: pa.Table) -> pa.Table:
        lean()
        out, shard = [], None
        rows = rows.to_pylist()
        fold, level, part = (rows[0][c] for c in ("fold", "level", "part"))
        for r in rows:
            if r["counts"] is not None:
                shard = Shard(unsqueeze(r["grams"], r["size"] * level, np.uint32).reshape(level, -1), unsqueeze(r["counts"], r["size"], np.int64), cuts[fold, level])
        for r in rows:
            if r["counts"] is None:
                share, weight = np.zeros(r["size"]), np.ones(r["size"])
                if shard is not None:
                    share, weight = shard.ask(unsqueeze(r["grams"], r["size"] * level, np.uint32).reshape(level, -1))
                out.append((r["block"], level, part, r["size"], squeeze_share(share), squeeze_share(weight)))
        return pa.Table.from_batches([batch_of(ANSWERS, out)])

    return asked.union(known).groupBy("fold", "level", "part", "copy").applyInArrow(run, ANSWERS)


SCORED = "key long, doc_id string, lang string, n_symbols long, nll double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, fold, key, doc_id as string, lang) -> SCORED: nll is the mean negative log-probability, null without text."""
    parts, order = model.parts, model.order

    def use(block: dict, told: list[dict]) -> pa.Table:
        texts, others = unpacked(block)
        found, grams, chunks = _block_grams(texts, order)
        given = {(a["level"], a["part"]): a for a in told}
        prob = np.zeros(0)
        levels = suffixes(grams)
        for i in range(len(levels) - 1, -1, -1):
            grams, _ = levels[i]
            level = len(grams)
            share, weight = np.zeros(grams.shape[1]), np.ones(grams.shape[1])
            for p, at in by_part(grams, n_parts(parts, level, order)):
                a = given.get((level, p))
                if a is None or a["size"] != len(at):
                    raise RuntimeError("the documents changed between two reads")
                share[at], weight[at] = (unsqueeze(a[c], a["size"], np.uint32).view(np.float32) for c in ("share", "weight"))
            lower = prob[levels[i + 1][1]] if level > 1 else 1 / (PAD + 1)
            prob = share + weight * lower
        logs = np.log(prob)
        n, nll = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for start, stop, own, which, at in chunks:
            sums = np.concatenate([[0], np.cumsum(logs[np.searchsorted(found, own)][which])])
            n[start:stop] = np.diff(at)
            nll[start:stop] = -(sums[at[1:]] - sums[at[:-1]])
        mean = pa.array(np.divide(nll, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
        return pa.table([others.column("key"), others.column("doc_id"), others.column("lang"), pa.array(n), mean], columns(SCORED))

    told = answers(packed(docs, BLOCK, "fold", (requests(parts, order), ASKED)), model)
    return meet(packed(docs, BLOCK, "fold"), told, use, SCORED).withColumn("doc_id", F.col("doc_id").cast("long"))


def row_key(docs: DataFrame):
    """Tells rows apart by what a judgement depends on."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["text"].cast("string"))


def judged(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """SCORED with deviation and keep, for every row of docs (doc_id, text, lang; others are ignored)."""
    docs = stored(docs.select("doc_id", "text", "lang"))
    trust = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    trust = small(trust)
    text = clean(F.col("text"))
    base = docs.select(text.alias("text"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("fold"), row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    mine = F.col("doc_id") == F.col("trusted_id")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = train(base.join(trust, mine, "left_semi").filter("length(text) > 0").select("text", "fold"), parts=max(8, -(-n_bytes // PART)))
    if model is None:
        out = base.select("key", "doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("nll"), F.lit(None).cast("double").alias("deviation"))
        return out.withColumn("keep", F.col("n_symbols") > 0)
    scored = save(score(base.withColumn("doc_id", F.col("doc_id").cast("string")), model).join(trust, mine, "left").select("key", "doc_id", "lang", "n_symbols", "nll", F.col("trusted_id").isNotNull().alias("trusted")), "scored")
    known = scored.filter("trusted and nll is not null")
    middle = F.percentile_approx("nll", 0.5, 10000)
    own = known.filter("lang is not null").groupBy(F.col("lang").alias("own_lang")).agg(middle.alias("mid"), F.count(F.lit(1)).alias("many")).filter(F.col("many") >= MIN_TRUSTED).drop("many")
    mid_all = known.agg(middle).first()[0]
    weight = 1 / F.sqrt(1 / F.col("n_symbols") + F.lit(1 / LONG))
    scored = scored.join(small(own), F.col("lang") == F.col("own_lang"), "left").withColumn("deviation", F.when(F.col("nll").isNotNull(), (F.col("nll") - F.coalesce("mid", F.lit(mid_all))) * weight))
    known = scored.filter("trusted and nll is not null")
    bounds = F.percentile_approx("deviation", [low, high], 10000)
    cuts = known.filter("own_lang is not null").groupBy(F.col("own_lang").alias("cut_lang")).agg(bounds.alias("bounds"))
    every = known.agg(bounds).first()[0]
    cut = F.coalesce("bounds", F.array(*(F.lit(float(x)) for x in every)))
    keep = F.coalesce((F.col("deviation") >= cut[0]) & (F.col("deviation") <= cut[1]), F.lit(False))
    return scored.join(small(cuts), F.col("own_lang") == F.col("cut_lang"), "left").select("key", "doc_id", "lang", "n_symbols", "nll", "deviation", keep.alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, deviation, keep for every row of docs."""
    return judged(docs, labels, low, high).select("doc_id", "lang", "n_symbols", F.exp("nll").alias("perplexity"), "deviation", "keep")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    name = free(docs, "rejected")
    bad = judged(docs, labels).filter(~F.col("keep")).select(F.col("key").alias(name)).distinct()
    return docs.join(small(bad), row_key(docs) == F.col(name), "left_anti")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
