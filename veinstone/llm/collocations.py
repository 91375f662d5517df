"""Phrase collocation mining (operator 13): exact phrase counts by automata over candidates from a sketch.

Three steps. (1) A sketch: blocks of documents send the cut hashes of all their phrases, with counts, to shards that add
them up (shared.py); hashes that fall together can only raise a sum, so a sum below `least` rules a phrase out, in every
language. (2) The phrases of a block that are left compile into a pyahocorasick automaton, each between delimiters; the block's
text, its words between the same delimiters and its pieces kept apart by another one, is scanned for all overlapping
matches by language. Single words, which are parts of candidates alone, are counted as they are read. (3) The blocks' counts are added up by phrase, with partial sums first, and the exact thresholds
follow as joins of phrases with their parts.

The sketch has as many shards as the text needs and about a thousandth of the phrases in it share a cell, at any input; an
automaton holds phrases of one block only. A frequent phrase is one row a block. A text longer than a block is a block alone.

A word is a run of bytes other than space, tab and [.,;:!?\\x0A-\\x0D], with A-Z lower-cased; the latter end a piece. A null
text is empty, a null language is `und`; doc_id isn't read, so repeated rows count again; an empty table gives an empty
result; other columns are ignored. Ties of a score go by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import clean, read, save, small, stored
from .shared import Levels, with_levels

#: Words of a phrase at most, occurrences of it at least; share (in hundredths) of its occurrences inside a longer one that drops it.
LONGEST, LEAST, INSIDE = 3, 10, 50
FIRST = 2000
#: Bytes of text in a block: the more, the fewer rows a phrase has.
BLOCK = 12 << 20
#: Bytes read alike: capitals are small, and what ends a piece is a line feed, which no word holds.
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_READ[list(b".,;:!?\n\x0b\x0c\r")] = 10
#: Between words, and between pieces.
GAP, STOP = " ", "\n"


def _phrases(texts: pa.Array, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, hash, phrase's words, first byte, end byte) of all phrases of 1 to longest words, by stretches of rows."""
    for start, _, raw, offsets in W.chunks(texts):
        buf = _READ[raw]
        hashes, row, first, end = W.words(buf, offsets)
        piece = np.cumsum(buf == 10)[first] + row if len(first) else row
        out = []
        for k in range(1, longest + 1):
            n = len(hashes) - k + 1
            if n <= 0:
                break
            total = np.full(n, np.uint64(k))
            for j in range(k):
                total += hashes[j : n + j] * W._ODD[j]
            at = np.flatnonzero(piece[:n] == piece[k - 1 :])
            out.append((row[at] + start, W.mix64(total[at]), np.full(len(at), k), first[at], end[at + k - 1]))
        yield (buf, *(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(5)))


def _spaced(text: bytes) -> str:
    """A text as it is scanned: each piece's words between gaps, pieces apart."""
    return STOP.join(GAP + GAP.join(w.decode() for w in piece.split()) + GAP for piece in text.split(b"\n"))


def _matches(automaton: ahocorasick.Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, its overlapping occurrences in texts)."""
    value, which, counts = itemgetter(1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, stop, raw, offsets in W.chunks(texts):
        body = _READ[raw].tobytes()
        met = [np.fromiter(map(value, automaton.iter(_spaced(body[offsets[r] : offsets[r + 1]]))), np.int64) for r in range(stop - start)]
        own, f = np.unique(np.concatenate(met), return_counts=True)
        which.append(own)
        counts.append(f)
    own, place = np.unique(np.concatenate(which), return_inverse=True)
    return own, np.bincount(place, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)


def _table(keys: pa.Array, f: np.ndarray) -> pa.Table:
    return pa.table([keys, pa.array(f.astype(np.int64))], ["key", "f"])


def _keys(phrases: pa.Array, langs: pa.Array | str) -> pa.Array:
    """Phrase and language in one string: no phrase holds STOP."""
    return pc.binary_join_element_wise(phrases, langs, STOP)


#: key: phrase (empty: all words), STOP, language. One narrow column, in order, is half of what four columns would move.
COUNTS = "key string, f long"


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f: exact counts, by language, of all phrases of up to longest words with at least `least` occurrences; words = 0: all words of a language."""

    def hashes_of(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, hashes, *_ in _phrases(texts, longest):
            yield hashes.astype(np.uint64)

    def use(texts: pa.Array, others: pa.Table, look: Levels) -> pa.Table:
        code = others.column("lang").combine_chunks().dictionary_encode()
        names_of, code = code.dictionary.cast(pa.string()), code.indices.to_numpy()
        langs = names_of.to_pylist()
        names, seen, n_words, out = [], np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), []
        for buf, row, hashes, words, first, end in _phrases(texts, longest):
            body = buf.tobytes()
            n_words += np.bincount(row[words == 1], minlength=len(texts))
            own, at, place = np.unique(hashes.astype(np.uint64), return_index=True, return_inverse=True)
            hot = look.level(own) > 0  # in order, so neighbours are looked up together
            # Single words are no candidates, only parts of them: they are counted here.
            alone = np.flatnonzero((words == 1) & hot[place])
            cells, f = np.unique(place[alone] * len(langs) + code[row[alone]], return_counts=True)
            spots = at[cells // len(langs)]
            single = [body[a:b].decode() for a, b in zip(first[spots].tolist(), end[spots].tolist(), strict=True)]
            out.append(_table(_keys(pa.array(single, pa.string()), names_of.take(pa.array(cells % len(langs)))), f))
            hot &= words[at] > 1
            own, at = own[hot], at[hot]
            new = ~np.isin(own, seen, assume_unique=True)
            at = at[new]
            seen = np.concatenate([seen, own[new]])
            names += [" ".join(w.decode() for w in body[a:b].split()) for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)]
        whole = np.bincount(code, weights=n_words, minlength=len(langs)).astype(np.int64)
        out.append(_table(_keys(pa.array([""] * len(langs), pa.string()), names_of), whole))
        if names:
            names.sort()
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, name in enumerate(names):
                automaton.add_word(f"{GAP}{name}{GAP}", i)
            automaton.make_automaton()
            phrases = pa.array(names, pa.string())
            order = np.argsort(code, kind="stable")
            edges, texts = np.searchsorted(code[order], np.arange(len(langs) + 1)), texts.take(pa.array(order))
            for lang, lo, hi in zip(langs, edges, edges[1:], strict=False):
                which, f = _matches(automaton, texts.slice(lo, hi - lo))
                out.append(_table(_keys(phrases.take(pa.array(which)), lang), f))
        return pa.concat_tables(out).combine_chunks()

    own = stored(docs.select(clean(docs["text"]).alias("text"), F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang")))
    counts = with_levels(own, hashes_of, use, COUNTS, lambda sums: sums >= least, BLOCK).groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", STOP, 1)
    lang = F.substr(F.col("key"), F.length(phrase) + 2)
    split = counts.select(lang.alias("lang"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, GAP))).alias("words"), phrase.alias("phrase"), "f")
    return save(split.where((F.col("f") >= least) | (F.col("words") == 0)), "phrases")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), in decimals: exact below 10**15 occurrences."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score; all numbers long.

    a, l, r: occurrences of the phrase and of its two parts at the cut with the lowest score; n: all words of the language.
    """
    counts = phrase_counts(docs, longest, least)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("words > 0").select("lang", "phrase", "f")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(parts, start, size), " ")
    # A cut is its two parts: phrase and place follow from them, so joins move no string twice.
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "a", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    phrase = F.concat_ws(" ", "left", "right").alias("phrase")
    cut = F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), F.size(F.split("left", " ")).alias("k"), "l", "r")
    # By language and phrase alone, as the join with longer phrases needs it.
    lowest = cuts.groupBy("lang", phrase).agg(F.max("a").alias("a"), F.min(cut).alias("cut"))
    # All shorter phrases of two or more words inside a longer candidate, with its count.
    spans = [(i, w, size) for w in range(3, longest + 1) for size in range(2, w) for i in range(1, w - size + 2)]
    if spans:
        within = F.array_compact(F.array(*(F.when(F.col("words") == w, joined(F.lit(i), F.lit(size))) for i, w, size in spans)))
        longer = candidates.where("words > 2").select("lang", F.explode(F.array_distinct(within)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        lowest = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each sixty-fourth of a language's phrases, then the first of those: no task sorts a whole language.
    some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(small(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT doc, lang, unnest(regexp_extract_all(text, '[.,;:!?\x0A-\x0D]|[^.,;:!?\x09-\x0D\x20]+')) AS word, unnest(range(len(regexp_extract_all(text, '[.,;:!?\x0A-\x0D]|[^.,;:!?\x09-\x0D\x20]+')))) AS i FROM d),
s AS (SELECT lang, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, word NOT SIMILAR TO '[.,;:!?\x0A-\x0D]' AS own FROM w WINDOW o AS (PARTITION BY doc ORDER BY i)),
t AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM s WHERE own GROUP BY lang),
g AS (
  SELECT lang, 1 AS words, word AS phrase FROM s WHERE own
  UNION ALL SELECT lang, 2, word || ' ' || w2 FROM s WHERE own AND w2 NOT SIMILAR TO '[.,;:!?\x0A-\x0D]'
  UNION ALL SELECT lang, 3, word || ' ' || w2 || ' ' || w3 FROM s WHERE own AND w2 NOT SIMILAR TO '[.,;:!?\x0A-\x0D]' AND w3 NOT SIMILAR TO '[.,;:!?\x0A-\x0D]'
), f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10)
, p AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1),
q AS (SELECT p.*, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM p, (VALUES (1), (2)) v(k) WHERE k < words),
c AS (
  SELECT q.lang, q.phrase, q.words, q.a, k, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * q.a * q.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM q JOIN f l ON l.lang = q.lang AND l.phrase = lp JOIN f r ON r.lang = q.lang AND r.phrase = rp
), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(ws[j:j + 1], ' ') AS phrase, max(a) AS longer FROM p, (VALUES (1), (2)) v(j) WHERE words = 3 GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, t.n, o.score FROM o JOIN t USING (lang) WHERE o.rank <= 2000
"""
