"""N-gram Jaccard join (operator 4): an exact grouped prefix join on sets of word shingles.

1. Documents with the same shingle set become one node.
2. Shards tell in how many texts each shingle occurs (shared.py). A node in which fewer than the threshold's share
   of shingles occur in other documents can have no partner and leaves. The rest keep a prefix under one global order,
   rarest shingles first.
3. Nodes with identical prefix and size form a group; its most central member stands for it. Groups are
   filtered against the most central group of each of their prefix tokens and size bands, expanded and
   verified: a number of pairs in proportion to the prefixes, however large a group of near copies is.
4. Whatever pairs share a prefix token and are not yet connected are then verified without exception:
   row by row where a token has at most SHORT nodes, else in packed blocks that never become rows. Both ways verify
   the same pairs.

Null or wordless texts have an empty set: no links, n_shingles 0, their own component. Very long texts count whole;
bytes that are no valid UTF-8 are words like any others. Repeated rows are equal sets and link. Rows with a null
doc_id take part; a component's id is its least non-null doc_id. Rows that share a doc_id are told apart by their
texts. Other columns are ignored. An empty table gives no rows. Sets are compared by 64-bit hashes of shingles. docs is
read twice: a table that is no plain scan is written first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import discard, forget_shuffles, free, read, save, small, stored, tidy
from .components import components
from .shared import Levels, empty, with_levels

#: A token with more nodes than this is resolved in blocks of this many nodes instead of by rows.
SHORT, BLOCK = 64, 256


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for start, stop, buf, offsets in W.chunks(texts):
        hashes, row, _, _ = W.words(buf, offsets, lower=True)
        hashes, row, _ = W.shingles(hashes, row, k, stop - start)
        yield start, stop, *W.distinct(hashes, row)


PRINTS = "key long, doc_id long, n long, node long, cent long, prefix array<long>, items binary"


def fingerprints(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs (text, key, doc_id) -> PRINTS; cent, prefix (shared tokens only) and items are null for nodes that can have no partners."""

    def use(texts: pa.Array, others: pa.Table, look: Levels) -> pa.Table:
        out = []
        for start, stop, hashes, row in _sets(texts, k):
            rows = stop - start
            n = np.bincount(row, minlength=rows)
            cuts = np.concatenate([[0], np.cumsum(n)])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix64(hashes + np.uint64(1)))])
            node = W.mix64(sums[cuts[1:]] - sums[cuts[:-1]] + n.astype(np.uint64))
            level = look.level(hashes)
            shared = level > 0
            live = (n > 0) & (den * np.bincount(row, weights=shared, minlength=rows) >= num * n)
            weight = np.bincount(row, weights=level, minlength=rows)
            cent: list = [None] * rows
            prefix: list = [None] * rows
            items: list = [None] * rows
            for i in np.flatnonzero(live):
                at = slice(cuts[i], cuts[i + 1])
                h, s = hashes[at], shared[at]
                size = int(n[i] - -(-num * int(n[i]) // den) + 1)
                first = np.lexsort((h, level[at], s))[:size]
                cent[i] = int(1000 * weight[i] / n[i])
                prefix[i] = h[first][s[first]].view(np.int64)
                items[i] = h.tobytes()
            mine = others.slice(start, rows)
            out.append(pa.table([
                mine.column("key"),
                mine.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(node.view(np.int64)),
                pa.array(cent, pa.int64()),
                pa.array(prefix, pa.list_(pa.int64())),
                pa.array(items, pa.binary()),
            ], names=["key", "doc_id", "n", "node", "cent", "prefix", "items"]))
        return pa.concat_tables(out)

    return with_levels(docs, lambda texts: (h for _, _, h, _ in _sets(texts, k)), use, PRINTS)


def _linked(a: bytes, b: bytes, num: int, den: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link."""
    left = nodes.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep = [_linked(p.as_py(), q.as_py(), num, den) for p, q in zip(x, y, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(tidy(run), "a long, b long")


def _close(n: str, m: str, num: int, den: int) -> F.Column:
    """Sizes that allow a link."""
    return (F.col(n) * den >= F.col(m) * num) & (F.col(m) * den >= F.col(n) * num)


def _open_pairs(nodes: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame | None:
    """Links among nodes that share a prefix token and are not connected yet; None if there are none to try."""
    named = nodes.join(labels, "node", "left").select("node", "n", "prefix", F.coalesce("label", "node").alias("label"))
    posts = named.select("node", "n", "label", F.explode("prefix").alias("token"))
    tokens = posts.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token", "many")
    posts = save(posts.join(tokens, "token"), "open")
    if empty(posts):
        return None
    few = posts.filter(F.col("many") <= SHORT)
    other = few.select("token", *(F.col(c).alias(f"{c}_2") for c in ("node", "n", "label")))
    pairs = few.join(other, "token").filter((F.col("node") < F.col("node_2")) & (F.col("label") != F.col("label_2")) & _close("n", "n_2", num, den))
    found = _verify(pairs.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct(), nodes, num, den)
    many = posts.filter(F.col("many") > SHORT)
    if empty(many):
        return found
    # A crowded token's nodes outside its largest component (rest) meet that component's nodes and each other.
    sizes = many.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m")).select("token", F.col("m.label").alias("main"))
    roles = many.join(main, "token").groupBy("main", "node", "label", "n").agg(F.max(F.col("label") != F.col("main")).alias("rest"))
    crowd = roles.groupBy("main").agg(F.count(F.lit(1)).alias("crowd"), F.count_if("rest").alias("others")).filter("others > 0")
    roles = roles.join(crowd, "main").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("crowd") / BLOCK)))
    packs = roles.join(nodes.select("node", "items"), "node").groupBy("main", "rest", "block").agg(F.collect_list(F.struct("node", "label", "items")).alias("pack"))
    packs = save(packs, "packs")
    left = packs.filter("rest").select("main", F.col("block").alias("block_a"), F.col("pack").alias("p"))
    right = packs.select("main", "rest", F.col("block").alias("block_b"), F.col("pack").alias("q"))
    meets = left.join(right, "main").filter(~F.col("rest") | (F.col("block_a") <= F.col("block_b"))).select("p", "q")
    return found.union(meets.mapInPandas(tidy(_meet(num, den)), "a long, b long"))


def _meet(num: int, den: int):
    """Verify every pair of two packs that is not in one component, by counting one node at a time against a pack.

    Links that join nothing new within the packs are left out, so two packs give fewer rows than they hold nodes.
    """

    def root(parent: dict[int, int], x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, q in zip(frame["p"], frame["q"], strict=True):
                ids = np.array([r["node"] for r in q], np.int64)
                label = np.array([r["label"] for r in q], np.int64)
                sets = [np.frombuffer(r["items"], np.uint64) for r in q]
                size = np.array([len(s) for s in sets])
                cuts = np.cumsum(size) - size
                values, where = np.unique(np.concatenate(sets), return_inverse=True)
                a, b = [], []
                parent: dict[int, int] = {}
                for r in p:
                    x = np.frombuffer(r["items"], np.uint64)
                    at = np.searchsorted(values, x)
                    at[at == len(values)] = 0
                    flag = np.zeros(len(values), np.int32)
                    flag[at[values[at] == x]] = 1
                    both = np.add.reduceat(flag[where], cuts)
                    hit = np.flatnonzero((den * both >= num * (len(x) + size - both)) & (label != r["label"]))
                    for i in hit[np.unique(label[hit], return_index=True)[1]]:
                        mine, other = root(parent, r["label"]), root(parent, int(label[i]))
                        if mine != other:
                            parent[other] = mine
                            a.append(r["node"])
                            b.append(int(ids[i]))
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def row_key(docs: DataFrame):
    """Tells rows apart by doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def labelled(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """key, doc_id, n, label for every row of docs: rows with shingles link, directly or not, if their labels are equal."""
    base = stored(docs.select("doc_id", "text"))
    base = base.select(F.col("text").cast("string").alias("text"), row_key(base).alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    prints = save(fingerprints(base, k, num, den), "prints")
    forget_shuffles(docs.sparkSession)
    live = prints.filter("prefix is not null")
    owner = live.groupBy("node").agg(F.min(F.struct("doc_id", "n", "cent", "prefix", "items")).alias("s")).select("node", "s.n", "s.cent", "s.prefix", "s.items")
    band = F.floor(F.log("n") / math.log(den / num)) if num < den else F.col("n")
    nodes = save(owner.withColumn("band", band.cast("long")).withColumn("grp", F.xxhash64("n", "prefix")), "nodes")

    heads = nodes.groupBy("grp").agg(F.max(F.struct("cent", "node")).alias("h")).select("grp", F.col("h.node").alias("head"))
    inside = nodes.join(heads, "grp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    posts = nodes.join(heads.select(F.col("head").alias("node")), "node", "left_semi").select("node", "n", "cent", "band", F.explode("prefix").alias("token"))
    pivots = posts.groupBy("token", "band").agg(F.max(F.struct("cent", "node", "n")).alias("p")).select("token", F.col("band").alias("near"), F.col("p.node").alias("b"), F.col("p.n").alias("m"))
    tries = (
        posts.select("token", "n", F.col("node").alias("a"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("near"))
        .join(pivots, ["token", "near"])
        .filter((F.col("a") != F.col("b")) & _close("n", "m", num, den))
        .select("a", "b")
    )
    links = save(_verify(tries.union(inside).distinct(), nodes, num, den), "links")
    labels = components(links)
    more = _open_pairs(nodes, labels, num, den)
    if more is not None:
        more = save(more, "links")
        if not empty(more):
            discard(labels)
            labels = components(links.union(more))
        discard(more)
    discard(nodes)
    discard(links)
    return prints.select("key", "doc_id", "n", "node").join(labels, "node", "left").select("key", "doc_id", "n", F.coalesce("label", "node").alias("label"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (columns doc_id and text; others are ignored).

    Two rows link when den * |intersection| >= num * |union| of their sets of distinct k-word shingles.
    """
    rows = labelled(docs, k, num, den)
    # Written, so that the join has an exchange of its own on either side and Spark can split a large component's rows.
    ids = save(rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least")), "ids")
    return rows.join(ids, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (a null one last), of several texts of it the one with the least hash.

    Rows without words are linked with nothing, but of rows that repeat doc_id and text one stays, the least by its other columns.
    """
    rows = labelled(docs, k, num, den)
    component = F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("key"))
    own = rows.groupBy(component.alias("label"), (F.col("n") > 0).alias("words"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "key").agg(F.count(F.lit(1)).alias("many"))
    chosen = own.groupBy("label", "words").agg(F.min(F.struct("nameless", "doc_id", "key", "many")).alias("c"))
    name = free(docs, "chosen")
    chosen = save(chosen.select(F.col("c.key").alias(name), F.col("c.many").alias("many")), "chosen")
    once, repeated = (small(chosen.filter(f"many {op} 1").select(name)) for op in ("=", ">"))
    alone = docs.join(once, row_key(docs) == F.col(name), "left_semi")
    again = docs.join(repeated, row_key(docs) == F.col(name), "left_semi").withColumn(name, row_key(docs))
    least = again.groupBy(name).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(free(docs, "row")))
    return alone.union(least.select(f"{free(docs, 'row')}.*"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


#: Links from an inverted list of all shingles, components by repeated least labels.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, least(len(ws), 1)))) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(min(r.b) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id GROUP BY 1, 2
"""
