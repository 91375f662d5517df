"""Periodic runs, sharding and phrase collocations against brute force, and on odd tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.llm import collocations as C
from veinstone.llm import runs as R
from veinstone.llm import shards as S

SCHEMA = "doc_id long, text string, lang string, source string, size int, file string, part string, row string, n_words long, runs string, shard string, f long, a long"


def rows_of(texts):
    return [(i, t, ["en", "fr", None, "x\ny"][i % 4], "s", 1, "f", "p", "r", 1, "u", "h", 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats, extra columns that clash."""
    r = random.Random(2)
    words = lambda n, v: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a " * 30, "a b " * 20 + "c", "x y z " * 9 + words(40, 3), words(200, 2), words(20_000, 500), "é 日本 x\x00y\x1c. ,é\n日本 x\x00y\x1c " * 15]
    texts += [words(r.randint(0, 80), r.choice([1, 2, 3, 40])) for _ in range(60)] + ["The Cat, the cat the cat; THE CAT\tthe cat."] * 12
    rows = rows_of(texts)
    rows += [rows[6], (None, "a b " * 12, *[None] * 11), (None,) * 13]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def runs_of(words, least=12):
    """All maximal runs by comparing all words with those q later, for every q."""
    ids = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words])
    seen = {}
    for q in range(1, len(words) // 2 + 1):
        same = np.diff(np.concatenate([[0], (a[:-q] == a[q:]).astype(int), [0]]))
        for start, end in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist(), strict=True):
            if end + q - start >= 2 * q:
                seen.setdefault((start, end + q), q)
    return sorted((s, e - s, q) for (s, e), q in seen.items() if e - s >= least)


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_by_brute_force(spark, odd):
    """Every run of every text but the longest, whose runs are those of its doubled short words."""
    got = R.periodic_runs(odd.select("doc_id", "text", F.col("source").alias("s")), keys=("doc_id", "s")).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) > 70
    for r in got:
        words = (r.text or "").encode().split()
        if len(words) > 2000:
            continue
        want = runs_of(words)
        assert [(x.start, x.length, x.period) for x in r.runs] == want and r.collapsed.encode() == kept(words, want) and r.n_words == len(words)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_small_alphabets(least):
    r = random.Random(least)
    for _ in range(150):
        docs = [[r.randrange(v) for _ in range(r.randint(0, 90))] for v in r.choices([1, 2, 3, 9], k=4)]
        hashes, row = np.array([w for d in docs for w in d], np.uint64), np.array([i for i, d in enumerate(docs) for _ in d], np.int64)
        low, length, period = R.maximal_runs(hashes, row, least)
        opens = np.cumsum([0] + [len(d) for d in docs])
        for i, d in enumerate(docs):
            own = row[low] == i if len(low) else np.zeros(0, bool)
            assert list(zip((low[own] - opens[i]).tolist(), length[own].tolist(), period[own].tolist(), strict=True)) == runs_of(d, least)


def test_runs_of_long_regular_texts(monkeypatch):
    """A word 50,000 times; Fibonacci words, whose runs nest; both with few leaves at a time and long chains left to the last step."""
    for leaves, rounds in ((R.LEAVES, R.ROUNDS), (97, 1)):
        monkeypatch.setattr(R, "LEAVES", leaves)
        monkeypatch.setattr(R, "ROUNDS", rounds)
        n = 50_000 if leaves > 97 else 700
        assert [x.tolist() for x in R.maximal_runs(np.zeros(n, np.uint64), np.zeros(n, np.int64))] == [[0], [n], [1]]
        a, b = [0], [0, 1]
        while len(b) < 600:
            a, b = b, b + a
        got = [x.tolist() for x in R.maximal_runs(np.array(b, np.uint64), np.zeros(len(b), np.int64))]
        assert list(zip(*got, strict=True)) == runs_of(b)


def test_op11_by_its_contract(spark, tmp_path):
    r = random.Random(8)
    docs = [(i, None if i == 5 else " ".join(f"v{r.randrange(30)}" for _ in range(r.randint(0, 120)))) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in R.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in docs:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        want = runs_of(words)
        planted += bool(want)
        x = got[i]
        assert x.n_runs == len(want) and x.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in want).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(kept(words, want)).hexdigest()
        top = max(want, key=lambda y: (y[1], -y[0], -y[2])) if want else (None,) * 3
        assert (x.start, x.length, x.period, x.exponent_milli) == (*top, 1000 * top[1] // top[2] if want else None)
    assert planted > 5 and len(got) == 200


def test_runs_of_an_empty_table(spark, odd):
    assert R.periodic_runs(odd.limit(0)).count() == 0


def shards_of(sizes, n):
    out, before, total = [], 0, sum(sizes)
    for s in sizes:
        out.append(min(n - 1, (2 * before + s) * n // (2 * total)))
        before += s
    return out


@pytest.mark.parametrize(("block", "n"), [(4, 24), (1 << 16, 24), (8, 1), (8, 1000)])
def test_shards(spark, odd, tmp_path, monkeypatch, block, n):
    """Stored order, cut at equal targets by the middle byte; slots without gaps; the same again; written shards hold the same rows."""
    monkeypatch.setattr(S, "BLOCK", block)
    odd.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    sized = docs.select("doc_id", "text", F.col("shard").alias("file"), F.lit("p").alias("part"), F.lit("r").alias("row"), S.text_bytes(docs["text"]).alias("size"))
    got = [tuple(r) for r in S.sharded(sized, n).select("doc_id", "size", "shard", "slot").collect()]
    # Rows in the order of files and rows in them.
    order = docs.select("doc_id", "text", docs.metadataColumn("_metadata")["file_path"].alias("p"), docs.metadataColumn("_metadata")["row_index"].alias("i")).orderBy("p", "i").collect()
    sizes = [len((r.text or "").encode()) + 8 for r in order]
    slots, want = collections.Counter(), []
    for r, size, shard in zip(order, sizes, shards_of(sizes, n), strict=True):
        want.append((r.doc_id, size, shard, slots[shard]))
        slots[shard] += 1
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted(map(tuple, S.sharded(sized, n).select("doc_id", "size", "shard", "slot").collect()), key=key) == sorted(got, key=key)
    S.write_shards(docs.withColumnRenamed("shard", "old"), str(tmp_path / "out"), n)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.doc_id, r.text, r.shard) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text, s) for r, s in zip(order, shards_of(sizes, n), strict=True)), key=str)


def test_shards_of_other_tables(spark, odd):
    """No rows; rows without bytes; a filtered scan and a table that is no scan."""
    none = odd.limit(0).select("doc_id", F.lit(1).cast("long").alias("size"))
    assert S.sharded(none).count() == 0
    zero = S.sharded(spark.range(5).select("id", F.lit(0).cast("long").alias("size")), 3).collect()
    assert {r.shard for r in zero} == {0} and sorted(r.slot for r in zero) == list(range(5))
    even = S.sharded(spark.range(240).select("id", F.lit(10).cast("long").alias("size")), 24).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert {(r.n, r.m) for r in even} == {(10, 9)} and len(even) == 24


def test_hot_sizes_do_not_overflow(spark):
    wide = S.sharded(spark.range(50).select("id", F.lit(1 << 55).alias("size")), 24).groupBy("shard").count().collect()
    assert len(wide) == 24 and {r["count"] for r in wide} <= {2, 3}


def collocations_of(docs, longest=3, least=10, inside=50, first=2000):
    import re

    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).decode()
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, le, ri = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), le, ri))
        out += [(lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(rows)[:first])]
    return sorted(out)


@pytest.mark.parametrize("more", [{}, {"longest": 4, "least": 3, "first": 20}, {"longest": 2, "least": 300}])
def test_collocations(spark, odd, more):
    docs = odd.union(odd.where("doc_id < 60"))
    want = collocations_of([(r.text, r.lang) for r in docs.select("text", "lang").collect()], **more)
    got = sorted(tuple(r) for r in C.collocations(docs, **more).collect())
    assert got == want and (want or more.get("least") == 300)


def test_collocations_over_blocks(spark, monkeypatch):
    """Counts that only blocks together reach, phrases at the threshold, a frequent phrase; pieces and texts end phrases."""
    monkeypatch.setattr(C, "BLOCK", 300)
    texts = [f"rare pair{i}, rare pair{i}" for i in range(40)] * 5 + ["never the, same piece"] * 30 + ["just nine"] * 9 + ["just ten"] * 10 + ["über straße. Über Straße"] * 6
    docs = spark.createDataFrame([(t, ["de", None][i % 2]) for i, t in enumerate(texts)], "text string, lang string").repartition(4)
    want = collocations_of([(r.text, r.lang) for r in docs.collect()])
    assert sorted(tuple(r) for r in C.collocations(docs).collect()) == want
    assert not any(w[2] == "the same" for w in want) and any(w[2] == "never the" for w in want)


def test_collocations_of_an_empty_table(spark, odd):
    assert C.collocations(odd.limit(0)).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_scores_are_exact(spark):
    """Products beyond 64 bits, and quotients just below a whole number."""
    rows = [(10**12 + 7, 10**13 + 9, 10**12 + 8), (3, 3, 3), (10**14 - 1, 10**14, 10**14), (999_999, 10**6, 10**6)]
    frame = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in frame.collect())
