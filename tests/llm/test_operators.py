"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import collections
import hashlib
import itertools
import os
import re
import time

import numpy as np
import pandas as pd
import pytest

from veinstone.llm import chaining
from veinstone.llm import chat_format as C
from veinstone.llm import kneser_ney as K
from veinstone.llm import jaccard_join as J
from veinstone.llm import language_id as L
from veinstone.llm import pieces as P
from veinstone.llm import stable_ann as S
from veinstone.llm import url_filter as U
from veinstone.llm import words as W
from veinstone.llm.chaining import chains, cut_passages, keyed, open_starts, passages, repeated_passages, run_hashes, without
from veinstone.llm.jaccard_join import _linked, _meet, jaccard_components, keep_one
from veinstone.llm.maxscore import top_k
from veinstone.llm.mixing import mix, mixed
from veinstone.llm.stable_ann import chi_square, neighbours

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, key string, label int"
rng = np.random.default_rng(5)
VOCABULARY = ["w%d" % i for i in range(3000)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


def edit(text, n):
    w = text.split()
    for i in rng.choice(len(w), n, replace=False):
        w[i] = "edited%d" % rng.integers(1e9)
    return " ".join(w)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats, clashing extra columns, a large near-copy group."""
    base = prose(200)
    texts = [None, "", "  \t\n", "one", "one two three", "ONE two THREE", base, base, *(edit(base, int(rng.integers(1, 8))) for _ in range(150)), prose(30_000), "é 日本 \u2581 x\x00y"]
    texts += [prose(120) for _ in range(20)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", None, "b", "\U0001f600", "\uffff"][i % 5], len(t or ""), 1, 2, "k", 3) for i, t in enumerate(texts)]
    rows += [rows[6], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def sets(text, k):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard(spark, odd, k, num):
    rows = odd.select("doc_id", "text").collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd, k, num, 100).collect())
    own = [sets(r.text, k) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if own[i] and own[j]:
            both = len(own[i] & own[j])
            if 100 * both >= num * (len(own[i]) + len(own[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = collections.Counter((r.doc_id, len(own[i]), least.get(find(i)) if own[i] else r.doc_id) for i, r in enumerate(rows))
    assert got == want


@pytest.mark.parametrize("short", [0, 3, 10_000])
def test_both_ways_of_open_pairs(spark, monkeypatch, short):
    """A crowded token resolved row by row or in packs: the same components."""
    monkeypatch.setattr(J, "SHORT", short)
    monkeypatch.setattr(J, "BLOCK", 5)
    bases = [prose(60) for _ in range(4)]
    texts = [edit(b, int(n)) for b in bases for n in rng.integers(1, 14, 25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [sets(t, 5) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(own[i] & own[j])
        if 100 * both >= 80 * (len(own[i]) + len(own[j]) - both):
            label = [label[i] if x == label[j] else x for x in label]
    least = {c: min(i for i, x in enumerate(label) if x == c) for c in label}
    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {i: least[c] for i, c in enumerate(label)}


def test_keep_one_judges_rows(spark):
    """Different texts of one doc_id both stay, also without doc_id; equal rows become one, whatever their other columns."""
    a, b = prose(40), prose(40)
    rows = [(1, a, "x"), (1, b, "y"), (None, a, "z"), (None, prose(40), "n"), (2, b, "w"), (1, a, "x"), (1, a, "a"), (5, "", "e"), (5, "", "e"), (6, None, "e"), (None, None, "e")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, chosen string")).collect()
    assert sorted((str(r.doc_id), r.chosen) for r in kept) == sorted([("1", "a"), ("1", "y"), ("None", "n"), ("5", "e"), ("6", "e"), ("None", "e")])


def test_levels_are_exact(spark):
    """Binary logarithms of the number of texts, over several blocks, shards and partitions; equal blocks and nulls too."""
    import pyarrow as pa

    from veinstone.llm.shared import with_levels

    texts = [" ".join(f"t{j}" for j in range(200) if i % (j + 1) == 0) for i in range(300)] + [None, "", "t0 alone"]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, doc_id long").repartition(5)
    path = os.path.join(spark.conf.get("spark.checkpoint.dir"), "levels-test")
    docs.write.mode("overwrite").parquet(path)

    def hashes(rows):
        for start, stop, buf, offsets in W.chunks(rows):
            found, row, _, _ = W.words(buf, offsets)
            yield W.distinct(found, row)[0]

    def use(rows, others, look):
        words = [w for t in rows.to_pylist() for w in (t or "").split()]
        out = []
        for start, stop, buf, offsets in W.chunks(rows):
            out += look.level(W.words(buf, offsets)[0]).tolist()
        return pa.table([pa.array(words, pa.string()), pa.array(out, pa.int32())], ["word", "level"])

    got = {(r.word, r.level) for r in with_levels(spark.read.parquet(path), hashes, use, "word string, level int").collect()}
    many = collections.Counter(w for t in texts for w in set((t or "").split()))
    assert got == {(w, int(np.log2(n))) for w, n in many.items()}


def test_keep_one(spark, odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 0 in ids and 1 in ids


def test_mixing(spark, odd):
    rows = mix(odd).collect()
    assert len(rows) == odd.count()
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd.collect() if r.doc_id is not None}
    assert all(r.size == words[r.doc_id] for r in rows if r.doc_id is not None)
    for s in target:
        assert abs(taken[s] - target[s]) <= 3
    size = collections.Counter()
    for r in rows:
        size[r.source] += r.size
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(str, mix(odd.repartition(7)).collect())) == sorted(map(str, rows))
    assert mixed(odd).columns == odd.columns


def test_mixed_judges_rows(spark):
    """Rows that share a doc_id, or have none, follow their own source and size; empty ones go."""
    rows = [(1, "a b c", "x", 9), (1, "d e", "y", 9), (None, "f g h", "x", 9), (None, "", "y", 9), (None, None, "z", 9), *((i, prose(20), "xyz"[i % 3], 9) for i in range(10, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    want = collections.Counter()
    for r in mix(docs).collect():
        if r.size:
            want[r.doc_id, r.source, r.size] += int(np.floor(r.taken / r.size + 0.5))
    got = collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed(docs).collect())
    assert got == +want and mixed(docs).columns == docs.columns


def test_passages(spark):
    shared, fuzzy = prose(60), prose(80)
    texts = [prose(50) + " " + shared + " " + prose(40), prose(10) + " " + shared, prose(30) + " " + edit(fuzzy, 4), fuzzy + " " + prose(20), prose(200), prose(20) + " " + " ".join(shared.split()[:20]), None, ""]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {(r.doc_id, r.src_doc_id): (r.start_word, r.end_word) for r in repeated_passages(keyed(docs)).collect()}
    assert set(got) == {(1, 0), (3, 2)} and got[1, 0] == (10, 70)
    cut = {r.doc_id: r for r in cut_passages(docs).collect()}
    assert cut[0].text == texts[0] and cut[4].text == texts[4] and cut[1].text == " ".join(texts[1].split()[:10]) + " " and cut[1].n_chars == len(cut[1].text)
    assert without(b"a b  c\nd", [(1, 2), (1, 3)]) == b"a d"


def test_passages_odd(spark, odd):
    assert cut_passages(odd).columns == odd.columns
    assert {r.doc_id for r in repeated_passages(keyed(odd)).collect()} >= set(range(7, 150))


def test_chains():
    runs = np.array([(0, 10, 0, 10), (12, 20, 13, 21), (15, 25, 100, 110), (30, 40, 30, 40)])
    assert chains(runs)[0] == [0, 1, 3]


def vectors(spark, n=400, d=16):
    rows = [(i, [float(x) for x in rng.standard_normal(d).astype(np.float32)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(60)] + [(5, rows[5][1]), (9001, None), (9002, [1.0, None]), (9003, [float("nan")] * d), (9004, [float("inf")] * d), (9005, [0.0] * d), (None, rows[1][1]), (9006, [1.0, 2.0])]
    return rows, spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, block int")


def best(rows, q, k, score):
    own = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 16]
    target = next(v for i, v in own if i == q)
    return sorted(((-score(target, v), i) for i, v in own if i != q))[:k]


def test_top_k(spark):
    rows, frame = vectors(spark)
    got = collections.defaultdict(list)
    for r in top_k(frame, frame.filter("vec_id % 50 = 0 and vec_id < 9000"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    f = lambda a, b: int(np.floor(256 * np.array(a)) @ np.floor(256 * np.array(b)))
    assert got == {q: best(rows, q, 5, f) for q in range(0, 451, 50)}


def test_neighbours(spark):
    rows, frame = vectors(spark)
    hit = total = 0
    found = collections.defaultdict(list)  # in several shards
    for r in neighbours(frame, frame.filter("vec_id % 20 = 0 and vec_id < 9000"), 20, shard_bytes=8000).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    rows = [(i, v) for i, v in rows if i != 9005]
    for q in range(0, 451, 20):
        want = [i for _, i in best(rows, q, 20, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))]
        hit, total = hit + len(set(want) & set(found[q])), total + len(want)
        assert len(found[q]) == 20
    assert hit >= 0.9 * total
    assert abs(chi_square(7.344, 8) - 0.5) < 1e-3
    exact = collections.defaultdict(list)
    for r in neighbours(frame, frame.filter("vec_id = 40"), 20, confidence=2).orderBy("rank").collect():
        exact[r.query_id].append(r.vec_id)
    assert exact[40] == [i for _, i in best(rows, 40, 20, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))]


@pytest.mark.parametrize("shards", [1, 4])
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_neighbours_by_the_stopping_test(shards):
    """On random unit vectors: a recall of 0.9 at least, and clearly not every vector verified."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, mat = t.column("vec_id").to_numpy(), np.stack(t.column("embedding").to_numpy()).astype(float)
    ask = ids % 20 == 0
    found, verified = [[] for _ in range(ask.sum())], 0
    for i in range(shards):
        mine = np.arange(len(ids)) % shards == i
        parts = S.build(ids[mine], mat[mine])
        order = np.frombuffer(parts["order"], np.int64)
        got, n = S.nearest(ids[ask], mat[ask], parts | {"ids": ids[mine][order].tobytes()}, mat.shape[1], 20)
        verified += n
        for x, (v, score) in zip(found, got, strict=True):
            x += zip(-score, v, strict=True)
    score = mat[ask] @ mat.T
    score[ids[ask][:, None] == ids] = -np.inf
    true = ids[np.argsort(-score, axis=1)[:, :20]]
    hits = sum(len({v for _, v in sorted(x)[:20]} & set(y)) for x, y in zip(found, true, strict=True))
    assert hits >= 0.9 * true.size
    assert verified < (0.85 if shards == 1 else 0.97) * ask.sum() * len(ids)


def test_huge_scores_and_repeated_rows(spark):
    """Scores above 2**53 are exact, beyond a long its bounds; every repeated row but the query's own is a candidate."""
    big = float(1 << 22)
    rows = [(0, [big + 1 / 256, big]), (1, [big, big + 1 / 256]), (2, [big + 1 / 256, big - 1 / 256]), (2, [big + 1 / 256, big - 1 / 256]), (3, [-1e300, 0.5]), (50, [1e300, 2.0]), (50, [1e300, 2.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = frame.filter("vec_id < 3")
    f = lambda v: [int(np.floor(256 * x)) for x in v]
    got = collections.Counter((r.rank, r.vec_id, r.score) for r in top_k(near, near.filter("vec_id = 0"), 5).collect())
    want = collections.Counter()
    for q in {tuple(v) for i, v in rows if i == 0}:
        ranked = sorted((-sum(a * b for a, b in zip(f(q), f(v), strict=True)), i) for i, v in rows if 0 < i < 3)
        want.update((n + 1, i, -s) for n, (s, i) in enumerate(ranked))
    assert got == want and sum(want.values()) == 6
    all_of = [(r.rank, r.vec_id, r.score) for r in top_k(frame, frame.filter("vec_id = 50"), 9).orderBy("rank").collect()]
    assert len(all_of) == 6 and all_of[0][2] == (1 << 63) - 1 and all_of[-1] == (6, 3, -(1 << 63))


def test_one_frequent_vector(spark):
    """A row that is repeated many times reaches one block k times at most, whatever its number."""
    frame = spark.createDataFrame([(7, [1.0, 1.0])] * 5000 + [(i, [0.5, 0.25]) for i in range(20)], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(frame, frame.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(7, 256 * (128 + 64))] * 5


def test_chat():
    texts = ["", "a\\b\\\\", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>><<<s>", "\\<|im_end|>\n<|im_start|>user<|im_sep|>", "<|im_end|", "日本\ud83d" [:2]]
    turns = [(r, t) for t in texts for r in ("user", "assistant", "a<|im_sep|>b", "")]
    formatted, spans = C.render(turns)
    assert C.parse(formatted) == turns
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for t in texts:
        assert not any(c in C.escape(t) for c in C.CONTROL)


def test_layouts():
    want = [("user", "q"), ("assistant", "a")]
    for record in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, {"prompt": "q", "completion": "a"}, {"instruction": "q", "input": "", "output": "a", "meta": {"x": [1]}}, {"question": "q", "answer": "a"}):
        assert C.canonical(record) == want
    assert C.canonical({"instruction": "q", "input": "c", "output": None})[0] == ("user", "q\n\nc")
    assert C.canonical({"x": 1}) == [] and C.canonical({"messages": []}) == []


def test_roles_stay(spark):
    """Roles of the messages layout are as they were; only vendors' layouts say which role a name means."""
    rows = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", "bc"), (1, 2, "a<|im_sep|>", "d"), (-1, 0, "assistant", "own")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.digests(C.format_records(C.from_rows(rows))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"human\na\ngpt\nbc\na<|im_sep|>\nd\n").hexdigest() and got[1].loss_chars == 0
    assert C.canonical({"conversations": [{"from": "gpt", "value": "a"}, {"from": "tool", "value": "b"}]}) == [("assistant", "a"), ("tool", "b")]


def test_chat_odd(spark, tmp_path):
    """A conversation -1 of the table stays apart from the added one; invalid UTF-8 and a long text."""
    rows = spark.sql("select -1L as conv_id, 0L as turn, 'user' as role, 'x' as text union all select 2L, 0L, 'assistant', cast(unhex('61FF') as string) union all select 3L, 0L, 'assistant', repeat('<s>', 200000)")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r.conv_id, r.n_turns, r.loss_chars) for r in C.op2_chat_formatting(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(-1, 1, 0), (-1, 2, 21), (2, 1, 2), (3, 1, 600000)]


def test_chat_table(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None, 0), (1, 0, None, "x", 0), (None, None, "user", "y", 0), (1, 0, None, "x", 0)], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in C.digests(C.format_records(C.from_rows(rows))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"\nx\n\nx\nassistant\n\n").hexdigest() and got[1].loss_chars == 0
    assert got[None].n_turns == 1
    assert C.digests(C.format_records(C.from_rows(rows.limit(0)))).count() == 0


def test_language(spark):
    alphabet = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(list(alphabet[g]), 4)) for _ in range(12)), g) for i in range(300) for g in [["aa", "bb"][i % 2]]]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (None, "abc abc", "bb")]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == g for i, t, g in rows[:300])
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and not got[None].held_out
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    assert L.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_six_hundred_languages(spark):
    """Every language keeps some rows of the fitted sample, and one that is a single row is learned too."""
    rows = [(3 * i + j, chr(0x4E00 + 7 * i) * 3 + chr(0x4E01 + 7 * i) * 2, f"l{i:03}") for i in range(600) for j in range(3)]
    model = L.fit(spark.createDataFrame([(str(k), t, g) for k, t, g in rows], "key string, text string, lang string"))
    assert len(model.langs) == 600 and len(model.weights) == 2
    names, _ = model.predict([t for _, t, _ in rows[::300]])
    assert len(names) == 6


def test_language_odd(spark):
    """Invalid UTF-8, one huge text, repeats of one row, equal texts in two languages, extra columns."""
    rows = [(i, "hello world text" if i % 2 else "bonjour monde texte", "en" if i % 2 else "fr", 1.0) for i in range(60)] + [(1, "hello world text", "en", 1.0)] * 500 + [(99, "hello " * 100_000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").union(spark.sql("select 77L, cast(unhex('68FF656C6C6F') as string), 'en', 0D"))
    got = L.identify(docs).collect()
    assert len(got) == len(rows) + 1 and all(r.lang_pred == "en" for r in got if r.doc_id in (1, 99)) and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    assert sum(r.lang_pred == "fr" for r in got) == 30


def brute_perplexities(texts, trusted, folds, order):
    """Mean negative log-probabilities by the recursion over plain dictionaries, one character at a time."""
    out = []
    levels, cuts = {}, {}
    for fold in (0, 1):
        top = collections.Counter()
        for t in (t for t, ok, f in zip(texts, trusted, folds, strict=True) if ok and f == fold):
            padded = "\0" * (order - 1) + t
            top.update(padded[i : i + order] for i in range(len(t)))
        for n in range(order, 0, -1):
            levels[fold, n] = top
            few = [sum(c == i for c in top.values()) for i in (1, 2, 3, 4)]
            cuts[fold, n] = K.discounts(few)
            top = collections.Counter(g[1:] for g in top)
    contexts = {k: collections.defaultdict(list) for k in levels}
    for k, counts in levels.items():
        for g, c in counts.items():
            contexts[k][g[:-1]].append(c)

    def p(fold, gram):
        if not gram:
            return 1 / (K.PAD + 1)
        k = fold, len(gram)
        row, cut = contexts[k].get(gram[:-1], []), cuts[k]
        if not row:
            return p(fold, gram[1:])
        c = levels[k][gram]
        return (c - cut[min(3, c)]) / sum(row) + sum(cut[min(3, c)] for c in row) / sum(row) * p(fold, gram[1:])

    for t, f in zip(texts, folds, strict=True):
        padded = "\0" * (order - 1) + t
        out.append(-sum(np.log(p(1 - f, padded[i : i + order])) for i in range(len(t))) / len(t) if t else None)
    return out


def test_perplexities_equal_brute_force(spark, monkeypatch):
    """Several scripts, over several blocks and chunks; no n-gram is folded with another."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(K, "BLOCK", 600)
    scripts = ["abcde ", "\u0430\u0431\u0432\u0433 ", "\u65e5\u672c\u8a9e\u4e2d\u6587", "\u05d0\u05d1 \u05d2", "\U0001f600\U0001f601 x"]
    texts = ["".join(rng.choice(list(scripts[i % 5]), int(rng.integers(0, 90)))) for i in range(120)] + ["", "q"]
    rows = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    folds = [r.fold for r in rows.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold")).orderBy("doc_id").collect()]
    trusted = [i % 3 > 0 for i in range(len(texts))]
    labels = spark.createDataFrame([(i, int(ok), 0) for i, ok in enumerate(trusted)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_symbols, r.perplexity) for r in K.classify(rows, labels).collect()}
    for i, want in enumerate(brute_perplexities(texts, trusted, folds, K.ORDER)):
        assert got[i][0] == len(texts[i]) and (got[i][1] is None) == (want is None)
        if want is not None:
            assert abs(np.log(got[i][1]) - want) < 1e-3


def test_grouped():
    hashes = rng.integers(0, 1 << 62, 50, dtype=np.uint64)[rng.integers(0, 50, 4000)] * np.uint64(4)
    found, at, where = K.grouped(hashes)
    assert (found[at] == hashes).all() and (hashes[where] == found).all() and (np.diff(found.astype(float)) > 0).all()
    assert len(K.grouped(hashes[:0])[0]) == 0


def test_quality(spark, odd):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6, 170)] + [(None, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    got = K.classify(odd.union(spark.createDataFrame([(999, "### !!! $$$ %%% " * 20, "en", "a", 0, 0, 0, "", 0)], SCHEMA)), labels).collect()
    keep = {r.doc_id: r.keep for r in got}
    assert len(got) == odd.count() + 1 and not keep[999] and not keep[0] and not keep[1] and sum(keep[i] for i in range(6, 158)) >= 145
    assert K.filter_quality(odd, labels).columns == odd.columns
    none = K.classify(odd, labels.limit(0)).collect()
    assert {r.doc_id: r.keep for r in none}[6] and not {r.doc_id: r.keep for r in none}[1]


def test_quality_judges_rows_and_odd_bytes(spark):
    """Two texts of one doc_id are judged apart; a null doc_id is judged; invalid UTF-8 does no harm."""
    good = [" ".join(rng.choice(VOCABULARY[:300], 150)) for _ in range(200)]
    rows = [(i, t, "en", 5) for i, t in enumerate(good)] + [(3, "\u2603#" * 200, "en", 5), (None, good[0], "en", 5), (None, "\u2603#" * 200, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected int").union(spark.sql("select 900L, cast(unhex('FFFE41C0') as string), 'en', 5"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4, 200)], "doc_id long, quality int, toxic int")
    kept = K.filter_quality(docs, labels).collect()
    assert sum(r.doc_id == 3 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 1 and len(kept) >= 190 and kept[0].rejected == 5


@pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no vocabulary")
def encoded(coder, texts):
    """Each text's ids."""
    import pyarrow as pa

    out = []
    for _, _, buf, offsets in W.chunks(pa.array(texts)):
        ids, ends = coder.encode(buf, offsets)
        out += [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return out


@pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no vocabulary")
def test_pieces(spark, odd):
    import sentencepiece

    proto = open(P.MODEL, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    coder = P.Coder(P.Vocabulary.load(proto, True))
    texts = [r.text for r in odd.collect() if r.text is not None and "\u2581" not in r.text] + ["  a  b ", "def f(x):\n    return x+1", "日本語 😀", "a" * 40]
    texts += ["y" * 5000 + str(i) for i in range(3)]
    for _ in range(2):  # new words, then known ones
        for t, ids in zip(texts, encoded(coder, texts), strict=True):
            assert ids == sp.encode(t)
    assert 0 < len(coder.hashes) and not any(t > P.LONG_WORD for t in np.diff(coder.many))
    rows = P.encode(odd).collect()
    assert len(rows) == odd.count() and all(r.roundtrip for r in rows if r.ids is not None) and any(r.ids is None for r in rows)
    back = {r.doc_id: r.text for r in P.decode(P.encode(odd)).collect()}
    assert all(back[r.doc_id] == r.text for r in odd.collect() if r.doc_id is not None)


@pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no vocabulary")
def test_pieces_of_odd_bytes(spark):
    """Bytes that are no UTF-8 are read as U+FFFD; a mark inside a text and a huge word come back."""
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF6220C3') as string) as text union all select 2L, concat(unhex('E29681'), ' x', unhex('E29681')) union all select 3L, repeat('z', 300000)")
    back = {r.doc_id: r.text for r in P.decode(P.encode(docs)).collect()}
    assert back == {1: "a\ufffdb \ufffd", 2: "\u2581 x\u2581", 3: "z" * 300000}
    assert all(r.roundtrip for r in P.encode(docs).collect())


def test_unigram_viterbi():
    pieces = {s: i for i, s in enumerate(["\u2581", "a", "b", "ab", "ba", "aba", "\u2581a", "\u2581ab"])}
    v = P.Vocabulary(pieces, [-1.0, -2.0, -2.0, -2.5, -2.2, -5.0, -2.1, -9.0], [], list(range(100, 356)), 0, False)
    coder = P.Coder(v)

    def brute(word):
        cuts = ([word[a:b] for a, b in zip((0, *c), (*c, len(word)), strict=True)] for n in range(len(word)) for c in itertools.combinations(range(1, len(word)), n))
        return max(sum(v.scores[pieces[p]] for p in c) for c in cuts if all(p in pieces for p in c))

    for text in ("a", "ab", "aba", "abab", "babaab"):
        ids = encoded(coder, [text])[0]
        assert abs(sum(v.scores[i] for i in ids) - brute("\u2581" + text)) < 1e-9


def test_urls(spark):
    urls = ["http://A.Example.net/en/1?x", "https://net/", "http://x.example.com/de/#f", "http://example.com", "http://b.org/fr/2", "nourl", None, "http://notexample.net/en/1", "x://h?a/b"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    train = spark.createDataFrame([(f"http://good{i}.example.org/p", 0) for i in range(60)] + [(f"http://bad.test/{i}?a=1&b=2&c=3", 1) for i in range(60)], "url string, blocked int")
    got = {r.page_id: r for r in U.judge(frame, U.fit(train)).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("net/", "block") and got[2].rule == "example.com/de/" and got[3].rule is None and got[3].path == ""
    assert got[4].verdict == "allow" and (got[5].host, got[5].path) == ("", "") == (got[6].host, got[6].path) and got[7].rule == "net/" and got[8].host == "h"
    unseen = spark.createDataFrame([(1, "http://bad.test/999?a=1&b=2&c=3"), (2, "http://good99.example.org/p")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(unseen, U.fit(train)).collect()} == {1: "block", 2: "allow"}
    assert {r.verdict for r in U.judge(unseen, U.fit(train.limit(0))).collect()} == {"allow"}


def auc(rows):
    """The share of (blocked, allowed) pairs that the score orders rightly."""
    good, bad = [r.score for r in rows if not r.blocked], [r.score for r in rows if r.blocked]
    return sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(good) * len(bad))


def test_urls_held_out(spark):
    """A task that depends on the url (many parameters and digits, or a bad suffix, with noise): held-out AUC far above chance."""
    rows = []
    for i in range(1200):
        bad = rng.random() < 0.4
        host = f"{'x' * int(rng.integers(1, 8))}{i % 37}.{rng.choice(['spam.biz', 'shop.info'] if bad and rng.random() < 0.5 else ['site.com', 'news.org'])}"
        query = "&".join(f"p{j}={rng.integers(1e6)}" for j in range(int(rng.integers(2, 6) if bad else rng.integers(0, 3))))
        rows.append((i, f"http://{host}/{'a/' * int(rng.integers(1, 4))}{i}?{query}", int(bad if rng.random() > 0.05 else not bad)))
    frame = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    model = U.fit(frame.filter("page_id % 3 <> 1").select("url", "blocked"))
    held = frame.filter("page_id % 3 = 1")
    assert auc(U.judge(held, model, ()).join(held.select("page_id", "blocked"), "page_id").collect()) > 0.85


def test_url_features_equal_brute_force(spark):
    urls = ["http://a-b.example.com/x/y_1?k=1&z=22#f", "https://h/", "nourl", "", "x://h?" + "a=1&" * 2000]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = U.split_url(frame["url"])
    for r in U.features(frame.withColumns({"host": host, "path": path})).collect():
        u, n = r.url, len(r.url)
        want = {"url_len": n, "depth": len([x for x in r.path.split("/") if x]), "dots": r.host.count("."), "digit_ratio": sum(c.isdigit() for c in u) / n if n else 0, "entropy": -sum(u.count(c) / n * np.log2(u.count(c) / n) for c in set(u)), "has_fragment": "#" in u, "https": u.startswith("https:"), "hyphens": u.count("-") + u.count("_"), "host_len": len(r.host), "path_len": len(r.path)}
        assert all(abs(r[k] - v) < 1e-9 for k, v in want.items())


def test_urls_odd(spark):
    """One hot url, numbers too long for a doc_id, empty and very long urls."""
    train = spark.createDataFrame([("http://hot.example/1", 1)] * 3000 + [(f"http://ok.example/{i}", 0) for i in range(300)], "url string, blocked int")
    model = U.fit(train, max_train=100)
    frame = spark.createDataFrame([(1, "http://hot.example/1"), (1, "http://hot.example/1"), (2, "http://" + "a" * 50_000), (3, None)], "page_id long, url string")
    got = U.judge(frame, model).collect()
    assert len(got) == 4 and len({r.score for r in got if r.page_id == 1}) == 1
    pages = spark.createDataFrame([(1, "http://h/en/" + "1" * 40 + "/x"), (2, "http://h/en/12/x")], "page_id long, url string")
    labels = spark.createDataFrame([(12, 0, 0), (111111111111111111, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r.url for r in U.labelled_pages(pages, labels).collect()] == ["http://h/en/12/x"]
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none, model).count() == 0 and U.judge(none, U.fit(train.limit(0))).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (jaccard_components(docs), keep_one(docs), mix(docs), cut_passages(docs), K.classify(docs, labels), K.filter_quality(docs, labels), P.encode(docs)):
        assert frame.count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert top_k(none, none, 5).count() == neighbours(none, none, 5).count() == 0


def test_pipeline(spark, tmp_path, odd):
    import corpus_pipeline

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(6, 170)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {*range(180), None} and all(r.roundtrip for r in out)
    assert 7 not in {r.doc_id for r in out}


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    """No documents give an empty corpus; clashing column names, invalid UTF-8 and rows without doc_id go through."""
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars int, key long, cut string, copy int, chosen int, rejected int"
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for name, docs in (("empty", spark.createDataFrame([], kinds)), ("odd", spark.createDataFrame([(i, prose(60), "en", "s", 0, i, "c", 1, 2, 3) for i in range(40)] + [(None, prose(60), None, None, 0, None, None, None, None, None)] * 2, kinds).union(spark.sql("select 77L, cast(unhex('61FF62') as string), 'en', 's', 0, 1L, 'c', 1, 2, 3")))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert len({r.doc_id for r in rows}) > 30 and all(r.roundtrip for r in rows)


def test_repeating_text_gives_one_passage():
    """Forty copies of one seed extend to the same words: one passage, not one for each."""
    words = np.tile(np.arange(6, dtype="<u4"), 40)
    hits = np.array([(at, 0) for at in range(0, 234, 6)])
    found = passages(hits, words, words)
    assert [f[:2] for f in found] == [(0, 240)]


def test_packs_emit_a_spanning_forest():
    """Two packs of near copies connect as all their pairs would, with fewer links than nodes."""
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 40, 100, replace=False)
    sets = [np.sort(np.append(np.delete(base, i % 100), (1 << 41) + i)) for i in range(60)] + [np.sort(rng.choice(1 << 40, 100, replace=False)) for _ in range(5)]
    nodes = [{"node": i, "label": i, "items": s.astype(np.uint64).tobytes()} for i, s in enumerate(sets)]
    out = next(_meet(80, 100)(iter([pd.DataFrame({"p": [nodes[:30]], "q": [nodes]})])))
    up = list(range(65))
    for a, b in zip(out["a"], out["b"], strict=True):
        assert _linked(nodes[a]["items"], nodes[b]["items"], 80, 100)
        up = [up[a] if x == up[b] else x for x in up]
    assert len(out) == 59 and len({up[i] for i in range(60)}) == 1 and len(set(up)) == 6


def near_passages(gap, second):
    """(hits, a, b): an exact passage of 52 words, gap other words on both sides, then second exact words."""
    rng = np.random.default_rng(gap + second)
    one, two = rng.integers(0, 1 << 32, 52), rng.integers(0, 1 << 32, second)
    a, b = (np.concatenate([rng.integers(0, 1 << 32, 20), one, rng.integers(0, 1 << 32, gap), two, rng.integers(0, 1 << 32, 20)]).astype("<u4") for _ in range(2))
    return np.array([(at, at) for at in [*range(20, 67, 4), *range(72 + gap, 72 + gap + second - 5, 4)]]), a, b


def test_near_passages_are_not_lost():
    """A chain over two near passages has too few equal words; each long enough part is a passage of its own."""
    assert sorted(f[:4] for f in passages(*near_passages(35, 52))) == [(20, 72, 20, 72), (107, 159, 107, 159)]
    assert [f[:4] for f in passages(*near_passages(30, 25))] == [(20, 72, 20, 72)]
    a, b = np.arange(200, dtype="<u4"), np.arange(200, dtype="<u4")
    a[60:120][np.arange(60) % 9 >= 6] = 999  # one diagonal: 60 equal words, then a third changed between seeds
    found = passages(np.array([(at, at) for at in [*range(0, 55, 4), *range(63, 114, 9)]]), a[:120], b[:120])
    assert found and min(f[1] for f in found) >= 60 and all(f[4] >= 0.8 for f in found)


def test_passage_whose_halves_have_earlier_owners(spark):
    """Documents 500 and 900 share 60 words; each third of them also stands in an earlier document."""
    texts, want = {}, set()
    for i in range(12):
        shared = prose(60).split()
        for j in range(3):
            texts[10 * i + j] = " ".join([prose(30), *shared[20 * j : 20 * j + 20], prose(30)])
        texts[500 + i], texts[900 + i] = (" ".join([prose(40), *shared, prose(40)]) for _ in range(2))
        want.add((900 + i, 500 + i, 40, 100, 40, 100))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.src_doc_id, r.start_word, r.end_word, r.src_start, r.src_end) for r in repeated_passages(keyed(docs)).collect()} == want


def exact_runs(texts, least):
    """By brute force over all pairs: (document, word) of all words in runs of at least `least` words that an earlier document has too."""
    out = set()
    for j, y in enumerate(texts):
        for x in texts[:j]:
            length = np.zeros((len(x) + 1, len(y) + 1), int)
            for a in range(len(x) - 1, -1, -1):
                for b in range(len(y) - 1, -1, -1):
                    length[a, b] = length[a + 1, b + 1] + 1 if x[a] == y[b] else 0
            for a, b in zip(*np.where(length >= least), strict=True):
                out |= {(j, b + i) for i in range(length[a, b])}
    return out


def test_passages_against_all_pairs(spark):
    """Every exact passage of 50 words or more is found, also where earlier documents hold overlapping parts of it."""
    whole = [prose(100).split() for _ in range(3)]
    texts = []
    for w in whole:  # parts of 40 words, then the whole twice, an exact copy, and a part again
        for x, y in ((0, 40), (30, 70), (60, 100), (0, 100), (0, 100), (20, 90), (0, 44)):
            texts.append([*prose(int(rng.integers(5, 30))).split(), *w[x:y], *prose(int(rng.integers(5, 30))).split()])
    texts += [texts[3], [*whole[0][:60], "x", *whole[1][40:100]], prose(60).split() * 3]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, i) for r in repeated_passages(keyed(docs)).collect() for i in range(r.start_word, r.end_word)}
    want = exact_runs(texts, chaining.MIN_WORDS + chaining.RUN_WINDOW - 1)
    missed = want - found
    # The first and last five words of a run may lie outside every picked run of 45.
    assert len(want) > 400 and len(missed) <= 0.02 * len(want)
    assert not [d for d, _ in found if d in (0, 1, 2, 7, 8, 9, 14, 15, 16, 23)]


def test_frequent_seeds_are_salted(spark, monkeypatch):
    """Groups of a frequent passage's holders have owners of their own, which meet the least one: all but one document are found."""
    monkeypatch.setattr(chaining, "HEAVY", 2)
    shared = prose(60)
    texts = [f"{prose(8)} {shared} {prose(8)}" for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = repeated_passages(keyed(docs)).collect()
    assert {r.doc_id for r in rows} == set(range(1, 90)) and all(r.src_doc_id < r.doc_id for r in rows)
    assert len({r.src_doc_id for r in rows}) > 4
    cut = {r.doc_id: r.text for r in cut_passages(docs).collect()}
    assert cut[0] == texts[0] and not any(shared in cut[i] for i in range(1, 90))


def test_repeated_rows_are_one_document(spark):
    """Four hundred copies of two rows, and rows without doc_id; a passage inside one document alone is none."""
    shared = prose(70)
    one, two, inner = f"{shared} {prose(20)}", f"{prose(20)} {shared}", prose(60)
    rows = [(1, one)] * 400 + [(2, two)] * 400 + [(None, shared), (3, f"{inner} {prose(5)} {inner}"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.src_doc_id, r.start_word, r.end_word) for r in repeated_passages(keyed(docs)).collect())
    assert got == {(1, None, 0, 70): 1, (2, None, 20, 90): 1}


def test_picked_runs():
    """Any six neighbouring open runs have one that is picked, by content alone."""
    words = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    starts = np.array([*range(20), *range(40, 120), 150])
    hashes, at = chaining.picked_runs(words, starts, 45, 6)
    assert {150} <= set(at) and all(set(range(i, i + 6)) & set(at) for i in [*range(15), *range(40, 115)]) and len(at) < 50
    moved = np.concatenate([words[:3], words])
    assert set(chaining.picked_runs(moved, starts[20:100] + 3, 45, 6)[0]) == set(hashes[(at >= 40) & (at < 120)])


def test_open_runs():
    words = np.arange(100, dtype="<u4")
    assert list(open_starts(44, np.array([], int), 45)) == [] and list(open_starts(46, np.array([], int), 45)) == [0, 1]
    assert 50 not in open_starts(100, np.array([70]), 45) and open_starts(100, np.array([70]), 45).tolist() == [*range(24 + chaining.K + chaining.WINDOW)]
    moved = np.concatenate([np.full(7, 5, "<u4"), words])
    assert (run_hashes(words, np.arange(56), 45) == run_hashes(moved, np.arange(7, 63), 45)).all() and len(set(run_hashes(words, np.arange(56), 45))) == 56


def test_passages_with_a_word_in_seven_changed(spark):
    """Sixty words of which every seventh differs (identity 0.86) share seeds between the changes."""
    texts, want = {}, set()
    for i in range(20):
        shared = prose(60).split()
        other = ["other%d_%d" % (i, j) if j % 7 == i % 7 else w for j, w in enumerate(shared)]
        texts[i], texts[100 + i] = " ".join([prose(30), *shared, prose(30)]), " ".join([prose(30), *other, prose(30)])
        want.add((100 + i, i))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.src_doc_id) for r in repeated_passages(keyed(docs)).collect()} == want


def test_neighbours_meet_leaves_in_blocks():
    """200 queries over 10,000 vectors take no longer than a few products of blocks would, and equal vectors end in order of ids."""
    rng = np.random.default_rng(3)
    mat = rng.standard_normal((10_000, 64))
    mat[5000:9000] = mat[0]
    mat /= np.linalg.norm(mat, axis=1)[:, None]
    ids = np.arange(10_000)[::-1].copy()
    parts = S.build(ids, mat, 40)
    order = np.frombuffer(parts["order"], np.int64)
    assert len(order) == 6000 - 1 + 40
    began = time.process_time()
    got, _ = S.nearest(ids[:200], mat[:200], parts | {"ids": ids[order].tobytes()}, 64, 20)
    # A walk of each query by itself took 4.6 s here.
    assert time.process_time() - began < 3
    equal = np.sort(ids[(mat == mat[0]).all(axis=1)])
    assert got[0][0].tolist() == equal[equal != ids[0]][:20].tolist()
