"""The segmented index against full scans, many queries in one plan, stored results, payload bitmaps, relaxation, metrics."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone import report
from veinstone.operators import payload as PI
from veinstone.operators import relax
from veinstone.operators import retrieval as R
from veinstone.operators import segments as S
from veinstone.operators.filters import apply_filters
from veinstone.operators.metrics import mean_metrics, ranking_metrics
from veinstone.plans.engine import Engine
from veinstone.plans.models import SparseBackend, batch_encoder, instructed
from veinstone.sources import scratch
from veinstone.sources.files import names, publish, read_text
from veinstone.sources.sinks import save_feedback

BRANCHES = ("basic", "art", "pat", "pjt")
WORDS = [f"w{i}" for i in range(40)]


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, [1 / (i + 1) for i in range(40)], k=r.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """300 points of 60 experts; every third has no vector, two have broken payloads."""
    rows = [(i, f"e{i % 60}", BRANCHES[i % 4], t, None if i % 3 == 0 else [1.0, (i % 17) / 17 - 0.5]) for i, t in enumerate(texts(300, 1))]
    rows += [(900, None, "art", "w0 w1", [1.0, 0.0]), (901, "e1", None, "w0 w1", [1.0, 0.0])]
    path = str(tmp_path_factory.mktemp("search"))
    spark.createDataFrame(rows, "point_id long, expert_id string, branch string, content_text string, embedding array<double>").write.parquet(f"{path}/points")
    spark.createDataFrame([(f"e{i}", f"Name {i:02}", "orgB" if i % 6 == 0 else "orgA", "PhD", i % 5) for i in range(60)], "expert_id string, name string, org string, degree string, article_cnt int").write.parquet(f"{path}/people")
    return path


@pytest.fixture(scope="module")
def index(spark, corpus):
    span, S.SPAN = S.SPAN, 4  # many ranges
    out = S.create_segments(S.text_terms(spark.read.parquet(f"{corpus}/points")), f"{corpus}/index")
    S.SPAN = span
    return out


def engine(spark, corpus, **more):
    points, people = (spark.read.parquet(f"{corpus}/{t}") for t in ("points", "people"))
    items = points.select("expert_id", F.lit("paper").alias("type"), F.concat(F.lit("paper:"), "point_id").alias("item_id"), F.col("content_text").alias("title"), F.lit("b").alias("body"), F.lit("2000-01-01").alias("date"))
    more.setdefault("limits", R.Limits(cutoff=0.0))
    return Engine(spark, points, people, items, **more)


def wanted(spark, queries):
    rows = [(q, b, t, 1.0) for q, ts in queries.items() for b in BRANCHES for t in ts]
    return spark.createDataFrame(rows, "query_id int, branch string, term string, weight double")


def best(index, spark, queries, k):
    by = ("query_id", "branch")
    return {(r.query_id, r.branch, r.point_id, round(r.sparse, 5)) for r in R.top(index.scores(wanted(spark, queries), by, k), list(by), "sparse", k).collect()}


def scanned(points, queries, k):
    """BM25 over all points in plain Python."""
    rows = [(r.point_id, r.branch, r.content_text.split()) for r in points.where("expert_id is not null and branch is not null").collect()]
    out = set()
    for b in BRANCHES:
        own = [r for r in rows if r[1] == b]
        mean = sum(len(t) for _, _, t in own) / max(1, len(own))
        for q, terms in queries.items():
            df = {t: sum(t in ts for _, _, ts in own) for t in terms}
            got = []
            for p, _, ts in own:
                s = sum(math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for t in terms)
                if round(s, 6) > 0:
                    got.append((-round(s, 6), p))
            out |= {(q, b, p, round(-s, 5)) for s, p in sorted(got)[:k]}
    return out


QUERIES = {0: ["w0", "w7"], 1: ["w30"], 2: ["w1", "w2", "w39", "w5"], 3: ["nowhere"]}


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_blocks_that_cannot_enter_are_skipped(spark, corpus, index, k):
    assert best(index, spark, QUERIES, k) == scanned(spark.read.parquet(f"{corpus}/points"), QUERIES, k)
    read = index.blocks_read(wanted(spark, QUERIES), ("query_id", "branch"), k).agg(F.sum("blocks"), F.sum("read")).first()
    assert read[1] < 0.8 * read[0] if k == 1 else read[1] <= read[0]
    if k == 1000:
        assert read[0] == read[1]


def test_segments_give_the_rows_of_a_rebuild(spark, corpus, tmp_path):
    points = spark.read.parquet(f"{corpus}/points").where("expert_id is not null and branch is not null")
    changed = points.where("point_id % 5 = 0").withColumn("content_text", F.concat(F.lit("w39 w38 "), "content_text"))
    index = S.create_segments(S.text_terms(points.where("point_id % 2 = 0")), str(tmp_path / "i"), buckets=4)
    first = index.snapshot
    index = index.add(S.text_terms(points.where("point_id % 2 = 1"))).add(S.text_terms(changed))
    index = index.delete(points.where("point_id % 7 = 0").select("point_id").union(spark.range(5000, 5002)))
    index = index.add(S.text_terms(points.where("point_id = 14")))  # deleted, then back
    now = points.where("point_id % 5 > 0").unionByName(changed).where("point_id % 7 > 0 AND point_id <> 14").unionByName(points.where("point_id = 14"))
    want = scanned(now, QUERIES, 10)
    assert best(index, spark, QUERIES, 10) == want and len(index.segments) == 4 and index.snapshot != first
    stale = S.open_segments(spark, str(tmp_path / "i"))
    merged = index.merge()
    assert best(merged, spark, QUERIES, 10) == want and len(merged.segments) == 1 and not merged.dead
    with pytest.raises(RuntimeError, match="another writer"):
        stale.delete(spark.range(1).withColumnRenamed("id", "point_id"))
    assert merged.expire() > 0
    again = S.open_segments(spark, str(tmp_path / "i"))
    assert again.snapshot == merged.snapshot and best(again, spark, QUERIES, 10) == want
    with pytest.raises(FileExistsError):
        S.create_segments(S.text_terms(points), str(tmp_path / "i"))


def test_texts_are_counted_once_for_an_index(spark, corpus, tmp_path):
    """A build, its number of buckets included, reads each text once (before: three times)."""
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    points = spark.read.parquet(f"{corpus}/points").withColumn("content_text", F.udf(count)("content_text"))
    index = S.create_segments(S.text_terms(points), str(tmp_path / "i"))
    assert seen.value == index.points().count() == 300


def shuffled(spark, run):
    """Bytes that the stages of run write for shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}

    last = max(stages(), default=-1)
    run()
    return sum(n for i, n in stages().items() if i > last)


def test_a_merge_shuffles_its_points_once_and_packed(spark, tmp_path, monkeypatch):
    """Neither postings nor, where tombstones are too many to be broadcast, the points' terms are shuffled besides."""
    r = random.Random(5)
    rows = [(i, f"e{i % 60}", BRANCHES[i % 4], " ".join(r.choices([f"word{j}" for j in range(3000)], k=300))) for i in range(1200)]
    points = spark.createDataFrame(rows, "point_id long, expert_id string, branch string, content_text string")
    changed = points.where("point_id % 5 = 0").withColumn("content_text", F.concat(F.lit("word1 word2 "), "content_text"))
    monkeypatch.setattr(S, "FEW", 0)
    index = S.create_segments(S.text_terms(points), str(tmp_path / "i")).add(S.text_terms(changed)).delete(spark.range(0, 1200, 7).withColumnRenamed("id", "point_id"))
    queries, merged = {0: ["word1", "word7"], 1: ["word2"]}, []
    want = best(index, spark, queries, 10)
    sent = shuffled(spark, lambda: merged.append(index.merge()))
    postings = merged[0].points().agg(F.sum(F.size("terms"))).first()[0]
    assert sent < 8 * postings, sent / postings
    assert best(merged[0], spark, queries, 10) == want


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_live_points_of_files_with_many_rows(spark, tmp_path, monkeypatch, few):
    """Dead rows are marked by file and block of 32,768 rows, the first and last of a block included."""
    monkeypatch.setattr(S, "FEW", few)
    points = spark.range(0, 70_000, 1, 1).select(F.col("id").alias("point_id"), F.lit("e").alias("expert_id"), F.lit("art").alias("branch"), F.lit(1).alias("length"), F.expr("array(struct('w' AS term, 1.0D AS weight))").alias("terms"))
    gone = {0, 1, 7, 8, 32_767, 32_768, 65_535, 65_536, 69_999}
    index = S.create_segments(points, str(tmp_path / "i")).add(points.where("point_id IN (5, 32768)"))
    index = index.delete(spark.createDataFrame([(i,) for i in gone], "point_id long")).add(points.where("point_id = 8"))
    rows = [tuple(r) for r in index.live_points().select("seq", "point_id").collect()]
    assert sorted(rows) == sorted([(1, i) for i in range(70_000) if i not in gone | {5, 8}] + [(2, 5), (4, 8)])
    assert index.live_points().columns == index.points().columns


@pytest.mark.parametrize("ids,joins", [([1, 2, None, None], False), ([1, 2, 2], True)])
def test_texts_meet_vectors_only_where_an_id_repeats(spark, tmp_path, ids, joins):
    """Before, an index of texts shuffled them all to meet vectors that it doesn't read."""
    from veinstone import search_queries as Q
    from veinstone.sources.corpus import points

    d = str(tmp_path)
    spark.createDataFrame([(i, f"text {i}", "en", f"src{i}") for i in range(5)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [0.5]) for i in ids], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    own = Q._texts(spark, d)
    assert sorted(own.collect()) == sorted(points(spark, d).drop("embedding").collect())
    assert ("Join" in own._jdf.queryExecution().optimizedPlan().toString()) == joins


def shown(frame):
    return [(r["rank"], r.expert_id, round(r.score, 6), r.stable_hits) for r in frame.orderBy("rank").collect()]


def test_many_queries_equal_single_ones(spark, corpus, index):
    """Each of a hundred queries by itself, or all in one plan: the same rows, and as many jobs as for ten."""
    own = engine(spark, corpus, index=index)
    asked = [(i, t) for i, t in enumerate(texts(98, 7))] + [(98, "expert recommendation"), (99, None)]
    queries = spark.createDataFrame(asked, "query_id int, text string").repartition(1)
    many = own.search_many(queries).select("query_id", "rank", "expert_id", "score", "stable_hits").collect()
    got = {}
    for r in many:
        got.setdefault(r.query_id, []).append((r["rank"], r.expert_id, round(r.score, 6), r.stable_hits))
    for i in (0, 13, 50, 97):
        assert sorted(got.get(i, [])) == shown(own.search(asked[i][1])), i
    assert 98 not in got and 99 not in got and len(got) > 50

    def jobs(n):
        group = f"jobs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        own.search_many(queries.where(F.col("query_id") < n)).write.format("noop").mode("overwrite").save()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert abs(jobs(98) - jobs(10)) <= 4  # adaptive stages differ by a few

    few = own.search_many(queries, filters={"article_cnt_min": 3}, exclude=["orgB"])
    one = own.search(asked[0][1], filters={"article_cnt_min": 3}, exclude=["orgB"])
    assert shown(few.where("query_id = 0")) == shown(one)
    with pytest.raises(ValueError, match="segmented"):
        engine(spark, corpus).search_many(queries)


def test_points_without_vectors_are_found_by_their_words(spark, corpus, index):
    hits = engine(spark, corpus, index=index).search("w0 w1").select(F.explode("matches.point_id").alias("p"))
    assert hits.where("p % 3 = 0").count() > 0 and hits.where("p >= 900").count() == 0


def test_learned_weights(spark, corpus, tmp_path):
    """Scores are products of an encoder's weights; frequencies and weights don't mix."""
    encoder = lambda text: F.map_from_entries(F.transform(F.array_distinct(F.split(text, " ")), lambda w: F.struct(w, F.length(w).cast("double"))))
    points = spark.read.parquet(f"{corpus}/points").where("expert_id is not null and branch is not null")
    index = S.create_segments(S.encoded_terms(points, encoder), str(tmp_path / "l"), kind=S.DOT)
    own = engine(spark, corpus, index=index, sparse=SparseBackend("encoder", "m", False, False, (), encoder))
    found = index.scores(spark.createDataFrame([("art", "w10", 2.0), ("art", "w1", 1.0)], "branch string, term string, weight double"), ("branch",), 5)
    for r in found.join(points, "point_id").collect():
        assert r.sparse == 2.0 * 3 * ("w10" in r.content_text.split()) + 2 * ("w1" in r.content_text.split())
    many = own.search_many(spark.createDataFrame([(1, "w10 w1")], "query_id int, text string"))
    assert shown(many) == shown(own.search("w10 w1")) != []
    with pytest.raises(ValueError, match="encoder"):
        engine(spark, corpus, index=index)


def test_results_belong_to_limits_and_snapshot(spark, corpus, index, tmp_path):
    """The same texts under another cutoff, or over another state of the index, are other results."""
    cache = str(tmp_path / "cache")
    loose = engine(spark, corpus, index=index, cache=cache).search("w0 w1").count()
    strict = engine(spark, corpus, index=index, cache=cache, limits=R.Limits(cutoff=2.0))
    assert loose > 0 and strict.search("w0 w1").count() == 0 and strict.trace["retrieval_cache"] == "miss"
    again = engine(spark, corpus, index=index, cache=cache)
    assert again.search("w0 w1").count() == loose and again.trace["retrieval_cache"] == "hit"
    later = engine(spark, corpus, index=index, cache=cache, reference_year=2010)
    later.search("w0 w1")
    assert later.trace["retrieval_cache"] == "miss"
    with pytest.raises(ValueError, match="snapshot"):
        engine(spark, corpus, cache=cache)


def test_a_response_is_few_jobs_and_tells_its_scores(spark, corpus, index):
    own = engine(spark, corpus, index=index)
    out = own.respond("w0 w1", request_id="few-jobs", top_k=5)
    assert out["status"] == "ok" and len(out["recommendations"]) == 5
    trace = out["trace"]
    assert [t["expert_id"] for t in trace["score_trace"]] == trace["candidate_ids"] and all(t["n_matches"] == t["stable_hits"] + t["expanded_hits"] for t in trace["score_trace"])
    assert all(r["support"]["stable"] >= 1 for r in out["recommendations"])
    assert trace["metrics"]["search"]["rows"] == len(trace["candidate_ids"]) and {s: n for s, n in trace["metrics"]["gates"].items() if s != "rows"} == {s: len(ids) for s, ids in trace["shortlist_gate"].items()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 60


def test_a_failing_task_does_not_end_the_search(spark, corpus, index):
    calls = []

    def vector(text):
        calls.append(text)
        if len(calls) == 1:
            raise RuntimeError("down")
        return spark.range(1).select(F.array(F.lit(1.0), F.lit(0.0)).alias("q"))

    own = engine(spark, corpus, index=index, query_vector=vector)
    found = own.search("w0 w1")
    assert found.count() > 0 and found.where(F.array_contains("branches", "basic")).count() == 0

    def down(text):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="every search task"):
        engine(spark, corpus, index=index, query_vector=down).search("w0 w1")


def test_a_writer_that_dies_does_not_lock_the_store(spark, tmp_path):
    """Before the rename a claim is nothing; after it, its range is taken and the next writer goes on behind it."""
    path = str(tmp_path / "f")
    rows = spark.createDataFrame([("2024-01-01", "q", ["1"], [], "n", {"a": "b"})], "created_at string, query string, selected array<string>, rejected array<string>, notes string, metadata map<string,string>")
    assert save_feedback(spark, path, rows) == 1
    (tmp_path / "f.claims" / ".00000000000000000002-dead").write_text("2")
    assert publish(spark, f"{path}.claims/{2:020d}", "6")  # claimed 2 to 6 and died
    assert save_feedback(spark, path, rows) == 7
    assert not publish(spark, f"{path}.claims/{2:020d}", "9") and read_text(spark, f"{path}.claims/{2:020d}") == "6" and len(names(spark, f"{path}.claims")) == 3
    assert read_text(spark, f"{path}.claims/none") is None and names(spark, f"{path}.nowhere") == []


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Sparkless:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="share"):
        scratch.scratch_dir(Sparkless())


PEOPLE = "expert_id string, org string, degree string, article_cnt int, publications array<struct<index_type:string,date:string>>, patents array<struct<registration_type:string,date:string>>, projects array<struct<end:string>>"


def test_payload_bitmaps_pass_whom_the_filters_pass(spark, tmp_path):
    r = random.Random(3)
    day = lambda: r.choice(["2024", "2024-01-01", "2023-12-31", "2019-05-05", "unknown", "", None])
    rows = [(f"e{i}", r.choice([None, "A", "(주) B", "c"]), r.choice(["PhD", "MSc", None]), r.randint(0, 5), [(r.choice(["SCIE", "KCI", None]), day()) for _ in range(r.randint(0, 3))], r.choice([None, [("F", day())], [("O", day()), ("F", day())]]), [(day(),) for _ in range(r.randint(0, 2))]) for i in range(400)]
    people = spark.createDataFrame(rows, PEOPLE).repartition(3)
    index = PI.build_payload(people, str(tmp_path))
    cases = [
        ({"art_sci_slct_nm": "SCIE", "art_recent_years": 2}, {}), ({"art_recent_years": 2, "pat_recent_years": 2, "pjt_recent_years": 2}, {}), ({"pjt_recent_years": 5, "article_cnt_min": 2}, {}),
        ({"degree_slct_nm": ["PhD", "MSc"], "pat_reg_slct_nm": "F"}, {"exclude": ["b"]}), ({}, {"include": ["A", "B"], "include_any": True}), ({}, {"include": ["A", "B"]}), ({}, {}), ({"article_cnt_min": 9}, {}),
    ]
    for filters, more in cases:
        got = sorted(r.expert_id for r in index.search(filters, as_of=2025, **more).collect())
        assert got == sorted(r.expert_id for r in apply_filters(people, filters, as_of=2025, **more).collect()), (filters, more)
    with pytest.raises(ValueError, match="unknown"):
        index.search({"salary": 1})
    plan = index.search({"article_cnt_min": 5}, as_of=2025)._jdf.queryExecution().executedPlan().toString()
    assert "In(block" in plan and "PartitionFilters" in plan


def test_relaxation_equals_its_levels_one_by_one(spark):
    r = random.Random(5)
    rows = [(i, *(r.choice([True, False, None]) for _ in range(3)), r.random() < 0.8) for i in range(200)]
    people = spark.createDataFrame(rows, "expert_id int, a boolean, b boolean, c boolean, keep boolean")
    ladder = [(n, F.col(n)) for n in "abc"]
    for k in (1, 10, 40, 90, 1000):
        for level in range(4):
            want = {x[0] for x in rows if x[4] and all(x[1 + i] for i in range(level, 3))}
            if len(want) >= k or level == 3:
                break
        got = relax.relaxed(people, ladder, k, F.col("keep")).withColumn("names", relax.names_of(F.col("unmet"), ladder)).collect()
        assert {g.expert_id for g in got} == want and all(g.dropped == list("abc")[:level] and set(g.names) <= set(g.dropped) and g.level <= level for g in got)
    assert relax.relaxed(people.limit(0), ladder, 1).count() == 0


def test_ranking_metrics(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id int, expert_id string, rank int")
    judged = spark.createDataFrame([(1, "b", 3), (1, "c", 1), (1, "d", 2), (1, "a", 0), (2, "y", 1), (3, "q", 0)], "query_id int, expert_id string, gain int")
    got = {r.query_id: r for r in ranking_metrics(results, judged, 2).collect()}
    assert set(got) == {1, 2} and got[1].precision == 0.5 and got[1].recall == 1 / 3 and got[1].mrr == 0.5
    assert abs(got[1].ndcg - (3 / math.log2(3)) / (3 + 2 / math.log2(3))) < 1e-12 and got[2].ndcg == got[2].mrr == 0
    assert mean_metrics(ranking_metrics(results, judged, 2)).first().n == 2


def test_batch_encoder(spark):
    """Batches of two; nulls stay null; the wrong number of dimensions is an error; a model's name tells whether it wants instructions."""

    def model(texts):
        if any(t == "" for t in texts):
            return np.zeros((len(texts), 3))
        return np.array([[len(t), len(texts)] for t in texts], float)

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, "bb", "ccc", "dd", None])], "i int, t string").coalesce(1)
    got = {r.i: r.v for r in frame.select("i", batch_encoder(model, 2, size=2)(F.col("t")).alias("v")).collect()}
    assert got == {0: [1, 2], 1: None, 2: [2, 2], 3: [3, 2], 4: [2, 2], 5: None}
    with pytest.raises(Exception, match="2 dimensions"):
        spark.createDataFrame([("",)], "t string").select(batch_encoder(model, 2)(F.col("t"))).collect()
    assert instructed("multilingual-E5-large-Instruct") and not instructed("bge-m3")


def test_evaluation(spark, corpus, index, tmp_path, capsys):
    """A table of queries by one plan; one that finds nobody has a row too; the command line prints rows and means."""
    own = engine(spark, corpus, index=index)
    queries = spark.createDataFrame([(1, "w0 w1"), (2, "zzz"), (3, "w5")], "query_id int, text string")
    best_of = {i: own.search(t).orderBy("rank").first() for i, t in ((1, "w0 w1"), (3, "w5"))}
    judged = spark.createDataFrame([(1, best_of[1].expert_id, 2), (3, "nobody", 1)], "query_id int, expert_id string, gain int")
    got = {r.query_id: r for r in report.evaluate(own, queries, judged).collect()}
    assert got[1].top_id == best_of[1].expert_id and got[1].retrieved > 0 and got[1].mrr == 1 and got[3].mrr == 0
    assert got[2].retrieved == 0 and got[2].top_id is None and got[2].ndcg is None
    for name, frame in (("points.parquet", own.points), ("people.parquet", own.people), ("items.parquet", own.items), ("queries", queries), ("judged", judged)):
        frame.write.parquet(str(tmp_path / name))
    S.create_segments(S.text_terms(own.points), str(tmp_path / "index"))
    assert report.main([str(tmp_path), "--evaluate", str(tmp_path / "queries"), str(tmp_path / "judged")], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(lines) == 4 and lines[-1]["n"] == 2


def test_a_range_meets_all_queries_at_once():
    """Blocks of a range are scored for every query in one group: the best k of each, points that don't count left out, less than the least left out."""
    import pyarrow as pa

    words = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())]))
    ids, empty = pa.list_(pa.int64()), [None, None, None]
    blocks = pa.table({"term": pa.array([None, "a", "b"]), "ids": pa.array([[1, 2, 3], [1, 2, 3, 9], [2, 9]], ids), "weights": pa.array([[0, 0, 0], [1, 2, 3, 50], [5, 50]], pa.list_(pa.float64())), "experts": pa.array([["x", "y", "z"], *empty[:2]]), "lengths": pa.array([[1, 1, 1], *empty[:2]], pa.list_(pa.int32()))})
    asked = pa.table({"query_id": [7, 8, 9], "least": pa.array([None, None, 2.5], pa.float64()), "words": pa.array([[{"term": "a", "w": 1.0}, {"term": "b", "w": 2.0}], [{"term": "nowhere", "w": 1.0}], [{"term": "a", "w": 1.0}]], words), "mean": [1.0, 1.0, 1.0]})
    out = pa.schema([("query_id", pa.int64()), ("point_id", pa.int64()), ("expert_id", pa.string()), ("score", pa.float64())])
    got = S._add_up(S.DOT, ["query_id"], 2, out)(blocks, asked).to_pylist()
    assert [tuple(r.values()) for r in got] == [(7, 2, "y", 12.0), (7, 3, "z", 3.0), (9, 3, "z", 3.0)]
