"""The engine as a service: filters, tokens, gates, responses, reasons and their retries, stores, readiness."""

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone import report
from veinstone.operators import evidence as E
from veinstone.operators import quality as V
from veinstone.operators import reasons as N
from veinstone.operators import recommend as G
from veinstone.operators import retrieval as R
from veinstone.plans import models as M
from veinstone.plans.engine import Engine
from veinstone.plans.plan import contract_of, fallback_plan, heuristic_plan, single_text
from veinstone.sources import sinks as S
from veinstone.sources.corpus import fixtures


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Sixty experts of one organisation and one of another; everyone writes about drones, one about sensors too."""
    text = lambda i: "drone sensor platform" if i == 60 else f"drone flight number {i}"
    points = spark.createDataFrame([(i, f"e{i}", ["basic", "art", "pat", "pjt"][i % 4], text(i), [1.0, 0.01 * i]) for i in range(61)], "point_id long, expert_id string, branch string, content_text string, embedding array<double>")
    people = spark.createDataFrame([(f"e{i}", f"Name {i:02}", "orgB" if i == 60 else "orgA", "PhD", i % 3) for i in range(61)], "expert_id string, name string, org string, degree string, article_cnt int")
    items = points.select("expert_id", F.lit("paper").alias("type"), F.concat(F.lit("paper:"), "point_id").alias("item_id"), F.col("content_text").alias("title"), F.lit("about drone things").alias("body"), F.lit("2000-01-01").alias("date"))
    path = str(tmp_path_factory.mktemp("corpus"))
    for name, frame in (("points", points), ("people", people), ("items", items)):
        frame.write.parquet(f"{path}/{name}.parquet")
    R.build_index(spark.read.parquet(f"{path}/points.parquet"), f"{path}/index", 4)
    return path


def make(spark, path, **more):
    vector = spark.range(1).select(F.array(F.lit(1.0), F.lit(0.0)).alias("q"))
    tables = [spark.read.parquet(f"{path}/{t}.parquet") for t in ("points", "people", "items")]
    return Engine(spark, *tables, limits=R.Limits(cutoff=0.0), query_vector=lambda text: vector, index=R.open_index(spark, f"{path}/index", 4), **more)


def test_filters_come_before_the_prefetch(spark, corpus):
    """One expert of sixty-one passes; three points a task survive the prefetch, and that one must be among them."""
    engine = make(spark, corpus)
    engine.limits = R.Limits(cutoff=0.0, keyword_prefetch=3, branch_prefetch=3, branch_output=3)
    assert [r.expert_id for r in engine.search("drone", include=["orgB"]).collect()] == ["e60"]
    assert engine.search("drone", filters={"article_cnt_min": 2}).count() > 0
    with pytest.raises(ValueError, match="publications"):
        engine.search("drone", filters={"art_recent_years": 3})


def test_query_tokens_are_the_corpus_tokens(spark, corpus):
    engine = make(spark, corpus)
    assert engine.search("sensor,\ndrone;").count() == engine.search("sensor drone").count() == 61
    scanned = Engine(spark, engine.points, engine.people, engine.items, limits=engine.limits, query_vector=engine.query_vector)
    shown = lambda e: [tuple(r) for r in e.search("drone sensor").select("rank", "expert_id", F.round("score", 6)).orderBy("rank").collect()]
    assert shown(engine) == shown(scanned)


def test_responses_say_why_they_are_empty(spark, corpus):
    engine = make(spark, corpus)
    none = engine.respond("nothingness")
    assert none["status"] == "no_match" and none["not_selected_reasons"] == [G.NO_MATCH] and none["recommendations"] == []
    skipped = engine.respond("recommend expert")
    assert skipped["status"] == "skipped" and skipped["data_gaps"] == [G.SKIPPED]
    engine.items = engine.items.limit(0)
    gated = engine.respond("drone", request_id="r1")
    assert gated["status"] == "gated_empty" and gated["not_selected_reasons"] == [G.GATED_EMPTY] and gated["trace"]["reason_generation_trace"]["mode"] == "gated_empty"
    assert len(gated["trace"]["shortlist_gate"]["drop"]) == 61 and gated["trace"]["log"] == ["r1 WARNING the gates have removed every candidate"]


def test_response(spark, corpus, tmp_path):
    """A generator that forgets a candidate, breaks a rule, is retried with compact payloads; a batch that fails passes through."""
    asked = []

    def client(text):
        told = json.loads(text)
        asked.append(told)
        if any(c["expert_id"] == "e5" for c in told):
            raise RuntimeError("down")
        reasons = [{"expert_id": c["expert_id"], "fit": "높음", "recommendation_reason": f"drone work, see {c['selected_evidence'][0]['evidence_id']}" if c["expert_id"] == "e0" else " drone   work ", "risks": ["r"]} for c in told]
        return "so: " + json.dumps({"items": reasons[1:] if len(asked) == 1 else reasons, "data_gaps": ["gap", " gap"]})

    engine = make(spark, corpus, generator=client, cache=str(tmp_path / "cache"), snapshot="s1")
    out = engine.respond("drone", top_k=15)
    rows, trace = out["recommendations"], out["trace"]
    assert out["status"] == "ok" and len(rows) == 15 and [r["rank"] for r in rows] == list(range(1, 16)) and out["data_gaps"] == ["gap"]
    batches = trace["reason_generation_trace"]["batches"]
    assert len(batches) == 3 and batches[0]["retry_trigger"] == "missing_candidate_ids" and batches[0]["prompt_budget_mode"] == "retry_compact"
    for r in rows:
        own = next(b for b in batches if r["expert_id"] in b["candidate_ids"])
        assert r["fit"] == ("보통" if own["mode"] == "fallback" else "높음") and r["fallback_source"] == ("selected_evidence" if own["mode"] == "fallback" else "reason_sync_validator" if r["expert_id"] == "e0" else None)
    assert {b["mode"] for b in batches} <= {"client", "fallback"} and trace["reason_sync_validator"]["checked"] == 15
    others = next(c for c in asked[0])["do_not_mention"]
    assert sum(n.startswith("Name") for n in others) == 4 and sum(n.startswith("paper:") for n in others) == 15
    assert set(trace["timers"]) >= {"plan_ms", "search_ms", "evidence_selection_ms", "reason_generation_ms", "total_ms"} or "total_ms" in engine.timers
    again = engine.respond("drone", top_k=15)
    assert again["trace"]["planner_trace"]["cache"]["canonical_plan"] == "hit" and again["trace"]["cache"]["retrieval"] == "hit" and again["trace"]["candidate_ids"] == trace["candidate_ids"]
    assert trace["evidence_selection"]["aspect_source"] == "evidence_aspects" and len(trace["evidence_selection"]["candidate_evidence_counts"]) == 61


def test_stream(spark, corpus):
    engine = make(spark, corpus)
    events = list(engine.stream("drone", batch=4, top_k=10))
    assert [e for e, _ in events] == ["plan_completed", "search_completed", "shortlist_completed", *["reason_batch_completed"] * 3, "stream_completed"]
    assert [r["rank"] for e, d in events if e == "reason_batch_completed" for r in sorted(d["rows"], key=lambda r: r["rank"])] == list(range(1, 11))
    engine.items = None
    assert list(engine.stream("drone"))[-1][0] == "error"


def test_read_back():
    short = [{"expert_id": i, "risks": ["own"]} for i in (1, 2)]
    items, gaps, trace = N.read_back('x {"items":[{"expert_id":2,"fit":"?","recommendation_reason":" a  b ","risks":[]},{"expert_id":9}],"data_gaps":["g"]}', short)
    assert items == [{"expert_id": 1, "fit": "보통", "reason": "", "risks": ["own"]}, {"expert_id": 2, "fit": "보통", "reason": "a b", "risks": []}]
    assert gaps == ["g"] and trace.missing_candidate_ids == [1] and trace.empty_reason_candidate_ids == [1] and trace.returned_ratio == 0.5
    assert list(N.in_batches(short, {}, None, 0))[0][2].candidate_ids == [1, 2]  # no size: one batch
    assert N.generation_summary(2, 2, [])["mode"] == "mixed"


def test_profile_evidence(spark):
    none = F.array().cast("array<struct<item_id:string,type:string,title:string,date:string,detail:string,snippet:string>>")
    frame = spark.createDataFrame([("A", "org", ""), ("B", "", "")], "name string, org string, degree string").withColumn("selected", none)
    got = {r.name: r.e for r in frame.withColumn("e", G.resolve_evidence("selected", F.col("name"), F.col("org"), F.col("degree"), F.lit(""))).collect()}
    assert got["A"][0].title == "A" and got["A"][0].detail == "org / unknown degree / unknown major" and got["B"] == []


def test_many_items_of_one_expert_stay_bounded(spark):
    """The quota's rows hold at most four items for each set of aspects, and choose what all items would give."""
    rows = spark.range(3000).select(F.lit(1).alias("expert_id"), F.lit("paper").alias("type"), F.concat(F.lit("paper:"), "id").alias("item_id"), F.concat(F.lit("title "), "id", F.when(F.col("id") % 7 == 0, " ab").otherwise(""), F.when(F.col("id") % 11 == 0, " cd").otherwise("")).alias("title"), F.lit("body").alias("body"), F.lit("2000").alias("date"))
    scored = E.dedup(E.score_items(rows, ["ab", "cd"], [], 2000))
    out = E.select_quota(scored, ["ab", "cd"]).first().selected
    ranked = E.ranked(scored).where("direct").orderBy("item_rank").collect()
    both = [r.item_id for r in ranked if len(r.aspects) == 2]
    assert [x.item_id for x in out] == both[:2]


def test_quota_with_repeated_ids(spark):
    """Items that share an id and a set of aspects take one place; the next id follows."""
    rows = spark.createDataFrame([(1, "paper", f"paper:{i // 5}", f"title {i} ab", "body", f"2000-01-{28 - i}") for i in range(10)], "expert_id long, type string, item_id string, title string, body string, date string")
    out = E.select_quota(E.dedup(E.score_items(rows, ["ab"], [], 2000)), ["ab"]).first().selected
    assert [(x.item_id, x.title) for x in out] == [("paper:0", "title 0 ab"), ("paper:1", "title 5 ab")]


def test_planning(spark):
    assert heuristic_plan("AI chips", top_k=3).retrieval_core == [] and heuristic_plan("AI chips").top_k == 15
    plan = fallback_plan("drone system expert")
    assert contract_of(plan)["pruned_must_aspects"] == ["drone"] and single_text(plan) == "drone system"


def test_sparse_models(tmp_path):
    def make(name, local):
        if name != "online-splade":
            raise OSError("no such model")
        return name

    got = M.sparse_backend("mine", "online-splade", make)
    assert got.encoder == "online-splade" and got.fallback and not got.idf
    assert M.sparse_backend("mine", "online-splade", make, offline=True).idf
    with pytest.raises(RuntimeError, match="offline"):
        M.sparse_backend("mine", "online-splade", make, offline=True, bm25=False)
    (tmp_path / "m").mkdir()
    with pytest.raises(FileNotFoundError):
        M.model_reference(str(tmp_path / "m"), required=("config.json",))
    with pytest.raises(FileNotFoundError):
        M.model_reference("./nowhere")
    assert M.model_reference("hub/name", True) == ("hub/name", True)
    got = M.splade_weights(np.array([[1.0, -1, 0], [np.e - 1, 0, 0]]), np.array([1, 1]))
    assert list(got) == [0] and abs(got[0] - 1) < 1e-9 and M.splade_weights(np.zeros((0, 3)), np.zeros(0)) == {}


def test_dimension_check(spark):
    frame = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert frame.select(M.checked_dimension(F.col("v"), 2).alias("v")).first().v == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        frame.select(M.checked_dimension(F.col("v"), 3)).collect()


def test_readiness(spark, corpus, tmp_path, capsys):
    people = fixtures(spark)
    points = spark.read.parquet(f"{corpus}/points.parquet")
    good = V.readiness(people, points, object(), "idf", ("degree", "org"))
    assert good["ready"] and good["sample_id"] == 11008395
    bad = V.readiness(people.drop("degree"), points, None, "none", ("degree",))
    assert not bad["ready"] and not bad["checks"]["sparse_vectors_present"] and not bad["checks"]["payload_indexes_present"] and not bad["checks"]["sparse_vectors_idf"]
    assert not V.readiness(people, None)["ready"]
    with pytest.raises(RuntimeError):
        V.validate_settings(True, None, None, False)
    engine = report.engine_of(spark, corpus)
    assert engine.alive() == {"status": "ok"} and report.main([], spark) == 2


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "c")
    S.ensure_collection(spark.range(5), path)
    assert S.modifier_of(spark, path) is None and S.repair_modifier(spark, path, "bm25") and not S.repair_modifier(spark, path, "bm25")
    assert S.collection_info(spark, path) == {"columns": {"id": "bigint"}, "rows": 5, "modifier": "idf"} and S.repair_modifier(spark, path, "x-splade")
    assert S.write_clustered(spark.range(9).withColumn("k", F.col("id") % 3), str(tmp_path / "k"), ("k", "nope")) == ["k"]
    store = str(tmp_path / "f")
    engine = Engine.__new__(Engine)
    engine.spark, engine.feedback_path = spark, store
    threads = [threading.Thread(target=engine.feedback, args=(f"q{i}", ["a"], [], "n")) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = spark.read.parquet(store).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 4] and all(r.created_at.endswith("Z") for r in rows)
