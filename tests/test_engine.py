"""Fixtures of the engine's semantics."""

import pytest
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.functions.json_scan import first_object
from veinstone.operators import evidence as E
from veinstone.operators import recommend as G
from veinstone.operators import retrieval as R
from veinstone.operators.filters import compile_filters
from veinstone.plans.plan import QueryPlan, branch_queries, constrain, fallback_plan, plan_with, prune
from veinstone.sources.sinks import BranchCache, PlanCache, cached_result, save_feedback


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)]).select(column).first()[0]


def test_text(spark):
    assert one(spark, T.normalize_org(F.lit("주식회사 미소테크 (서울)"))) == "미소테크"
    assert one(spark, T.normalize_org(F.lit("()"))) is None
    assert one(spark, T.collapse(F.lit(" a\u3000 b\n"))) == "a b"
    assert one(spark, T.rfc3339(F.lit("2024"))) == "1905-07-16T00:00:00Z"
    assert one(spark, T.truncate(F.lit("abcdef"), 5)) == "ab..."
    assert one(spark, T.unique_strings(F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.lit("b")))) == ["a", "b"]
    assert one(spark, T.most_specific(F.array(F.lit("ab"), F.lit("a b c"), F.lit("abc")))) == ["abc", "a b c", "ab"]
    assert one(spark, T.branch_of(F.lit("7_art_2"))) == "art"
    assert one(spark, T.keywords(F.array(F.lit("  fire suppression  "), F.lit(""), F.lit("drone"), F.lit("fire")))) == ["fire", "suppression", "drone"]


def test_json():
    assert first_object('<thinking>{"a":1}</thinking> x ```json\n{"b": "}"}\n```') == '{"b": "}"}'
    assert first_object("none") is None


def test_planner():
    p = fallback_plan("AI semiconductor expert recommendation")
    assert p.retrieval_core == ["AI", "semiconductor"] and p.query == "AI semiconductor expert recommendation"
    assert fallback_plan("Recommend experts committee").retrieval_core == ["experts"]
    own = constrain(QueryPlan(query="expert recommendation", retrieval_core=["AI semiconductor", "expert recommendation"], bundle_ids=["uav", "nope", "fire_response"]))
    assert own.retrieval_core == own.must_aspects == ["AI semiconductor"] and own.bundle_ids == ["uav", "fire_response"]
    assert prune(["의료영상 분석", "AI 기반", "기술 개발"], [])[0] == ["의료영상 분석"]
    assert constrain(QueryPlan(query="AI 기반 의료영상 과제를 평가할 수 있는 전문가", retrieval_core=["AI 기반 의료영상"])).intent_flags["review_targets"] == ["과제 평가"]
    with pytest.raises(ValueError):
        fallback_plan("x", top_k=16)
    calls = []
    assert plan_with(lambda t: calls.append(t) or QueryPlan(query=t), "drone sensor").retrieval_core == ["drone", "sensor"] and len(calls) == 2
    assert QueryPlan(query="a", include_orgs=["x"]).key() != QueryPlan(query="a").key()


def test_branch_queries():
    stable = branch_queries(constrain(QueryPlan(query="fire drone", retrieval_core=["fire suppression", "drone"], semantic_query="putting out fires")))
    assert len(stable) == 4 and stable[0].sparse == "fire suppression drone" and stable[0].dense == "putting out fires"
    wide = branch_queries(constrain(QueryPlan(query="fire", retrieval_core=["fire"], bundle_ids=["uav"])))
    assert [(q.branch, q.path) for q in wide].count(("basic", "expanded")) == 0 and len(wide) == 7


def test_filters(spark):
    people = spark.createDataFrame([(1, [("SCIE", "2010-01-01"), ("KCI", "2025-01-01")]), (2, [("SCIE", "2025-01-01")])], "expert_id long, publications array<struct<index_type:string,date:string>>")
    got = people.where(compile_filters({"art_sci_slct_nm": "SCIE", "art_recent_years": 5}, as_of=2026)).select("expert_id").collect()
    assert [r[0] for r in got] == [2]
    assert compile_filters({}) is None
    with pytest.raises(ValueError):
        compile_filters({"salary": 1})


def test_aggregation(spark):
    hits = spark.createDataFrame([("x", "art", "stable", 1, "p1", 0.90), ("x", "art", "stable", 3, "p2", 0.85), ("x", "pjt", "stable", 2, "p3", 0.89), ("y", "art", "stable", 1, "p4", 0.8199), ("z", "art", "expanded", 1, "p5", 0.9), ("z", "art", "expanded", 2, "p6", 0.9)], "expert_id string, branch string, path string, rank int, point_id string, score double")
    limits = R.Limits()
    got = {r.expert_id: r for r in R.aggregate(hits, limits).collect()}
    assert round(got["x"].score, 5) == 0.90335 and got["x"].stable_hits == 3 and got["x"].first_point == "p1" and "y" not in got
    trace = {r.expert_id: r for r in R.score_trace(R.aggregate(hits, limits)).collect()}
    assert trace["x"].primary_branch == "art"
    assert [r.expert_id for r in R.filtered_out(R.aggregate(hits, limits), limits).collect()] == ["z"]


def items(spark, rows):
    return spark.createDataFrame([(1, t, f"{t}:{i}", title, body, date) for t, i, title, body, date in rows], "expert_id long, type string, item_id string, title string, body string, date string")


def test_evidence(spark):
    s = E.score_items(items(spark, [("project", 0, "AI  semiconductor process platform", "Process optimization", "2025-12-31")]), ["ai semiconductor"], [], 2026).first()
    assert s.score == 6.6 and s.direct
    rows = [(t, i, f"{h} medical imaging {i} emergency ct", "", f"{2025 - i}-01-01") for t, h in (("paper", "p"), ("project", "j"), ("patent", "t")) for i in range(5)]
    aspects = ["medical imaging", "emergency ct"]
    own = E.dedup(E.score_items(items(spark, rows), aspects, [], 2026))
    b = E.bundles(own, E.select_quota(own, aspects)).first()
    assert b.aspect_coverage == 2 and len(b.selected) == 2 and b.direct_match_count == 15
    twice = E.dedup(E.score_items(items(spark, [("paper", 0, "Same title", "", "2025-12-31"), ("project", 0, "same  Title", "", "2025-06-01")]), ["same"], [], 2026))
    assert twice.count() == 1
    loose = E.score_items(items(spark, [("paper", 0, "experience", "", "2025")]), ["ct"], ["experience"], 2026)
    g = E.bundles(loose, E.select_quota(loose, ["ct"])).first()
    assert g.generic_only and g.direct_match_count == 0 and not g.selected


def test_gates(spark):
    rows = [(1, 1, 2, 2, False), (2, 2, 1, 1, False), (3, 3, 1, 2, True), (4, 4, 0, 0, False)]
    f = spark.createDataFrame(rows, "expert_id long, retrieval_rank int, direct_match_count int, aspect_coverage int, generic_only boolean")
    gated = G.gate(f, 2)
    assert {r.expert_id: r.status for r in gated.collect()} == {1: "keep", 2: "demote_low_coverage", 3: "demote_generic_only", 4: "drop"}
    assert [r.expert_id for r in G.shortlist(gated, 2).orderBy("rank").collect()] == [1, 2]
    assert spark.range(1, 7).select(G.batch_of("id")).distinct().count() == 2


def test_reasons(spark):
    f = spark.createDataFrame([("Alpha", "Bravo is better", [("paper", "Chip platform", "", "medical imaging")], ["Alpha", "Bravo"]), ("Bravo", "", [], ["Alpha", "Bravo"]), ("Bravo", "추천 paper:1", [], ["Alpha"])], "name string, reason string, evidence array<struct<type:string,title:string,detail:string,snippet:string>>, names array<string>")
    got = [r[0] for r in f.select(G.violations("reason", "name", "evidence", "names", ["medical imaging"])).collect()]
    assert got[0] == ["other_candidate_name"] and got[1] == []
    assert set(got[2]) == {"other_candidate_name", "internal_evidence_id", "strong_claim_without_direct_evidence"} - {"other_candidate_name"}
    assert "Chip platform" in f.select(G.fallback_reason("evidence")).first()[0]


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", "q", ["1"], [], "n", {"a": "b"})], "created_at string, query string, selected array<string>, rejected array<string>, notes string, metadata map<string,string>")
    assert save_feedback(spark, str(tmp_path / "f"), rows) == 1 and save_feedback(spark, str(tmp_path / "f"), rows) == 2
    cache = PlanCache(spark, str(tmp_path / "c"))
    cache.put("k", {"a": 0})
    cache.put("k", {"a": 1})
    assert cache.get("k") == {"a": 1} and cache.get("x") is None
    made = []
    for _ in range(2):
        assert BranchCache(spark, str(tmp_path / "b")).texts("plan", lambda: made.append(1) or [{"branch": "art"}]) == [{"branch": "art"}]
    assert made == [1]
    assert PlanCache(spark, str(tmp_path / "c"), version="2").get("k") is None and PlanCache(spark, str(tmp_path / "c"), ttl=-1).get("k") is None
    assert cached_result(spark, str(tmp_path / "r"), "k", lambda: spark.range(2))[1] is False
    assert cached_result(spark, str(tmp_path / "r"), "k", lambda: spark.range(9))[0].count() == 2


def test_hashed_vectors_hash_once_a_row(spark):
    """The plan holds one digest expression in one lambda, and the vector is that of the definition."""
    import hashlib

    import numpy as np

    from veinstone.functions.vectors import hashed_unit_vector

    frame = spark.createDataFrame([("drone",), ("",), ("다",)], "t string").select("t", hashed_unit_vector(F.col("t"), 20).alias("v"))
    for r in frame.collect():
        words = [hashlib.sha256(f"{r.t}::{i // 8}".encode()).hexdigest()[i % 8 * 8 :][:8] for i in range(20)]
        raw = np.array([int(w, 16) for w in words]) / 2**32 - 0.5
        assert np.allclose(r.v, raw / np.linalg.norm(raw), atol=1e-12)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1


def test_index_is_written_without_a_shuffle(spark, tmp_path):
    """Each task writes its own points' postings: a bucket has a file a task."""
    rows = spark.createDataFrame([(i, f"e{i % 3}", "art", f"drone w{i % 5} w{i % 5}") for i in range(40)], "point_id long, expert_id string, branch string, content_text string").repartition(3)
    index = R.build_index(rows, str(tmp_path / "i"), 1)
    assert len(list((tmp_path / "i" / "postings" / "bucket=0").glob("*.parquet"))) == 3
    got = {(r.term, r.point_id, r.tf) for r in index.postings.collect()}
    assert got == {(t, i, n) for i in range(40) for t, n in (("drone", 1), (f"w{i % 5}", 2))}
