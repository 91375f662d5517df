"""The engine: a text becomes a plan, the plan one lazy DataFrame; a response is that DataFrame's few rows in an envelope."""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators import evidence as E
from ..operators import filters as P
from ..operators import quality as V
from ..operators import reasons as N
from ..operators import recommend as G
from ..operators import retrieval as R
from ..operators.segments import DOT, SegmentedIndex
from ..sources.scratch import Keep, kept
from ..sources.sinks import BranchCache, PlanCache, cached_result, result_key, save_feedback
from . import lexicon as X
from .models import SparseBackend, instructed
from .plan import BranchQuery, QueryPlan, branch_queries, branch_tasks, constrain, contract_of, fallback_plan, plan_with, unique

log = logging.getLogger("veinstone")
SORT_POLICY = "score desc, name asc, expert_id asc"


def words(text: str) -> list[str]:
    """The query's tokens, by the corpus' own token rule (F2)."""
    return unique(re.findall(TOKEN, text.lower()))


class Engine:
    """points (point_id, expert_id, branch, content_text, embedding), people (expert_id, name, org, degree, what filters read), items (flat evidence).

    index: stored postings (R.build_index, or a SegmentedIndex, which also answers many queries in one plan); without it the
    corpus is scanned. encode: a column of texts to vectors, by default the hashed unit vector; query_vector instead: a text to a
    one-row DataFrame with column q. sparse: what weighs terms; its encoder, a column of texts to map<term, weight>, needs an
    index of encoded weights. generator: a batch's payload text to answer text. cache: a folder for plans and results; snapshot
    names the state of the corpus (a SegmentedIndex has its own), encoder that of the models.
    """

    def __init__(self, spark: SparkSession, points: DataFrame, people: DataFrame, items: DataFrame, limits: R.Limits | None = None, reference_year: int = 2001, planner: Callable[[str], QueryPlan] | None = None, query_vector: Callable[[str], DataFrame] | None = None, generator: Callable[[str], str] | None = None, strict: bool = True, index: R.Index | SegmentedIndex | None = None, cache: str | None = None, snapshot: str = "", instruct: bool = False, feedback: str | None = None, strict_settings: bool = False, seeded: bool = False, encode: Callable[[Column], Column] | None = None, sparse: SparseBackend | None = None, encoder: str = "", ttl: float | None = None):
        V.validate_settings(strict_settings, generator, query_vector, seeded)
        self.spark, self.points, self.people, self.items, self.index = spark, points, people, items, index
        self.limits, self.reference_year, self.planner, self.strict, self.instruct = limits or R.Limits(), reference_year, planner, strict, instruct or instructed(encoder)
        self.encode, self._query_vector, self.sparse, self.encoder = encode, query_vector, sparse, encoder
        if (sparse is not None and sparse.encoder is not None) != (isinstance(index, SegmentedIndex) and index.kind == DOT):
            raise ValueError("an encoder's query weights need an index of its weights, and term frequencies one of terms")
        self.generator, self.cache, self.feedback_path = generator, cache, feedback
        self.snapshot = snapshot or (index.snapshot if isinstance(index, SegmentedIndex) else "")
        if cache and not self.snapshot:
            raise ValueError("stored results need a snapshot: without one, changed data would not be seen")
        self.plans = PlanCache(spark, f"{cache}/plans", ttl=ttl) if cache else None
        self.branches = BranchCache(spark, f"{cache}/branches", ttl=ttl) if cache else None
        self.timers: dict[str, float] = {}
        self.trace: dict[str, Any] = {}

    def _encoded(self, text: Column) -> Column:
        from ..functions.vectors import hashed_unit_vector

        if self.encode is not None:
            return self.encode(text)
        dim = self.points.select(F.size("embedding")).where("embedding is not null").first()
        return hashed_unit_vector(text, dim[0] if dim else 1)

    def query_vector(self, text: str) -> DataFrame:
        """One row with column q."""
        if self._query_vector is not None:
            return self._query_vector(text)
        return self.spark.range(1).select(self._encoded(F.lit(text)).alias("q"))

    @contextmanager
    def _timed(self, name: str) -> Iterator[None]:
        """O1."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timers[name] = 1000 * (time.perf_counter() - began)

    # --- plan ---

    def plan(self, text: str, **request: Any) -> QueryPlan:
        """P13, P14, L1-L8. Filters, include, exclude and top_k are the request's; a cached plan gets them again."""
        with self._timed("plan_ms"):
            key = QueryPlan(query=text, hard_filters=request.get("filters") or {}, include_orgs=request.get("include") or [], exclude_orgs=request.get("exclude") or [], top_k=request.get("top_k") or 0).key()
            stored = self.plans.get(key) if self.plans else None
            if stored:
                out = constrain(QueryPlan(**stored), **request)
            else:
                out = plan_with(self.planner, text, **request) if self.planner else fallback_plan(text, **request)
                if self.plans:
                    self.plans.put(key, json.loads(out.to_json()))
        self.trace["planner_trace"] = {"cache": {"canonical_plan": "hit" if stored else "miss"}, "removed_meta_terms": unique(out.role_terms + out.action_terms + out.generic_terms), **contract_of(out)}
        return out

    # --- search ---

    def tasks(self, plan: QueryPlan) -> list[BranchQuery]:
        """R1-R1c, R7, R8, S12."""
        if self.branches is None:
            return branch_queries(plan, self.instruct)
        told = self.branches.texts(f"{self.instruct}|{plan.to_json()}", lambda: [asdict(t) for t in branch_queries(plan, self.instruct)])
        return [BranchQuery(**t) for t in told]

    def _vectors(self, tasks: list[BranchQuery]) -> DataFrame:
        """branch, path, q: one row for each task; equal texts are encoded once. R8: a task whose text can't be encoded is left out, unless all are."""
        known: dict[str, DataFrame] = {}
        rows, errors = [], []
        for t in tasks:
            try:
                own = known.get(t.dense) or known.setdefault(t.dense, self.query_vector(t.dense))
                rows.append(own.select(F.lit(t.branch).alias("branch"), F.lit(t.path).alias("path"), F.col("q").cast("array<double>").alias("q")))
            except Exception as e:  # noqa: BLE001  an outside encoder may fail in any way
                errors.append(f"{t.branch}/{t.path}: {e}")
                log.warning("task %s/%s has failed: %s", t.branch, t.path, e)
        if not rows:
            raise RuntimeError("every search task has failed: " + "; ".join(errors))
        return reduce(DataFrame.union, rows)

    def _wanted(self, tasks: DataFrame, by: list[str]) -> DataFrame:
        """tasks (by, words, sparse) -> by, term, weight: a query's words once each, or an encoder's weights of its text."""
        if self.sparse is None or self.sparse.encoder is None:
            return tasks.select(*by, F.explode(F.array_distinct("words")).alias("term"), F.lit(1.0).alias("weight"))
        return tasks.select(*by, F.explode(self.sparse.encoder(F.col("sparse"))).alias("term", "weight")).withColumn("term", F.col("term").cast("string"))

    def allowed(self, plan: QueryPlan) -> DataFrame | None:
        """Who passes the hard filters; None if there are none."""
        if not (plan.hard_filters or plan.include_orgs or plan.exclude_orgs):
            return None
        return P.apply_filters(self.people, plan.hard_filters, plan.include_orgs, plan.exclude_orgs, as_of=self.reference_year).select("expert_id")

    def hits(self, plan: QueryPlan) -> DataFrame:
        """R2-R9 as one plan for all tasks. Filters cut the points before the prefetch; only what that leaves (a thousand points a task at most) meets the vectors."""
        tasks, allowed = self.tasks(plan), self.allowed(plan)
        terms = unique([w for t in tasks for w in words(t.sparse)])
        if isinstance(self.index, SegmentedIndex):
            asked = self.spark.createDataFrame([(t.branch, t.path, words(t.sparse), t.sparse) for t in tasks], "branch string, path string, words array<string>, sparse string")
            known = terms if self.index.kind != DOT else None  # an encoder may add words
            scored = self.index.scores(self._wanted(asked, ["branch", "path"]), ("branch", "path"), self.limits.keyword_prefetch, allowed, known)
        else:
            asked = self.spark.createDataFrame([(t.branch, t.path, words(t.sparse)) for t in tasks], "branch string, path string, terms array<string>")
            scored = R.bm25_tasks(self.index or R.scan_index(self.points, terms), asked)
            if allowed is not None:
                scored = scored.join(allowed, "expert_id", "left_semi")
        return self.reranked(scored, self._vectors(tasks))

    def reranked(self, scored: DataFrame, vectors: DataFrame) -> DataFrame:
        """Scored points (branch, path, point_id, sparse) cut by the prefetch, which bounds the broadcasts, met with their vectors (branch, path, q)."""
        pre = R.prefetch(scored, self.limits)
        near = self.points.select("point_id", "embedding").join(F.broadcast(pre), "point_id").join(F.broadcast(vectors), ["branch", "path"])
        dense = near.withColumn("dense", F.round(R.cosine(F.col("embedding"), F.col("q")), 6)).drop("embedding", "q")
        return R.rerank(dense, self.limits).withColumn("score", F.coalesce("dense", F.lit(0.0)))

    def search_many(self, queries: DataFrame, filters: dict[str, Any] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """All of queries (query_id, text) as one plan: query_id and the columns of search(), ranks and percents by query.

        Plans are made on the executors, a query's id is a key of every join and window, and the number of jobs doesn't depend
        on the number of queries. Filters hold for all of them. Queries without keywords, hits or supported experts have no rows;
        a null or repeated query_id is an error of the caller's: rows with equal ids are one query. Needs a SegmentedIndex.
        """
        if not isinstance(self.index, SegmentedIndex) or self._query_vector is not None:
            raise ValueError("search_many needs a segmented index and encodes texts as a column (encode)")
        request = QueryPlan(hard_filters=filters or {}, include_orgs=include or [], exclude_orgs=exclude or [])
        hits = self._hits_of(branch_tasks(queries, self.planner, self.instruct), self.allowed(request))
        rows = R.aggregate(hits, self.limits, by=("query_id",)).join(self.people, "expert_id")
        named = P.drop_containing(R.penalise(rows, self.limits), request.exclude_orgs).where(R.supported(self.limits))
        return R.normalised(R.final_order(named, by=("query_id",)), by=("query_id",))

    def _hits_of(self, tasks: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """R2-R9 for many queries: tasks (query_id, branch, path, sparse, dense) to hits with query_id."""
        by = ["query_id", "branch", "path"]
        tokens = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("sparse"), F.lit(TOKEN), 0), F.lower))
        wanted = self._wanted(tasks.select(*by, "sparse", tokens.alias("words")), by)
        pre = R.prefetch(self.index.scores(wanted, tuple(by), self.limits.keyword_prefetch, allowed), self.limits, tuple(by))
        texts = tasks.select(*by, F.col("dense").alias("text"))
        # Equal texts are encoded once; a thousand points a task meet the vectors by their id.
        vectors = texts.select("text").distinct().withColumn("q", self._encoded(F.col("text")).cast("array<double>"))
        near = pre.join(self.points.select("point_id", "embedding"), "point_id").join(texts.join(vectors, "text").drop("text"), by)
        dense = near.withColumn("dense", F.round(R.cosine(F.col("embedding"), F.col("q")), 6)).drop("embedding", "q")
        return R.rerank(dense, self.limits, tuple(by)).withColumn("score", F.coalesce("dense", F.lit(0.0)))

    def skipped(self, plan: QueryPlan) -> str | None:
        """R19."""
        return None if plan.retrieval_core else G.SKIPPED

    def aggregated(self, plan: QueryPlan) -> DataFrame:
        """R10, R11 with people's columns."""
        if self.skipped(plan):  # an empty frame of the same shape, without any scan
            rows = self.spark.createDataFrame([], "expert_id string, score double, stable_hits long, expanded_hits long, branches array<string>, first_point long, matches array<struct<rank:int,minus:double,branch:string,path:string,point_id:long>>")
            rows = rows.withColumn("expert_id", F.col("expert_id").cast(self.people.schema["expert_id"].dataType))
        else:
            rows = R.aggregate(self.hits(plan), self.limits)
        return R.penalise(rows.join(self.people, "expert_id"), self.limits)

    def search(self, text: str | QueryPlan, limit_candidates: bool = False, **request: Any) -> DataFrame:
        """Candidates in order (P11, R12, R15, R20, F26); empty without keywords."""
        plan = text if isinstance(text, QueryPlan) else self.plan(text, **request)
        if not self.cache:
            return self._searched(plan, limit_candidates)
        compiled = json.dumps([[t.branch, t.path, t.sparse, t.dense] for t in self.tasks(plan)])
        settings = json.dumps([asdict(self.limits), self.reference_year, self.encoder, self.sparse.model if self.sparse else "", getattr(self.index, "kind", "")], sort_keys=True)
        key = result_key(compiled, json.dumps([plan.hard_filters, plan.include_orgs, plan.exclude_orgs, plan.top_k if limit_candidates else None], sort_keys=True, default=str), self.snapshot, settings)
        found, hit = cached_result(self.spark, f"{self.cache}/results", key, lambda: self._searched(plan, limit_candidates))
        self.trace["retrieval_cache"] = "hit" if hit else "miss"
        return found

    def _searched(self, plan: QueryPlan, limit_candidates: bool) -> DataFrame:
        named = P.drop_containing(self.aggregated(plan), plan.exclude_orgs).where(R.supported(self.limits))
        return R.display(R.normalised(R.final_order(named)), plan.top_k, limit_candidates)

    def filtered_out(self, plan: QueryPlan) -> DataFrame:
        """R13."""
        return R.filtered_out(P.drop_containing(self.aggregated(plan), plan.exclude_orgs), self.limits)

    def shadow(self, plan: QueryPlan) -> DataFrame:
        """R17, R22."""
        return R.shadow_names(R.aggregate(self.hits(plan), self.limits), self.people)

    # --- recommend ---

    def evidence(self, plan: QueryPlan, candidates: DataFrame) -> DataFrame:
        """E6-E17 for the candidates only: items are cut down by a semi-join before they are scored."""
        items = E.dedup(self._scored(plan, candidates))
        return E.bundles(items, E.select_quota(items, plan.targets()))

    def _scored(self, plan: QueryPlan, candidates: DataFrame) -> DataFrame:
        own = self.items.join(candidates.select("expert_id"), "expert_id", "left_semi")
        return E.score_items(own, plan.targets(), plan.generic_terms, self.reference_year)

    def selection_trace(self, plan: QueryPlan, candidates: DataFrame) -> DataFrame:
        """E16."""
        scored = self._scored(plan, candidates)
        items = E.dedup(scored)
        return E.selection_trace(E.bundles(items, E.select_quota(items, plan.targets())), E.dedup_dropped(scored, items))

    def _column(self, name: str) -> Column:
        return F.col(name) if name in self.people.columns else F.lit("")

    def gated(self, plan: QueryPlan, found: DataFrame | None = None) -> DataFrame:
        """G1-G3 over all candidates."""
        found = self.search(plan) if found is None else found
        return self._gated(plan, found, self.evidence(plan, found))

    def _gated(self, plan: QueryPlan, found: DataFrame, bundles: DataFrame) -> DataFrame:
        joined = found.withColumnRenamed("rank", "retrieval_rank").join(bundles, "expert_id", "left")
        return G.gate(joined.withColumn("grounding", R.ground()), len(plan.targets()), self.strict)

    def short(self, plan: QueryPlan, gated: DataFrame) -> DataFrame:
        """The shortlist with its evidence and risks."""
        rows = G.shortlist(gated, plan.top_k).withColumn("evidence", G.resolve_evidence("selected", F.col("name"), F.col("org"), F.col("degree"), self._column("major")))
        known = {"publications", "patents", "projects"} <= set(self.people.columns)
        return rows.withColumn("card_risks", E.risks(E.gaps()) if known else F.array().cast("array<string>"))

    def recommend(self, text: str | QueryPlan, **request: Any) -> DataFrame:
        """G1-G10 as one plan: gates before top-k, reasons, validation, assembly. A generator sees at most 15 rows."""
        plan = text if isinstance(text, QueryPlan) else self.plan(text, **request)
        short = self.short(plan, self.gated(plan))
        if self.generator is None:
            rows = short.withColumns({"fit": F.lit("보통"), "reason": F.lit(""), "risks": F.col("card_risks")})
        else:
            outputs, _, _ = self._reasons(short)
            rows = self._with_reasons(short, outputs)
        return self._assembled(plan, rows)

    def _assembled(self, plan: QueryPlan, rows: DataFrame) -> DataFrame:
        return G.assemble(rows, unique(plan.must_aspects or plan.retrieval_core)).orderBy("rank")

    def _reasons(self, short: DataFrame) -> tuple[list[dict], list[str], list[N.BatchTrace]]:
        items, gaps, traces = [], [], []
        for own, more, trace in self._reason_batches(short):
            items += own
            gaps = unique([*gaps, *more])
            traces.append(trace)
        return items, gaps, traces

    def _reason_batches(self, short: DataFrame, size: int = N.BATCH) -> Iterator[tuple[list[dict], list[str], N.BatchTrace]]:
        """Payloads are made by Spark, the calls by the driver, batch after batch."""
        rows = [{"expert_id": r.expert_id, "risks": r.card_risks} for r in short.select("rank", "expert_id", "card_risks").orderBy("rank").collect()]
        profiles = (N.PRIMARY, N.COMPACT) if self.generator else ()
        told = {p.name: {r.expert_id: r.payload for r in N.payloads(short, p, size).collect()} for p in profiles}
        return N.in_batches(rows, told, self.generator, size)

    def _with_reasons(self, short: DataFrame, outputs: list[dict]) -> DataFrame:
        """J2, J3."""
        kind = self.people.schema["expert_id"].dataType.simpleString()
        told = self.spark.createDataFrame([(o["expert_id"], o["fit"], o["reason"], o["risks"]) for o in outputs], f"expert_id {kind}, fit string, reason string, told_risks array<string>")
        rows = short.join(F.broadcast(told), "expert_id", "left")
        return rows.withColumns({"fit": F.coalesce("fit", F.lit("보통")), "reason": F.coalesce("reason", F.lit("")), "risks": F.when(F.size("told_risks") > 0, F.col("told_risks")).otherwise(F.col("card_risks"))})

    # --- responses ---

    @contextmanager
    def _request(self, request_id: str | None) -> Iterator[list[str]]:
        """O2: Spark jobs and log records of one request carry its id."""
        own = request_id or uuid.uuid4().hex[:12]
        records: list[str] = []
        handler = logging.Handler()
        handler.emit = lambda r: records.append(f"{own} {r.levelname} {r.getMessage()}")  # type: ignore[method-assign]
        log.addHandler(handler)
        self.spark.sparkContext.setJobGroup(own, f"veinstone request {own}")
        try:
            yield records
        finally:
            log.removeHandler(handler)
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def respond(self, text: str, request_id: str | None = None, **request: Any) -> dict[str, Any]:
        """Status, recommendations and trace. Without candidates, or with none past the gates, the reason is stated.

        The candidates, the gated ones and the shortlist are written once each; their counts come from the jobs that write them (O1, G5).
        """
        with self._request(request_id) as records, self._timed("total_ms"), kept(self.spark) as keep:
            plan = self.plan(text, **request)
            names, metrics = [], {}
            if not self.skipped(plan):
                with self._timed("search_ms"):
                    found, metrics["search"] = self._found(plan, keep)
                    # Candidates: branch_output points of 8 tasks at most.
                    names = [r.asDict(recursive=True) for r in found.select("expert_id", "rank", "name", "stable_hits", "expanded_hits", "branches", *R.traced()).orderBy("rank").collect()]
            reasons, gaps, rows, generation, gates, summary, selection = [], [], [], {}, {}, {}, []
            if not names:
                status = "skipped" if self.skipped(plan) else "no_match"
                reasons, gaps = [G.NO_MATCH], [g for g in [self.skipped(plan)] if g]
                log.info("no candidates")
            else:
                with self._timed("evidence_selection_ms"):
                    gated, metrics["gates"], selection = self._kept_gates(plan, found, keep)
                    gates = self._gate_lists(gated)
                    short, metrics["shortlist"] = keep(self.short(plan, gated), "short")
                status = "ok" if len(gates["drop"]) < len(names) else "gated_empty"
                if status == "gated_empty":
                    reasons = [G.GATED_EMPTY]
                    generation = N.generation_summary(len(names), 0, []) | {"mode": "gated_empty", "reason_generation_failed": False}
                    summary = {"checked": 0, "fallback_count": 0, "fallback_ratio": 0.0}
                    log.warning("the gates have removed every candidate")
                else:
                    with self._timed("reason_generation_ms"):
                        outputs, gaps, traces = self._reasons(short)
                        done = self._assembled(plan, self._with_reasons(short, outputs))
                        rows = [r.asDict(recursive=True) for r in done.collect()]
                    generation = N.generation_summary(len(outputs), len(rows), traces)
                    bad = sum(bool(r["violations"]) for r in rows)
                    summary = {"checked": len(rows), "fallback_count": bad, "fallback_ratio": round(bad / len(rows), 3) if rows else 0.0}
            told = list(records)
        return self._envelope(plan, status, names, rows, gaps, reasons, generation, gates, summary, selection, told, metrics)

    def _found(self, plan: QueryPlan, keep: Keep) -> tuple[DataFrame, dict]:
        """The candidates and how many they are, by support too."""
        return keep(self.search(plan), "found", stable_only=F.count_if(F.col("expanded_hits") == 0), expanded_only=F.count_if(F.col("stable_hits") == 0))

    def _kept_gates(self, plan: QueryPlan, found: DataFrame, keep: Keep) -> tuple[DataFrame, dict, list[dict]]:
        """Gated candidates with counts by status, and the selection's trace; the candidates' scored items are made once."""
        scored, _ = keep(self._scored(plan, found), "scored")
        items, _ = keep(E.dedup(scored), "items")
        bundles, _ = keep(E.bundles(items, E.select_quota(items, plan.targets())), "bundles")
        gated, counts = keep(self._gated(plan, found, bundles), "gated", **{s: F.count_if(F.col("status") == s) for s in G.STATUSES})
        trace = [r.asDict(recursive=True) for r in E.selection_trace(bundles, E.dedup_dropped(scored, items)).orderBy("expert_id").collect()]
        return gated, counts, trace

    def _gate_lists(self, gated: DataFrame) -> dict[str, list]:
        """G5 for a response: ids by status, of at most 8 tasks' candidates."""
        out: dict[str, list] = {s: [] for s in G.STATUSES}
        for r in gated.select("status", "expert_id", "retrieval_rank").orderBy("retrieval_rank").collect():
            out[r.status].append(r.expert_id)
        return out

    def _envelope(self, plan: QueryPlan, status: str, names: list[dict], rows: list[dict], gaps: list[str], reasons: list[str], generation: dict, gates: dict, summary: dict, selection: list, records: list[str], metrics: dict[str, dict]) -> dict[str, Any]:
        support = {n["expert_id"]: {"stable": n["stable_hits"], "expanded": n["expanded_hits"], "branches": n["branches"]} for n in names}
        rows = [r | {"support": support.get(r["expert_id"])} for r in rows]
        fallbacks = [{"expert_id": r["expert_id"], "source": r["fallback_source"], "violations": r["violations"]} for r in rows if r["fallback_source"]]
        return {
            "status": status, "intent_summary": plan.intent_summary, "applied_filters": plan.hard_filters, "searched_branches": list(X.BRANCHES), "retrieved_count": len(names),
            "recommendations": rows, "data_gaps": unique(gaps), "not_selected_reasons": reasons,
            "trace": {
                "planner": json.loads(plan.to_json()), "planner_trace": self.trace.get("planner_trace", {}), "cache": {"retrieval": self.trace.get("retrieval_cache", "miss")},
                "retrieval_keywords": plan.retrieval_core, "bundle_ids": plan.bundle_ids, "branch_queries": [t.__dict__ for t in self.tasks(plan)], "include_orgs": plan.include_orgs, "exclude_orgs": plan.exclude_orgs,
                "candidate_ids": [n["expert_id"] for n in names], "recommendation_ids": [r["expert_id"] for r in rows], "retrieval_skipped_reason": self.skipped(plan), "final_sort_policy": SORT_POLICY,
                "top_k_used": plan.top_k, "shortlist_gate": gates, "evidence_selection": {"aspect_source": plan.aspect_source(), "aspects": plan.targets(), "candidate_evidence_counts": selection},
                "reason_generation_trace": generation, "reason_sync_validator": summary, "server_fallback_reasons": fallbacks, "timers": dict(self.timers), "log": records, "metrics": metrics,
                "score_trace": [{k: n[k] for k in ("expert_id", "name", "rank", "primary_branch", "primary_rank", "final_score", "n_matches", "stable_hits", "expanded_hits", "branches")} for n in names],
            },
        }

    def stream(self, text: str, batch: int = N.BATCH, **request: Any) -> Iterator[tuple[str, Any]]:
        """Progress events; reasons are made and sent batch by batch, ranks go on across batches."""
        try:
            with self._timed("total_ms"), kept(self.spark) as keep:
                plan = self.plan(text, **request)
                yield "plan_completed", {"retrieval_keywords": plan.retrieval_core}
                found, counts = self._found(plan, keep)
                n = counts.get("rows", 0)
                yield "search_completed", {"retrieved": n, "reason": self.skipped(plan)}
                short, counts = keep(self.short(plan, self.gated(plan, found)), "short")
                yield "shortlist_completed", {"shortlisted": counts.get("rows", 0)}
                sent = 0
                for outputs, gaps, trace in self._reason_batches(short, batch):
                    done = self._assembled(plan, self._with_reasons(short, outputs)).where(F.col("expert_id").isin(trace.candidate_ids))
                    rows = [r.asDict(recursive=True) for r in done.collect()]
                    sent += len(rows)
                    yield "reason_batch_completed", {"rows": rows, "data_gaps": gaps, "trace": trace.asdict()}
            yield "stream_completed", {"count": sent, "status": "ok" if sent else G.GATED_EMPTY if n else G.NO_MATCH}
        except Exception as e:  # noqa: BLE001  an error is an event of the stream
            yield "error", {"message": str(e)}

    # --- service ---

    def feedback(self, query: str, selected: list[str], rejected: list[str], notes: str = "", metadata: dict[str, str] | None = None) -> int:
        """One feedback; returns its id."""
        if not self.feedback_path:
            raise ValueError("the engine has no feedback store")
        kinds = "query string, selected array<string>, rejected array<string>, notes string, metadata map<string,string>"
        row = self.spark.createDataFrame([(query, selected, rejected, notes, metadata or {})], kinds)
        return save_feedback(self.spark, self.feedback_path, row.withColumn("created_at", F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))))

    def alive(self) -> dict[str, str]:
        """O3."""
        return {"status": "ok"}

    def ready(self, required: tuple[str, ...] = (), modifier: str | None = None) -> dict[str, Any]:
        """V1-V4, J10 on the engine's people, where they are nested experts."""
        return V.readiness(self.people, self.points, self.index, modifier, required)
