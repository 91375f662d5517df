"""Driver-side query plans, the deterministic planner, and branch queries."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import term_pattern
from . import lexicon as X


@dataclass
class QueryPlan:
    """What a query asks for. top_k counts results; orgs and top_k are part of a cached plan's key."""

    query: str = ""
    intent_summary: str = ""
    retrieval_core: list[str] = field(default_factory=list)
    must_aspects: list[str] = field(default_factory=list)
    evidence_aspects: list[str] = field(default_factory=list)
    role_terms: list[str] = field(default_factory=list)
    action_terms: list[str] = field(default_factory=list)
    generic_terms: list[str] = field(default_factory=list)
    noise_terms: list[str] = field(default_factory=list)
    bundle_ids: list[str] = field(default_factory=list)
    semantic_query: str = ""
    hyde_document: str = ""
    intent_flags: dict[str, Any] = field(default_factory=dict)
    hard_filters: dict[str, Any] = field(default_factory=dict)
    include_orgs: list[str] = field(default_factory=list)
    exclude_orgs: list[str] = field(default_factory=list)
    top_k: int = 15

    def key(self) -> str:
        """The cache key of the request, orgs and top_k included."""
        own = {"query": self.query.lower().strip(), "filters": self.hard_filters, "include": self.include_orgs, "exclude": self.exclude_orgs, "top_k": self.top_k}
        return hashlib.sha256(json.dumps(own, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def targets(self) -> list[str]:
        """Evidence aspects, else must aspects, else the core."""
        return self.evidence_aspects or self.must_aspects or self.retrieval_core

    @classmethod
    def from_json(cls, text: str) -> QueryPlan:
        return cls(**json.loads(text))

    def aspect_source(self) -> str:
        """Which list gave the targets."""
        return "evidence_aspects" if self.evidence_aspects else "must_aspects" if self.must_aspects else "retrieval_core"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)


def squash(text: str | None) -> str:
    return " ".join((text or "").split())


def unique(values: list[str] | None) -> list[str]:
    return list(dict.fromkeys(v for v in map(squash, values or []) if v))


def strip(text: str, terms: list[str] | tuple[str, ...]) -> str:
    pattern = _pattern(tuple(terms))
    return squash(pattern.sub(" ", text) if pattern else text)


@lru_cache(maxsize=1024)
def _pattern(terms: tuple[str, ...]) -> re.Pattern[str] | None:
    """The terms' pattern: a plan strips many words of the same few."""
    pattern = term_pattern(terms)
    return re.compile(pattern.replace("(?iU)", "(?i)")) if pattern else None


def found(text: str, terms: tuple[str, ...]) -> list[str]:
    own = squash(text).lower()
    return [t for t, low in _longest_first(tuple(terms)) if low in own]


@lru_cache(maxsize=64)
def _longest_first(terms: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    """A word list's terms, each with its lower-case form."""
    return tuple((t, t.lower()) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def contextual_terms(text: str) -> list[str]:
    return [name for name, pattern in X.CONTEXTUAL if re.search(pattern, squash(text).lower())]


def generic(term: str) -> bool:
    own = squash(term).lower()
    return own in X.GENERIC_PHRASES or all(w in X.GENERIC_SINGLES for w in own.split())


def prune(aspects: list[str], contextual: list[str]) -> tuple[list[str], list[dict[str, str]]]:
    """must aspects without review contexts and generic ones, with reasons; the most specific if all would go."""
    context = {c.lower() for c in contextual}
    why = {a: "review_context" if a.lower() in context else "generic" if generic(a) else "" for a in aspects}
    kept = [a for a in aspects if not why[a]]
    gone = [{"term": a, "reason": r} for a, r in why.items() if r]
    if not kept:
        rest = sorted((a for a in aspects if why[a] != "review_context"), key=lambda a: (-len(a.replace(" ", "")), a.count(" "), a))
        kept = rest[:1]
        gone = [g for g in gone if g["term"] not in kept]
    return kept, gone


def contract(raw: list[str], context: list[str], forbidden: list[str], fallback: list[str]) -> dict[str, Any]:
    """Must aspects as given, cleaned and pruned, and why some went."""
    clean = unique([strip(t, forbidden) for t in raw]) or unique(fallback)
    kept, gone = prune(clean, context)
    return {"raw_must_aspects": unique(raw), "normalized_must_aspects": clean, "pruned_must_aspects": kept, "must_aspect_prune_reasons": gone}


def contract_of(plan: QueryPlan) -> dict[str, Any]:
    """L7 for a finished plan."""
    context = list(plan.intent_flags.get("review_targets") or contextual_terms(plan.query))
    return contract(plan.must_aspects or plan.retrieval_core, context, unique(plan.role_terms + plan.action_terms + plan.generic_terms), plan.retrieval_core)


def constrain(plan: QueryPlan, filters: dict[str, Any] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, top_k: int | None = None, contextual: list[str] | None = None) -> QueryPlan:
    """L4: what a request and the fixed word lists impose on a plan, wherever it came from."""
    if top_k is not None and not 1 <= top_k <= 15:
        raise ValueError("top_k lies between 1 and 15")
    query = squash(plan.query)
    plan.intent_summary = squash(plan.intent_summary) or query
    context = unique([*(contextual or []), *contextual_terms(query)])
    plan.role_terms = unique(plan.role_terms + found(query, X.ROLE_TERMS))
    plan.action_terms = unique(plan.action_terms + found(query, X.ACTION_TERMS))
    plan.generic_terms = unique(plan.generic_terms + found(query, X.GENERIC_TERMS))
    if context:
        plan.generic_terms = [t for t in plan.generic_terms if t.lower() not in ("평가", "evaluation")]
    forbidden = unique(plan.noise_terms + plan.role_terms + plan.action_terms + plan.generic_terms)
    clean = lambda terms: unique([strip(t, forbidden) for t in terms])
    lower = {c.lower() for c in context}
    plan.retrieval_core = [t for t in clean(plan.retrieval_core) if t.lower() not in lower]
    plan.must_aspects = prune(clean(plan.must_aspects or plan.retrieval_core) or plan.retrieval_core, context)[0]
    plan.intent_flags = {k: v for k, v in plan.intent_flags.items() if k not in ("review_context", "review_targets")}
    if context:
        plan.intent_flags |= {"review_context": True, "review_targets": context}
    plan.bundle_ids = [b for b in unique(plan.bundle_ids) if b in X.EXPANSION]
    plan.semantic_query = strip(plan.semantic_query, forbidden) if plan.semantic_query else " ".join(plan.retrieval_core) or plan.intent_summary
    plan.hyde_document = strip(plan.hyde_document, forbidden)
    plan.evidence_aspects = [t for t in clean(plan.evidence_aspects) if not generic(t)] or list(plan.must_aspects)
    plan.hard_filters = {**plan.hard_filters, **(filters or {})}
    plan.include_orgs = list(dict.fromkeys([*plan.include_orgs, *(include or [])]))
    plan.exclude_orgs = list(dict.fromkeys([*plan.exclude_orgs, *(exclude or [])]))
    plan.top_k = top_k if top_k is not None else plan.top_k
    return plan


def fallback_plan(text: str, **request: Any) -> QueryPlan:
    """L6, our default planner: the query without meta terms, its tokens as core and aspects."""
    query = squash(", ".join(line.strip() for line in text.split("\n") if line.strip()))
    meta = found(query, X.ROLE_TERMS) + found(query, X.ACTION_TERMS) + found(query, X.GENERIC_TERMS)
    terms = unique([t for t in strip(query, meta).split() if len(t) >= 2])
    return constrain(QueryPlan(query=query, intent_summary=f"[Fallback] {query}", retrieval_core=terms, must_aspects=list(terms)), **request)


def heuristic_plan(text: str, **request: Any) -> QueryPlan:
    """L1: the query as intent and nothing else; without a core, retrieval is skipped. Not the default."""
    query = squash(text)
    filters, include, exclude, top_k = (request.get(k) for k in ("filters", "include", "exclude", "top_k"))
    return QueryPlan(query=query, intent_summary=query, hard_filters=dict(filters or {}), include_orgs=list(include or []), exclude_orgs=list(exclude or []), top_k=top_k or 15)


def plan_with(planner: Any, text: str, attempts: int = 2, **request: Any) -> QueryPlan:
    """A pluggable planner, tried again while its core stays empty or it fails; then the fallback."""
    for _ in range(attempts):
        try:
            plan = constrain(planner(text), **request)
        except Exception:  # noqa: BLE001  any failure of an outside planner means another try
            continue
        if plan.retrieval_core:
            return plan
    return fallback_plan(text, **request)


def expansion(bundle_ids: list[str], branch: str) -> list[str]:
    """F31, in a fixed order."""
    return sorted({k for b in bundle_ids for k in X.EXPANSION.get(b, {}).get(branch, ())})


def lexicon_summary() -> str:
    """F32."""
    return "\n".join(f"- {name}: {text}" for name, text in X.EXPANSION_SUMMARY.items())


def single_text(plan: QueryPlan) -> str:
    """R1d: the keywords in one string, else the intent."""
    return " ".join(unique(plan.retrieval_core)) or plan.intent_summary


def plans(texts: DataFrame, column: str = "text") -> DataFrame:
    """L4, L6 over a table of queries: the deterministic planner in Arrow batches; adds core, must, role, action and generic terms and review targets."""

    def run(frames):
        for frame in frames:
            own = [fallback_plan(t or "") for t in frame[column]]
            yield frame.assign(core=[p.retrieval_core for p in own], must=[p.must_aspects for p in own], evidence=[p.evidence_aspects for p in own], roles=[p.role_terms for p in own], actions=[p.action_terms for p in own], generics=[p.generic_terms for p in own], targets=[p.intent_flags.get("review_targets", []) for p in own], semantic=[p.semantic_query for p in own])

    lists = ", ".join(f"{c} array<string>" for c in ("core", "must", "evidence", "roles", "actions", "generics", "targets"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes)
    return texts.mapInPandas(run, f"{kinds}, {lists}, semantic string")


@dataclass(frozen=True)
class BranchQuery:
    branch: str
    path: str
    sparse: str
    dense: str


def branch_queries(plan: QueryPlan, instruct: bool = False) -> list[BranchQuery]:
    """Each branch's stable texts, and expanded ones where they differ."""
    words = unique(" ".join(plan.retrieval_core).split())
    sparse = " ".join(words) or plan.query or plan.intent_summary
    dense = plan.hyde_document or plan.semantic_query or sparse
    out = []
    for branch in X.BRANCHES:
        head = X.INSTRUCTIONS[branch] if instruct else ""
        out.append(BranchQuery(branch, "stable", sparse, head + dense))
        wide = squash(" ".join(unique([sparse, *expansion(plan.bundle_ids, branch)])))
        wide_dense = dense if plan.semantic_query and not plan.hyde_document else wide
        if wide != squash(sparse) or squash(wide_dense) != squash(dense):
            out.append(BranchQuery(branch, "expanded", wide, head + wide_dense))
    return out


def branch_tasks(queries: DataFrame, planner: Any = None, instruct: bool = False) -> DataFrame:
    """L4-L6, R1-R1c, R7 over a table of queries (query_id, text), in Arrow batches: query_id, branch, path, sparse, dense of each search task. Without keywords a query has none."""

    def run(frames):
        for frame in frames:
            rows = []
            for query, text in zip(frame["query_id"], frame["text"], strict=True):
                plan = plan_with(planner, text or "") if planner else fallback_plan(text or "")
                rows += [(query, t.branch, t.path, t.sparse, t.dense) for t in branch_queries(plan, instruct)] if plan.retrieval_core else []
            yield pd.DataFrame(rows, columns=["query_id", "branch", "path", "sparse", "dense"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "text").mapInPandas(run, f"query_id {kind}, branch string, path string, sparse string, dense string")
