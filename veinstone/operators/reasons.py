"""Reason generation: what a generator is told, its answers read back, retries by batch, traces.

A generator is a callable: the JSON text of a batch's payloads to text that holds a JSON object
{"items": [{"expert_id", "fit", "recommendation_reason", "risks"}], "data_gaps": [...]}.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_scan import extract_json, first_object
from ..functions.text import collapse, token_estimate, truncate
from .evidence import matched_keywords
from .recommend import FITS, batch_of

BATCH = 5


@dataclass(frozen=True)
class Profile:
    """How much a payload may hold."""

    name: str
    trimmed: bool
    items: int
    keywords: int
    snippet: int
    detail: int
    person: int


#: Fixed values.
PRIMARY = Profile("primary", False, 4, 5, 1000, 200, 80)
COMPACT = Profile("retry_compact", True, 2, 3, 280, 120, 60)


def payloads(short: DataFrame, profile: Profile = PRIMARY, size: int = BATCH) -> DataFrame:
    """expert_id, rank, batch_id, payload (JSON), tokens. short: a shortlist with name, org, degree, score, selected, bundle columns, grounding.

    do_not_mention holds the batch's other names and all item ids of the shortlist (15 rows at most, so the windows are small).
    """
    cut = lambda c, n: truncate(c, n)
    person = F.coalesce(F.nullif(cut("name", profile.person), F.lit("")), F.col("expert_id").cast("string"))
    rows = short.withColumns({"batch_id": batch_of("rank", size), "person": person})
    ids = F.coalesce(F.transform("selected", lambda x: x["item_id"]), F.array().cast("array<string>"))
    own = Window.partitionBy("batch_id")
    rows = rows.withColumns({"others": F.collect_list(F.struct("expert_id", "person")).over(own), "ids": F.array_distinct(F.flatten(F.collect_list(ids).over(Window.partitionBy())))})
    names = F.transform(F.filter("others", lambda o: o["expert_id"] != F.col("expert_id")), lambda o: o["person"])
    item = lambda x: F.struct(
        x["item_id"].alias("evidence_id"), x["type"].alias("type"), cut(x["title"], profile.detail).alias("title"), x["date"].alias("date"), cut(x["detail"], profile.detail).alias("detail"),
        cut(x["snippet"], profile.snippet).alias("snippet"), F.slice(matched_keywords(x), 1, profile.keywords).alias("matched_keywords"), x["aspects"].alias("aspect_matches"), (F.size(x["aspects"]) > 0).alias("direct_match"),
    )
    told = F.struct(
        "expert_id", F.col("person").alias("candidate_name"), cut("org", profile.detail).alias("organization"), cut("degree", profile.detail).alias("degree"), F.col("score").alias("rank_score"),
        F.col("grounding").alias("retrieval_grounding"), F.transform(F.slice("selected", 1, profile.items), item).alias("selected_evidence"),
        F.struct("direct_match_count", "aspect_coverage", "matched_aspects", "generic_only").alias("selected_evidence_summary"),
        F.array_sort(F.array_distinct(F.concat(names, "ids"))).alias("do_not_mention"),
    )
    return rows.select("expert_id", "rank", "batch_id", F.to_json(told).alias("payload")).withColumn("tokens", token_estimate("payload"))


ITEMS = "struct<items:array<struct<expert_id:string,fit:string,recommendation_reason:string,risks:array<string>>>,data_gaps:array<string>>"


def generate(batches: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """N4 over many batches: batches (batch_id, payload) -> batch_id, raw, error; the client is called on the executors, a row at a time in Arrow batches."""

    def run(frames):
        for frame in frames:
            raw, error = [], []
            for text in frame["payload"]:
                try:
                    raw.append(client(text))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  an outside client's failure is an answer
                    raw.append(None)
                    error.append(str(e))
            yield frame[["batch_id"]].assign(raw=raw, error=error)

    return batches.select(F.col("batch_id").cast("long").alias("batch_id"), "payload").mapInPandas(run, "batch_id long, raw string, error string")


def parsed(answers: DataFrame) -> DataFrame:
    """batch_id, raw -> batch_id, pos, expert_id (as text), fit, reason, risks: the first JSON object's items."""
    body = F.from_json(extract_json(F.col("raw")), ITEMS)
    rows = answers.select("batch_id", F.posexplode(body["items"]).alias("pos", "i"))
    return rows.select("batch_id", "pos", F.col("i.expert_id").alias("expert_id"), F.col("i.fit").alias("fit"), F.col("i.recommendation_reason").alias("reason"), F.col("i.risks").alias("risks"))


def data_gaps(answers: DataFrame) -> DataFrame:
    """The answers' gaps in order of batch and place, each once."""
    rows = answers.select("batch_id", F.posexplode(F.from_json(extract_json(F.col("raw")), ITEMS)["data_gaps"]).alias("pos", "gap"))
    return rows.withColumn("gap", collapse("gap")).where("gap <> ''").groupBy("gap").agg(F.min(F.struct("batch_id", "pos")).alias("at")).orderBy("at").select("gap")


def batch_stats(candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    """N5, N6 by batch: what is missing or empty, the share returned, and why to try again. candidates: batch_id, expert_id; outputs: batch_id, pos, expert_id, reason."""
    last = outputs.groupBy("batch_id", F.col("expert_id").cast("string").alias("id")).agg(F.max_by(collapse("reason"), "pos").alias("reason"))
    rows = candidates.withColumn("id", F.col("expert_id").cast("string")).join(last.withColumn("found", F.lit(True)), ["batch_id", "id"], "left")
    missing, empty = F.col("found").isNull(), F.coalesce("reason", F.lit("")) == ""
    ratio = F.bround(F.count_if(~missing) / F.count(F.lit(1)), 3)
    out = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(missing).alias("missing"), F.count_if(empty).alias("empty"), ratio.alias("returned_ratio"))
    return out.withColumn("retry_trigger", retry_trigger(F.col("missing"), F.col("empty"), F.col("returned_ratio")))


def retry_trigger(missing: Column, empty: Column, ratio: Column) -> Column:
    """Null if nothing calls for another try."""
    return F.when(missing > 0, "missing_candidate_ids").when(empty > 0, "empty_reason_candidate_ids").when(ratio < 1, "partial_return_ratio")


@dataclass
class BatchTrace:
    """What happened to one batch."""

    batch_index: int
    candidate_ids: list
    mode: str = "unknown"
    returned_ids: list = field(default_factory=list)
    missing_candidate_ids: list = field(default_factory=list)
    empty_reason_candidate_ids: list = field(default_factory=list)
    returned_ratio: float = 0.0
    retry_count: int = 0
    retry_trigger: str | None = None
    retry_reason: str | None = None
    prompt_budget_mode: str = ""
    attempts: list = field(default_factory=list)

    def asdict(self) -> dict[str, Any]:
        return self.__dict__ | {"batch_size": len(self.candidate_ids), "retry_triggered": self.retry_trigger is not None}


def read_back(raw: str, candidates: list[dict]) -> tuple[list[dict], list[str], BatchTrace]:
    """N5 for one batch at the driver: an item for each candidate in order, the data gaps, what is missing or blank."""
    text = first_object(raw)
    if text is None:
        raise ValueError("no JSON object in the answer")
    body = json.loads(text)
    by = {str(i.get("expert_id")): i for i in body.get("items") or [] if isinstance(i, dict)}
    trace = BatchTrace(0, [c["expert_id"] for c in candidates])
    items = []
    for c in candidates:
        got = by.get(str(c["expert_id"]))
        reason = " ".join(str((got or {}).get("recommendation_reason") or "").split())
        if got is None:
            trace.missing_candidate_ids.append(c["expert_id"])
        else:
            trace.returned_ids.append(c["expert_id"])
        if not reason:
            trace.empty_reason_candidate_ids.append(c["expert_id"])
        fit = got.get("fit") if got else None
        items.append({"expert_id": c["expert_id"], "fit": fit if fit in FITS else "보통", "reason": reason, "risks": [str(r) for r in (got.get("risks") or [])] if got else list(c["risks"])})
    trace.returned_ratio = round(len(trace.returned_ids) / len(candidates), 3) if candidates else 0.0
    return items, [str(g) for g in body.get("data_gaps") or []], trace


def _why(trace: BatchTrace) -> tuple[str | None, str | None]:
    for name in ("missing_candidate_ids", "empty_reason_candidate_ids"):
        if ids := getattr(trace, name):
            return name, f"{name}={ids} returned_ratio={trace.returned_ratio:.3f}"
    return ("partial_return_ratio", f"returned_ratio={trace.returned_ratio:.3f}") if trace.returned_ratio < 1 else (None, None)


def pass_through(candidates: list[dict]) -> list[dict]:
    """Every candidate with a neutral fit, no reason and its card's risks."""
    return [{"expert_id": c["expert_id"], "fit": "보통", "reason": "", "risks": list(c["risks"])} for c in candidates]


def batch_reasons(index: int, candidates: list[dict], told: dict[str, list[str]], client: Callable[[str], str] | None) -> tuple[list[dict], list[str], BatchTrace]:
    """One batch, first with full payloads, then with compact ones, then passed through. told: payloads by profile name."""
    if client is None:
        ids = [c["expert_id"] for c in candidates]
        return pass_through(candidates), [], BatchTrace(index, ids, "pass_through", returned_ids=list(ids), empty_reason_candidate_ids=list(ids), returned_ratio=1.0)
    attempts: list[dict] = []
    trigger = reason = None
    for retry, profile in enumerate((PRIMARY, COMPACT)):
        note = {"retry_index": retry, "prompt_budget_mode": profile.name, "trim_applied": profile.trimmed}
        try:
            items, gaps, trace = read_back(client("[" + ",".join(told[profile.name]) + "]"), candidates)
        except Exception as e:  # noqa: BLE001  any failure of an outside client means another try
            attempts.append(note | {"status": "error", "reason": str(e)})
            continue
        now, text = _why(trace)
        if now and retry == 0:
            trigger, reason = now, text
            attempts.append(note | {"status": "retry_scheduled", "retry_trigger": now, "reason": text, "returned_ids": trace.returned_ids})
            continue
        trace.batch_index, trace.mode, trace.retry_count = index, "client", retry
        trace.retry_trigger, trace.retry_reason, trace.prompt_budget_mode = trigger, reason, profile.name
        trace.attempts = [*attempts, note | {"status": "ok", "returned_ids": trace.returned_ids}]
        return items, gaps, trace
    items = pass_through(candidates)
    ids = [c["expert_id"] for c in candidates]
    return items, [], BatchTrace(index, ids, "fallback", ids, [], ids, 1.0, 2, trigger, reason, "fallback", attempts)


def in_batches(short: list[dict], told: dict[str, dict[Any, str]], client: Callable[[str], str] | None, size: int = BATCH) -> Iterator[tuple[list[dict], list[str], BatchTrace]]:
    """The shortlist's batches one after the other. told: payload by profile name and expert_id."""
    size = size if size > 0 else max(1, len(short))
    for i in range(0, len(short), size):
        own = short[i : i + size]
        yield batch_reasons(i // size + 1, own, {p: [by[c["expert_id"]] for c in own] for p, by in told.items()}, client)


def generation_summary(candidates: int, outputs: int, traces: list[BatchTrace], size: int = BATCH) -> dict[str, Any]:
    """G15."""
    modes = {t.mode for t in traces}
    return {
        "mode": modes.pop() if len(modes) == 1 else "mixed", "candidate_count": candidates, "output_count": outputs, "batch_count": len(traces), "batch_size": size,
        "reason_generation_failed": any(t.returned_ratio == 0 for t in traces), "batches": [t.asdict() for t in traces],
    }
