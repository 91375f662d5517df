"""Gates, batches, reasons, their validation, and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..plans.lexicon import STRONG_MARKERS

# Texts of reasons.
NO_EVIDENCE = "직접적인 질의 일치 근거를 확인하지 못했습니다."
PROFILE_ONLY = "직접적인 질의 일치 근거는 제한적이지만 프로필 기반 후보로 검토되었습니다."
LABELS = {"project": "과제", "paper": "논문", "patent": "특허", "profile": "프로필"}
FITS = ("높음", "중간", "보통")
NO_MATCH = "No matching candidates were found."
GATED_EMPTY = "No candidates satisfied deterministic evidence gates."
SKIPPED = "Retrieval skipped because planner core_keywords were empty after retry."

STATUSES = ("keep", "demote_low_coverage", "demote_generic_only", "demote_no_direct", "drop")


def gate_status(n_targets: int, strict: bool = True) -> Column:
    """G1, G2."""
    need = min(2, n_targets)
    no_direct = F.lit("drop" if strict else "demote_no_direct")
    return F.when(F.coalesce("direct_match_count", F.lit(0)) < 1, no_direct).when(F.coalesce("aspect_coverage", F.lit(0)) < need, "demote_low_coverage").when(F.coalesce("generic_only", F.lit(False)), "demote_generic_only").otherwise("keep")


def gate(candidates: DataFrame, n_targets: int, strict: bool = True) -> DataFrame:
    """candidates (expert_id, retrieval_rank, bundle columns) with status and bucket."""
    bucket = F.when(F.col("status") == "keep", 0).when(F.col("status") == "demote_low_coverage", 1).when(F.col("status") == "demote_generic_only", 2).otherwise(3)
    return candidates.withColumn("status", gate_status(n_targets, strict)).withColumn("bucket", bucket)


def shortlist(gated: DataFrame, top_k: int) -> DataFrame:
    """Gates before top-k; buckets in order, retrieval order inside."""
    first = gated.where("status <> 'drop'").orderBy("bucket", "retrieval_rank").limit(top_k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("bucket", "retrieval_rank")))


def shortlist_by(gated: DataFrame, top_k: int, order: list[Column]) -> DataFrame:
    """G3, G4 where retrieval order is a sort key of the rows: no rank over all of them is needed."""
    first = gated.where("status <> 'drop'").orderBy("bucket", *order).limit(top_k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("bucket", *order)))


def gate_trace(gated: DataFrame) -> DataFrame:
    """G5 as rows, so that no status holds all its candidates in one: expert_id, status, bucket."""
    return gated.select("expert_id", "status", "bucket")


def gate_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def batch_of(rank: Column | str, size: int = 5) -> Column:
    """0-based batches of a rank; size of 0 or less gives one batch."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.lit(0).cast("long") if size <= 0 else F.floor((rank - 1) / size)


EVIDENCE = "array<struct<type:string,title:string,date:string,detail:string,snippet:string>>"


def resolve_evidence(selected: Column | str, name: Column, org: Column, degree: Column, major: Column) -> Column:
    """The selected items, else one profile item if organisation, degree or major is known, else nothing."""
    item = lambda t, title, date, detail, snip: F.struct(t.alias("type"), title.alias("title"), date.alias("date"), detail.alias("detail"), snip.alias("snippet"))
    none, own = F.lit(None).cast("string"), F.transform(selected, lambda x: item(x["type"], x["title"], x["date"], x["detail"], x["snippet"]))
    parts = [(F.nullif(c, F.lit("")), d) for c, d in ((org, "unknown organization"), (degree, "unknown degree"), (major, "unknown major"))]
    text = F.concat_ws(" / ", *(F.coalesce(c, F.lit(d)) for c, d in parts))
    profile = F.when(F.coalesce(*(c for c, _ in parts)).isNotNull(), F.array(item(F.lit("profile"), name, none, text, none))).otherwise(F.array().cast(EVIDENCE))
    return F.when(F.size(selected) > 0, own.cast(EVIDENCE)).otherwise(profile.cast(EVIDENCE))


def evidence_source(evidence: Column | str) -> Column:
    """Where a server-made reason comes from: selected_evidence, profile or empty."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    return F.when(F.size(e) == 0, "empty").when(F.forall(e, lambda x: x["type"] == "profile"), "profile").otherwise("selected_evidence")


def fallback_reason(evidence: Column | str) -> Column:
    """None, profile only, or the first two distinct (type, title)."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    label = lambda t: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), t), t)
    named = F.slice(F.array_distinct(F.transform(F.filter(e, lambda x: x["type"] != "profile"), lambda x: F.concat(F.lit("'"), x["title"], F.lit("' "), label(x["type"])))), 1, 2)
    tail = F.lit("을 통해 질의와 관련된 직접 근거를 확인했습니다.")
    return F.when(F.size(e) == 0, NO_EVIDENCE).when(F.size(named) == 0, PROFILE_ONLY).otherwise(F.concat(F.array_join(named, "과 "), tail))


def violations(reason: str, name: str, evidence: str, others: str, aspects: list[str]) -> Column:
    """G9 over columns: reason, own name, evidence items, all candidates' names. Blank reasons break no rule."""
    text = fold(reason)
    other = F.exists(others, lambda o: (o != F.col(name)) & (F.length(fold(o)) >= 2) & F.contains(text, fold(o)))
    internal = F.col(reason).rlike(r"(?U)\b(?:paper|project|patent):\d+\b")
    scopes = F.transform(F.filter(evidence, lambda x: x["type"] != "profile"), lambda x: fold(F.concat_ws(" ", x["title"], x["detail"], x["snippet"])))
    wanted = F.array(*(F.lit(" ".join(a.split()).lower()) for a in aspects)) if aspects else F.array().cast("array<string>")
    miss = (F.size(wanted) > 0) & (F.size(scopes) > 0) & ~F.exists(wanted, lambda a: F.exists(scopes, lambda s: F.contains(s, a)))
    strong = (F.size(scopes) == 0) & F.exists(F.array(*map(F.lit, STRONG_MARKERS)), lambda m: F.contains(text, m))
    rules = ((other, "other_candidate_name"), (internal, "internal_evidence_id"), (miss, "aspect_scope_miss"), (strong, "strong_claim_without_direct_evidence"))
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(found)


def align_reasons(candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    """Generated rows by candidate, the last of repeats; missing ones default, unknown ones go."""
    last = outputs.groupBy("expert_id").agg(F.max_by(F.struct("fit", "reason"), "pos").alias("o"))
    fit = F.when(F.col("o.fit").isin(*FITS), F.col("o.fit")).otherwise("보통")
    return candidates.join(last, "expert_id", "left").select(*candidates.columns, fit.alias("fit"), F.coalesce(F.trim(F.regexp_replace("o.reason", r"(?U)\s+", " ")), F.lit("")).alias("reason"), F.col("o").isNotNull().alias("returned"))


def missing_ids(candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    """J7."""
    return candidates.select("expert_id").join(outputs, "expert_id", "left_anti")


def assemble(short: DataFrame, aspects: list[str]) -> DataFrame:
    """Short (expert_id, rank, name, org, fit, reason, evidence, risks, score) to recommendations.

    Reasons are checked against all names of the shortlist, which has 15 rows at most: one window holds it. A blank reason and one that breaks a rule are replaced; fallback_source says why (null if the reason stands).
    """
    rows = short.withColumn("names", F.collect_list("name").over(Window.partitionBy())).withColumn("violations", violations("reason", "name", "evidence", "names", aspects))
    source = F.when(F.trim("reason") == "", evidence_source("evidence")).when(F.size("violations") > 0, "reason_sync_validator")
    rows = rows.withColumn("fallback_source", source)
    bad = F.col("fallback_source").isNotNull()
    return rows.select(
        "rank", "expert_id", "name", "org", "fit", F.when(bad, fallback_reason("evidence")).otherwise(F.col("reason")).alias("reason"), "evidence", "risks", "score", "violations", "fallback_source", bad.alias("fallback"),
    ).withColumn("reasons", reasons_alias("reason"))


def reasons_alias(reason: Column | str) -> Column:
    """G14."""
    return F.when(F.trim(reason) != "", F.array(reason)).otherwise(F.array().cast("array<string>"))


def validator_summary(recommendations: DataFrame) -> DataFrame:
    """Replacements by the validator; blank reasons are no violations."""
    n, bad = F.count(F.lit(1)), F.count_if(F.size("violations") > 0)
    return recommendations.agg(n.alias("checked"), bad.alias("fallback_count"), F.when(n > 0, F.bround(bad / n, 3)).otherwise(0.0).alias("fallback_ratio"))
