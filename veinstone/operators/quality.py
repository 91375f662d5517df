"""Data quality: completeness, best sample, readiness (V1-V3), index checks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHECKS = ("has_name", "has_org", "has_papers", "has_patents", "has_projects", "projects_dated")
OPTIONAL = ("has_patents",)
#: Rows that a readiness check looks at.
SAMPLE = 256


def completeness(people: DataFrame) -> DataFrame:
    """V1: a boolean for each check."""
    full = F.size("projects") > 0
    dated = F.forall("projects", lambda p: p["start"].isNotNull() & p["end"].isNotNull())
    cols = (F.coalesce("name", F.lit("")) != "", F.coalesce("org", F.lit("")) != "", F.size("publications") > 0, F.size("patents") > 0, full, full & dated)
    return people.select("expert_id", *(c.alias(n) for c, n in zip(cols, CHECKS, strict=True)))


def sample(people: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The first rows by id; each task keeps only its own first ones."""
    return people.orderBy("expert_id").limit(limit)


def best_sample(checked: DataFrame) -> DataFrame:
    """V2: the first row with the highest score."""
    score = sum((F.col(c).cast("int") for c in CHECKS), F.lit(0))
    return checked.withColumn("score", score).orderBy(F.desc("score"), "expert_id").limit(1)


def report(checked: DataFrame) -> DataFrame:
    """V3 on rows: whether all that must hold do in the best sample, and what does not."""
    best = best_sample(checked)
    need = [c for c in CHECKS if c not in OPTIONAL]
    ready = F.lit(True)
    for c in need:
        ready = ready & F.col(c)
    return best.select("expert_id", "score", ready.alias("ready"), F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c)) for c in CHECKS))).alias("issues"))


def readiness(people: DataFrame, points: DataFrame | None = None, index: Any = None, modifier: str | None = None, required: tuple[str, ...] = (), backends: dict[str, bool] | None = None, limit: int = SAMPLE) -> dict[str, Any]:
    """V3: checks, issues and ready, of collection, vectors, index, columns and the best of a bounded sample."""
    checks: dict[str, bool] = {f"{k}_connected": v for k, v in (backends or {}).items()}
    issues = [f"backend {k} is not reachable" for k, v in (backends or {}).items() if not v]

    def check(name: str, good: bool, issue: str) -> None:
        checks[name] = good
        if not good:
            issues.append(issue)

    check("collection_exists", points is not None, "the collection of points is missing")
    if points is not None:
        check("dense_vectors_present", "embedding" in points.columns, "points have no embedding column")
        check("sparse_vectors_present", index is not None, "the sparse index is missing")
        check("sparse_vectors_idf", modifier in (None, "idf"), f"the sparse weights' modifier is {modifier}")
        gone = sorted(set(required) - set(people.columns))
        check("payload_indexes_present", not gone, f"filterable columns are missing: {gone}")
        found = report(completeness(sample(people, limit))).first()
        check("sample_point_exists", found is not None, "no sample can be read")
        if found is not None:
            for c in CHECKS:
                checks[f"sample_{c}"] = c not in found.issues
            issues += [f"sample {found.expert_id}: {c} fails" for c in found.issues if c not in OPTIONAL]
    optional = {f"sample_{c}" for c in OPTIONAL}
    return {"ready": all(v for k, v in checks.items() if k not in optional), "checks": checks, "issues": issues, "sample_id": found.expert_id if points is not None and found is not None else None}


def validate_settings(strict: bool, generator: Any, query_vector: Any, seeded: bool) -> None:
    """V4: in strict operation the deterministic stand-ins and seeded data are errors."""
    if strict and generator is None:
        raise RuntimeError("strict operation needs a generator of reasons")
    if strict and query_vector is None:
        raise RuntimeError("strict operation needs an encoder of queries")
    if strict and seeded:
        raise RuntimeError("strict operation does not run on seeded data")


def missing_keys(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """J10."""
    return required.join(available, key, "left_anti")


def fulfilled(checked: DataFrame) -> DataFrame:
    return checked.agg(*(F.count_if(c).alias(c) for c in CHECKS), F.count(F.lit(1)).alias("n"))
