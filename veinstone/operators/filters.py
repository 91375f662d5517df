"""Hard filters compiled to one Column over nested experts."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_org

COUNTS = {"article_cnt_min": "article_cnt", "scie_cnt_min": "scie_cnt", "patent_cnt_min": "patent_cnt", "project_cnt_min": "project_cnt"}
KNOWN = {"degree_slct_nm", "art_sci_slct_nm", "art_recent_years", "pat_reg_slct_nm", "pat_recent_years", "pjt_recent_years", "major", *COUNTS}


def at_least(conditions: list[Column], n: int) -> Column:
    """n of the conditions hold."""
    if n == 1:
        return reduce(lambda a, b: a | b, conditions)
    return reduce(lambda a, b: a + b, (c.cast("int") for c in conditions)) >= n


def _element(date: str, cutoff: Column | None, field: str | None = None, value: str | None = None):
    """A condition on one element: recent enough and of a kind, where asked for."""

    def holds(e: Column) -> Column:
        recent = e[date] >= cutoff if cutoff is not None else F.lit(True)
        return recent & (e[field] == value) if field else recent

    return holds


def compile_filters(filters: dict[str, Any], include: list[str] | None = None, exclude: list[str] | None = None, as_of: int = 0, include_any: bool = False) -> Column | None:
    """The conjunction of all conditions, or None without any (P10). as_of: the year that recency counts back from.

    Qualified nested conditions hold on one element and stay conjuncts; unqualified recency conditions of
    several kinds form one disjunction (P7).
    """
    unknown = set(filters) - KNOWN
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    must: list[Column] = []
    pool: list[Column] = []
    if include:
        orgs = [normalize_org(F.lit(o)) for o in include]
        hits = [normalize_org("org") == o for o in orgs]
        must += [at_least(hits, 1)] if include_any else hits
    if degree := filters.get("degree_slct_nm"):
        must.append(F.col("degree").isin(degree if isinstance(degree, (list, tuple)) else [degree]))
    must += [F.col(column) >= filters[name] for name, column in COUNTS.items() if filters.get(name) is not None]
    cutoff = lambda years: F.lit(f"{as_of - int(years)}-01-01")
    for column, kind, field, recent in (("publications", "art_sci_slct_nm", "index_type", "art_recent_years"), ("patents", "pat_reg_slct_nm", "registration_type", "pat_recent_years"), ("projects", None, None, "pjt_recent_years")):
        kinds = filters.get(kind) if kind else None
        years = filters.get(recent)
        date = "end" if column == "projects" else "date"
        if kinds:
            must.append(F.exists(column, _element(date, cutoff(years) if years else None, field, kinds)))
        elif years:
            pool.append(F.exists(column, _element(date, cutoff(years))))
    must += pool if len(pool) == 1 else [at_least(pool, 1)] if pool else []
    if major := filters.get("major"):
        must.append(F.contains("major", F.lit(major)))
    must += [~normalize_org("org").eqNullSafe(normalize_org(F.lit(o))) for o in exclude or []]
    return reduce(lambda a, b: a & b, must) if must else None


#: The columns of people that a filter reads.
COLUMNS = {"degree_slct_nm": "degree", "art_sci_slct_nm": "publications", "art_recent_years": "publications", "pat_reg_slct_nm": "patents", "pat_recent_years": "patents", "pjt_recent_years": "projects", "major": "major", **COUNTS}


def apply_filters(people: DataFrame, filters: dict[str, Any], include: list[str] | None = None, exclude: list[str] | None = None, **kwargs: Any) -> DataFrame:
    """people that pass; an error names what people would need to be filtered so."""
    condition = compile_filters(filters, include, exclude, **kwargs)
    need = {COLUMNS[k] for k, v in filters.items() if v is not None} | ({"org"} if include or exclude else set())
    if gone := sorted(need - set(people.columns)):
        raise ValueError(f"people have no columns {gone}, which the filters need")
    return people if condition is None else people.where(condition)


def drop_containing(hits: DataFrame, exclude: list[str]) -> DataFrame:
    """Hits whose normalised organisation contains an excluded one go silently."""
    org = F.coalesce(normalize_org("org"), F.lit(""))
    return reduce(lambda f, o: f.where(~F.coalesce(F.contains(org, normalize_org(F.lit(o))), F.lit(False))), exclude, hits)
