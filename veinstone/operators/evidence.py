"""Cards and evidence: nested sorts, lexical scores, order, dedup, quota selection, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, date_key, fold, snippet, year

CAP, PER_ASPECT, WINDOW_YEARS = 4, 2, 19


def latest_first(array: Column | str, date: str, title: str = "title") -> Column:
    """By date, then title, descending; equal ones keep their order."""
    keyed = F.transform(array, lambda x, i: F.struct(date_key(x[date]).alias("d"), x[title].alias("t"), (-i).alias("i"), x.alias("x")))
    return F.transform(F.reverse(F.array_sort(keyed)), lambda k: k["x"])


def presence(people: DataFrame) -> DataFrame:
    """Presence flags and counts."""
    has = {"art": "publications", "pat": "patents", "pjt": "projects"}
    return people.select("expert_id", F.lit(False).alias("basic"), *((F.size(c) > 0).alias(b) for b, c in has.items()))


def gaps() -> Column:
    """E4."""
    return F.array_compact(F.array(*(F.when(F.size(c) == 0, f"{n} evidence is missing.") for n, c in (("Publication", "publications"), ("Patent", "patents"), ("Project", "projects")))))


def risks(data_gaps: Column) -> Column:
    return F.when(F.size(data_gaps) >= 2, F.array(F.lit("Evidence coverage is limited."))).otherwise(F.array().cast("array<string>"))


def filter_summary(filters: dict) -> Column:
    """E3."""
    parts = [
        F.when(F.lit(bool(filters.get("degree_slct_nm"))), F.concat(F.lit("Degree filter matched: "), F.coalesce(F.nullif("degree", F.lit("")), F.lit("unknown")))),
        F.when(F.lit(filters.get("art_sci_slct_nm") == "SCIE"), F.concat(F.lit("SCIE count: "), F.col("scie_cnt"))),
        F.when(F.lit(filters.get("project_cnt_min") is not None), F.concat(F.lit("Project count: "), F.col("project_cnt"))),
    ]
    return F.array_compact(F.array(*parts))


def cards(people: DataFrame, filters: dict | None = None) -> DataFrame:
    """What a candidate shows."""
    counts = F.create_map(*(x for c in ("article_cnt", "scie_cnt", "patent_cnt", "project_cnt") for x in (F.lit(c), F.col(c))))
    return people.select(
        "expert_id", "name", "org", "degree", counts.alias("counts"), latest_first("publications", "date").alias("publications"), latest_first("patents", "date").alias("patents"),
        latest_first("projects", "end").alias("projects"), filter_summary(filters or {}).alias("matched_filters"), gaps().alias("data_gaps"), risks(gaps()).alias("risks"),
    )


def _holds(text: str, term: str) -> Column:
    """Containment in the folded column, with or without spaces; the latter matches across words by design."""
    own = " ".join(term.split()).lower()
    return F.contains(f"__{text}", F.lit(own)) | F.contains(f"__{text}_compact", F.lit(own.replace(" ", "")))


def score_items(items: DataFrame, aspects: list[str], generic: list[str], reference_year: int) -> DataFrame:
    """E7, E8, E10, E11 over flat items (expert_id, type, item_id, title, body, date).

    Base score by position in an expert's latest-first order of the type; +8 for an aspect that is the
    title, +5 for one in it, +3 for one in the body, +1 for each further aspect, +0.5 if recent. Items are dealt out by
    expert once, which serves the windows of scores, dedup, ranks and quota alike.
    """
    items = items.repartition("expert_id")
    own = Window.partitionBy("expert_id", "type")
    at = F.row_number().over(own.orderBy(date_key("date").desc(), F.desc("title"), "item_id"))
    n = F.count(F.lit(1)).over(own)
    base = F.lit(1.0) + (n - at + 1) * 0.1
    hits, points = [], F.lit(0.0)
    for aspect in aspects:
        low = " ".join(aspect.split()).lower()
        same = (F.col("__title") == low) | (F.col("__title_compact") == low.replace(" ", ""))
        title, body = _holds("title", aspect), _holds("body", aspect)
        points = points + F.when(same, 8.0).when(title, 5.0).otherwise(0.0) + F.when(body, 3.0).otherwise(0.0)
        hits.append(F.when(title | body, F.lit(aspect)))
    matched = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    loose = F.array_compact(F.array(*(F.when(_holds("title", g) | _holds("body", g), F.lit(g)) for g in generic))) if generic else F.array().cast("array<string>")
    more = F.when(F.size("aspects") > 1, F.size("aspects") - 1.0).otherwise(0.0)
    recent = F.when((F.size("aspects") > 0) & (F.col("year") >= reference_year - WINDOW_YEARS), 0.5).otherwise(0.0)
    # Each text is folded once; what follows refers to these columns.
    items = items.withColumns({"__title": fold("title"), "__body": fold("body")})
    items = items.withColumns({f"__{c}_compact": F.replace(f"__{c}", F.lit(" "), F.lit("")) for c in ("title", "body")})
    out = items.withColumns({"base": base, "aspects": matched, "generic": loose, "year": year("date"), "points": points})
    more_columns = [c for c in ("detail", "main", "secondary", "metadata") if c in items.columns]
    return out.select(
        "expert_id", "type", "item_id", "title", "body", "date", *more_columns, "year", "aspects", "generic", (F.size("aspects") > 0).alias("direct"), F.round(F.col("base") + F.col("points") + more + recent, 6).alias("score"),
        ((F.col("type") == "project") & F.coalesce(F.col("year") > reference_year, F.lit(False))).alias("is_future"),
    )


def order() -> list[Column]:
    """E12."""
    return [F.desc("direct"), F.desc(F.size("aspects")), F.desc("score"), F.coalesce("year", F.lit(0)).desc(), F.asc("title"), F.asc("item_id")]


def ranked(items: DataFrame) -> DataFrame:
    return items.withColumn("item_rank", F.row_number().over(Window.partitionBy("expert_id").orderBy(*order())))


def dedup(items: DataFrame) -> DataFrame:
    """Of items with one compact title and year the first in order, across types; a null year is a year of its own."""
    first = Window.partitionBy("expert_id", compact("title"), "year").orderBy(*order())
    return items.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _about(aspect: str):
    return lambda x: F.array_contains(x["aspects"], aspect)


def _typed(kind: str):
    return lambda x: x["type"] == kind


def select_quota(items: DataFrame, aspects: list[str], cap: int = CAP, per_aspect: int = PER_ASPECT) -> DataFrame:
    """expert_id, selected (ordered item structs), by one fold over each expert's ordered direct items.

    First every aspect not yet covered takes the best item that holds it; then the order fills up, leaving
    out items with an aspect that has per_aspect already; cap in all. A first-pass item covers all its aspects.

    Ids may repeat, and an id is chosen once. Of items with the same set of aspects and one id only the first can be chosen,
    and of those with the same set only the ones with the first cap ids: if one is left out and its id is not chosen, all
    later ones are. So a row holds at most cap items for each set, however many an expert has; texts are cut to
    snippets there and bodies never collected.
    """
    return _quota(items, aspects, cap, per_aspect).select("expert_id", "selected")


def _quota(items: DataFrame, aspects: list[str], cap: int, per_aspect: int, *more: Column) -> DataFrame:
    """select_quota with more aggregates of all of an expert's items, by the same pass over them."""
    own = ("expert_id", "direct", F.array_join("aspects", "\x1f"))
    kept = ranked(items).withColumn("__first", F.row_number().over(Window.partitionBy(*own, F.when(F.col("direct"), F.col("item_id"))).orderBy("item_rank")) == 1)
    # First ones of an id come before repeated ones, so their numbers have no gaps.
    kept = kept.withColumn("__same", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("__first"), "item_rank")))
    extra = [F.col("detail") if "detail" in items.columns else F.col("body").alias("detail"), rich_snippet(items).alias("snippet")]
    row = F.struct("item_rank", "item_id", "type", "title", "date", "aspects", "generic", "score", "is_future", *extra)
    can = F.col("direct") & F.col("__first") & (F.col("__same") <= cap)
    direct = kept.groupBy("expert_id").agg(F.array_sort(F.collect_list(F.when(can, row))).alias("items"), *more)
    chosen = F.filter("items", lambda x: F.lit(False))
    have = lambda a: F.flatten(F.transform(a, lambda x: x["aspects"]))
    out = direct.withColumn("chosen", chosen)
    for aspect in aspects:
        best = F.filter("items", _about(aspect))
        take = (~F.array_contains(have(F.col("chosen")), aspect)) & (F.size(best) > 0) & (F.size("chosen") < cap)
        out = out.withColumn("chosen", F.when(take, F.concat("chosen", F.slice(best, 1, 1))).otherwise(F.col("chosen")))

    def fill(acc: Column, x: Column) -> Column:
        full = F.exists(x["aspects"], lambda a: F.size(F.filter(have(acc), lambda b: b == a)) >= per_aspect)
        taken = F.exists(acc, lambda y: y["item_id"] == x["item_id"])
        return F.when((F.size(acc) < cap) & ~full & ~taken, F.concat(acc, F.array(x))).otherwise(acc)

    return out.withColumn("selected", F.array_sort(F.aggregate("items", F.col("chosen"), fill))).drop("items", "chosen")


def rich_snippet(items: DataFrame) -> Column:
    """F21 for an evidence item: its metadata line and the text around what matched."""
    matched = F.array_distinct(F.concat("aspects", F.when(F.size("aspects") == 0, F.col("generic")).otherwise(F.array().cast("array<string>"))))
    if "main" not in items.columns:
        return snippet("body", matched)
    text = F.concat_ws(" ", F.nullif("main", F.lit("")), F.nullif("secondary", F.lit("")))
    return F.nullif(F.concat_ws("\n", "metadata", snippet(text, matched)), F.lit(""))


def matched_keywords(item: Column) -> Column:
    """Aspects and generic terms of an item, each once."""
    return F.array_distinct(F.concat(item["aspects"], item["generic"]))


def selection_trace(bundle: DataFrame, dropped: DataFrame) -> DataFrame:
    """A row of diagnostics for each candidate. dropped: expert_id, dedup_dropped_count."""
    of = lambda t: F.size(F.filter("selected", _typed(t)))
    ids = F.coalesce(F.transform("selected", lambda x: x["item_id"]), F.array().cast("array<string>"))
    return bundle.join(dropped, "expert_id", "left").select(
        "expert_id", ids.alias("selected_evidence_ids"), "direct_match_count", "aspect_coverage", "generic_only", "matched_aspects", F.col("generic_terms").alias("matched_generic_terms"),
        F.coalesce("dedup_dropped_count", F.lit(0)).alias("dedup_dropped_count"), F.col("future_ids").alias("future_selected_evidence_ids"), of("paper").alias("papers"), of("project").alias("projects"), of("patent").alias("patents"),
        F.size(ids).alias("total"),
    )


def dedup_dropped(scored: DataFrame, kept: DataFrame) -> DataFrame:
    """How many items of an expert dedup has left out."""
    n = lambda f, c: f.groupBy("expert_id").agg(F.count(F.lit(1)).alias(c))
    return n(scored, "__all").join(n(kept, "__kept"), "expert_id").select("expert_id", (F.col("__all") - F.col("__kept")).alias("dedup_dropped_count"))


def prefix(cards: DataFrame, limit: int, *order: str) -> DataFrame:
    """E5: the first cards."""
    return cards.orderBy(*order).limit(limit)


def bundles(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Aspects of what was selected; generic terms, direct matches and futures of all deduplicated items."""
    return _bundled(items.groupBy("expert_id").agg(*_stats()).join(selected.select("expert_id", "selected"), "expert_id", "left"))


def quota_bundles(items: DataFrame, aspects: list[str], cap: int = CAP, per_aspect: int = PER_ASPECT) -> DataFrame:
    """bundles(items, select_quota(items, aspects)) by one pass: items are scored and ordered once, and nothing is joined."""
    return _bundled(_quota(items, aspects, cap, per_aspect, *_stats()))


def _stats() -> tuple[Column, Column]:
    return F.count_if("direct").alias("direct_match_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("generic")))).alias("generic_terms")


def _bundled(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("matched_aspects", F.array_sort(F.array_distinct(F.flatten(F.transform("selected", lambda x: x["aspects"])))))
    return out.select(
        "expert_id", "direct_match_count", "generic_terms", "matched_aspects", F.size("matched_aspects").alias("aspect_coverage"),
        ((F.col("direct_match_count") == 0) & (F.size("generic_terms") > 0)).alias("generic_only"),
        F.transform(F.filter("selected", lambda x: x["is_future"]), lambda x: x["item_id"]).alias("future_ids"),
        by_type("selected").alias("selected"),
    )


def by_type(selected: Column | str) -> Column:
    """Papers, projects, patents."""
    return F.concat(*(F.filter(selected, _typed(t)) for t in ("paper", "project", "patent")))
