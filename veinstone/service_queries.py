"""Registered queries of plans, responses and streams as a service gives them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import retrieval as R
from .plans.plan import QueryPlan, constrain, contract, plan_with, single_text
from .queries import _RECOMMENDED, HEAD, LIMITS, SQL, _engine_sql, _experts, _hits, corpus_of, engine, query, table

# --- plans over a table of requests ------------------------------------------------------------------------

_BARE = r"trim(regexp_replace(regexp_replace({c}, '(?i)\bbolt\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    f"WITH s AS (SELECT p_partkey, p_name, p_type, p_size % 2 = 0 AS even, {_BARE.format(c='p_name')} AS a, {_BARE.format(c='p_type')} AS b FROM part)"
    " SELECT p_partkey, concat_ws('|', p_name, CASE WHEN p_type <> p_name THEN p_type END, CASE WHEN even THEN 'system' END) AS raw, concat_ws('|', nullif(a, ''), CASE WHEN b <> a THEN nullif(b, '') END, CASE WHEN even THEN 'system' END) AS normalized,"
    " concat_ws('|', nullif(a, ''), CASE WHEN b <> a THEN nullif(b, '') END) AS pruned, CASE WHEN even THEN 'system:generic' ELSE '' END AS reasons FROM s"
)
def plan_contract(spark: SparkSession, d: str) -> DataFrame:
    """Aspects as a planner gave them, cleaned, and pruned with reasons, for a table of plans."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                told = contract([r.p_name, f"  {r.p_type} ", r.p_name, *(["system"] if r.p_size % 2 == 0 else [])], [], ["bolt"], [r.p_type])
                why = [f"{g['term']}:{g['reason']}" for g in told["must_aspect_prune_reasons"]]
                rows.append((r.p_partkey, *("|".join(told[k]) for k in ("raw_must_aspects", "normalized_must_aspects", "pruned_must_aspects")), "|".join(why)))
            yield pd.DataFrame(rows, columns=["p_partkey", "raw", "normalized", "pruned", "reasons"])

    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size").mapInPandas(run, "p_partkey long, raw string, normalized string, pruned string, reasons string")


@query(
    "SELECT p_partkey, p_brand AS degree, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 0 END AS articles, CASE WHEN p_size % 3 = 0 THEN 'own' ELSE 'own|' || p_type END AS include, CAST(p_size % 15 + 1 AS INTEGER) AS top_k, concat('kept ', p_name) AS text, CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS calls FROM part"
)
def plan_overrides(spark: SparkSession, d: str) -> DataFrame:
    """P13, P14, L5, R1d: the request's filters, organisations and top_k stand over a planner's; a planner without a core is asked again."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                calls: list[str] = []

                def planner(text, r=r, calls=calls):
                    calls.append(text)
                    core = [] if r.p_size % 5 == 0 and len(calls) == 1 else ["kept", r.p_name]
                    filters = {"degree_slct_nm": "other"} | ({"article_cnt_min": 3} if r.p_size % 2 == 0 else {})
                    return QueryPlan(query=text, retrieval_core=core, hard_filters=filters, include_orgs=["own"])

                out = plan_with(planner, f"about {r.p_name}", filters={"degree_slct_nm": r.p_brand}, include=["own"] if r.p_size % 3 == 0 else ["own", r.p_type], top_k=r.p_size % 15 + 1)
                rows.append((r.p_partkey, out.hard_filters["degree_slct_nm"], out.hard_filters.get("article_cnt_min", 0), "|".join(out.include_orgs), out.top_k, single_text(out), len(calls)))
            yield pd.DataFrame(rows, columns=["p_partkey", "degree", "articles", "include", "top_k", "text", "calls"])

    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size").mapInPandas(run, "p_partkey long, degree string, articles int, include string, top_k int, text string, calls int")


# --- what a search tells -----------------------------------------------------------------------------------


@query(
    HEAD + ", m AS (SELECT *, row_number() OVER (PARTITION BY expert_id ORDER BY rank, dense DESC, branch, path, point_id) AS i FROM k) SELECT m.expert_id, arg_min(branch, i) AS primary_branch, round(any_value(g.score), 6) AS final_score,"
    " string_agg(concat(branch, ':', rank), '|' ORDER BY i) FILTER (i <= 2) AS matches, round(sum(dense) FILTER (i <= 2), 5) AS scores FROM m JOIN g USING (expert_id) GROUP BY m.expert_id"
)
def grounding(spark: SparkSession, d: str) -> DataFrame:
    """What a generator is told of a hit's score."""
    g = R.grounding(_experts(spark, d)).select("expert_id", "grounding.*")
    matches = F.array_join(F.transform("branch_matches", lambda m: F.concat(m["branch"], F.lit(":"), m["rank"].cast("string"))), "|")
    total = F.round(F.aggregate("branch_matches", F.lit(0.0), lambda s, m: s + m["score"]), 5)
    return g.select("expert_id", "primary_branch", "final_score", matches.alias("matches"), total.alias("scores"))


@query("WITH e AS (" + SQL["shadow_set"] + ") SELECT expert_id, CASE WHEN expert_id IN (SELECT source FROM documents WHERE lang = 'de') THEN concat('Expert ', expert_id) ELSE '' END AS name FROM e")
def shadow_named(spark: SparkSession, d: str) -> DataFrame:
    """Experts whom expansion alone has found, with names; unknown ones have an empty one."""
    people = table(spark, d, "documents").where("lang = 'de'").select(F.col("source").alias("expert_id"), F.concat(F.lit("Expert "), "source").alias("name")).distinct()
    return R.shadow_names(R.aggregate(_hits(spark, d).where("NOT (path = 'stable' AND rank > 5)"), LIMITS), people)


@query(_engine_sql(["the", "and"], 0.0) + " SELECT rank, expert_id, score_pct FROM o WHERE rank <= 4")
def display_limit(spark: SparkSession, d: str) -> DataFrame:
    """The list is cut because it is asked for and top_k is given."""
    return engine(spark, d).search("the and", limit_candidates=True, top_k=4).select("rank", "expert_id", "score_pct")


@query("SELECT source AS expert_id, CAST(0 AS BIGINT) AS candidates FROM documents GROUP BY 1")
def skipped_search(spark: SparkSession, d: str) -> DataFrame:
    """A query of meta terms alone finds nobody, and nothing is scanned for it."""
    found = engine(spark, d).search("recommend expert").select("expert_id", F.lit(1).alias("one"))
    return corpus_of(spark, d)[1].select("expert_id").join(found, "expert_id", "left").groupBy("expert_id").agg(F.count("one").alias("candidates"))


_CHAIN, _LAST = _RECOMMENDED[: _RECOMMENDED.rindex("\nSELECT place AS rank")], _RECOMMENDED[_RECOMMENDED.rindex("\nSELECT place AS rank") :]


@query(
    _CHAIN + ", re AS (" + _LAST + ") SELECT 'the and' AS text, 'ok' AS status, (SELECT count(*) FROM o) AS retrieved, rank, expert_id, reason, CAST((SELECT stable_hits FROM o WHERE o.expert_id = re.expert_id) AS BIGINT) AS stable FROM re"
    " UNION ALL SELECT 'zzzqqq', 'no_match', 0, 0, '', 'No matching candidates were found.', 0 UNION ALL SELECT 'recommend expert', 'skipped', 0, 0, '', 'No matching candidates were found.', 0"
)
def responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses of three kinds, with support counts; at most 15 recommendations each."""
    own, rows = engine(spark, d), []
    for text in ("the and", "zzzqqq", "recommend expert"):
        out = own.respond(text)
        head = (text, out["status"], out["retrieved_count"])
        rows += [(*head, r["rank"], r["expert_id"], r["reason"], r["support"]["stable"]) for r in out["recommendations"]] or [(*head, 0, "", out["not_selected_reasons"][0], 0)]
    return spark.createDataFrame(rows, "text string, status string, retrieved long, rank int, expert_id string, reason string, stable long")


@query(
    _CHAIN.replace("place <= 15", "place <= 10") + " SELECT CAST(i AS INTEGER) AS i, event, CAST(n AS BIGINT) AS n FROM (SELECT 0 AS i, 'plan_completed' AS event, 2 AS n UNION ALL SELECT 1, 'search_completed', (SELECT count(*) FROM o) UNION ALL SELECT 2, 'shortlist_completed', (SELECT count(*) FROM sh)"
    " UNION ALL SELECT 2 + (place - 1) // 4 + 1, 'reason_batch_completed', count(*) FROM sh GROUP BY (place - 1) // 4 UNION ALL SELECT 3 + CAST(ceil((SELECT count(*) FROM sh) / 4.0) AS INTEGER), 'stream_completed', (SELECT count(*) FROM sh))"
)
def response_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events of a streamed response, reasons in batches of four."""
    size = {"plan_completed": lambda x: len(x["retrieval_keywords"]), "search_completed": lambda x: x["retrieved"], "shortlist_completed": lambda x: x["shortlisted"], "reason_batch_completed": lambda x: len(x["rows"]), "stream_completed": lambda x: x["count"]}
    rows = [(i, event, size[event](told)) for i, (event, told) in enumerate(engine(spark, d).stream("the and", batch=4, top_k=10))]
    return spark.createDataFrame(rows, "i int, event string, n long")
