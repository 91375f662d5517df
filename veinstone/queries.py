"""Registered queries, one or more for each operator, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.json_scan import extract_json
from .functions.vectors import cosine, hashed_unit_vector
from .operators import evidence as E
from .operators import filters as P
from .operators import quality as V
from .operators import reasons as N
from .operators import recommend as G
from .operators import retrieval as R
from .plans import lexicon as X
from .plans.engine import Engine
from .plans.models import sparse_column
from .plans.plan import QueryPlan, branch_queries, constrain, plans
from .sources.files import fingerprint
from .sources.scratch import fresh
from .sources.corpus import evidence_items, experts, explode_points, fixtures, flat_evidence, points, source_texts, table
from .sources.sinks import cached_result, collection_info, ensure_collection, feedback_rows, result_key
from .streaming.queries import feedback_counts

QUERIES: dict = {}
SQL: dict = {}
ASPECTS, GENERIC, YEAR = ["blue bolt", "small"], ["economy"], 2001
TERMS, WIDE = ["the", "and", "with"], ["the", "and", "with", "that"]
LIMITS = R.Limits(cutoff=0.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def strings(a: F.Column) -> F.Column:
    return F.array_join(a, "|")


# --- functions -------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, nullif(upper(regexp_replace(regexp_replace(regexp_replace(concat('주식회사 ', n_name, ' (seoul) [x]'), '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '주식회사|유한회사|사단법인|재단법인', '', 'g'), '[^0-9A-Za-z가-힣]', '', 'g')), '') AS org FROM nation")
def org_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", T.normalize_org(F.concat(F.lit("주식회사 "), "n_name", F.lit(" (seoul) [x]"))).alias("org"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS collapsed, md5(lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')))) AS folded, md5(replace(lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))), ' ', '')) AS compacted FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.collapse("text")).alias("collapsed"), F.md5(T.fold("text")).alias("folded"), F.md5(T.compact("text")).alias("compacted"))


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]+')) AS term FROM documents) GROUP BY 1, 2")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("point_id"), F.lit("").alias("branch"), F.lower("text").alias("content_text"))
    return R.postings(docs).select(F.col("point_id").alias("doc_id"), "term", "tf")


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), '|') AS kw FROM (SELECT p_partkey, string_split(concat(p_name, ' ', p_type, ' ', p_name), ' ') AS w FROM part)")
def keyword_unique(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", strings(T.keywords(F.array(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name")))).alias("kw"))


@query(r"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' ') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w),
m AS (SELECT doc_id, t, min(i) AS i FROM u WHERE length(t) >= 2 GROUP BY 1, 2)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(t, '|' ORDER BY i), '') END AS toks FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id, d.text""")
def fallback_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", strings(T.fallback_tokens("text")).alias("toks"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(concat(p_name, ' expert  ', p_type), '(?i)\b(small bolt|economy|expert|bolt|red)\b', ' ', 'g'), '\s+', ' ', 'g')) AS stripped FROM part")
def strip_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.strip_terms(F.concat(F.col("p_name"), F.lit(" expert  "), F.col("p_type")), ["expert", "economy", "small bolt", "bolt", "red"]).alias("stripped"))


@query("SELECT p_partkey, array_to_string(list_filter(['economy', 'small', 'blue', 'bolt', 'red'], lambda t: contains(lower(concat(p_name, ' ', p_type)), t)), '|') AS found FROM part")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", strings(T.query_terms(F.concat_ws(" ", "p_name", "p_type"), ["red", "blue", "bolt", "small", "economy"])).alias("found"))


@query("SELECT o_orderkey, TRY_CAST(substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) AS INTEGER) AS year, concat(CAST(CAST(DATE '1899-12-30' + CAST(30000 + o_orderkey % 9000 AS INTEGER) AS DATE) AS VARCHAR), 'T00:00:00Z') AS serial, concat(substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 7), '-01T00:00:00Z') AS month FROM orders")
def dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", T.year(day).alias("year"), T.rfc3339((30000 + F.col("o_orderkey") % 9000).cast("string")).alias("serial"), T.rfc3339(F.substring(day, 1, 7)).alias("month"))


@query(r"SELECT doc_id, CASE WHEN length(t) > 120 THEN concat(rtrim(substr(t, 1, 117)), '...') ELSE t END AS cut, CAST(greatest(1, round_even(length(text) / 4, 0)) AS INTEGER) AS tokens FROM (SELECT doc_id, text, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents)")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate("text", 120).alias("cut"), T.token_estimate("text").alias("tokens"))


@query(r"""
WITH t AS (SELECT doc_id, lang, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents),
p AS (SELECT *, CASE WHEN strpos(lower(t), 'thing') > 0 THEN strpos(lower(t), 'thing') WHEN strpos(lower(t), 'des') > 0 THEN strpos(lower(t), 'des') END AS pos FROM t)
SELECT doc_id, concat('[lang: ', lang, ']', chr(10), CASE WHEN length(t) <= 500 THEN substr(t, 1, 1000) WHEN pos IS NULL THEN concat(substr(t, 1, 1000), '...')
  ELSE concat(CASE WHEN pos > 201 THEN '...' ELSE '' END, substr(t, greatest(1, pos - 200), least(length(t), pos + 599) - greatest(1, pos - 200) + 1), CASE WHEN pos + 599 < length(t) THEN '...' ELSE '' END) END) AS snippet FROM p""")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet("text", F.array(F.lit("thing"), F.lit("des")), {"lang": F.col("lang")}).alias("snippet"))


@query("""
WITH w AS (SELECT p_partkey, i, CAST(concat('0x', substr(sha256(concat(p_name, '::', CAST(i // 8 AS VARCHAR))), CAST((i % 8) * 8 + 1 AS BIGINT), 8)) AS BIGINT) / 4294967296.0::DOUBLE - 0.5::DOUBLE AS x FROM part, range(16) t(i))
SELECT p_partkey, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 9) AS x FROM w""")
def hash_vector(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select("p_partkey", F.posexplode(hashed_unit_vector(F.col("p_name"), 16)).alias("i", "x"))
    return v.select("p_partkey", "i", F.round("x", 9).alias("x"))


@query("SELECT page_id, CAST(concat('0x', substr(sha256(url), 1, 8)) AS BIGINT) AS seed FROM pages")
def seed32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.seed32("url").alias("seed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_object(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("<thinking>{no}</thinking> so {x ```json\n"), "props", F.lit("\n``` done"))
    return table(spark, d, "events").select("event_id", F.get_json_object(extract_json(raw), "$.k").cast("int").alias("k"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)), ', ') AS line FROM documents")
def multiline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.multiline("text").alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS n, CASE WHEN p_size % 4 <> 0 THEN p_size ELSE -1 END AS m, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_type ELSE 'Untitled project' END AS title, CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS list FROM part")
def coercions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    raw = F.when(F.col("p_size") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    first = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")
    second = F.when(F.col("p_size") % 3 == 0, F.col("p_type"))
    return p.select("p_partkey", T.int_or_zero(raw).alias("n"), F.coalesce(T.int_or_null(raw), F.lit(-1)).alias("m"), T.display_title(first, second).alias("title"), strings(T.string_list(F.array(raw))).alias("list"))


@query("SELECT vec_id, concat(CASE vec_id % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'art' WHEN 2 THEN 'pat' ELSE 'pjt' END) AS branch, len(embedding) AS n FROM embeddings")
def branch_inference(spark: SparkSession, d: str) -> DataFrame:
    b = F.element_at(F.array(*map(F.lit, X.BRANCHES)), (F.col("vec_id") % 4 + 1).cast("int"))
    pid = F.concat_ws("_", "vec_id", b, F.when(F.col("vec_id") % 4 > 0, F.lit("0")))
    return table(spark, d, "embeddings").select("vec_id", T.branch_of(pid).alias("branch"), F.size("embedding").cast("long").alias("n"))


@query("SELECT l.l_orderkey, l.l_linenumber, CASE WHEN p_type = 'ECONOMY' OR p_name = 'small bolt' THEN true ELSE false END AS generic FROM lineitem l JOIN part ON p_partkey = l_partkey")
def generic_aspect(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = F.when(F.col("p_type") == "ECONOMY", F.lit("Economy  system")).otherwise(F.col("p_name"))
    return own.select("l_orderkey", "l_linenumber", T.is_generic(t, ["small bolt"], ["economy", "system"]).alias("generic"))


# --- filters ---------------------------------------------------------------------------------------------

EXPERTS = """
o AS (SELECT *, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders),
pr AS (SELECT o_orderkey, o_custkey, day, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS endd FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 2 GROUP BY ALL),
x AS (SELECT c_custkey AS expert_id, c_mktsegment AS degree, n_name AS org, c_name AS name,
  (SELECT count(*) FROM o WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0) AS article_cnt,
  (SELECT count(*) FROM o WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0 AND o_orderpriority = '1-URGENT') AS scie_cnt,
  (SELECT count(*) FROM o WHERE o_custkey = c_custkey AND o_orderkey % 3 = 1) AS patent_cnt,
  (SELECT count(*) FROM pr WHERE o_custkey = c_custkey) AS project_cnt FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)
"""


def filtered(name: str, where: str, filters: dict, **kw) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return P.apply_filters(experts(spark, d), filters, as_of=YEAR, **kw).select("expert_id")

    f.__name__ = name
    query(f"WITH {EXPERTS} SELECT expert_id FROM x WHERE {where}")(f)


filtered("filter_degree", "degree IN ('BUILDING', 'MACHINERY')", {"degree_slct_nm": ["BUILDING", "MACHINERY"]})
filtered("filter_min_counts", "article_cnt >= 2 AND scie_cnt >= 1 AND patent_cnt >= 1 AND project_cnt >= 0", {"article_cnt_min": 2, "scie_cnt_min": 1, "patent_cnt_min": 1, "project_cnt_min": 0})
filtered("filter_nested_exists", "EXISTS (SELECT 1 FROM o WHERE o_custkey = expert_id AND o_orderkey % 3 = 0 AND o_orderpriority = '1-URGENT' AND day >= '1998-01-01') AND EXISTS (SELECT 1 FROM o WHERE o_custkey = expert_id AND o_orderkey % 3 = 1 AND o_orderstatus = 'F')", {"art_sci_slct_nm": "1-URGENT", "art_recent_years": 3, "pat_reg_slct_nm": "F"})
filtered("filter_recency_pool", "EXISTS (SELECT 1 FROM o WHERE o_custkey = expert_id AND o_orderkey % 3 IN (0, 1) AND day >= '2001-01-01') OR EXISTS (SELECT 1 FROM pr WHERE o_custkey = expert_id AND endd >= '2001-01-01')", {"art_recent_years": 0.5, "pat_recent_years": 0.5, "pjt_recent_years": 0.5})
filtered("filter_recency_single", "EXISTS (SELECT 1 FROM pr WHERE o_custkey = expert_id AND endd >= '1999-01-01')", {"pjt_recent_years": 2})
filtered("filter_include_org", "org = 'NATION_3'", {}, include=["nation 3"])
filtered("filter_include_any", "org IN ('NATION_3', 'NATION_4')", {}, include=["nation_3", "NATION-4"], include_any=True)
filtered("filter_exclude_org", "org IS NULL OR org <> 'NATION_3'", {}, exclude=["(주) nation_3"])
filtered("filter_none", "true", {})


@query(f"WITH {EXPERTS} SELECT expert_id FROM x WHERE NOT contains(coalesce(replace(org, '_', ''), ''), 'NATION1')")
def post_filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return P.drop_containing(experts(spark, d), ["nation 1"]).select("expert_id")


# --- points, cards, quality ------------------------------------------------------------------------------


@query(f"WITH {EXPERTS} SELECT concat(expert_id, '_basic') AS point_id, 'basic' AS branch FROM x UNION ALL SELECT concat(o_custkey, CASE o_orderkey % 3 WHEN 0 THEN '_art_' ELSE '_pat_' END, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1), CASE o_orderkey % 3 WHEN 0 THEN 'art' ELSE 'pat' END FROM o JOIN x ON o_custkey = expert_id WHERE o_orderkey % 3 < 2 UNION ALL SELECT concat(o_custkey, '_pjt_', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1), 'pjt' FROM pr JOIN x ON o_custkey = expert_id")
def points_explode(spark: SparkSession, d: str) -> DataFrame:
    return explode_points(experts(spark, d)).select("point_id", "branch")


@query(f"WITH {EXPERTS} SELECT expert_id, coalesce((SELECT string_agg(concat('Paper ', o_orderkey), chr(10) ORDER BY o_orderkey) FROM o WHERE o_custkey = expert_id AND o_orderkey % 3 = 0), '논문 근거 부족') AS art, coalesce((SELECT string_agg(concat('Patent ', o_orderkey), chr(10) ORDER BY o_orderkey) FROM o WHERE o_custkey = expert_id AND o_orderkey % 3 = 1), '특허 근거 부족') AS pat, coalesce((SELECT string_agg(concat('Project ', o_orderkey), chr(10) ORDER BY o_orderkey) FROM pr WHERE o_custkey = expert_id), '과제 근거 부족') AS pjt FROM x")
def branch_texts(spark: SparkSession, d: str) -> DataFrame:
    return source_texts(experts(spark, d))


@query(f"WITH {EXPERTS} SELECT expert_id, false AS basic, article_cnt > 0 AS art, patent_cnt > 0 AS pat, project_cnt > 0 AS pjt FROM x")
def presence_flags(spark: SparkSession, d: str) -> DataFrame:
    return E.presence(experts(spark, d))


@query(f"WITH {EXPERTS} SELECT expert_id, concat_ws('|', CASE WHEN article_cnt = 0 THEN 'Publication evidence is missing.' END, CASE WHEN patent_cnt = 0 THEN 'Patent evidence is missing.' END, CASE WHEN project_cnt = 0 THEN 'Project evidence is missing.' END) AS data_gaps, CASE WHEN (article_cnt = 0)::INT + (patent_cnt = 0)::INT + (project_cnt = 0)::INT >= 2 THEN 'Evidence coverage is limited.' ELSE '' END AS risks, concat('Degree filter matched: ', degree, '|Project count: ', project_cnt) AS matched FROM x")
def card_notes(spark: SparkSession, d: str) -> DataFrame:
    own = E.cards(experts(spark, d), {"degree_slct_nm": "x", "project_cnt_min": 0})
    return own.select("expert_id", strings("data_gaps").alias("data_gaps"), strings("risks").alias("risks"), strings("matched_filters").alias("matched"))


@query(f"WITH {EXPERTS} SELECT expert_id, (SELECT string_agg(concat('Paper ', o_orderkey), '|' ORDER BY day DESC, concat('Paper ', o_orderkey) DESC) FROM o WHERE o_custkey = expert_id AND o_orderkey % 3 = 0) AS papers, (SELECT string_agg(concat('Project ', o_orderkey), '|' ORDER BY endd DESC, concat('Project ', o_orderkey) DESC) FROM pr WHERE o_custkey = expert_id) AS projects FROM x")
def nested_sort_latest(spark: SparkSession, d: str) -> DataFrame:
    titles = lambda c: F.nullif(strings(F.transform(c, lambda x: x["title"])), F.lit(""))
    return E.cards(experts(spark, d)).select("expert_id", titles("publications").alias("papers"), titles("projects").alias("projects"))


@query(f"WITH {EXPERTS} SELECT count(*) FILTER (name <> '') AS has_name, count(*) FILTER (org <> '') AS has_org, count(*) FILTER (article_cnt > 0) AS has_papers, count(*) FILTER (patent_cnt > 0) AS has_patents, count(*) FILTER (project_cnt > 0) AS has_projects, count(*) FILTER (project_cnt > 0) AS projects_dated, count(*) AS n FROM x")
def completeness_report(spark: SparkSession, d: str) -> DataFrame:
    return V.fulfilled(V.completeness(experts(spark, d)))


@query(f"WITH {EXPERTS}, s AS (SELECT expert_id, (name <> '')::INT + coalesce((org <> '')::INT, 0) + (article_cnt > 0)::INT + (patent_cnt > 0)::INT + 2 * (project_cnt > 0)::INT AS score, name <> '' AND org <> '' AND article_cnt > 0 AND project_cnt > 0 AS ready FROM x ORDER BY expert_id LIMIT 256) SELECT expert_id, CAST(score AS INTEGER) AS score, ready, '' AS issues FROM s ORDER BY score DESC, expert_id LIMIT 1")
def best_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.report(V.completeness(V.sample(experts(spark, d)))).select("expert_id", "score", "ready", strings("issues").alias("issues"))


@query("SELECT * FROM (VALUES (11008395, 7), (11008396, 8), (11008397, 8), (11008398, 5), (11008399, 9), (11008400, 7), (11008401, 2)) t(expert_id, n_points)")
def synthetic_fixtures(spark: SparkSession, d: str) -> DataFrame:
    return explode_points(fixtures(spark)).groupBy("expert_id").agg(F.count(F.lit(1)).cast("int").alias("n_points")).select(F.col("expert_id").cast("int").alias("expert_id"), "n_points")


# --- retrieval -------------------------------------------------------------------------------------------

COS = "round(list_dot_product(CAST(sc.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(sc.embedding AS DOUBLE[]), CAST(sc.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6)"


_ENGINES: dict = {}


def stored_once(spark: SparkSession, d: str, name: str, make):
    """What make gives, once a session and state of the tables: after a change of the tables it is made anew."""
    key = (spark.sparkContext.applicationId, d, name, fingerprint(spark, *(f"{d}/{t}.parquet" for t in ("documents", "embeddings", "customer", "orders", "lineitem", "nation"))))
    if key not in _ENGINES:
        _ENGINES[key] = make()
    return _ENGINES[key]


def corpus_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, people and items of the driver's tables: documents as points, sources as experts, documents' texts as evidence of a year by their id."""
    pts = points(spark, d)

    def people() -> DataFrame:
        counts = {f"{n}_cnt": F.count_if(F.col("branch") == b) for n, b in (("article", "art"), ("patent", "pat"), ("project", "pjt"))}
        own = pts.groupBy("expert_id").agg(*(c.alias(n) for n, c in counts.items())).withColumns({"name": F.concat(F.lit("Expert "), "expert_id"), "org": F.concat(F.lit("org "), "expert_id"), "degree": F.lit("PhD")})
        path = fresh(spark)
        own.write.parquet(path)
        return spark.read.parquet(path)

    kind = F.when(F.col("branch") == "pat", "patent").when(F.col("branch") == "pjt", "project").otherwise("paper")
    date = F.concat((F.lit(1975) + F.pmod("point_id", F.lit(40))).cast("string"), F.lit("-01-01"))
    items = pts.select("expert_id", kind.alias("type"), F.concat_ws(":", kind, "point_id").alias("item_id"), F.split("content_text", "\n")[0].alias("title"), F.col("content_text").alias("body"), date.alias("date"))
    return pts, stored_once(spark, d, "people", people), items


def engine(spark: SparkSession, d: str, limits: R.Limits | None = None, **more) -> Engine:
    """The engine over the driver's tables; its index and people are stored once a session, texts are encoded as hashed vectors."""
    pts, people, items = corpus_of(spark, d)
    if "index" not in more:
        more["index"] = stored_once(spark, d, "index", lambda: R.build_index(pts, fresh(spark)))
    return Engine(spark, pts, people, items, limits or LIMITS, YEAR, **more)


BRANCH = "CASE lang WHEN 'es' THEN 'basic' WHEN 'en' THEN 'art' WHEN 'fr' THEN 'pat' ELSE 'pjt' END"
POINTS = f"p AS (SELECT doc_id AS point_id, source AS expert_id, {BRANCH} AS branch, embedding, text, regexp_extract_all(lower(text), '[0-9a-z가-힣]+') AS toks FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"
#: A text's hashed vector.
HASHED = """
SELECT text, list(x ORDER BY i) AS q FROM (SELECT text, i, x / sqrt(sum(x * x) OVER (PARTITION BY text)) AS x FROM (
  SELECT text, i, CAST(concat('0x', substr(sha256(concat(text, '::', CAST(i // 8 AS VARCHAR))), CAST((i % 8) * 8 + 1 AS BIGINT), 8)) AS BIGINT) / 4294967296.0::DOUBLE - 0.5::DOUBLE AS x
  FROM (SELECT DISTINCT dense AS text FROM qq), range(64) t(i))) GROUP BY 1"""


BM25_SQL = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * le / al))"


def search_sql(tasks: str, cutoff: float = 0.0, where: str = "true", after: str = "true", support: str = "stable_hits >= 1 OR (expanded_hits >= 2 AND n_branches >= 2)", hashed: str = HASHED, points_: str = POINTS, weigh: str = BM25_SQL) -> str:
    """The engine's search in SQL, for the tasks that a select gives (query_id, branch, path, sparse, dense): statistics by branch, filters before the prefetch (where) and on hits (after); ends with o, the experts."""
    return f"""
WITH {points_},
tf AS (SELECT point_id, expert_id, branch, term, count(*) AS tf FROM (SELECT point_id, expert_id, branch, unnest(toks) AS term FROM p) GROUP BY ALL),
st AS (SELECT branch, count(*) AS n, avg(len(toks)) AS al FROM p GROUP BY 1),
le AS (SELECT point_id, len(toks) AS le FROM p),
df AS (SELECT branch, term, count(*) AS df FROM tf GROUP BY 1, 2),
pe AS (SELECT expert_id, count(*) FILTER (branch = 'art') AS article_cnt FROM p GROUP BY 1),
qq AS ({tasks}),
w AS (SELECT query_id, branch, path, term, count(*) AS qf FROM (SELECT query_id, branch, path, unnest(regexp_extract_all(lower(sparse), '[0-9a-z가-힣]+')) AS term FROM qq) GROUP BY ALL),
sc AS (SELECT query_id, tf.branch, path, tf.point_id, expert_id, round(sum({weigh}), 6) AS sparse
  FROM w JOIN tf ON tf.branch = w.branch AND tf.term = w.term JOIN df ON df.branch = w.branch AND df.term = w.term JOIN st ON st.branch = w.branch JOIN le ON le.point_id = tf.point_id
  WHERE expert_id IN (SELECT expert_id FROM pe WHERE {where}) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch, path ORDER BY sparse DESC, point_id) AS sr FROM sc WHERE sparse > 0),
hv AS ({hashed}),
t AS (SELECT a.*, {COS.replace("sc.", "p.").replace("q.embedding", "hv.q")} AS dense FROM a JOIN p ON p.point_id = a.point_id JOIN qq ON qq.query_id = a.query_id AND qq.branch = a.branch AND qq.path = a.path JOIN hv ON hv.text = qq.dense WHERE sr <= 1000),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch, path ORDER BY dense DESC NULLS LAST, point_id) AS dr FROM t),
c AS (SELECT *, round(CASE WHEN dense IS NOT NULL AND dr <= 100 THEN 1.0::DOUBLE / (60 + dr) ELSE 0 END + CASE WHEN sr <= 100 THEN 1.0::DOUBLE / (60 + sr) ELSE 0 END, 9) AS rrf_score FROM b),
h AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, branch, path ORDER BY rrf_score DESC, point_id) AS INTEGER) AS rank FROM c WHERE rrf_score > 0) WHERE rank <= 50),
k AS (SELECT * REPLACE (coalesce(dense, 0) AS dense), coalesce(dense, 0) * CASE branch WHEN 'pjt' THEN 1.015::DOUBLE WHEN 'pat' THEN 1.005::DOUBLE WHEN 'art' THEN 1.0::DOUBLE ELSE 0.99::DOUBLE END AS w,
  CASE branch WHEN 'basic' THEN 0 WHEN 'art' THEN 2 WHEN 'pat' THEN 4 ELSE 6 END + CASE path WHEN 'stable' THEN 0 ELSE 1 END AS task FROM h WHERE coalesce(dense, 0) >= {cutoff} AND {after}),
g AS (SELECT query_id, expert_id, max(w) AS score, count(*) FILTER (path = 'stable') AS stable_hits, count(*) FILTER (path <> 'stable') AS expanded_hits, string_agg(DISTINCT branch, '|' ORDER BY branch) AS branches, count(DISTINCT branch) AS n_branches FROM k GROUP BY 1, 2),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concat('Expert ', expert_id), expert_id) AS INTEGER) AS rank, expert_id, concat('Expert ', expert_id) AS name, stable_hits, expanded_hits, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN round_even(score / max(score) OVER (PARTITION BY query_id) * 100, 1) ELSE 0 END AS score_pct FROM g WHERE {support})"""


def _engine_sql(words: list[str], cutoff: float, where: str = "true", after: str = "true", dense: str | None = None, **more: str) -> str:
    """One query with a stable path alone."""
    text = " ".join(words)
    return search_sql(f"SELECT 0 AS query_id, b AS branch, 'stable' AS path, '{text}' AS sparse, '{dense or text}' AS dense FROM unnest(['basic', 'art', 'pat', 'pjt']) u(b)", cutoff, where, after, **more)


_SHOWN = " SELECT rank, expert_id, name, stable_hits, expanded_hits, score_pct FROM o"


@query(search_sql(f"SELECT 0 AS query_id, b AS branch, 'stable' AS path, '{' '.join(TERMS)}' AS sparse, '' AS dense FROM unnest(['basic', 'art', 'pat', 'pjt']) u(b)") + " SELECT point_id, branch, sparse FROM sc WHERE sparse > 0 ORDER BY sparse DESC, point_id LIMIT 1000")
def sparse_topk_bm25(spark: SparkSession, d: str) -> DataFrame:
    """R3 by one scan of the corpus, as without an index; statistics by branch."""
    own, tasks = points(spark, d), spark.createDataFrame([(b, "stable", TERMS) for b in X.BRANCHES], "branch string, path string, terms array<string>")
    found = R.bm25_tasks(R.scan_index(own, TERMS), tasks)
    return found.where("sparse > 0").orderBy(F.desc("sparse"), "point_id").limit(1000).select("point_id", "branch", "sparse")


def _vector(spark: SparkSession, d: str, i: int) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") == i).select(F.col("embedding").alias("q"))


@query(f"WITH sc AS (SELECT vec_id, embedding FROM embeddings) SELECT sc.vec_id, {COS} AS dense FROM sc, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY dense DESC, vec_id LIMIT 100")
def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").join(F.broadcast(_vector(spark, d, 0)))
    return own.select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("dense")).orderBy(F.desc("dense"), "vec_id").limit(100)


HEAD = search_sql(
    " UNION ALL ".join(f"SELECT 0 AS query_id, b AS branch, '{path}' AS path, '{' '.join(terms)}' AS sparse, 'v{i}' AS dense FROM unnest(['basic', 'art', 'pat', 'pjt']) u(b)" for i, (path, terms) in enumerate((("stable", TERMS), ("expanded", WIDE)))),
    hashed="SELECT concat('v', vec_id) AS text, embedding AS q FROM embeddings WHERE vec_id IN (0, 1)",
)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """R2-R9 for given words and vectors, over the stored postings."""
    own = engine(spark, d)
    tasks = spark.createDataFrame([(b, path, terms) for b in X.BRANCHES for path, terms in (("stable", TERMS), ("expanded", WIDE))], "branch string, path string, terms array<string>")
    vectors = None
    for i, path in enumerate(("stable", "expanded")):
        one = _vector(spark, d, i).select(F.explode(F.lit(list(X.BRANCHES))).alias("branch"), F.lit(path).alias("path"), "q")
        vectors = one if vectors is None else vectors.union(one)
    return own.reranked(R.bm25_tasks(own.index, tasks), vectors)


@query(HEAD + "SELECT branch, path, rank, point_id, expert_id, sparse, dense, rrf_score FROM h")
def cascade_rrf_branch(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("branch", "path", "rank", "point_id", "expert_id", "sparse", "dense", "rrf_score")


@query(HEAD + "SELECT expert_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf, count(*) AS lists FROM (SELECT expert_id, branch, path, min(rank) AS r FROM h GROUP BY ALL) GROUP BY 1")
def rrf_cross_branch(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf(_hits(spark, d))


def _experts(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(_hits(spark, d), LIMITS)


@query(HEAD + "SELECT g.expert_id, round(score, 9) AS score, stable_hits, expanded_hits, branches, (SELECT arg_min(point_id, task * 100000 + rank) FROM k WHERE k.expert_id = g.expert_id) AS first_point FROM g")
def max_weighted_agg(spark: SparkSession, d: str) -> DataFrame:
    return _experts(spark, d).select("expert_id", F.round("score", 9).alias("score"), "stable_hits", "expanded_hits", strings("branches").alias("branches"), "first_point")


@query(HEAD + "SELECT expert_id, CASE WHEN stable_hits >= 3 OR (expanded_hits >= 3 AND n_branches >= 2) THEN '' ELSE concat('stable=', stable_hits, ' expanded=', expanded_hits, ' branches=', n_branches) END AS reason FROM g")
def support_rule(spark: SparkSession, d: str) -> DataFrame:
    own, strict = _experts(spark, d), R.Limits(stable_min=3, expanded_min=3)
    kept = own.where(R.supported(strict)).select("expert_id", F.lit("").alias("reason"))
    return kept.union(R.filtered_out(own, strict))


@query(HEAD + "SELECT expert_id FROM (SELECT expert_id, count(*) FILTER (path = 'stable') AS s, count(*) FILTER (path <> 'stable') AS e FROM k WHERE NOT (path = 'stable' AND rank > 5) GROUP BY 1) WHERE s = 0 AND e > 0")
def shadow_set(spark: SparkSession, d: str) -> DataFrame:
    return R.shadow(R.aggregate(_hits(spark, d).where("NOT (path = 'stable' AND rank > 5)"), LIMITS))


@query(HEAD + ", m AS (SELECT *, row_number() OVER (PARTITION BY expert_id ORDER BY rank, dense DESC, branch, path, point_id) AS i FROM k) SELECT m.expert_id, branch AS primary_branch, rank AS primary_rank, round(score, 6) AS final_score, CAST((SELECT count(*) FROM k WHERE k.expert_id = m.expert_id) AS INTEGER) AS n_matches FROM m JOIN g USING (expert_id) WHERE i = 1")
def primary_branch(spark: SparkSession, d: str) -> DataFrame:
    return R.score_trace(_experts(spark, d))


@query(HEAD + ", oo AS (SELECT expert_id, CASE WHEN expert_id = 'src1' THEN score * 0.98::DOUBLE ELSE score END AS s FROM g) SELECT expert_id, CAST(row_number() OVER (ORDER BY s DESC, concat('n', expert_id), expert_id) AS INTEGER) AS rank, CASE WHEN max(s) OVER () > 0 THEN round_even(s / max(s) OVER () * 100, 1) ELSE 0 END AS score_pct FROM oo")
def final_rank(spark: SparkSession, d: str) -> DataFrame:
    named = _experts(spark, d).withColumns({"org": F.when(F.col("expert_id") == "src1", F.lit("")).otherwise(F.lit("x")), "name": F.concat(F.lit("n"), "expert_id")})
    return R.normalised(R.final_order(R.penalise(named, LIMITS))).select("expert_id", "rank", "score_pct")


# --- evidence --------------------------------------------------------------------------------------------

ITEMS = """
i AS (SELECT o_custkey AS expert_id, ['paper', 'patent', 'project'][l_linenumber % 3 + 1] AS type, concat(['paper', 'patent', 'project'][l_linenumber % 3 + 1], ':', l_orderkey, ':', l_linenumber) AS item_id,
  concat(p_name, ' ', p_type) AS title, concat(p_brand, ' ', o_orderpriority, ' ', l_returnflag) AS body, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, year(l_shipdate) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
v AS (SELECT *, lower(title) AS t, lower(body) AS bo, replace(lower(title), ' ', '') AS tc, replace(lower(body), ' ', '') AS bc, row_number() OVER (PARTITION BY expert_id, type ORDER BY date DESC, title DESC, item_id) AS pos, count(*) OVER (PARTITION BY expert_id, type) AS n FROM i),
f AS (SELECT *, contains(t, 'blue bolt') OR contains(tc, 'bluebolt') AS ta, contains(bo, 'blue bolt') OR contains(bc, 'bluebolt') AS ba, contains(t, 'small') OR contains(tc, 'small') AS tb, contains(bo, 'small') OR contains(bc, 'small') AS bb, contains(t, 'economy') OR contains(bo, 'economy') AS ge FROM v),
e AS (SELECT *, ((ta OR ba)::INT + (tb OR bb)::INT) AS na FROM f),
s AS (SELECT *, na > 0 AS direct, round(1.0::DOUBLE + (n - pos + 1) * 0.1::DOUBLE + CASE WHEN t = 'blue bolt' THEN 8 WHEN ta THEN 5 ELSE 0 END + CASE WHEN ba THEN 3 ELSE 0 END + CASE WHEN t = 'small' THEN 8 WHEN tb THEN 5 ELSE 0 END + CASE WHEN bb THEN 3 ELSE 0 END + CASE WHEN na > 1 THEN na - 1 ELSE 0 END + CASE WHEN na > 0 AND year >= 2001 - 19 THEN 0.5::DOUBLE ELSE 0 END, 6) AS score FROM e),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY expert_id, tc, year ORDER BY direct DESC, na DESC, score DESC, year DESC, title, item_id) AS dn FROM s) WHERE dn = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY expert_id ORDER BY direct DESC, na DESC, score DESC, year DESC, title, item_id) AS INTEGER) AS item_rank FROM dd)
"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return E.score_items(evidence_items(spark, d), ASPECTS, GENERIC, YEAR)


@query(f"WITH {ITEMS} SELECT item_id, expert_id, direct, score, concat_ws('|', CASE WHEN ta OR ba THEN 'blue bolt' END, CASE WHEN tb OR bb THEN 'small' END) AS aspects, CASE WHEN ge THEN 'economy' ELSE '' END AS generic, (type = 'project' AND year > 2001) AS is_future FROM s")
def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", "expert_id", "direct", "score", strings("aspects").alias("aspects"), strings("generic").alias("generic"), "is_future")


@query(f"WITH {ITEMS} SELECT item_id, expert_id, item_rank FROM r")
def evidence_dedup_rank(spark: SparkSession, d: str) -> DataFrame:
    return E.ranked(E.dedup(_items(spark, d))).select("item_id", "expert_id", "item_rank")


QUOTA = """
z AS (SELECT expert_id, list(struct_pack(rk := item_rank, a := (ta OR ba), b := (tb OR bb), id := item_id, ty := type, fu := type = 'project' AND year > 2001, lb := concat('''', title, '''', ' ', CASE type WHEN 'paper' THEN '논문' WHEN 'patent' THEN '특허' ELSE '과제' END)) ORDER BY item_rank) FILTER (direct) AS l FROM r GROUP BY 1),
y AS (SELECT expert_id, coalesce(l, []) AS l, list_filter(l, lambda x: x.a)[1] AS fa, list_filter(l, lambda x: x.b)[1] AS fb FROM z),
u AS (SELECT *, list_filter([fa, CASE WHEN fa IS NULL OR NOT fa.b THEN fb END], lambda x: x IS NOT NULL) AS start FROM y),
q AS (SELECT expert_id, list_sort(list_transform(list_reduce(list_prepend([start[1:4]], list_transform(l, lambda x: [x])), lambda acc, x:
  CASE WHEN len(acc) < 4 AND NOT (x[1].a AND len(list_filter(acc, lambda k: k.a)) >= 2) AND NOT (x[1].b AND len(list_filter(acc, lambda k: k.b)) >= 2) AND len(list_filter(acc, lambda k: k.id = x[1].id)) = 0 THEN list_concat(acc, x) ELSE acc END), lambda x: x)) AS sel FROM
  (SELECT expert_id, l, start FROM u))
"""
QUOTA = QUOTA.replace("list_prepend([start[1:4]], list_transform(l, lambda x: [x]))", "list_concat([start], list_transform(l, lambda x: [x]))")


@query(f"WITH {ITEMS}, {QUOTA} SELECT expert_id, array_to_string(list_transform(sel, lambda x: x.id), '|') AS selected FROM q")
def evidence_quota(spark: SparkSession, d: str) -> DataFrame:
    own = E.select_quota(E.dedup(_items(spark, d)), ASPECTS)
    return own.select("expert_id", strings(F.transform("selected", lambda x: x["item_id"])).alias("selected"))


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    return E.quota_bundles(E.dedup(_items(spark, d)), ASPECTS)


BUNDLES = f"WITH {ITEMS}, {QUOTA}, bu AS (SELECT expert_id, count(*) FILTER (direct) AS direct_match_count, bool_or(ge) AS gen FROM dd GROUP BY 1), bs AS (SELECT bu.*, sel, (len(list_filter(sel, lambda x: x.a)) > 0)::INT + (len(list_filter(sel, lambda x: x.b)) > 0)::INT AS cov FROM bu JOIN q USING (expert_id))"


@query(BUNDLES + " SELECT expert_id, direct_match_count, CAST(cov AS INTEGER) AS aspect_coverage, (direct_match_count = 0 AND gen) AS generic_only, array_to_string(list_transform(list_concat(list_concat(list_filter(sel, lambda x: x.ty = 'paper'), list_filter(sel, lambda x: x.ty = 'project')), list_filter(sel, lambda x: x.ty = 'patent')), lambda x: x.id), '|') AS items FROM bs")
def bundle_stats(spark: SparkSession, d: str) -> DataFrame:
    own = _bundles(spark, d)
    return own.select("expert_id", "direct_match_count", "aspect_coverage", "generic_only", strings(F.transform("selected", lambda x: x["item_id"])).alias("items"))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("expert_id"), "c_acctbal")
    return G.gate(people.join(_bundles(spark, d), "expert_id", "left"), len(ASPECTS))


GATES = BUNDLES + ", cu AS (SELECT c_custkey AS expert_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS retrieval_rank FROM customer), ga AS (SELECT cu.*, CASE WHEN coalesce(direct_match_count, 0) < 1 THEN 'drop' WHEN coalesce(cov, 0) < 2 THEN 'demote_low_coverage' ELSE 'keep' END AS status FROM cu LEFT JOIN bs USING (expert_id))"


@query(GATES + " SELECT status, expert_id, CASE status WHEN 'keep' THEN 0 WHEN 'demote_low_coverage' THEN 1 ELSE 3 END AS bucket FROM ga")
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    return G.gate_trace(_gated(spark, d)).select("status", "expert_id", "bucket")


@query(GATES + " SELECT status, count(*) AS n FROM ga GROUP BY 1")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.gate_counts(_gated(spark, d))


def _short(spark: SparkSession, d: str) -> DataFrame:
    return G.shortlist_by(_gated(spark, d), 15, [F.desc("c_acctbal"), F.asc("expert_id")])


SHORT = GATES + ", sl AS (SELECT expert_id, CAST(row_number() OVER (ORDER BY status = 'demote_low_coverage', retrieval_rank) AS INTEGER) AS rank FROM ga WHERE status <> 'drop' QUALIFY rank <= 15)"


@query(SHORT + " SELECT expert_id, rank, CAST((rank - 1) // 5 AS BIGINT) AS batch_id FROM sl")
def gate_order_topk(spark: SparkSession, d: str) -> DataFrame:
    return _short(spark, d).select("expert_id", "rank", G.batch_of("rank").cast("long").alias("batch_id"))


@query(SHORT + """, id AS (SELECT sl.expert_id, rank, (rank - 1) // 5 AS batch_id, unnest(sel).id AS item FROM sl JOIN bs USING (expert_id)),
al AS (SELECT count(DISTINCT item) AS n FROM id)
SELECT sl.expert_id, CAST((sl.rank - 1) // 5 AS BIGINT) AS batch_id, CAST((SELECT count(*) FROM id WHERE id.expert_id = sl.expert_id) AS INTEGER) AS items, CAST(al.n + (SELECT count(*) FROM sl o WHERE (o.rank - 1) // 5 = (sl.rank - 1) // 5) - 1 AS INTEGER) AS hidden FROM sl, al""")
def reason_payloads(spark: SparkSession, d: str) -> DataFrame:
    named = _short(spark, d).withColumns({"name": F.concat(F.lit("Name "), "expert_id"), "org": F.lit("o"), "degree": F.lit("d"), "score": F.lit(1.0), "grounding": F.lit(None).cast("struct<primary_branch:string>")})
    told = N.payloads(named)
    size = lambda key: F.json_array_length(F.get_json_object("payload", f"$.{key}"))
    return told.select("expert_id", "batch_id", size("selected_evidence").alias("items"), size("do_not_mention").alias("hidden"))


@query(BUNDLES + """ SELECT bs.expert_id, array_to_string(list_transform(list_concat(list_concat(list_filter(sel, lambda x: x.ty = 'paper'), list_filter(sel, lambda x: x.ty = 'project')), list_filter(sel, lambda x: x.ty = 'patent')), lambda x: x.id), '|') AS ids, direct_match_count,
  CAST((SELECT count(*) FROM s WHERE s.expert_id = bs.expert_id) - (SELECT count(*) FROM dd WHERE dd.expert_id = bs.expert_id) AS BIGINT) AS dropped, CAST(len(list_filter(sel, lambda x: x.ty = 'paper')) AS INTEGER) AS papers, CAST(len(list_filter(sel, lambda x: x.ty = 'project')) AS INTEGER) AS projects, CAST(len(list_filter(sel, lambda x: x.ty = 'patent')) AS INTEGER) AS patents, CAST(len(sel) AS INTEGER) AS total FROM bs""")
def selection_trace(spark: SparkSession, d: str) -> DataFrame:
    scored = _items(spark, d)
    items = E.dedup(scored)
    own = E.selection_trace(E.bundles(items, E.select_quota(items, ASPECTS)), E.dedup_dropped(scored, items))
    return own.select("expert_id", strings("selected_evidence_ids").alias("ids"), "direct_match_count", F.col("dedup_dropped_count").alias("dropped"), "papers", "projects", "patents", "total")


# --- reasons, set operations, feedback ---------------------------------------------------------------------

FALL = """CASE WHEN len(x) = 0 THEN '직접적인 질의 일치 근거를 확인하지 못했습니다.' ELSE concat(array_to_string(x[1:2], '과 '), '을 통해 질의와 관련된 직접 근거를 확인했습니다.') END"""


@query(BUNDLES + """, ord AS (SELECT expert_id, list_concat(list_concat(list_filter(sel, lambda x: x.ty = 'paper'), list_filter(sel, lambda x: x.ty = 'project')), list_filter(sel, lambda x: x.ty = 'patent')) AS o FROM bs),
un AS (SELECT expert_id, generate_subscripts(o, 1) AS i, unnest(o).lb AS lab FROM ord),
la AS (SELECT expert_id, lab, min(i) AS i FROM un GROUP BY 1, 2),
xs AS (SELECT ord.expert_id, coalesce(list(lab ORDER BY i) FILTER (lab IS NOT NULL), []) AS x FROM ord LEFT JOIN la USING (expert_id) GROUP BY 1) SELECT expert_id, """ + FALL + " AS reason FROM xs")
def fallback_reason(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    own = _bundles(spark, d).withColumn("evidence", G.resolve_evidence("selected", none, none, none, none))
    return own.select("expert_id", G.fallback_reason("evidence").alias("reason"))


@query(r"""
WITH m AS (SELECT conv_id, turn, concat(text, CASE WHEN turn = 1 THEN ' see paper:3' ELSE '' END) AS reason, lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, concat_ws('|', CASE WHEN t <> '' AND conv_id % 3 <> 1 AND contains(t, 'thing') OR t <> '' AND conv_id % 3 <> 2 AND contains(t, 'der') THEN 'other_candidate_name' END,
  CASE WHEN t <> '' AND turn = 1 THEN 'internal_evidence_id' END, CASE WHEN t <> '' AND conv_id % 2 = 0 AND NOT (contains(concat(lower(CAST(conv_id AS VARCHAR)), ' title'), '4')) THEN 'aspect_scope_miss' END,
  CASE WHEN conv_id % 2 = 1 AND contains(t, 'recommend') THEN 'strong_claim_without_direct_evidence' END) AS violations FROM m""")
def reason_validator(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("conv_id", "turn", strings("violations").alias("violations"))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") == 1, " see paper:3").otherwise("")).alias("reason"))
    name = F.when(F.col("conv_id") % 3 == 1, "thing").when(F.col("conv_id") % 3 == 2, "der").otherwise("-")
    item = F.struct(F.lit("paper").alias("type"), F.concat(F.col("conv_id").cast("string"), F.lit(" Title")).alias("title"), F.lit("").alias("detail"), F.lit("").alias("snippet"))
    rows = rows.withColumns({"name": name, "names": F.array(F.lit("thing"), F.lit("der"), F.lit("x")), "evidence": F.filter(F.array(item), lambda x: F.col("conv_id") % 2 == 0)})
    return rows.withColumn("violations", G.violations("reason", "name", "evidence", "names", ["4"]))


@query("WITH v AS (" + SQL["reason_validator"] + ") SELECT count(*) AS checked, count(*) FILTER (violations <> '') AS fallback_count, CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER (violations <> '')::DOUBLE / count(*), 3) ELSE 0 END AS fallback_ratio FROM v")
def validator_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.validator_summary(_validated(spark, d))


@query("SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN text ELSE '' END AS reasons FROM conversations")
def reasons_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", strings(G.reasons_alias("text")).alias("reasons"))


@query("""WITH c AS (SELECT c_custkey AS expert_id FROM customer), o AS (SELECT o_custkey AS expert_id, arg_max(o_orderpriority, o_orderkey) AS reason, arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY 1)
SELECT c.expert_id, CASE st WHEN 'F' THEN '높음' ELSE '보통' END AS fit, coalesce(reason, '') AS reason, o.expert_id IS NOT NULL AS returned FROM c LEFT JOIN o USING (expert_id)""")
def reason_alignment(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").select(F.col("o_custkey").alias("expert_id"), F.when(F.col("o_orderstatus") == "F", "높음").otherwise("other").alias("fit"), F.concat(F.lit("  "), "o_orderpriority").alias("reason"), F.col("o_orderkey").alias("pos"))
    return G.align_reasons(table(spark, d, "customer").select(F.col("c_custkey").alias("expert_id")), out)


@query("SELECT c_custkey AS expert_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_candidates(spark: SparkSession, d: str) -> DataFrame:
    return G.missing_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("expert_id")), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("expert_id")))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def batch_subset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON n_nationkey = s_nationkey")
def lookup_with_default(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation").where("n_nationkey < 10")), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("SELECT CAST(row_number() OVER (ORDER BY ts, concat('q', event_id)) AS BIGINT) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, concat('q', event_id) AS query, concat('[\"', user_id, '\"]') AS selected_expert_ids, '[]' AS rejected_expert_ids, event_type AS notes FROM events")
def feedback_append(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("ts").alias("created_at"), F.concat(F.lit("q"), "event_id").alias("query"), F.array(F.col("user_id").cast("string")).alias("selected"), F.array().cast("array<string>").alias("rejected"), F.col("event_type").alias("notes"), F.struct("value").alias("metadata"))
    return feedback_rows(rows).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "query", "selected_expert_ids", "rejected_expert_ids", "notes")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def feedback_windows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return feedback_counts(events).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


# --- functions over lists, plans --------------------------------------------------------------------------


@query("SELECT p_partkey, concat(p_name, CASE WHEN p_type <> p_name THEN concat('|', p_type) ELSE '' END) AS items FROM part")
def unique_list(spark: SparkSession, d: str) -> DataFrame:
    own = F.array(F.concat(F.lit("  "), F.col("p_name")), F.col("p_type"), F.lit(" "), F.concat(F.col("p_name"), F.lit("\n")), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", strings(T.unique_strings(own)).alias("items"))


@query(r"WITH s AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '(?i)\b(bolt|red)\b', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(p_type, '(?i)\b(bolt|red|promo)\b', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM part) SELECT p_partkey, concat_ws('|', nullif(a, ''), CASE WHEN b <> a THEN nullif(b, '') END) AS terms FROM s")
def domain_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", strings(T.domain_terms(F.array("p_name", "p_type", "p_name"), ["red", "bolt", "promo"])).alias("terms"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '과제 평가' WHEN 1 THEN 'project evaluation' ELSE '' END AS names FROM part")
def contextual_terms(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("p_size") % 3 == 0, "과제를  평가").when(F.col("p_size") % 3 == 1, "who EVALUATE projects").otherwise("projection evaluations")
    return table(spark, d, "part").select("p_partkey", strings(T.contextual(F.concat_ws(" ", "p_name", tail), X.CONTEXTUAL)).alias("names"))


@query("WITH u AS (SELECT p_partkey, unnest([p_name, p_type, p_brand, concat(p_type, ' x')]) AS t FROM part) SELECT p_partkey, string_agg(t, '|' ORDER BY length(replace(t, ' ', '')) DESC, length(t) - length(replace(t, ' ', '')), t) AS items FROM u GROUP BY 1")
def most_specific(spark: SparkSession, d: str) -> DataFrame:
    own = F.array("p_name", "p_type", "p_brand", F.concat(F.col("p_type"), F.lit(" x")))
    return table(spark, d, "part").select("p_partkey", strings(T.most_specific(own)).alias("items"))


_DISTINCT = "array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]{more}), lambda x: x[1]), '|')"


@query(
    "WITH t AS (SELECT p_partkey, p_size, string_split(concat(p_name, ' ', p_type, CASE WHEN p_size % 2 = 0 THEN ' system' ELSE '' END), ' ') AS w FROM part) SELECT p_partkey, "
    + _DISTINCT.format(more="") + " AS core, " + _DISTINCT.format(more=" AND x[1] <> 'system'") + " AS must, 'expert' AS roles, 'find' AS actions, CASE WHEN p_size % 3 = 0 THEN 'project evaluation' ELSE '' END AS targets FROM t"
)
def planned(spark: SparkSession, d: str) -> DataFrame:
    """L3, L4, L6, F19 over a table of queries; the context of a review is no aspect."""
    text = F.concat(F.lit("find "), "p_name", F.lit(" expert\n "), "p_type", F.when(F.col("p_size") % 2 == 0, " system").otherwise(""), F.when(F.col("p_size") % 3 == 0, " project evaluation").otherwise(""))
    own = plans(table(spark, d, "part").select("p_partkey", text.alias("text")))
    core = F.filter("core", lambda t: ~t.isin("project", "evaluation"))
    must = F.filter("must", lambda t: ~t.isin("project", "evaluation"))
    return own.select("p_partkey", strings(core).alias("core"), strings(must).alias("must"), strings("roles").alias("roles"), strings("actions").alias("actions"), strings("targets").alias("targets"))


def _expanded(branch: str) -> str:
    return " ".join(" ".join(sorted(X.EXPANSION["uav"][branch])).split())


@query(
    "WITH p AS (SELECT p_partkey, p_size, concat(p_name, ' ', p_type) AS t FROM part) SELECT p_partkey, b AS branch, 'stable' AS path, t AS sparse, t AS dense FROM p, unnest(['basic', 'art', 'pat', 'pjt']) u(b)"
    + "".join(f" UNION ALL SELECT p_partkey, '{b}', 'expanded', concat(t, ' {_expanded(b)}'), t FROM p WHERE p_size % 2 = 0" for b in ("art", "pat", "pjt"))
)
def branch_query_texts(spark: SparkSession, d: str) -> DataFrame:
    """R1, R1b, R1c over a table of plans; expansion reaches the sparse text, the dense one is the semantic query."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                plan = constrain(QueryPlan(query="", retrieval_core=[r.p_name, r.p_type], bundle_ids=["uav", "none"] if r.p_size % 2 == 0 else []))
                rows += [(r.p_partkey, q.branch, q.path, q.sparse, q.dense) for q in branch_queries(plan)]
            yield pd.DataFrame(rows, columns=["p_partkey", "branch", "path", "sparse", "dense"])

    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size").mapInPandas(run, "p_partkey long, branch string, path string, sparse string, dense string")


@query("SELECT vec_id, concat('<Dense Vector: ', 2 * len(embedding), ' dimensions>') AS shown FROM embeddings")
def mask_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", T.mask_vector(F.concat("embedding", "embedding")).alias("shown"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, round(coalesce(ln(1 + nullif(greatest(list_max(list_transform(w, lambda x: length(x) - 4)), 0), 0)), 0), 9) AS long_words, round(coalesce(ln(1 + nullif(list_max(list_transform(w, lambda x: length(x) - length(replace(x, 'o', '')))), 0)), 0), 9) AS os FROM w")
def sparse_weights(spark: SparkSession, d: str) -> DataFrame:
    """two features of words as logits of tokens; the third never fires."""

    def model(text: str):
        words = text.split(" ")
        return np.array([[len(w) - 4, w.count("o"), -1] for w in words], float), np.ones(len(words))

    own = table(spark, d, "part").select("p_partkey", sparse_column(F.col("p_name"), model).alias("m"))
    weight = lambda i: F.round(F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)), 9)
    return own.select("p_partkey", weight(0).alias("long_words"), weight(1).alias("os"))


@query(f"WITH {EXPERTS} SELECT expert_id FROM x WHERE contains(degree, 'MACH')")
def filter_major(spark: SparkSession, d: str) -> DataFrame:
    return P.apply_filters(experts(spark, d).withColumn("major", F.col("degree")), {"major": "MACH"}).select("expert_id")


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0)")
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return V.missing_keys(table(spark, d, "nation").select("n_nationkey", "n_name"), have, "n_nationkey").select("n_name")


@query(f"""WITH {EXPERTS}, e AS (
  SELECT o_custkey AS expert_id, CASE o_orderkey % 3 WHEN 0 THEN 'paper' ELSE 'patent' END AS type, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1 AS i,
    concat(CASE o_orderkey % 3 WHEN 0 THEN 'Paper ' ELSE 'Patent ' END, o_orderkey) AS title, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE o_orderstatus END AS body, day AS date, CASE o_orderkey % 3 WHEN 1 THEN o_orderstatus END AS detail,
    CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat('Patent ', o_orderkey) END AS main, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat('type: ', o_orderstatus, ', country: ') END AS secondary FROM o WHERE o_orderkey % 3 < 2
  UNION ALL SELECT o_custkey, 'project', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, concat('Project ', o_orderkey), '', endd, NULL, '', '' FROM pr)
SELECT expert_id, type, concat(type, ':', i) AS item_id, title, body, date, detail, main, secondary FROM e WHERE expert_id IN (SELECT expert_id FROM x)""")
def evidence_mapping(spark: SparkSession, d: str) -> DataFrame:
    return flat_evidence(experts(spark, d)).drop("metadata")


# --- reasons: answers read back ----------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer a part: prose around a JSON object whose last item repeats the candidate."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("batch_id"), "p_name", "p_type", "p_brand", "p_size")
    item = lambda fit, reason: F.struct(F.col("batch_id").cast("string").alias("expert_id"), fit.alias("fit"), reason.alias("recommendation_reason"), F.array("p_brand").alias("risks"))
    fit = F.when(F.col("p_size") % 2 == 0, "높음").otherwise("bad")
    body = F.to_json(F.struct(F.array(item(F.lit("중간"), F.lit("{first}")), item(fit, F.concat(F.lit(" "), "p_name", F.lit("\n")))).alias("items"), F.array(F.col("p_type"), F.concat(F.lit("  "), "p_type"), F.lit("")).alias("data_gaps")))
    return p.select("batch_id", F.concat(F.lit("Here {it} is\n```json\n"), body, F.lit("\n```")).alias("raw"))


@query("SELECT p_partkey AS batch_id, CAST(0 AS INTEGER) AS pos, CAST(p_partkey AS VARCHAR) AS expert_id, '중간' AS fit, '{first}' AS reason, p_brand AS risks FROM part UNION ALL SELECT p_partkey, 1, CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN '높음' ELSE 'bad' END, concat(' ', p_name, chr(10)), p_brand FROM part")
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    return N.parsed(_answers(spark, d)).select("batch_id", "pos", "expert_id", "fit", "reason", strings("risks").alias("risks"))


@query("SELECT DISTINCT p_type AS gap FROM part")
def merged_gaps(spark: SparkSession, d: str) -> DataFrame:
    return N.data_gaps(_answers(spark, d))


@query("SELECT p_partkey AS expert_id, CASE WHEN p_size % 2 = 0 THEN '높음' ELSE '보통' END AS fit, p_name AS reason, true AS returned FROM part")
def generated_reasons(spark: SparkSession, d: str) -> DataFrame:
    """A client on the executors, its answers parsed and aligned; ids keep their type, the last of repeats counts."""
    answers = N.generate(_answers(spark, d).withColumnRenamed("raw", "payload"), lambda text: text.replace("Here", "There"))
    outputs = N.parsed(answers).withColumn("expert_id", F.col("expert_id").cast("long"))
    return G.align_reasons(table(spark, d, "part").select(F.col("p_partkey").alias("expert_id")), outputs)


@query("""WITH c AS (SELECT c_custkey, c_custkey % 40 AS batch_id FROM customer), o AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'P' THEN '  ' ELSE o_orderpriority END, o_orderkey) AS reason FROM orders WHERE o_orderkey % 40 < 36 AND o_custkey % 40 <> 7 GROUP BY 1),
b AS (SELECT batch_id, count(*) AS size, count(*) FILTER (o_custkey IS NULL) AS missing, count(*) FILTER (coalesce(trim(reason), '') = '') AS empty FROM c LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1)
SELECT batch_id, size, missing, empty, round_even((size - missing)::DOUBLE / size, 3) AS returned_ratio, CASE WHEN missing > 0 THEN 'missing_candidate_ids' WHEN empty > 0 THEN 'empty_reason_candidate_ids' ELSE '' END AS retry_trigger FROM b""")
def retry_decisions(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("batch_id"), F.col("c_custkey").alias("expert_id"))
    out = table(spark, d, "orders").where("o_orderkey % 40 < 36 AND o_custkey % 40 <> 7").select((F.col("o_custkey") % 40).alias("batch_id"), F.col("o_custkey").alias("expert_id"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderpriority")).alias("reason"))
    return N.batch_stats(own, out).withColumn("retry_trigger", F.coalesce("retry_trigger", F.lit("")))


# --- stored tables -----------------------------------------------------------------------------------------


@query("SELECT 'r_name' AS name, 'string' AS type, count(*) AS n FROM region UNION ALL SELECT 'r_regionkey', 'int', count(*) FROM region")
def collection_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A collection is created once, a second creation leaves it."""
    path, own = fresh(spark), table(spark, d, "region").select("r_regionkey", "r_name")
    ensure_collection(own, path)
    ensure_collection(own.limit(1), path)
    info = collection_info(spark, path)
    return spark.createDataFrame([(c, t, info["rows"]) for c, t in info["columns"].items()], "name string, type string, n long")


@query("SELECT n_nationkey, n_name, false AS first_hit, true AS second_hit, false AS other_hit, false AS strict_hit FROM nation")
def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """A result is stored under its texts, filters, snapshot and settings; another snapshot or another cutoff is another result."""
    folder, own = fresh(spark), table(spark, d, "nation").select("n_nationkey", "n_name")
    keys = [result_key("texts", "{}", snapshot, cutoff) for snapshot, cutoff in (("a", "0.82"), ("a", "0.82"), ("b", "0.82"), ("a", "0.5"))]
    found = [cached_result(spark, folder, k, lambda: own) for k in keys]
    flags = {n: F.lit(hit) for n, (_, hit) in zip(("first_hit", "second_hit", "other_hit", "strict_hit"), found, strict=True)}
    return found[1][0].withColumns(flags)


# --- the engine --------------------------------------------------------------------------------------------

def _shown(found: DataFrame) -> DataFrame:
    return found.select("rank", "expert_id", "name", "stable_hits", "expanded_hits", "score_pct")


@query(_engine_sql(["the", "and", "with"], 0.0, dense="the, and;, With") + _SHOWN)
def search_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _shown(engine(spark, d).search("the, and;\nWith"))


@query(_engine_sql(["the", "and", "with"], 0.0, "article_cnt >= 10 AND expert_id <> 'src1'", "NOT contains(expert_id, 'src1')") + _SHOWN)
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """P3, P9 before the prefetch: what a filter drops takes no place in it; P11 after it, by containment."""
    return _shown(engine(spark, d).search("the and with", filters={"article_cnt_min": 10}, exclude=["Org SRC-1"]))


@query(_engine_sql(["the", "and", "with"], 0.0, "expert_id = 'src5'") + _SHOWN)
def included_search(spark: SparkSession, d: str) -> DataFrame:
    """One organisation of many still has all its points in the prefetch."""
    return _shown(engine(spark, d).search("the and with", include=["org src5"]))


@query(_engine_sql(["the", "and", "with", "that", "la", "de"], 0.82, hashed="SELECT DISTINCT dense AS text, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q FROM qq") + _SHOWN)
def search_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """P12 at its real value, with a stored vector as the query's: only what is close to it stays."""
    return _shown(engine(spark, d, R.Limits(), query_vector=lambda text: _vector(spark, d, 0)).search("the and with that la de"))


_OWN_ITEMS = r"""
i AS (SELECT p.expert_id, CASE branch WHEN 'pat' THEN 'patent' WHEN 'pjt' THEN 'project' ELSE 'paper' END AS type, concat(CASE branch WHEN 'pat' THEN 'patent' WHEN 'pjt' THEN 'project' ELSE 'paper' END, ':', point_id) AS item_id,
  string_split(text, chr(10))[1] AS title, text AS body, concat(1975 + point_id % 40, '-01-01') AS date, 1975 + point_id % 40 AS year FROM p JOIN o USING (expert_id)),
v AS (SELECT *, lower(trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g'))) AS t, lower(trim(regexp_replace(body, '[\s\p{Z}]+', ' ', 'g'))) AS bo, replace(t, ' ', '') AS tc, replace(bo, ' ', '') AS bc, row_number() OVER (PARTITION BY expert_id, type ORDER BY date DESC, title DESC, item_id) AS pos, count(*) OVER (PARTITION BY expert_id, type) AS n FROM i),
"""
_SCORED = ITEMS[ITEMS.index("f AS (SELECT *") :].replace("bluebolt", "the").replace("blue bolt", "the").replace("'small'", "'and'").replace("contains(t, 'economy') OR contains(bo, 'economy') AS ge", "false AS ge")
_RECOMMENDED = _engine_sql(["the", "and"], 0.0).replace("WITH p AS", "WITH p AS", 1) + "," + _OWN_ITEMS + _SCORED + "," + QUOTA + BUNDLES[BUNDLES.index(", bu AS (SELECT") :] + """,
ga AS (SELECT o.*, sel, CASE WHEN coalesce(direct_match_count, 0) < 1 THEN 3 WHEN coalesce(cov, 0) < 2 THEN 1 ELSE 0 END AS bucket FROM o LEFT JOIN bs USING (expert_id)),
sh AS (SELECT *, CAST(row_number() OVER (ORDER BY bucket, rank) AS INTEGER) AS place FROM ga WHERE bucket < 3 QUALIFY place <= 15),
ord AS (SELECT expert_id, list_concat(list_concat(list_filter(sel, lambda x: x.ty = 'paper'), list_filter(sel, lambda x: x.ty = 'project')), list_filter(sel, lambda x: x.ty = 'patent')) AS so FROM sh),
un AS (SELECT expert_id, generate_subscripts(so, 1) AS i, unnest(so).lb AS lab FROM ord),
la AS (SELECT expert_id, lab, min(i) AS i FROM un GROUP BY 1, 2),
xs AS (SELECT ord.expert_id, coalesce(list(lab ORDER BY i) FILTER (lab IS NOT NULL), []) AS x FROM ord LEFT JOIN la USING (expert_id) GROUP BY 1)
SELECT place AS rank, expert_id, name, '보통' AS fit, """ + FALL + " AS reason, 'selected_evidence' AS fallback_source FROM sh JOIN xs USING (expert_id)"


@query(_RECOMMENDED)
def recommend_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).recommend("the and").select("rank", "expert_id", "name", "fit", "reason", "fallback_source")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend_pipeline(spark, sf_dir)


from . import search_queries as _search_queries, service_queries as _service_queries  # noqa: E402, F401  they register their queries
