"""Registered queries of the segmented index, of many queries in one plan, and of what builds on them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import counted_terms, tokens
from .operators import retrieval as R
from .operators import segments as S
from .operators.metrics import ranking_metrics
from .operators.payload import PayloadIndex, build_payload
from .operators.relax import relaxed
from .operators.tables import register_tables
from .plans import lexicon as X
from .plans.models import SparseBackend, batch_encoder, sparse_backend
from .plans.plan import QueryPlan, constrain
from .report import evaluate
from .queries import BRANCH, EXPERTS, SQL, YEAR, engine, query, search_sql, stored_once, table
from .sources.corpus import documents, experts, points
from .sources.files import folder
from .sources.scratch import fresh
from .streaming.sessions import SESSIONS, stored_sessions

# --- many queries in one plan ------------------------------------------------------------------------------

#: Every benchmark passage is a query: its words of two letters or more, each once.
WORDS = "array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: length(x[1]) >= 2 AND list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ')"
ASKED = f"(SELECT item_id AS query_id, {WORDS} AS t FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark))"
TASKS = f"SELECT query_id, b AS branch, 'stable' AS path, t AS sparse, t AS dense FROM {ASKED} q, unnest(['basic', 'art', 'pat', 'pjt']) u(b) WHERE t <> ''"


def asked(spark: SparkSession, d: str) -> DataFrame:
    """query_id, text: the benchmark's passages."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("text"))


def index_of(spark: SparkSession, d: str) -> S.SegmentedIndex:
    """All documents as one segment, stored once a session."""
    return stored_once(spark, d, "segments", lambda: S.create_segments(S.text_terms(points(spark, d)), fresh(spark)))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) >= 2))).alias("term")
    own = asked(spark, d).select("query_id", words)
    return own.select("query_id", F.explode(F.lit(list(X.BRANCHES))).alias("branch"), "term", F.lit(1.0).alias("weight"))


_MANY = " SELECT query_id, rank, expert_id, name, stable_hits, expanded_hits, score_pct FROM o"


def _many(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "expert_id", "name", "stable_hits", "expanded_hits", "score_pct")


@query(search_sql(TASKS) + _MANY)
def multi_query_search(spark: SparkSession, d: str) -> DataFrame:
    """All passages of the benchmark searched by one plan."""
    return _many(engine(spark, d, index=index_of(spark, d)).search_many(asked(spark, d)))


@query(search_sql(TASKS, where="article_cnt >= 4 AND expert_id <> 'src1'", after="NOT contains(expert_id, 'src1')") + _MANY)
def multi_query_filtered(spark: SparkSession, d: str) -> DataFrame:
    """P3, P9, P11 for many queries: what a filter drops takes no place in a prefetch."""
    own = engine(spark, d, index=index_of(spark, d))
    return _many(own.search_many(asked(spark, d), filters={"article_cnt_min": 4}, exclude=["Org SRC-1"]))


@query(search_sql(TASKS) + " SELECT query_id, branch, point_id, sparse, CAST(sr AS INTEGER) AS rank FROM a WHERE sr <= 1000")
def block_max_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand points of each query and branch; blocks that can't enter are not scored."""
    by = ("query_id", "branch")
    return R.top(index_of(spark, d).scores(_wanted(spark, d), by, 1000), list(by), "sparse", 1000).select("query_id", "branch", "point_id", "sparse", "rank")


@query()
def block_max_share(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's blocks, how many are scored for its first ten points. How points fall into ranges is the index' own choice, so there is no SQL."""
    return index_of(spark, d).blocks_read(_wanted(spark, d), ("query_id", "branch"), 10)


_JUDGED = "SELECT DISTINCT q.item_id AS query_id, source AS expert_id, 1 + q.item_id % 3 AS gain FROM benchmark q JOIN documents d ON q.item_id % 20 = d.doc_id % 20"


@query(
    search_sql(TASKS) + f", ju AS ({_JUDGED}), fo AS (SELECT o.query_id, sum(gain / log2(rank + 1)) AS dcg, min(rank) AS best FROM o JOIN ju USING (query_id, expert_id) WHERE rank <= 10 GROUP BY 1),"
    " ii AS (SELECT query_id, sum(gain / log2(k + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS k FROM ju) WHERE k <= 10 GROUP BY 1),"
    " oo AS (SELECT query_id, count(*) AS retrieved, arg_min(expert_id, rank) AS top_id FROM o GROUP BY 1)"
    " SELECT query_id, coalesce(retrieved, 0) AS retrieved, coalesce(top_id, '') AS top_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / best, 0), 6) AS mrr FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN oo USING (query_id) JOIN ii USING (query_id) LEFT JOIN fo USING (query_id)"
)
def search_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Every passage searched and judged: experts of documents whose number goes with the passage's are relevant."""
    q, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    key = lambda c: F.pmod(F.col(c), F.lit(20)).alias("key")
    judged = q.select(F.col("item_id").alias("query_id"), key("item_id")).join(docs.select(F.col("source").alias("expert_id"), key("doc_id")).distinct(), "key")
    judged = judged.select("query_id", "expert_id", (1 + F.pmod("query_id", F.lit(3))).alias("gain"))
    own = evaluate(engine(spark, d, index=index_of(spark, d)), asked(spark, d), judged)
    return own.select("query_id", "retrieved", F.coalesce("top_id", F.lit("")).alias("top_id"), F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))


@query("SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS x, CAST(length(p_name) - length(replace(p_name, 'o', '')) AS DOUBLE) AS y, 2 AS n FROM part")
def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """a batch encoder over a table: lengths and counts of a letter as vectors of two dimensions."""
    encoder = batch_encoder(lambda texts: [[len(t), t.count("o")] for t in texts], 2)
    own = table(spark, d, "part").select("p_partkey", encoder(F.col("p_name")).alias("v"))
    return own.select("p_partkey", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.size("v").alias("n"))


# --- expanded paths and support ----------------------------------------------------------------------------

_WIDE = "SELECT 0 AS query_id, b AS branch, 'stable' AS path, 'the and' AS sparse, 'the and' AS dense FROM unnest(['basic', 'art', 'pat', 'pjt']) u(b)" + "".join(
    f" UNION ALL SELECT 0, '{b}', 'expanded', 'the and {' '.join(sorted(X.EXPANSION['uav'][b]))}', 'the and'" for b in ("art", "pat", "pjt")
)


@query(search_sql(_WIDE, support="stable_hits >= 5 OR (expanded_hits >= 3 AND n_branches >= 2)") + " SELECT rank, expert_id, stable_hits, expanded_hits, score_pct FROM o")
def bundle_search(spark: SparkSession, d: str) -> DataFrame:
    """A plan with a bundle runs expanded paths too; support asks for five stable hits, or three expanded ones in two branches."""
    plan = constrain(QueryPlan(query="the and", retrieval_core=["the", "and"], bundle_ids=["uav"], semantic_query="the and"))
    found = engine(spark, d, R.Limits(cutoff=0.0, stable_min=5, expanded_min=3)).search(plan)
    return found.select("rank", "expert_id", "stable_hits", "expanded_hits", "score_pct")


# --- learned weights ---------------------------------------------------------------------------------------


def log_frequencies(text: Column) -> Column:
    """A stand-in for a trained encoder: a word's logit in a text is its frequency, its weight log(1 + relu(logit))."""
    pairs = F.transform(counted_terms(tokens(text)), lambda t: F.struct(t["term"].alias("k"), F.log1p(t["weight"]).alias("v")))
    return F.map_from_entries(pairs)


def _make(name: str, local: bool) -> object:
    if name != "log-frequencies":
        raise FileNotFoundError(name)
    return log_frequencies


def learned(spark: SparkSession, d: str) -> tuple[SparseBackend, S.SegmentedIndex]:
    """The configured model isn't there, the chain's next one is; its weights are the index."""
    chain = sparse_backend("a-model-that-is-not-there", "log-frequencies", _make)
    return chain, stored_once(spark, d, "learned", lambda: S.create_segments(S.encoded_terms(points(spark, d), chain.encoder), fresh(spark), kind=S.DOT))


@query(search_sql(TASKS, weigh="ln(1 + qf) * ln(1 + tf)") + _MANY)
def learned_sparse_search(spark: SparkSession, d: str) -> DataFrame:
    """The backend chain's encoder weighs the words of points and queries; scores are products of stored weights."""
    chain, index = learned(spark, d)
    return _many(engine(spark, d, index=index, sparse=chain).search_many(asked(spark, d)))


# --- segments ----------------------------------------------------------------------------------------------

_NOW = f"""
p AS (SELECT doc_id AS point_id, source AS expert_id, {BRANCH} AS branch, embedding, regexp_extract_all(lower(CASE WHEN doc_id % 5 = 1 THEN concat('the zebra ', text) ELSE text END), '[0-9a-z가-힣]+') AS toks
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE doc_id % 7 <> 2)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """points() without vectors. Only a vector's id that repeats asks for the join, which shuffles all texts: else it changes no row."""
    vectors = table(spark, d, "embeddings").where("vec_id IS NOT NULL").groupBy("vec_id").count()
    own = points(spark, d) if vectors.where("count > 1").limit(1).count() else documents(spark, d)
    return own.select("point_id", "expert_id", "branch", "content_text")


def _segments(spark: SparkSession, d: str) -> S.SegmentedIndex:
    """Documents in three steps: two thirds, then the rest, then changed texts for a fifth; a seventh is deleted."""
    own = _texts(spark, d)
    index = S.create_segments(S.text_terms(own.where("point_id % 3 > 0")), fresh(spark))
    index = index.add(S.text_terms(own.where("point_id % 3 = 0")))
    changed = own.where("point_id % 5 = 1").withColumn("content_text", F.concat(F.lit("the zebra "), "content_text"))
    return index.add(S.text_terms(changed)).delete(own.where("point_id % 7 = 2").select("point_id"))


def _points_of(index: S.SegmentedIndex, spark: SparkSession) -> DataFrame:
    by = ("branch",)
    wanted = spark.createDataFrame([(b, t, 1.0) for b in X.BRANCHES for t in ("the", "zebra", "and")], "branch string, term string, weight double")
    return R.top(index.scores(wanted, by, 1000), list(by), "sparse", 1000).select("branch", "point_id", "sparse", "rank")


_NOW_SQL = search_sql("SELECT 0 AS query_id, b AS branch, 'stable' AS path, 'the zebra and' AS sparse, '' AS dense FROM unnest(['basic', 'art', 'pat', 'pjt']) u(b)", points_=_NOW.strip()) + " SELECT branch, point_id, sparse, CAST(sr AS INTEGER) AS rank FROM a WHERE sr <= 1000"


@query(_NOW_SQL)
def index_segments(spark: SparkSession, d: str) -> DataFrame:
    """Points added, replaced and deleted, before any merge."""
    return _points_of(stored_once(spark, d, "changed", lambda: _segments(spark, d)), spark)


@query(_NOW_SQL)
def index_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same after a merge, opened anew; what it replaced is removed."""

    def merged() -> S.SegmentedIndex:
        own = _segments(spark, d).merge()
        own.expire()
        return S.open_segments(spark, own.path)

    return _points_of(stored_once(spark, d, "merged", merged), spark)


# --- payload indexes, relaxation, metrics ------------------------------------------------------------------


def _payload(spark: SparkSession, d: str) -> PayloadIndex:
    return stored_once(spark, d, "payload", lambda: build_payload(experts(spark, d), fresh(spark)))


def _indexed(name: str, like: str, filters: dict, **more) -> None:
    """The same filter as an earlier query's, by the payload index; same SQL."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        return _payload(spark, d).search(filters, as_of=YEAR, **more).select("expert_id")

    f.__name__ = name
    query(SQL[like])(f)


_indexed("payload_nested", "filter_nested_exists", {"art_sci_slct_nm": "1-URGENT", "art_recent_years": 3, "pat_reg_slct_nm": "F"})
_indexed("payload_recency_pool", "filter_recency_pool", {"art_recent_years": 0.5, "pat_recent_years": 0.5, "pjt_recent_years": 0.5})
_indexed("payload_min_counts", "filter_min_counts", {"article_cnt_min": 2, "scie_cnt_min": 1, "patent_cnt_min": 1, "project_cnt_min": 0})
_indexed("payload_exclude_org", "filter_exclude_org", {}, exclude=["(주) nation_3"])
_indexed("payload_include_any", "filter_include_any", {}, include=["nation_3", "NATION-4"], include_any=True)
_indexed("payload_degree", "filter_degree", {"degree_slct_nm": ["BUILDING", "MACHINERY"]})

_LADDER = ("degree = 'BUILDING'", "scie_cnt >= 2", "patent_cnt >= 2", "article_cnt >= 2")


@query(
    f"WITH {EXPERTS}, l AS (SELECT expert_id, greatest({', '.join(f'CASE WHEN {c} THEN 0 ELSE {i + 1} END' for i, c in enumerate(_LADDER))}) AS level FROM x WHERE project_cnt >= 1),"
    " t AS (SELECT level, sum(count(*)) OVER (ORDER BY level) AS total FROM l GROUP BY level), c AS (SELECT coalesce(min(level) FILTER (total >= 200), 4) AS chosen FROM t)"
    " SELECT expert_id, CAST(level AS INTEGER) AS level, array_to_string(['degree', 'scie', 'patents', 'articles'][1:chosen], '|') AS dropped FROM l, c WHERE level <= chosen"
)
def relaxation_ladder(spark: SparkSession, d: str) -> DataFrame:
    """2.11: people with a project; the other conditions go one by one until 200 pass."""
    ladder = list(zip(("degree", "scie", "patents", "articles"), map(F.expr, _LADDER), strict=True))
    own = relaxed(experts(spark, d), ladder, 200, F.col("project_cnt") >= 1)
    return own.select("expert_id", "level", F.array_join("dropped", "|").alias("dropped"))


@query("""
WITH r AS (SELECT c_nationkey AS query_id, c_custkey AS expert_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
j AS (SELECT c_nationkey AS query_id, c_custkey AS expert_id, least(3, count(*) FILTER (o_orderstatus = 'F')) AS gain FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
p AS (SELECT * FROM j WHERE gain > 0),
f AS (SELECT query_id, count(*) AS hits, sum(gain / log2(rank + 1)) AS dcg, min(rank) AS first FROM r JOIN p USING (query_id, expert_id) WHERE rank <= 10 GROUP BY 1),
i AS (SELECT query_id, sum(gain / log2(k + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS k FROM p) WHERE k <= 10 GROUP BY 1),
t AS (SELECT query_id, count(*) AS relevant FROM p GROUP BY 1)
SELECT query_id, relevant, round(coalesce(hits / 10.0::DOUBLE, 0), 6) AS precision, round(coalesce(hits::DOUBLE / relevant, 0), 6) AS recall, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr
FROM t JOIN i USING (query_id) LEFT JOIN f USING (query_id)""")
def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's customers by balance, judged by how many of their orders are done."""
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("expert_id"), "c_acctbal")
    ranked = people.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c_acctbal"), "expert_id")))
    done = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("expert_id")).agg(F.least(F.lit(3), F.count_if(F.col("o_orderstatus") == "F")).alias("gain"))
    own = ranking_metrics(ranked, done.join(people.select("query_id", "expert_id"), "expert_id"))
    return own.select("query_id", "relevant", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "mrr")))


# --- streams and table functions ---------------------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e),
g AS (SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS key, CAST(session AS BIGINT) AS session, epoch_us(started) AS started, epoch_us(ended) AS ended, events FROM g
QUALIFY session < max(session) OVER (PARTITION BY user_id) OR ended + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """N10, 2.11: the events as a stream, to the sessions of its users that have ended."""
    kinds, path = table(spark, d, "events").schema, fresh(spark)
    files = f"{d}/events.parquet"
    stream = spark.readStream.schema(kinds)
    stream = stream.parquet(files) if folder(spark, files) else stream.option("pathGlobFilter", "events.parquet").parquet(d)
    stored_sessions(stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), f"{path}/out", f"{path}/at", key="user_id", gap_minutes=360)
    own = spark.read.schema(SESSIONS).parquet(f"{path}/out")
    return own.select("key", "session", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


@query(
    "WITH r AS (SELECT c_nationkey AS batch_id, c_custkey AS expert_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank, CASE WHEN c_acctbal < 0 THEN 'low' ELSE c_mktsegment END AS gap FROM customer),"
    " b AS (SELECT *, CAST((rank - 1) // 5 + 1 AS INTEGER) AS part FROM r), g AS (SELECT batch_id, part, gap, min(rank) AS f FROM b GROUP BY ALL), j AS (SELECT batch_id, part, string_agg(gap, '|' ORDER BY f) AS gaps FROM g GROUP BY ALL)"
    " SELECT batch_id, part, count(*) AS n, any_value(gaps) AS gaps FROM b JOIN j USING (batch_id, part) GROUP BY 1, 2"
)
def reason_batches(spark: SparkSession, d: str) -> DataFrame:
    """N7, N9, 2.11: a table function in SQL cuts many requests' ranked rows into batches of five and joins their gaps."""
    register_tables(spark)
    own = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("batch_id"), F.col("c_custkey").alias("expert_id"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"),
        F.when(F.col("c_acctbal") < 0, "low").otherwise(F.col("c_mktsegment")).alias("gap"),
    )
    view = f"ranked_{uuid.uuid4().hex}"
    own.createOrReplaceTempView(view)
    return spark.sql(f"SELECT batch_id, part, n, array_join(gaps, '|') AS gaps FROM reason_batches(TABLE(SELECT * FROM {view}) PARTITION BY batch_id ORDER BY (rank), 5)")
