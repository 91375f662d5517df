"""Retrieval: BM25 and cosine top-k, the cascade, fusion, aggregation to experts, support and order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import term_counts, tokens
from ..functions.vectors import cosine

K1, B = 1.2, 0.75
WEIGHTS = {"pjt": 1.015, "pat": 1.005, "art": 1.0, "basic": 0.99}


@dataclass(frozen=True)
class Limits:
    keyword_prefetch: int = 1000
    branch_prefetch: int = 100
    branch_output: int = 50
    cutoff: float = 0.82
    rrf_k: int = 60
    stable_min: int = 1
    expanded_min: int = 2
    missing_org: float = 0.98
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


def postings(points: DataFrame) -> DataFrame:
    """point_id, branch, term, tf. Terms are counted inside their row, so nothing is shuffled."""
    own = points.select("point_id", "branch", F.explode(term_counts(tokens("content_text"))).alias("t"))
    return own.select("point_id", "branch", "t.term", "t.tf")


@dataclass(frozen=True)
class Index:
    """Postings (bucket, term, branch, point_id, expert_id, tf, length) and statistics by branch (branch, n, mean)."""

    postings: DataFrame
    stats: DataFrame
    buckets: int


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(points: DataFrame, path: str, buckets: int = 64) -> Index:
    """Write postings partitioned by the term's bucket and the statistics; a query then reads its terms' buckets alone.

    Each task writes the postings of its own points, so none is shuffled and a frequent term's are spread over all tasks.
    """
    toks = tokens("content_text")
    rows = points.select("point_id", "expert_id", "branch", toks.alias("toks")).select("point_id", "expert_id", "branch", F.size("toks").alias("length"), F.explode_outer(term_counts("toks")).alias("t"))
    posts = rows.where("t is not null").select("t.term", "branch", "point_id", "expert_id", "t.tf", "length", bucket_of(F.col("t.term"), buckets).alias("bucket"))
    posts.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    points.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(toks)).alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(points.sparkSession, path, buckets)


def open_index(spark: SparkSession, path: str, buckets: int = 64) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), buckets)


def scan_index(points: DataFrame, terms: list[str]) -> Index:
    """The same for a corpus without a stored index: the terms' postings by one scan, as part of the query's own plan."""
    toks = tokens("content_text")
    some = F.filter(term_counts(F.filter("toks", lambda t: t.isin(terms))), lambda t: t["tf"] > 0)
    rows = points.select("point_id", "expert_id", "branch", toks.alias("toks")).select("point_id", "expert_id", "branch", F.size("toks").alias("length"), F.explode(some).alias("t"))
    posts = rows.select("t.term", "branch", "point_id", "expert_id", "t.tf", "length", F.lit(0).alias("bucket"))
    return Index(posts, points.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(toks)).alias("mean")), 1)


def bm25_tasks(index: Index, tasks: DataFrame) -> DataFrame:
    """R3 over the index: tasks (task columns, branch, path, terms) -> point_id, expert_id, branch, path, sparse of every point that holds a term.

    tasks has a row for each branch and path: a handful, so it and the terms' document counts are broadcast. The buckets
    are literals: only their partitions are read.
    """
    wanted = tasks.select("branch", "path", F.explode(F.array_distinct("terms")).alias("term"))
    terms = wanted.select("term", bucket_of(F.col("term"), index.buckets).alias("b")).collect()  # the query's own words
    mine = F.col("bucket").isin(sorted({r.b for r in terms})) & F.col("term").isin(sorted({r.term for r in terms})) if terms else F.lit(False)
    posts = index.postings.where(mine).join(F.broadcast(index.stats), "branch")
    known = posts.groupBy("branch", "term").agg(F.count(F.lit(1)).alias("df"))
    size = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + size)
    # One row for each of the query's terms and branches.
    rows = posts.join(F.broadcast(known), ["branch", "term"]).join(F.broadcast(wanted), ["branch", "term"])
    return rows.groupBy("point_id", "expert_id", "branch", "path").agg(F.round(F.sum(part), 6).alias("sparse"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _equals(value: str):
    return lambda x: x == value


def bm25(points: DataFrame, terms: list[str], name: str = "sparse") -> DataFrame:
    """Points with the sum of the terms' BM25 weights; one pass for the statistics and one for the scores, no postings shuffle.

    The statistics are one row, whatever the corpus, so their broadcast is bounded.
    """
    points_, toks = points.withColumn("__toks", tokens("content_text")), F.col("__toks")
    tf = [F.size(F.filter(toks, _equals(w))).alias(f"__tf{i}") for i, w in enumerate(terms)]
    counted = points_.select(*points.columns, F.size(toks).alias("__len"), *tf)
    stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *(F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))))
    size = K1 * (1 - B + B * F.col("__len") / F.col("__avg"))
    parts = [idf(F.col("__n"), F.col(f"__df{i}")) * F.col(f"__tf{i}") * (K1 + 1) / (F.col(f"__tf{i}") + size) for i in range(len(terms))]
    score = F.lit(0.0)
    for p in parts:
        score = score + p
    return counted.join(F.broadcast(stats)).select(*points.columns, F.round(score, 6).alias(name))


def with_cosine(points: DataFrame, vector: DataFrame, name: str = "dense") -> DataFrame:
    """Cosine with the one query vector (a row with column q)."""
    return points.join(F.broadcast(vector)).withColumn(name, F.round(cosine(F.col("embedding"), F.col("q")), 6)).drop("q")


def ranked(frame: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """1-based rank by descending score, then point_id."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "point_id")))


def top(frame: DataFrame, by: list[str], score: str, k: int, name: str = "rank") -> DataFrame:
    return ranked(frame, by, score, name).where(F.col(name) <= k)


def prefetch(scored: DataFrame, limits: Limits, by: tuple[str, ...] = ("branch", "path")) -> DataFrame:
    """R2: the best points by sparse score."""
    return top(scored.where("sparse > 0"), list(by), "sparse", limits.keyword_prefetch, "pre_rank")


def cascade(scored: DataFrame, limits: Limits, by: tuple[str, ...] = ("branch", "path")) -> DataFrame:
    """Sparse prefetch, then the best of it by each score, fused by reciprocal rank.

    scored: point_id, expert_id, the by columns, sparse, dense. One window each; no list is joined back.
    """
    return rerank(prefetch(scored, limits, by), limits, by)


def rerank(pre: DataFrame, limits: Limits, by: tuple[str, ...] = ("branch", "path")) -> DataFrame:
    """R4-R6 on what the prefetch has left. A point without a vector (dense is null) has no dense rank."""
    own = list(by)
    pre = ranked(ranked(pre, own, "dense", "dense_rank"), own, "sparse", "sparse_rank")
    part = lambda c, of: F.when(F.col(of).isNotNull() & (F.col(c) <= limits.branch_prefetch), 1 / (F.col(c) + limits.rrf_k)).otherwise(0.0)
    fused = pre.withColumn("rrf_score", F.round(part("dense_rank", "dense") + part("sparse_rank", "sparse"), 9)).where("rrf_score > 0")
    return top(fused, own, "rrf_score", limits.branch_output).drop("pre_rank", "dense_rank", "sparse_rank")


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Lists (branch, path, rank, expert_id) fused over all lists: the best rank of an expert in each counts."""
    best = lists.groupBy("expert_id", "branch", "path").agg(F.min("rank").alias("rank"))
    return best.groupBy("expert_id").agg(F.round(F.sum(1 / (F.col("rank") + k)), 9).alias("rrf"), F.count(F.lit(1)).alias("lists"))


def task_index() -> Column:
    b = F.when(F.col("branch") == "basic", 0).when(F.col("branch") == "art", 1).when(F.col("branch") == "pat", 2).otherwise(3)
    return b * 2 + F.when(F.col("path") == "stable", 0).otherwise(1)


def weight(weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for branch, w in weights.items():
        out = F.when(F.col("branch") == branch, w).otherwise(out)
    return out


def aggregate(hits: DataFrame, limits: Limits, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """experts' largest weighted score, support counts, branches, first-seen point and matches; points below the cutoff are dropped. by: of many queries, the query."""
    kept = hits.where(F.col(score) >= limits.cutoff).withColumn("task", task_index())
    match = F.struct("rank", (-F.col(score)).alias("minus"), "branch", "path", "point_id")
    return kept.groupBy(*by, "expert_id").agg(
        F.max(F.col(score) * weight(limits.weights)).alias("score"),
        F.count_if(F.col("path") == "stable").alias("stable_hits"),
        F.count_if(F.col("path") != "stable").alias("expanded_hits"),
        F.array_sort(F.collect_set("branch")).alias("branches"),
        F.min_by("point_id", F.struct("task", "rank", "point_id")).alias("first_point"),
        F.array_sort(F.collect_list(match)).alias("matches"),
    )


def penalise(hits: DataFrame, limits: Limits) -> DataFrame:
    """A missing organisation costs a share of the score."""
    return hits.withColumn("score", F.col("score") * F.when(F.coalesce("org", F.lit("")) == "", limits.missing_org).otherwise(1.0))


def supported(limits: Limits) -> Column:
    """R12."""
    return (F.col("stable_hits") >= limits.stable_min) | ((F.col("expanded_hits") >= limits.expanded_min) & (F.size("branches") >= 2))


def filtered_out(hits: DataFrame, limits: Limits) -> DataFrame:
    """What the support rule drops, and why."""
    return hits.where(~supported(limits)).select("expert_id", F.format_string("stable=%d expanded=%d branches=%d", "stable_hits", "expanded_hits", F.size("branches")).alias("reason"))


def shadow(hits: DataFrame) -> DataFrame:
    """Experts whom expansion alone has found."""
    return hits.where("stable_hits = 0 AND expanded_hits > 0").select("expert_id")


def shadow_names(hits: DataFrame, people: DataFrame) -> DataFrame:
    """Their ids and names (empty if unknown)."""
    return shadow(hits).join(people.select("expert_id", "name"), "expert_id", "left").select("expert_id", F.coalesce("name", F.lit("")).alias("name"))


def ground() -> Column:
    """What a generator is told of a hit's score: primary branch, final score, the first two matches."""
    near = F.transform(F.slice("matches", 1, 2), lambda m: F.struct(m["branch"].alias("branch"), m["rank"].alias("rank"), F.round(-m["minus"], 6).alias("score")))
    return F.struct(F.col("matches")[0]["branch"].alias("primary_branch"), F.round("score", 6).alias("final_score"), near.alias("branch_matches"))


def grounding(hits: DataFrame) -> DataFrame:
    """ground() by expert."""
    return hits.select("expert_id", ground().alias("grounding"))


def display(ordered: DataFrame, top_k: int | None, limit_candidates: bool) -> DataFrame:
    """The list is cut only if that is asked for and top_k is given. ordered: with rank."""
    return ordered.where(F.col("rank") <= top_k) if limit_candidates and top_k is not None else ordered


def traced() -> list[Column]:
    """The primary branch is that of the least (rank, -score, branch)."""
    first = F.col("matches")[0]
    return [first["branch"].alias("primary_branch"), first["rank"].alias("primary_rank"), F.round("score", 6).alias("final_score"), F.size("matches").alias("n_matches")]


def score_trace(hits: DataFrame) -> DataFrame:
    """traced() by expert."""
    return hits.select("expert_id", *traced())


def final_order(hits: DataFrame, name: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """By score, then name, then id. The rank is global (or by query): experts that passed all limits, not points."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), "expert_id")))


def normalised(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """percent of the best score, to one digit."""
    best = F.max("score").over(Window.partitionBy(*by))
    return hits.withColumn("score_pct", F.when(best > 0, F.bround(F.col("score") / best * 100, 1)).otherwise(0.0))
