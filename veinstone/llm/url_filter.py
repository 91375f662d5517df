"""URL filters (operator 10), with DataFrame functions and Spark's own gradient-boosted trees only.

Rules of (host, path prefix, verdict) decide first: a rule fits its host and all subdomains where the
url's path starts with the rule's path; of several the longest wins. Elsewhere boosted trees decide from
lexical features of the url: lengths, depth, digit ratio, entropy, parameter counts, and statistics of
the host's suffix among the training urls. Labels come from a table of (url, blocked).

Null urls and urls without `://` have empty host and path; they match no rule and are scored by the
method like any other. Very long urls count whole. Repeated rows are judged alike; in training a repeated url is one row
whose weight is its number. Without labels of both kinds, the method allows. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, save, small

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = ("url_len", "host_len", "path_len", "depth", "dots", "digit_ratio", "entropy", "params", "query_len", "has_fragment", "https", "hyphens", "suffix_rate", "suffix_log_n")
#: The trees are fitted on about so many different labelled urls at most, chosen by hash.
MAX_TRAIN = 50_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, others) with the lexical features and the host's suffix (its last two labels)."""
    u = F.coalesce("url", F.lit(""))
    n = F.length(u)
    letters = F.array_distinct(F.split(u, ""))
    count = lambda c: (n - F.length(F.replace(u, c, F.lit("")))).cast("double")
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - count(c) / n * F.log2(count(c) / n))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.withColumns({
        "url_len": n.cast("double"),
        "host_len": F.length("host").cast("double"),
        "path_len": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("[^/]+")).cast("double"),
        "dots": F.regexp_count("host", F.lit(r"\.")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "params": F.regexp_count(query, F.lit("[^&=]+(=|&|$)")).cast("double"),
        "query_len": F.length(query).cast("double"),
        "has_fragment": F.contains(u, F.lit("#")).cast("double"),
        "https": F.startswith(u, F.lit("https:")).cast("double"),
        "hyphens": F.regexp_count(u, F.lit("[-_]")).cast("double"),
        "suffix": F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0),
    })


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame
    base: float


def with_suffix(urls: DataFrame, suffixes: DataFrame, base: float) -> DataFrame:
    """Suffix statistics: the smoothed share of blocked urls and the log of the number of labelled ones."""
    return urls.join(small(suffixes), "suffix", "left").withColumns({"suffix_rate": F.coalesce("rate", F.lit(base)), "suffix_log_n": F.log1p(F.coalesce("labelled", F.lit(0)).cast("double"))})


def assemble(urls: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(urls)


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, rounds: int = 20, depth: int = 4, smoothing: float = 20.0) -> UrlModel:
    """labelled: (url, blocked as 0 or 1). Suffix statistics use every row; the trees a bounded choice by hash."""
    host, path = split_url(F.col("url"))
    urls = labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("double").alias("blocked")).dropna()
    urls = urls.groupBy("url", "blocked").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = save(features(urls.withColumns({"host": host, "path": path})), "urls")
    different, n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum(F.col("weight") * F.col("blocked")), F.lit(0.0))).first()
    base = ones / n if n else 0.0
    rate = (F.sum(F.col("weight") * F.col("blocked")) + F.lit(smoothing * base)) / (F.sum("weight") + smoothing)
    suffixes = save(rows.groupBy("suffix").agg(rate.alias("rate"), F.sum("weight").alias("labelled")), "suffixes")
    if not 0 < ones < n:
        return UrlModel(None, suffixes, base)
    part = F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_train / different))
    train = assemble(with_suffix(rows.filter(part), suffixes, base)).select("features", F.col("blocked").alias("label"), "weight")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7, cacheNodeIds=False, maxMemoryInMB=64, weightCol="weight")
    return UrlModel(trees.fit(train), suffixes, base)


def judge(urls: DataFrame, model: UrlModel, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """urls (page_id, url; others are ignored) -> page_id, host, path, rule, verdict, score (the trees' probability of block)."""
    host, path = split_url(F.col("url"))
    rows = urls.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}).withColumn("fit", rule_of(rules))
    rows = with_suffix(features(rows), model.suffixes, model.base)
    if model.trees is None:
        rows = rows.withColumn("score", F.lit(model.base))
    else:
        rows = model.trees.transform(assemble(rows)).withColumn("score", vector_to_array("probability")[1])
    found = F.when(F.col("score") > 0.5, "block").otherwise("allow") if model.trees is not None else F.lit("allow")
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", found).alias("verdict"), "score")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels by url: the number in a page's path names the document it shows; low quality or toxic means blocked.

    A number too long for a doc_id names none.
    """
    named = pages.select("url", F.regexp_extract("url", r"^[^:]*://[^/?#]*/[^/?#]+/(\d+)", 1).alias("d")).withColumn("doc_id", F.col("d").try_cast("long")).filter("doc_id is not null")
    marks = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("blocked"))
    return named.join(marks, "doc_id").select("url", "blocked")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_pages(pages, read(spark, sf_dir, "labels"))))
