"""The engine's corpora as DataFrames: evidence points, nested experts, evidence items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY = {"art": "논문 근거 부족", "pat": "특허 근거 부족", "pjt": "과제 근거 부족"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence points of the driver's tables without vectors: a document each, its source as expert, its language as branch."""
    branch = F.when(F.col("lang") == "es", "basic").when(F.col("lang") == "en", "art").when(F.col("lang") == "fr", "pat").otherwise("pjt")
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("point_id"), F.col("source").alias("expert_id"), branch.alias("branch"), F.col("text").alias("content_text"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents() with embedding, which is null where a document has none."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    return documents(spark, sf_dir).join(vectors, "point_id", "left").select("point_id", "expert_id", "branch", "content_text", "embedding")


def experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts with nested evidence: customers, their orders as publications and patents, order lines as projects."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    people = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    kind = F.col("o_orderkey") % 3
    papers = F.sort_array(F.collect_list(F.when(kind == 0, F.struct(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Paper "), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("index_type"), F.col("day").alias("date")))))
    patents = F.sort_array(F.collect_list(F.when(kind == 1, F.struct(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Patent "), "o_orderkey").alias("title"), F.col("o_orderstatus").alias("registration_type"), F.col("day").alias("date")))))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("end"))
    projects = F.sort_array(F.collect_list(F.when((kind == 2) & F.col("end").isNotNull(), F.struct(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Project "), "o_orderkey").alias("title"), F.col("day").alias("start"), F.col("end")))))
    nested = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(papers.alias("publications"), patents.alias("patents"), projects.alias("projects"))
    none = lambda c: F.coalesce(F.col(c), F.filter(nested_null(nested, c), lambda x: F.lit(False)))
    out = people.join(nested, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("expert_id"), F.col("c_name").alias("name"), F.col("n_name").alias("org"), F.col("c_mktsegment").alias("degree"),
        none("publications").alias("publications"), none("patents").alias("patents"), none("projects").alias("projects"),
    )
    return with_counts(out)


def nested_null(frame: DataFrame, column: str) -> F.Column:
    """An empty array of the column's type."""
    return F.array().cast(frame.schema[column].dataType)


def with_counts(people: DataFrame) -> DataFrame:
    """Counts of evidence, made once at ingest."""
    scie = F.size(F.filter("publications", lambda p: p["index_type"] == "1-URGENT"))
    return people.withColumns({"article_cnt": F.size("publications"), "scie_cnt": scie, "patent_cnt": F.size("patents"), "project_cnt": F.size("projects")})


def explode_points(people: DataFrame) -> DataFrame:
    """One basic point for each expert and one for each paper, patent and project."""
    base = people.select("expert_id", F.concat_ws("_", "expert_id", F.lit("basic")).alias("point_id"), F.lit("basic").alias("branch"), F.concat_ws(" ", "name", "org", "degree").alias("content_text"))
    out = base
    for branch, column in (("art", "publications"), ("pat", "patents"), ("pjt", "projects")):
        own = people.select("expert_id", F.posexplode(column).alias("i", "e"))
        out = out.unionByName(own.select("expert_id", F.concat_ws("_", "expert_id", F.lit(branch), "i").alias("point_id"), F.lit(branch).alias("branch"), F.col("e.title").alias("content_text")))
    return out


def source_texts(people: DataFrame) -> DataFrame:
    """Each branch's text of an expert, a placeholder where there is no evidence."""
    text = lambda column, branch: F.coalesce(F.nullif(F.array_join(F.transform(column, lambda e: e["title"]), "\n"), F.lit("")), F.lit(EMPTY[branch]))
    return people.select("expert_id", text("publications", "art").alias("art"), text("patents", "pat").alias("pat"), text("projects", "pjt").alias("pjt"))


def _field(kind, name: str) -> F.Column:
    """An evidence element's field as text, empty where the layout has none."""
    fields = {f.name: f.dataType for f in kind.elementType.fields}
    if name not in fields:
        return F.lit("")
    own = F.col(f"e.{name}")
    return F.coalesce(F.concat_ws(" ", own) if fields[name].typeName() == "array" else own.cast("string"), F.lit(""))


def flat_evidence(people: DataFrame) -> DataFrame:
    """Nested evidence as flat items, each type by its own mapping: title, body (all searched text), date, detail, main and secondary text and metadata line of the snippet.

    Reads the fields that the arrays have: papers (title, journal, abstract, korean_keywords, english_keywords, date), projects
    (title or korean and english title, objective, content, managing, performing, start, end), patents (title,
    registration_type, country, registration_date or date, application_date).
    """
    out = None
    for kind, column in (("paper", "publications"), ("project", "projects"), ("patent", "patents")):
        of = people.schema[column].dataType
        f = lambda name, of=of: _field(of, name)
        first = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c), F.lit(""))
        line = lambda name, c: F.when(c != "", F.concat(F.lit(f"[{name}: "), c, F.lit("]")))
        none = F.lit(None).cast("string")
        if kind == "paper":
            title, date, detail = f("title"), f("date"), f("journal")
            words = F.concat_ws(" ", F.nullif(f("korean_keywords"), F.lit("")), F.nullif(f("english_keywords"), F.lit("")))
            body, main, secondary, metadata = (f("journal"), f("abstract"), words), f("abstract"), words, line("journal", f("journal"))
        elif kind == "project":
            named = first(f("title"), f("korean_title"), f("english_title"))
            title, date, detail = F.when(named == "", "Untitled project").otherwise(named), first(f("end"), f("start")), first(f("managing"), f("performing"))
            english = F.when(f("english_title") != named, f("english_title")).otherwise("")
            body, main, secondary, metadata = (english, f("objective"), f("content"), f("managing"), f("performing")), f("objective"), f("content"), line("organization", first(f("performing"), f("managing")))
        else:
            title, date, detail = f("title"), first(f("registration_date"), f("date"), f("application_date")), first(f("registration_type"), f("country"))
            body, main, metadata = (f("registration_type"), f("country")), title, none
            secondary = F.concat(F.lit("type: "), f("registration_type"), F.lit(", country: "), f("country"))
        text = F.concat_ws(" ", *(F.nullif(b, F.lit("")) for b in body))
        rows = people.select("expert_id", F.posexplode(column).alias("i", "e")).select(
            "expert_id", F.lit(kind).alias("type"), F.concat(F.lit(f"{kind}:"), "i").alias("item_id"), title.alias("title"), text.alias("body"), F.nullif(date, F.lit("")).alias("date"),
            F.nullif(detail, F.lit("")).alias("detail"), main.alias("main"), secondary.alias("secondary"), metadata.alias("metadata"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def variants(canonical: DataFrame) -> DataFrame:
    """From one canonical expert (nested, with counts) the six variants, each by changing its arrays: balanced, paper-, patent- and project-heavy, an excluded organisation, weak."""
    times = lambda c, n: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.slice(c, 1, 1)))
    some = lambda c, n: F.slice(F.concat(c, times(c, n)), 1, n) if n else F.slice(c, 1, 0)
    shapes = ((1, 4, 2, 1, None), (2, 6, 0, 1, None), (3, 1, 2, 1, None), (4, 4, 1, 3, None), (5, 4, 1, 1, "A기관"), (6, 0, 0, 1, None))
    base = canonical.select("expert_id", "name", "org", "degree", "publications", "patents", "projects")
    out = base
    for step, papers, patents, projects, org in shapes:
        changed = {"expert_id": F.col("expert_id") + step, "publications": some(F.col("publications"), papers), "patents": some(F.col("patents"), patents), "projects": some(F.col("projects"), projects)}
        out = out.unionByName(base.withColumns(changed | ({"org": F.lit(org)} if org else {})))
    return with_counts(out)


def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat evidence: an order line each; type by line number; the part's name and type as title."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("expert_id"), "o_orderpriority")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    kind = F.element_at(F.array(F.lit("paper"), F.lit("patent"), F.lit("project")), (F.pmod(F.col("l_linenumber"), F.lit(3)) + 1).cast("int"))
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey").select(
        "expert_id", kind.alias("type"), F.concat_ws(":", kind, "l_orderkey", "l_linenumber").alias("item_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.concat_ws(" ", "p_brand", "o_orderpriority", "l_returnflag").alias("body"), "date",
    )


def fixtures(spark: SparkSession) -> DataFrame:
    """The canonical expert (4 papers, a patent, a project) and its variants."""
    papers = [(i, f"paper {i}", "SCIE", "2024-01") for i in range(4)]
    row = (11008395, "expert 11008395", "주식회사 미소테크", "박사", papers, [(0, "patent 0", "등록", "2023-05-01")], [(0, "project 0", "2019-10-07", "2020-04-06")])
    kinds = "publications array<struct<seq:long,title:string,index_type:string,date:string>>, patents array<struct<seq:long,title:string,registration_type:string,date:string>>, projects array<struct<seq:long,title:string,start:string,end:string>>"
    return variants(spark.createDataFrame([row], f"expert_id long, name string, org string, degree string, {kinds}"))
