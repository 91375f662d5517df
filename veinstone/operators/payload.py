"""Payload indexes over nested fields (S6, P1-P9): bitmaps of people by what one of their elements holds, met before people are read.

A posting is a field's value, for nested elements with the element's kind and date together, so a condition on one element is
one posting and not two. Its people are bitmaps of 32,768 numbers each. A filter is a conjunction of conditions; a
condition is the union of the postings that satisfy it, found by the postings' keys alone. Unions and the intersection are
bitmap aggregates by block of numbers, so no task holds more than a block of one condition, however frequent a value is. People lie in files in the
order of their numbers: blocks without a match are skipped by their statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_org
from .filters import COUNTS, KNOWN

#: Blocks whose numbers are given to the scan as literals at most; beyond it people are joined.
FEW_BLOCKS = 1000
NESTED = (("publications", "index_type", "date", "art_sci_slct_nm", "art_recent_years"), ("patents", "registration_type", "date", "pat_reg_slct_nm", "pat_recent_years"), ("projects", None, "end", None, "pjt_recent_years"))


def _since(date: Column) -> Column:
    """The last first of January that is not after a date, as text: recency is asked for in whole years. Texts that are no dates stay as they are."""
    new_year = F.concat(F.substring(date, 1, 4), F.lit("-01-01"))
    before = F.concat(F.lpad((F.substring(date, 1, 4).try_cast("int") - 1).cast("string"), 4, "0"), F.lit("-01-01"))
    return F.when(~date.rlike("^[0-9]{4}"), date).when(date >= new_year, new_year).otherwise(before)


def _postings(people: DataFrame) -> DataFrame:
    """n, field, value, since, num: a row for each distinct key of a person."""
    none = F.lit(None)
    rows = []
    for column, kind, date, _, _ in NESTED:
        if column in people.columns:
            e = people.select("n", F.explode(column).alias("e"))
            value = F.col(f"e.{kind}") if kind else none
            rows.append(e.select("n", F.lit(column).alias("field"), value.cast("string").alias("value"), _since(F.col(f"e.{date}")).alias("since"), none.cast("double").alias("num")).distinct())
    for column in ("degree", "major"):
        if column in people.columns:
            rows.append(people.select("n", F.lit(column).alias("field"), F.col(column).cast("string").alias("value"), none.cast("string").alias("since"), none.cast("double").alias("num")))
    if "org" in people.columns:
        rows.append(people.select("n", F.lit("org").alias("field"), normalize_org("org").alias("value"), none.cast("string").alias("since"), none.cast("double").alias("num")))
    for column in COUNTS.values():
        if column in people.columns:
            rows.append(people.select("n", F.lit(column).alias("field"), none.cast("string").alias("value"), none.cast("string").alias("since"), F.col(column).cast("double").alias("num")))
    return reduce(DataFrame.unionByName, rows)


@dataclass(frozen=True)
class PayloadIndex:
    """people (n, block, and their columns) in the order of n; postings (field, value, since, num, block, bits)."""

    people: DataFrame
    postings: DataFrame

    def matching(self, filters: dict[str, Any], include: list[str] | None = None, exclude: list[str] | None = None, as_of: int = 0, include_any: bool = False) -> DataFrame | None:
        """block, bits of the people that compile_filters would pass; None if there are no conditions."""
        wanted = conditions(filters, include, exclude, as_of, include_any)
        if not wanted:
            return None
        met = F.filter(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(wanted))), lambda i: i.isNotNull())
        rows = self.postings.where(reduce(lambda a, b: a | b, wanted)).select("block", "bits", F.explode(met).alias("condition"))
        each = rows.groupBy("block", "condition").agg(F.bitmap_or_agg("bits").alias("bits"))
        return each.groupBy("block").agg(F.count(F.lit(1)).alias("conditions"), F.bitmap_and_agg("bits").alias("bits")).where((F.col("conditions") == len(wanted)) & (F.bitmap_count("bits") > 0)).select("block", "bits")

    def search(self, filters: dict[str, Any], include: list[str] | None = None, exclude: list[str] | None = None, **more: Any) -> DataFrame:
        """The people that pass, without n and block. Only blocks with a match are read where these are few."""
        found = self.matching(filters, include, exclude, **more)
        if found is None:
            return self.people.drop("n", "block")
        blocks = [r[0] for r in found.select("block").limit(FEW_BLOCKS + 1).collect()]
        people = self.people.where(F.col("block").isin(blocks)) if len(blocks) <= FEW_BLOCKS else self.people
        return people.join(numbers(found), "n", "left_semi").drop("n", "block")


def conditions(filters: dict[str, Any], include: list[str] | None = None, exclude: list[str] | None = None, as_of: int = 0, include_any: bool = False) -> list[Column]:
    """What compile_filters asks of a person, each condition as one on a posting."""
    if unknown := set(filters) - KNOWN:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    field, value, since = F.col("field"), F.col("value"), F.col("since")
    org = [(field == "org") & (value == normalize_org(F.lit(o))) for o in include or []]
    out = [reduce(lambda a, b: a | b, org)] if include_any and org else org
    if degree := filters.get("degree_slct_nm"):
        out.append((field == "degree") & value.isin(degree if isinstance(degree, (list, tuple)) else [degree]))
    out += [(field == column) & (F.col("num") >= filters[name]) for name, column in COUNTS.items() if filters.get(name) is not None]
    pool = []
    for column, _, _, kind, recent in NESTED:
        kinds, years = filters.get(kind) if kind else None, filters.get(recent)
        new = since >= F.lit(f"{as_of - int(years)}-01-01") if years else F.lit(True)
        if kinds:
            out.append((field == column) & (value == kinds) & new)
        elif years:
            pool.append((field == column) & new)
    out += [reduce(lambda a, b: a | b, pool)] if pool else []
    if major := filters.get("major"):
        out.append((field == "major") & F.contains(value, F.lit(major)))
    return out + [(field == "org") & ~value.eqNullSafe(normalize_org(F.lit(o))) for o in exclude or []]


def numbers(found: DataFrame) -> DataFrame:
    """block, bits -> n: the numbers whose bit is set."""
    octet = lambda i: F.conv(F.hex(F.substring("bits", i + 1, 1)), 16, 10).cast("int")
    octets = F.filter(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.struct(i.alias("i"), octet(i).alias("v"))), lambda o: o["v"] > 0)
    own = found.select("block", F.explode(octets).alias("o")).select("block", "o.i", "o.v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    return own.where(F.expr("(v >> bit) & 1 = 1")).select(((F.col("block") - 1) * 32768 + F.col("i") * 8 + F.col("bit")).cast("long").alias("n"))


def build_payload(people: DataFrame, path: str) -> PayloadIndex:
    """Number people as they are written, and write the postings of what they hold."""
    spark = people.sparkSession
    # The numbers are fixed by being written once; everything else reads them.
    numbered = people.withColumn("n", F.monotonically_increasing_id())
    numbered.withColumn("block", F.bitmap_bucket_number(F.col("n") + 1)).sortWithinPartitions("n").write.mode("overwrite").parquet(f"{path}/people")
    stored = spark.read.parquet(f"{path}/people")
    rows = _postings(stored).select("*", F.bitmap_bucket_number(F.col("n") + 1).alias("block"), F.bitmap_bit_position(F.col("n") + 1).alias("bit"))
    rows.groupBy("field", "value", "since", "num", "block").agg(F.bitmap_construct_agg("bit").alias("bits")).write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
    return open_payload(spark, path)


def open_payload(spark: SparkSession, path: str) -> PayloadIndex:
    return PayloadIndex(spark.read.parquet(f"{path}/people"), spark.read.parquet(f"{path}/postings"))
