"""The training corpus from documents, in five stages: (spark, docs, sf_dir) -> DataFrame, each written and read again.

All stages but the last return the columns of documents. Empty documents give an empty corpus. Rows are judged by what
they hold, not by their doc_id: rows that share one, or have none, are documents of their own unless their texts are equal
or near; repeated rows are duplicates and one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinstone.llm.chaining import cut_passages
from veinstone.llm.common import read, release, save
from veinstone.llm.jaccard_join import keep_one
from veinstone.llm.kneser_ney import filter_quality
from veinstone.llm.mixing import mixed
from veinstone.llm.pieces import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return filter_quality(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 on 5-word shingles."""
    return keep_one(docs, k=5, num=80, den=100)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out."""
    return cut_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, roundtrip."""
    return encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("tokens", tokens)]

#: A Kneser-Ney model and piece encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
        release()
    return docs
