"""Sinks and stored results: feedback, plan and result caches, collection tables."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from .files import names, publish, read_text

FEEDBACK = "id long, created_at string, query string, selected_expert_ids string, rejected_expert_ids string, notes string, metadata string"


def feedback_rows(frame: DataFrame, last_id: int = 0) -> DataFrame:
    """Rows (created_at, query, selected, rejected, notes, metadata) to FEEDBACK; ids follow on in order of time, numbered range by range.

    frame is read more than once and must give the same rows each time.
    """
    time_of = F.unix_micros(F.col("created_at").try_cast("timestamp"))
    rows = global_rank(frame, time_of, [F.col("created_at"), F.col("query"), F.xxhash64("notes")], "id", last_id + 1)
    return rows.select(
        F.col("id").cast("long").alias("id"), "created_at", "query", F.to_json("selected").alias("selected_expert_ids"),
        F.to_json("rejected").alias("rejected_expert_ids"), "notes", F.to_json("metadata").alias("metadata"),
    )


def last_id(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.schema(FEEDBACK).parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def save_feedback(spark: SparkSession, path: str, frame: DataFrame) -> int:
    """Append to the store, a folder for each call, and return the last id.

    Every call first claims its range of ids: a file named by the first one that holds the last one, published whole. Of two
    writers one gets it and the other goes on behind its range; one that dies leaves either no claim or a claimed range without rows.
    """
    n = frame.count()
    if not n:
        return last_id(spark, path)
    first = _claim(spark, path, n)
    feedback_rows(frame, first - 1).write.mode("overwrite").parquet(f"{path}/batch={first}")
    return first + n - 1


def _claim(spark: SparkSession, path: str, n: int) -> int:
    folder = f"{path}.claims"
    for _ in range(1000):
        newest = max(map(int, names(spark, folder)), default=None)
        first = 1 if newest is None else int(read_text(spark, f"{folder}/{newest:020d}") or 0) + 1
        if publish(spark, f"{folder}/{first:020d}", str(first + n - 1)):
            return first
    raise TimeoutError(f"other writers keep claiming ids of {path}")


def ensure_collection(frame: DataFrame, path: str, recreate: bool = False) -> None:
    """Create the stored corpus, replace it, or leave what is there."""
    frame.write.mode("overwrite" if recreate else "ignore").parquet(path)


def collection_info(spark: SparkSession, path: str) -> dict:
    """S3: columns, row count, the sparse weights' modifier."""
    frame = spark.read.parquet(path)
    return {"columns": dict(frame.dtypes), "rows": frame.count(), "modifier": modifier_of(spark, path)}


def modifier_of(spark: SparkSession, path: str) -> str | None:
    """How a stored index weighs its terms: idf, or none (null) where an encoder has weighed them."""
    try:
        return spark.read.schema("modifier string").json(f"{path}.meta").first()["modifier"]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def repair_modifier(spark: SparkSession, path: str, model_name: str) -> bool:
    """Make the stored modifier what the sparse model needs; whether it had to change. Postings keep raw counts, so no row is rewritten."""
    want = "idf" if requires_idf(model_name) else None
    if modifier_of(spark, path) == want:
        return False
    spark.createDataFrame([(want,)], "modifier string").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}.meta")
    return True


def requires_idf(model_name: str) -> bool:
    """an encoder that weighs terms itself needs no inverse document frequency."""
    return "splade" not in model_name.lower()


def write_clustered(frame: DataFrame, path: str, columns: tuple[str, ...]) -> list[str]:
    """What payload indexes are for: files sorted by the filterable columns, so that scans skip by their statistics. Unknown columns are left out; returns those used."""
    used = [c for c in columns if c in frame.columns]
    (frame.repartitionByRange(*used).sortWithinPartitions(*used) if used else frame).write.mode("overwrite").parquet(path)
    return used


class PlanCache:
    """Plans by request key and version of the planner, as files of a store that Spark reads; older than ttl seconds they are gone."""

    def __init__(self, spark: SparkSession, folder: str, version: str = "1", ttl: float | None = None):
        self.spark, self.folder, self.version, self.ttl = spark, folder, version, ttl

    def _file(self, key: str) -> str:
        return f"{self.folder}/{hashlib.sha256(f'{self.version}|{key}'.encode()).hexdigest()}.json"

    def get(self, key: str) -> dict | None:
        text = read_text(self.spark, self._file(key))
        held = json.loads(text) if text else None
        return held["plan"] if held and (self.ttl is None or time.time() - held["at"] <= self.ttl) else None

    def put(self, key: str, plan: dict) -> None:
        publish(self.spark, self._file(key), json.dumps({"at": time.time(), "plan": plan}, ensure_ascii=False), replace=True)


class BranchCache(PlanCache):
    """The branch texts compiled from a plan, by the plan itself."""

    def texts(self, plan: str, make: Callable[[], list[dict]]) -> list[dict]:
        """The stored texts of a plan, made and stored if there are none."""
        held = self.get(plan)
        if held is None:
            held = {"tasks": make()}
            self.put(plan, held)
        return held["tasks"]


def result_key(compiled: str, filters: str, snapshot: str, *settings: str) -> str:
    """A result belongs to compiled texts, filters, a snapshot of the corpus, and the settings that a search depends on (limits, year, encoders)."""
    return hashlib.sha256("\x1f".join((compiled, filters, snapshot, *settings)).encode()).hexdigest()


def cached_result(spark: SparkSession, folder: str, key: str, make) -> tuple[DataFrame, bool]:
    """A stored result by key; results without rows are not stored."""
    path = f"{folder}/{key}"
    try:
        return spark.read.parquet(path), True
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    frame = make()
    if frame.limit(1).count():
        frame.write.mode("overwrite").parquet(path)
        frame = spark.read.parquet(path)
    return frame, False
