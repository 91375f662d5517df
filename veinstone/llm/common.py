"""Session plumbing the operators share: scratch tables, checked broadcasts, workers that give memory back."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most so many rows of a few longs (about 32 MB).
BROADCAST_ROWS = 2_000_000
_HELD: list[Broadcast] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir or setCheckpointDir. Where neither is set, one process (local mode) may use its own."""
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veinstone-"))
    return (spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()).rstrip("/")


def save(df: DataFrame, label: str, rows: int = 1000) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and any executor may be lost.

    While it is written, Python workers get batches of at most rows rows and 8 MB: rows may hold whole texts, and the
    executors' buffers outside the heap are as large as their largest batch.
    """
    spark, conf = df.sparkSession, df.sparkSession.conf
    path = f"{scratch_dir(spark)}/veinstone/{label}-{uuid.uuid4().hex}"
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {k: conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now: its cleaner waits for the driver's garbage collection.

    The second round finds what the first one has let go of.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that save() has written and nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written first unless it is a plain scan, which gives the same rows in the same order each time."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return save(df, "stored") if re.search("Exchange|Join|Aggregate|Window|LocalTableScan|Scan ExistingRDD|InMemoryTableScan|Limit|Sample", plan) else df


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = "_" + name
    return name


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if counting shows it small enough; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def held(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast variable that release() lets go of. The caller states the bound of its size."""
    out = spark.sparkContext.broadcast(value)
    _HELD.append(out)
    return out


def release() -> None:
    """Remove the executors' copies of all variables from held(); one that is needed again is fetched again."""
    while _HELD:
        _HELD.pop().unpersist()


def tidy(run: Callable[[Iterator], Iterator], work: str = "") -> Callable[[Iterator], Iterator]:
    """run for mapInArrow or mapInPandas, after which an idle worker holds no freed memory."""

    def out(batches: Iterator) -> Iterator:
        lean(work)
        try:
            yield from run(batches)
        finally:
            trim()

    return out


_LEAN: list[bool] = []
#: What workers keep between tasks of one kind of work, as functions that drop it.
_KEPT: dict[str, Callable[[], object]] = {}


def keeps(work: str, drop: Callable[[], object]) -> None:
    """A worker that turns to other work than this calls drop."""
    _KEPT[work] = drop


def lean(work: str = "") -> None:
    """From now on this worker's arrays of 4 MB or more are returned to the system as soon as they are freed.

    Smaller ones, which loops make over and over, stay with the process until trim(): mapping them anew costs more than they hold.
    """
    for name, drop in _KEPT.items():
        if name != work:
            drop()
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, fixed
        except (OSError, AttributeError):  # another C library
            pass


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def clean(text: Column) -> Column:
    """A text as operators read it: bytes that are no valid UTF-8 are U+FFFD."""
    return F.make_valid_utf8(text.cast("string"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
