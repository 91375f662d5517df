"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Observation

_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or setCheckpointDir. Where neither is set, one process (local mode) may use its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="veinstone-"))
        base = _OWN[0]
    return base.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A new folder's name below it."""
    return f"{scratch_dir(spark)}/veinstone-{uuid.uuid4().hex}"


Keep = Callable[..., tuple[DataFrame, dict]]


@contextmanager
def kept(spark: SparkSession) -> Iterator[Keep]:
    """keep(frame, name, metric=column, ...) -> (the frame, written once and read from there, its metrics).

    The metrics (rows, and the given ones) are gathered by the job that writes the rows. What was kept goes at the end.
    """
    folder = fresh(spark)

    def keep(frame: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        frame.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())).write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}"), seen.get

    try:
        yield keep
    finally:
        to = spark._jvm.org.apache.hadoop.fs.Path(folder)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
