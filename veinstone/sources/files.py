"""Small text files in any store that Spark reads, published whole or not at all."""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import SparkSession

_TURN = threading.Lock()


def _hadoop(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to, to.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; None where there is no file."""
    to, fs = _hadoop(spark, path)
    if not fs.exists(to):
        return None
    stream = fs.open(to)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def folder(spark: SparkSession, path: str) -> bool:
    to, fs = _hadoop(spark, path)
    return bool(fs.getFileStatus(to).isDirectory())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's published files."""
    to, fs = _hadoop(spark, path)
    if not fs.exists(to):
        return []
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(to)) if not n.startswith((".", "_")))


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the files' names, lengths and times: another one after any change."""
    seen = []
    for path in paths:
        to, fs = _hadoop(spark, path)
        seen += sorted(f"{path}|{f.getPath().getName()}|{f.getLen()}|{f.getModificationTime()}" for f in (fs.listStatus(to) if fs.exists(to) else ()))
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def publish(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a file aside and rename it; False if path exists already. A writer that dies before the rename leaves nothing that is read.

    Two writers can't both succeed where the store renames atomically without replacing, as HDFS does; writers of one process
    take turns. On an object store, let one process write.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, fs = _hadoop(spark, path)
    fs.mkdirs(to.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{to.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        with _TURN:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(to), how)
        return True
    except Exception as e:  # noqa: BLE001  the JVM's exception, told apart by its name
        fs.delete(aside, False)
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
