"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on one machine a temporary folder where it is unset (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/webloom-{uuid.uuid4().hex}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, tag: str = "step", *by: str) -> DataFrame:
    """``df`` as a written table, partitioned by ``by``: its lineage ends here, and lost executors don't matter."""
    path = f"{folder(df.sparkSession)}/webloom-{tag}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    _made[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._webloom_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Python gets batches of 4 MB in this session, unless it has a limit of its own; rows alone don't bound their bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(1 << 22))


@contextmanager
def unsorted_writes(spark: SparkSession, parts: int) -> Iterator[None]:
    """Meanwhile a task keeps a file of each of up to ``parts`` parts open, instead of sorting its rows by part."""
    want = {"spark.sql.maxConcurrentOutputFileWriters": str(parts), "spark.sql.optimizer.plannedWrite.enabled": "false"}
    had = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(df: DataFrame | None) -> None:
    """Delete a table that ``cut`` wrote and that nothing reads any more; others are left alone."""
    path = getattr(df, "_webloom_path", None)
    spark = _made.pop(path, None)
    if spark is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder's owner clears it
            return


atexit.register(_sweep)
