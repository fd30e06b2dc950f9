"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, in the form of a Java/RE2 character class body.
BLANKS = r"\x20\x09-\x0D"

#: While a table is written: shuffle files go with the job, and Python gets batches of few bytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on one machine a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"/tmp/webloom-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _sweep() -> None:
    for spark, path in _made:
        try:
            jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder's owner clears it
            return


atexit.register(_sweep)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The table outlives lost executors.  Shuffle files of the writing job are
    released when the job ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/webloom-{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._webloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        path = df._webloom_path
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made[:] = [x for x in _made if x[1] != path]


def small_batches(spark: SparkSession) -> None:
    """Python gets batches of 4 MB in this session, unless it has a limit of its own; rows alone don't bound their bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, _WRITING[key])


def trim() -> None:
    """Give back to the system what this process has freed: Arrow's pool, then the C library's heap where it is glibc's."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, then ``trim``: a worker outlives its task, and what it keeps counts while others, and later stages, run."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """``fn`` over the Arrow batches of ``df``; it sees whole rows and keeps no state."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(trimmed(run), schema)


def slices(batch: pa.RecordBatch, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``most`` bytes, at least one row each."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    """The fields of these columns, all nullable."""
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
