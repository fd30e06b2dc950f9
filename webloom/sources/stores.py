"""Stores of links, edges and documents, opened by address."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import urls
from webloom.operators import linkgraph
from webloom.plans.crawl import State

TABLES = {"links": schemas.LINKS, "edges": schemas.EDGES, "docs": schemas.DOCUMENTS}


class MemoryStore:
    """Tables held as DataFrames; nothing outlives the session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._now = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}

    def load(self) -> State:
        return State(**self._now)

    def save(self, state: State) -> None:
        self._now = {name: getattr(state, name) for name in TABLES}


class ParquetStore:
    """Tables as versions in a folder; a version counts once its mark is written, and readers keep theirs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removeprefix("done-")) for n in names if n.startswith("done-"))

    def load(self) -> State:
        found = self.versions()
        if not found:
            return State(**{name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()})
        at = f"{self.path}/v{found[-1]}"
        return State(**{name: self.spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in TABLES.items()})

    def save(self, state: State, keep: int = 2) -> None:
        found = self.versions()
        n = found[-1] + 1 if found else 0
        for name, schema in TABLES.items():
            getattr(state, name).select(*schema.names).write.mode("overwrite").parquet(f"{self.path}/v{n}/{name}")
        fs, mark = self._fs(f"{self.path}/done-{n}")
        fs.create(mark, True).close()
        for old in [*found, n][:-keep]:
            for gone in (f"{self.path}/done-{old}", f"{self.path}/v{old}"):
                fs, p = self._fs(gone)
                fs.delete(p, True)


def open_store(spark: SparkSession, uri: str) -> MemoryStore | ParquetStore:
    """``memory://`` or ``parquet://`` and a path that Spark can write."""
    kind = urlparse(uri).scheme
    if kind in ("memory", "in-memory"):
        return MemoryStore(spark)
    if kind == "parquet":
        return ParquetStore(spark, uri.removeprefix("parquet://"))
    raise ValueError(f"no store for {uri!r}")


def submit_links(state: State, batch: DataFrame, url: str = "url") -> State:
    """``state`` with the http(s) URLs of ``batch``, fragments removed, as links never retrieved."""
    new = batch.select(urls.without_fragment(F.trim(url)).alias("url")).where(urls.is_web(F.col("url"))).distinct()
    links = linkgraph.upsert_links(state.links, new.withColumn("retrieved_at", F.lit(None).cast("timestamp")))
    return State(links, state.edges, state.docs)
