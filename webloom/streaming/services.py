"""Periodic services as Structured Streaming queries, and their supervision."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.operators import linkgraph, pagerank, textindex
from webloom.plans.crawl import State, crawl_pass, seeds


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def page_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of pages under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None, name: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def crawl_service(stream: DataFrame, store, checkpoint: str, every: str | None = None, clock: Callable[[], datetime] = _now) -> StreamingQuery:
    """Each batch of pages (url, html) is submitted and crawled in one pass.

    Of several pages of a URL in a batch, that of the smallest ``page_id``, if
    there is one, and then the smallest text is taken.  A batch that runs again
    after a failure gives the same ids and edges, at the time of that run.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        state = store.load()
        new = seeds(batch)
        links = linkgraph.upsert_links(state.links, new.select("url", "retrieved_at"))
        known = State(links, state.edges, state.docs)
        order = F.struct(*(c for c in ("page_id", "html") if c in batch.columns))
        pages = batch.groupBy(F.substring_index("url", "#", 1).alias("url")).agg(F.min_by("html", order).alias("html"))
        mine = links.join(pages.select("url"), "url", "left_semi")
        done, _ = crawl_pass(known, pages, F.lit(clock()), candidates=mine)
        store.save(done)

    return _start(stream, work, checkpoint, every, "crawl")


def rank_pass(state: State, as_of: datetime, config: pagerank.Config | None = None) -> State:
    """``state`` with the ranks of the links and edges that were there before ``as_of``."""
    links = state.links.where(F.col("retrieved_at").isNull() | (F.col("retrieved_at") < F.lit(as_of)))
    edges = state.edges.where(F.col("updated_at").isNull() | (F.col("updated_at") < F.lit(as_of))).select("src", F.col("dest").alias("dst"))
    edges = edges.join(links.select(F.col("id").alias("src")), "src", "left_semi")
    scores = pagerank.pagerank(links.select("id"), edges, config, strict=False).vertices
    return State(state.links, state.edges, textindex.update_scores(state.docs, scores))


def rank_service(spark: SparkSession, store, checkpoint: str, every: str | None = None, clock: Callable[[], datetime] = _now) -> StreamingQuery:
    """Ranks again at each trigger; the driver is the only leader."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def work(batch: DataFrame, batch_id: int) -> None:
        store.save(rank_pass(store.load(), clock()))

    return _start(ticks, work, checkpoint, every, "rank")


def last_seen_stream(events: DataFrame, key: str, time_: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """The latest time of each key in each window, late rows up to ``delay`` included."""
    return events.withWatermark(time_, delay).groupBy(F.window(time_, window), F.col(key)).agg(F.max(time_).alias("last_seen"), F.count(F.lit(1)).alias("n"))


class ServiceError(RuntimeError):
    """One or more services failed; ``errors`` has what each said."""

    def __init__(self, errors: list[Exception]) -> None:
        super().__init__("; ".join(str(e).splitlines()[0] for e in errors))
        self.errors = errors


def supervise(queries: list[StreamingQuery], timeout: float | None = None, poll: float = 0.1) -> bool:
    """Waits until all have ended; the first that fails stops the others, and all errors are raised together.

    False if ``timeout`` seconds passed; the queries then still run.
    """
    until = None if timeout is None else time.monotonic() + timeout
    while True:
        errors = [q.exception() for q in queries if not q.isActive and q.exception()]
        if errors:
            for q in queries:
                if q.isActive:
                    q.stop()
            raise ServiceError([e for q in queries if (e := q.exception())])
        if not any(q.isActive for q in queries):
            return True
        if until is not None and time.monotonic() > until:
            return False
        time.sleep(poll)
