"""The link graph: upserts, range scans, lookups and expiry, each a function of tables.

Upserts are a union and one aggregation by key, so that each shuffles once and
late or repeated observations don't matter.  A null time stands for "never",
which is before any time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.uuids import in_range, uuid_of


class NotFoundError(LookupError):
    """No row has the id."""


class UnknownEdgeLinksError(ValueError):
    """An edge's end is no known link."""


def _before(column: str, limit: Column | datetime | None) -> Column:
    if limit is None:
        return F.lit(True)
    return F.col(column).isNull() | (F.col(column) < F.lit(limit))


def upsert_links(links: DataFrame, batch: DataFrame) -> DataFrame:
    """``links`` with ``batch`` (url, retrieved_at): known URLs keep their id and the later time."""
    old = links.select("url", "id", "retrieved_at")
    new = batch.select("url", F.lit(None).cast("string").alias("id"), "retrieved_at").where("url IS NOT NULL")
    both = old.unionByName(new).groupBy("url").agg(F.min("id").alias("id"), F.max("retrieved_at").alias("retrieved_at"))
    return both.select(F.coalesce("id", uuid_of(F.col("url"))).alias("id"), "url", "retrieved_at")


def dangling(edges: DataFrame, links: DataFrame) -> DataFrame:
    """The edges with an end that ``links`` doesn't have."""
    known = links.select("id").distinct()
    no_src = edges.join(known.withColumnRenamed("id", "src"), "src", "left_anti")
    no_dest = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dest"), "dest", "left_anti")
    return no_src.unionByName(no_dest.select(*no_src.columns))


def upsert_edges(edges: DataFrame, batch: DataFrame, links: DataFrame | None = None, as_of: Column | datetime | None = None) -> DataFrame:
    """``edges`` with ``batch`` (src, dest): known pairs keep their id and get the new time.

    With ``links``, edges between unknown links raise.  ``as_of`` stamps the
    batch; without it the batch brings ``updated_at``.
    """
    if links is not None and dangling(batch.select("src", "dest"), links).limit(1).count():
        raise UnknownEdgeLinksError("an edge's source or destination is unknown")
    time = F.lit(as_of).cast("timestamp") if as_of is not None else F.col("updated_at")
    new = batch.select("src", "dest", F.lit(None).cast("string").alias("id"), time.alias("updated_at"))
    both = edges.select("src", "dest", "id", "updated_at").unionByName(new).groupBy("src", "dest").agg(F.min("id").alias("id"), F.max("updated_at").alias("updated_at"))
    return both.select(F.coalesce("id", uuid_of(F.concat_ws(">", "src", "dest"))).alias("id"), "src", "dest", "updated_at")


def remove_stale_edges(edges: DataFrame, limits: DataFrame) -> DataFrame:
    """``edges`` without those of a source in ``limits`` (src, before) whose time is before the source's limit."""
    cut = limits.groupBy("src").agg(F.max("before").alias("__before"))
    joined = edges.join(cut, "src", "left")
    stale = F.col("__before").isNotNull() & (F.col("updated_at").isNull() | (F.col("updated_at") < F.col("__before")))
    return joined.where(~stale).select(*edges.columns)


def remove_links(links: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the links in ``gone`` (id) and without their edges."""
    ids = gone.select("id").distinct()
    left = links.join(ids, "id", "left_anti")
    for end in ("src", "dest"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(*edges.columns)
    return left.select(*links.columns), edges


def links_in(links: DataFrame, start: str, end: str, retrieved_before: Column | datetime | None = None) -> DataFrame:
    """Links with ids in ``[start, end)`` retrieved strictly before a time; both conditions reach the scan."""
    return links.where(in_range(F.col("id"), start, end) & _before("retrieved_at", retrieved_before))


def edges_in(edges: DataFrame, start: str, end: str, updated_before: Column | datetime | None = None) -> DataFrame:
    """Edges whose source is in ``[start, end)``, updated strictly before a time."""
    return edges.where(in_range(F.col("src"), start, end) & _before("updated_at", updated_before))


def reindex_candidates(links: DataFrame, as_of: Column | datetime, threshold: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Links not retrieved since ``as_of`` less ``threshold`` (an interval such as ``2 minutes``)."""
    found = links if start is None else links.where(in_range(F.col("id"), start, end))
    return found.where(F.col("retrieved_at").isNull() | (F.col("retrieved_at") < F.lit(as_of) - F.expr(f"INTERVAL {threshold}")))


def find_link(links: DataFrame, link_id: str):
    """The row of an id; raises ``NotFoundError``."""
    row = links.where(F.col("id") == link_id).limit(1).first()
    if row is None:
        raise NotFoundError(link_id)
    return row
