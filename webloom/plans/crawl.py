"""A crawl pass over stored pages: filter, extract, update the graph, index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import html, net, urls
from webloom.functions.uuids import uuid_of
from webloom.operators import linkgraph, textindex
from webloom.scratch import cut


@dataclass(frozen=True)
class State:
    links: DataFrame
    edges: DataFrame
    docs: DataFrame


def allowed(links: DataFrame, resolver: DataFrame | None = None) -> DataFrame:
    """The rows whose ``url`` may be requested: http(s), no ending of media or code, no private host.

    A host neither literal nor in ``resolver`` counts as public if no resolver
    is given and is dropped if one is.
    """
    columns = links.columns
    want = links.where(urls.is_web(F.col("url")) & urls.is_page(F.col("url")))
    want = net.resolve_hosts(want.withColumn("__host_of", urls.host(F.col("url"))), "__host_of", resolver, "__private")
    return want.where(~F.coalesce("__private", F.lit(resolver is not None))).select(columns)


def fetched(links: DataFrame, pages: DataFrame, resolver: DataFrame | None = None) -> DataFrame:
    """``link_id, url, html`` of the links whose page may be used.

    ``pages``: ``url, html`` and, if known, ``status`` and ``content_type``.
    Cheap conditions on the URL come before the join.
    """
    want = allowed(links.select(F.col("id").alias("link_id"), "url"), resolver)
    got = pages
    if "status" in pages.columns:
        got = got.where(F.col("status").between(200, 299))
    if "content_type" in pages.columns:
        got = got.where(F.col("content_type").contains("html"))
    return want.join(got.select("url", "html"), "url").select("link_id", "url", "html")


def fetch_live(links: DataFrame, getter: Callable[[str], tuple[int, str, str] | None], resolver: DataFrame | None = None) -> DataFrame:
    """``url, status, content_type, html`` by an injected ``getter``; URLs for which it gives None are dropped.

    Only what ``allowed`` lets through is ever requested.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, *got) for u in b["url"] if (got := getter(u)) is not None]
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "html"])

    return allowed(links.select("url"), resolver).mapInPandas(run, "url string, status int, content_type string, html string")


def crawl_pass(state: State, pages: DataFrame, as_of: Column, candidates: DataFrame | None = None, resolver: DataFrame | None = None) -> tuple[State, int]:
    """The state after a pass over ``candidates`` (all links, unless given), and how many pages were used.

    A page that a filter drops leaves everything untouched.  A used page's
    link gets ``as_of``; its targets become links, without a time if new; its
    out-edges are those to followed targets only; its document is indexed and
    keeps its rank.
    """
    used = cut(fetched(candidates if candidates is not None else state.links, pages, resolver), "used")
    found = cut(html.extract_links(used, "link_id", "url", "html", resolver).withColumnRenamed("url", "to"), "found")
    seen = used.select("url", F.lit(as_of).cast("timestamp").alias("retrieved_at"))
    new = found.select(F.col("to").alias("url"), F.lit(None).cast("timestamp").alias("retrieved_at"))
    links = cut(linkgraph.upsert_links(state.links, seen.unionByName(new)), "links")
    ids = links.select(F.col("url").alias("to"), F.col("id").alias("dest"))
    batch = found.where("NOT nofollow").join(ids, "to").select(F.col("link_id").alias("src"), "dest", F.lit(as_of).cast("timestamp").alias("updated_at"))
    both = linkgraph.upsert_edges(state.edges, batch)
    edges = cut(linkgraph.remove_stale_edges(both, used.select(F.col("link_id").alias("src"), F.lit(as_of).cast("timestamp").alias("before"))), "edges")
    batch_docs = used.select("link_id", "url", html.title(F.col("html")).alias("title"), html.text(F.col("html")).alias("content"))
    docs = cut(textindex.index(state.docs, batch_docs, as_of), "docs")
    return State(links, edges, docs), used.count()


def seeds(pages: DataFrame, url: str = "url") -> DataFrame:
    """Links, never retrieved, of a table's URLs without fragments."""
    u = urls.without_fragment(F.col(url))
    return pages.select(u.alias("url")).where(urls.is_web(u)).distinct().select(uuid_of(F.col("url")).alias("id"), "url", F.lit(None).cast("timestamp").alias("retrieved_at"))
