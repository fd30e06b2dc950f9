"""Connected components by alternating large-star and small-star steps.

Each step is two joins and a minimum; hubs are no problem, since minima combine
before the exchange and the join of a hub's rows can be split.  The number of
steps grows with the logarithm of the longest chain.  Every step is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node with a link to another."""
    edges = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _mark(edges)
    for _ in range(most):
        if not before[0]:
            break
        last, edges = edges, materialize(_star(_star(edges, True), False), "edges")
        now = _mark(edges)
        discard(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # Stars are left: each node points to its root.
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def extended(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, root) with further ``links`` (a, b), found on its roots alone."""
    a, b = (comp.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
    rooted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct()
    more = materialize(components(rooted), "components")
    up = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = comp.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(more.join(comp.select("node"), "node", "left_anti").select("node", "root"))
