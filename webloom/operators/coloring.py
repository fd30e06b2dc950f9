"""Graph colouring: every vertex takes the least free colour once it outranks its uncoloured neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from webloom.operators import bsp
from webloom.scratch import cut, release, small_batches

#: Edges within a block, about, and vertices of a block: one task streams the edges and holds the vertices.
PAIRS = 4_000_000
VERTICES = 1_000_000


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _greedy():
    """What colours a block's vertices, which come by descending rank; made where it is used, so that workers need no module for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict = {}
        for batch in batches:
            colors = []
            for x, used, within in zip(*(batch.column(c).to_pylist() for c in ("id", "used", "within")), strict=True):
                taken = set(used or ())
                taken.update(got[n] for n in within or () if n in got)
                c = 1
                while c in taken:
                    c += 1
                got[x] = c
                colors.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(colors, pa.int32())], ["id", "color"])

    return run


def color(vertices: DataFrame, edges: DataFrame, seed: int = 0) -> bsp.Result:
    """``id, color``, and ``totals["colors"]``, the largest colour.

    ``vertices`` may bring ``color`` for coloured ones, which keep it.  A
    vertex's rank is a seeded hash and its id, so the result is that of the
    greedy order by descending rank, and of no other.

    Ranks are cut into blocks.  A step colours a block: what its vertices may
    not take of earlier blocks is gathered by join, and one task then goes
    through the block in order.  A chain of neighbours within a block costs no
    steps; blocks, as the root of the edges, keep that task's share bounded.
    """
    range_ = 1 << 31
    rank = lambda x: F.pmod(F.xxhash64(F.lit(seed), F.col(x)), F.lit(range_))
    given = F.coalesce(F.col("color").cast("int"), F.lit(0)) if "color" in vertices.columns else F.lit(0)
    small_batches(vertices.sparkSession)
    state = cut(vertices.select("id", given.alias("color")), "vertices")
    first = state.where("color <> 0")
    # An edge is told from the end that is coloured first.
    turned = F.struct(rank("src"), F.col("src")) > F.struct(rank("dst"), F.col("dst"))
    pairs = edges.where("src <> dst").select(F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("high"), F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("low"))
    if "color" in vertices.columns:
        pairs = pairs.join(first.select(F.col("id").alias("low"), F.lit(True).alias("set")).distinct(), "low", "left")
        pairs = pairs.select(F.when(F.col("set"), F.col("low")).otherwise(F.col("high")).alias("high"), F.when(F.col("set"), F.col("high")).otherwise(F.col("low")).alias("low"))
    pairs = cut(pairs.distinct(), "pairs")
    blocks = max(1, isqrt(pairs.count() // PAIRS) + 1, ceil(state.count() / VERTICES))
    block = lambda x: ((range_ - 1 - rank(x)) * blocks / range_).cast("int")

    schema = StructType([vertices.schema["id"], StructField("color", IntegerType())])
    done = first
    for k in range(blocks):
        known = done.where("color > 0").select(F.col("id").alias("high"), F.col("color").alias("taken")).distinct()
        near = pairs.where(block("low") == k).join(known, "high", "left")
        near = near.groupBy("low").agg(F.collect_set("taken").alias("used"), F.collect_list(F.when(F.col("taken").isNull() & (block("high") == k), F.col("high"))).alias("within"))
        mine = state.where((F.col("color") == 0) & (block("id") == k)).select("id", rank("id").alias("rank"))
        rows = mine.join(near, mine.id == near.low, "left").repartition(1).sortWithinPartitions(F.desc("rank"), F.desc("id"))
        done = done.unionByName(cut(rows.select("id", "used", "within").mapInArrow(_greedy(), schema), "colors"))
    release(pairs)
    return bsp.Result(done, blocks, done.agg(F.max("color").alias("colors")).first().asDict())


def conflicts(colored: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends share a colour."""
    a, b = (colored.select(F.col("id").alias(e), F.col("color").alias(f"{e}_color")) for e in ("src", "dst"))
    return edges.where("src <> dst").join(a, "src").join(b, "dst").where("src_color = dst_color")
