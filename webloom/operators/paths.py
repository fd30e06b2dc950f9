"""Shortest paths from one vertex, over directed edges with non-negative costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import bsp
from webloom.scratch import cut


def shortest_paths(vertices: DataFrame, edges: DataFrame, source, max_steps: int | None = None) -> bsp.Result:
    """``id, distance, via``; both null where nothing leads.  Ties go to the smaller predecessor.

    Only vertices whose distance fell send in the next step.
    """
    if edges.where("cost < 0").limit(1).count():
        raise ValueError("costs are not negative")
    own = F.col("id") == F.lit(source)
    kind = vertices.schema["id"].dataType
    start = vertices.select("id", F.when(own, F.lit(0)).cast("long").alias("distance"), F.lit(None).cast(kind).alias("via"), own.alias("fell"), F.lit(True).alias("active"))

    def apply(step: int, totals) -> dict:
        if step == 0:
            return {"active": F.lit(False)}
        better = F.col("best").isNotNull() & (F.col("distance").isNull() | (F.col("best.cost") < F.col("distance")))
        return {"distance": F.when(better, F.col("best.cost")).otherwise(F.col("distance")), "via": F.when(better, F.col("best.sender")).otherwise(F.col("via")), "fell": better, "active": F.lit(False)}

    program = bsp.Program(
        message={"offer": F.struct((F.col("distance") + F.col("cost")).cast("long").alias("cost"), F.col("id").alias("sender"))},
        combine={"best": F.min("offer")},
        apply=apply,
        sends=lambda step: F.col("fell"),
    )
    done = bsp.run(start, edges.select("src", "dst", "cost"), program, max_steps=max_steps)
    return bsp.Result(done.vertices.select("id", "distance", "via"), done.steps, done.totals)


def path_to(paths: DataFrame, targets: DataFrame, max_hops: int = 1 << 20) -> DataFrame:
    """``id, distance, path`` (from the source on) of ``targets`` (id); unreachable ones have nulls.

    All chains are followed at once, a hop a round; chains still open after ``max_hops`` raise.
    """
    hop = cut(paths.select(F.col("id").alias("at"), F.col("via").alias("next")), "hops")
    rows = targets.select("id").join(paths.select("id", "distance", "via"), "id", "left")
    open_ = rows.select("id", "distance", F.when(F.col("distance").isNotNull(), F.array("id")).alias("path"), F.col("via").alias("head"))
    done = None
    for hops in range(max_hops):
        open_ = cut(open_, "chains")
        ended = open_.where("head IS NULL").select("id", "distance", "path")
        done = ended if done is None else done.unionByName(ended)
        open_ = open_.where("head IS NOT NULL")
        if not open_.limit(1).count():
            break
        if hops == max_hops - 1:
            raise RuntimeError(f"paths of more than {max_hops} hops")
        open_ = open_.join(hop, F.col("head") == F.col("at")).select("id", "distance", F.array_prepend("path", F.col("head")).alias("path"), F.col("next").alias("head"))
    return done
