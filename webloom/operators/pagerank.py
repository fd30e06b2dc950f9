"""PageRank with a residual for dead ends, until scores settle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import bsp


@dataclass(frozen=True)
class Config:
    damping: float = 0.85
    tolerance: float = 0.001

    def __post_init__(self) -> None:
        if not 0 <= self.damping <= 1:
            raise ValueError("damping is from 0 to 1")
        if not 0 <= self.tolerance < 1:
            raise ValueError("tolerance is from 0 to below 1")
        # 0 stands for the default.
        object.__setattr__(self, "damping", self.damping or 0.85)
        object.__setattr__(self, "tolerance", self.tolerance or 0.001)


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def out_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree``: edges to other vertices, repeats counted."""
    count = without_loops(edges).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("id").join(count.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def pagerank(vertices: DataFrame, edges: DataFrame, config: Config | None = None, strict: bool = True, steps: int | None = None) -> bsp.Result:
    """``id, score`` of all vertices.

    Step 0 counts, step 1 gives every vertex 1/N, later steps give
    ``(1-d)/N + d * (messages + residual)``; a dead end adds score/N to the
    next step's residual.  Ends after the first update that changes scores by
    less than the tolerance in sum, or after ``steps`` updates.  With ``strict``
    an edge to an unknown vertex raises; else such edges go before degrees are
    counted.
    """
    config = config or Config()
    n = vertices.count()
    edges = without_loops(edges.select("src", "dst"))
    if strict:
        ids = vertices.select("id")
        if edges.join(ids, edges.dst == ids.id, "left_anti").limit(1).count():
            raise bsp.UnknownVertexError("an edge leads to no vertex")
    else:
        ids = vertices.select(F.col("id").alias("dst"))
        edges = edges.join(ids, "dst", "left_semi").select("src", "dst")
    start = out_degrees(vertices, edges).select("id", F.lit(1.0 / n if n else 0.0).alias("score"), "degree", F.lit(0.0).alias("change"), F.lit(True).alias("active"))

    def apply(step: int, totals) -> dict:
        if step < 2:
            return {"active": F.lit(True)}
        residual = float(totals.get("residual") or 0.0)
        new = F.lit((1 - config.damping) / n) + config.damping * (F.coalesce("sum", F.lit(0.0)) + residual)
        return {"score": new, "change": F.abs(new - F.col("score")), "active": F.lit(True)}

    program = bsp.Program(
        message={"part": F.col("score") / F.col("degree")},
        combine={"sum": F.sum("part")},
        apply=apply,
        sends=lambda step: F.lit(step >= 1),
        totals={"sad": F.sum("change"), "residual": F.sum(F.when(F.col("degree") == 0, F.col("score")).otherwise(0.0)) / float(max(n, 1))},
    )
    done = bsp.run(start, edges, program, stop=lambda step, t: step > 1 and (t["sad"] or 0.0) < config.tolerance if steps is None else step > steps)
    return bsp.Result(done.vertices.select("id", "score"), done.steps, done.totals)
