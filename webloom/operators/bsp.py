"""Vertex programs in super-steps, as a loop over tables.

A program is a set of Column expressions.  In each super-step the vertices that
are active or have messages compute; what they send is joined to their edges,
combined by destination before the exchange, and delivered in the next step.
Each step is written once, the totals that decide on going on are gathered
from the written table, and the table before it is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from numbers import Number

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.scratch import cut, release


class UnknownVertexError(ValueError):
    """A message was sent to, or an edge begins at, a vertex that doesn't exist."""


class Totals(dict):
    """Aggregates after a step; ``delta`` has by how much numbers changed since the step before, from 0 in the first."""

    delta: dict = {}

    def since(self, before: Mapping) -> Totals:
        self.delta = {k: v - (before.get(k) or 0) for k, v in self.items() if isinstance(v, Number)}
        return self


@dataclass(frozen=True)
class Program:
    """What every vertex does in a step.

    ``sends``: whether a vertex sends to its neighbours after a step.
    ``message``: named values of a message, of the sender's state and the edge.
    ``combine``: named aggregates of a vertex's messages.
    ``apply``: the new state, of the old one, the combined messages (null if
    none came), and ``totals``; its ``active`` is the vote.
    ``totals``: named aggregates of the state, over all vertices, after a step.
    """

    message: Mapping[str, Column]
    combine: Mapping[str, Column]
    apply: Callable[[int, Mapping], Mapping[str, Column]]
    sends: Callable[[int], Column] = lambda step: F.lit(True)
    totals: Mapping[str, Column] = field(default_factory=dict)


@dataclass
class Result:
    vertices: DataFrame
    steps: int
    totals: dict


def last_wins(vertices: DataFrame, *order: str) -> DataFrame:
    """One row for each ``id``, the last by ``order``: a vertex that is added again is overwritten."""
    values = [c for c in vertices.columns if c != "id"]
    return vertices.groupBy("id").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v")).select("id", *(F.col(f"__v.{c}").alias(c) for c in values))


def run(
    vertices: DataFrame,
    edges: DataFrame,
    program: Program,
    max_steps: int | None = None,
    stop: Callable[[int, Mapping], bool] | None = None,
    before: Callable[[int], None] | None = None,
    after: Callable[[int, Mapping], None] | None = None,
    strict: bool = False,
) -> Result:
    """Runs ``program`` until ``stop``, until no vertex is active and none has sent, or for ``max_steps``.

    ``vertices``: ``id`` and state columns.  ``edges``: ``src, dst`` and values;
    repeated edges each carry a message.  ``strict`` raises where an edge ends
    at no vertex; else such messages go nowhere.
    """
    if strict:
        known = vertices.select("id")
        lost = edges.join(known, edges.src == known.id, "left_anti").limit(1).count() or edges.join(known, edges.dst == known.id, "left_anti").limit(1).count()
        if lost:
            raise UnknownVertexError("an edge has an end that is no vertex")
    edges = cut(edges.repartition("src"), "edges")
    state = vertices if "active" in vertices.columns else vertices.withColumn("active", F.lit(True))
    messages: DataFrame | None = None
    totals = Totals()
    table: DataFrame | None = None  # the last written state
    step = 0
    while max_steps is None or step < max_steps:
        if before:
            before(step)
        inbox = state if messages is None else state.join(messages.withColumnRenamed("dst", "id"), "id", "left")
        if messages is None:
            for name, c in program.combine.items():
                inbox = inbox.withColumn(name, F.lit(None))
            inbox = inbox.withColumn("__any", F.lit(False))
        runs = F.col("active") | F.coalesce("__any", F.lit(False))
        made = program.apply(step, totals)
        columns = [c for c in state.columns if c != "id"]
        past, state = table, cut(inbox.select("id", *(F.when(runs, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in columns), runs.alias("__ran")), "state")
        found = state.agg(F.count_if("active").alias("__active"), F.count_if(F.col("__ran") & program.sends(step)).alias("__send"), *(c.alias(n) for n, c in program.totals.items())).first()
        totals = Totals(found.asDict()).since(totals)
        table = state
        release(past)
        senders = state.where(F.col("__ran") & program.sends(step)).drop("__ran")
        state = state.drop("__ran")
        if after:
            after(step, totals)
        step += 1
        if stop and stop(step - 1, totals):
            break
        if not totals["__active"] and not totals["__send"]:
            break
        out = senders.join(edges, senders.id == edges.src).select(F.col("dst"), *(c.alias(n) for n, c in program.message.items()))
        messages = out.groupBy("dst").agg(*(c.alias(n) for n, c in program.combine.items()), F.lit(True).alias("__any"))
    release(edges)
    return Result(state, step, {k: v for k, v in totals.items() if not k.startswith("__")})
