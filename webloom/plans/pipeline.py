"""Dataflow pipelines: a source table, stages, and sinks.

A stage is a function from table to table; a row that a stage leaves out is
dropped, and an error in any task ends the run.  Order within a partition is
kept by ``fifo``; pools may change it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webloom.scratch import cut

Stage = Callable[[DataFrame], DataFrame]


def fifo(process: Stage) -> Stage:
    return process


def fixed_pool(process: Stage, workers: int) -> Stage:
    """``process`` over exactly ``workers`` partitions."""
    if workers < 1:
        raise ValueError("a pool has a worker at least")
    return lambda df: process(df.repartition(workers))


def dynamic_pool(process: Stage, most: int) -> Stage:
    """``process`` over ``most`` partitions or fewer, as adaptive execution sees fit."""
    if most < 1:
        raise ValueError("a pool has a worker at least")
    return lambda df: process(df.hint("rebalance").coalesce(most))


def broadcast(*processes: Stage, once: bool = False) -> Stage:
    """Each row goes to every process; their outputs are united.

    With ``once`` the rows are written before, so that what made them runs once
    whatever the number of processes; else it may run, pruned, in each of them.
    """
    if not processes:
        raise ValueError("a broadcast has a process at least")

    def run(df: DataFrame) -> DataFrame:
        if once and not df.isStreaming:
            df = cut(df, "broadcast")
        outs = [p(df) for p in processes]
        done = outs[0]
        for o in outs[1:]:
            done = done.unionByName(o, allowMissingColumns=True)
        return done

    return run


class Pipeline:
    """Stages in order.  ``counts`` has the rows that left each counted stage of the last run."""

    def __init__(self, *stages: Stage, counted: bool = False) -> None:
        self.stages = stages
        self.counted = counted
        self._seen: list[Observation] = []

    def apply(self, source: DataFrame) -> DataFrame:
        self._seen = []
        out = source
        for i, stage in enumerate(self.stages):
            out = stage(out)
            if self.counted:
                self._seen.append(Observation(f"stage{i}-{id(out)}"))
                out = out.observe(self._seen[-1], F.count(F.lit(1)).alias("rows"))
        return out

    def execute(self, source: DataFrame, sink: Callable[[DataFrame], object]) -> object:
        return sink(self.apply(source))

    @property
    def counts(self) -> list[int]:
        return [o.get["rows"] for o in self._seen]


def counting_sink(df: DataFrame, branches: int = 1) -> int:
    """Rows, each counted once though it came by every branch of a broadcast."""
    return df.count() // branches
