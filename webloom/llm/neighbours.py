"""Approximate nearest neighbours by inner product, with a forest of random-projection trees.

The trees are fitted on at most ``SAMPLE`` vectors (those with the smallest id
hashes, a documented bound); every vector is then put in its leaf of every
tree.  Each inner node splits by a hyperplane between two random sample points
at the sample's median.  A query walks all trees at once from one priority
queue, whose order is the smallest margin on the way, and takes leaves until
they hold ``share`` of all vectors (repeats over trees included).  Leaves are
then scored exactly, block by block, and the best are merged.

Vectors get a further coordinate that makes all norms equal, as hyperplanes
serve angles and the measure is the inner product.  Scores come from the
original vectors in double precision.

Of exactly equal vectors only the ``k + 1`` smallest ids can be in an answer,
so only they are indexed, and equal queries are answered once.

Defined cases: vectors that are null, empty, zero, of another length than most,
or hold null or non-finite components take no part, as queries or candidates;
a query's own id is never its candidate; with fewer candidates than ``k`` all
that were found are given; ties go to the smaller id; null ids take no part; an
id with several vectors is one candidate, with the best of their scores, and as
a query has the smallest of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize

SAMPLE = 8192
TREES = 4
#: Vectors in a leaf, about.
LEAF = 400
#: Vectors that a query's leaves hold together, as a share of all.
SHARE = 1.2
K = 20


@dataclass
class Forest:
    """``planes``: trees x inner nodes x dimensions; ``cuts``: trees x inner nodes; heap order."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    top: float

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top**2 - (x * x).sum(1)))
        return np.column_stack([x, extra])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """trees x rows: each row's leaf, numbered over all trees."""
        out = np.zeros((len(self.planes), len(x)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, planes[node]) > cuts[node])
            out[t] = node - (2**self.depth - 1) + t * 2**self.depth
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, want: float) -> list[int]:
        """Leaves in the order of a shared queue, until they hold ``want`` vectors."""
        margins = [p @ q - c for p, c in zip(self.planes, self.cuts, strict=True)]
        queue = [(-np.inf, t, 0) for t in range(len(self.planes))]
        inner, held, found = 2**self.depth - 1, 0, []
        while queue and held < want:
            far, t, node = heapq.heappop(queue)
            if node >= inner:
                cell = node - inner + t * (inner + 1)
                if sizes[cell]:
                    found.append(cell)
                    held += sizes[cell]
                continue
            m = float(margins[t][node])
            heapq.heappush(queue, (max(far, -m), t, 2 * node + 2))
            heapq.heappush(queue, (max(far, m), t, 2 * node + 1))
        return found


def fit(sample: np.ndarray, top: float, depth: int, trees: int = TREES, seed: int = 17) -> Forest:
    """Trees of ``depth`` levels over the sample's rows."""
    rng = np.random.default_rng(seed)
    forest = Forest(np.zeros((trees, 2**depth - 1, sample.shape[1] + 1)), np.zeros((trees, 2**depth - 1)), depth, top)
    points = forest.lift(sample)
    for t in range(trees):
        node = np.zeros(len(points), np.int64)
        for i in range(2**depth - 1):
            mine = points[node == i]
            plane = rng.normal(size=points.shape[1])
            if len(mine) > 1:
                a, b = mine[rng.choice(len(mine), 2, replace=False)]
                if (a != b).any():
                    plane = a - b
            plane /= np.linalg.norm(plane)
            forest.planes[t, i] = plane
            at = mine @ plane
            forest.cuts[t, i] = np.median(at) if len(mine) else 0.0
            node[node == i] = 2 * i + 1 + (at > forest.cuts[t, i])
    return forest


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of candidates that may repeat; an id counts with its best score."""
    order = np.lexsort((-scores, ids))
    ids, first = np.unique(ids[order], return_index=True)
    scores = scores[order][first]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (doubles) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (most.d if most else 0))


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, trees: int = TREES, leaf: int = LEAF, share: float = SHARE, sample: int = SAMPLE, seed: int = 17) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest found for each row of ``queries`` among ``vectors``."""
    spark = vectors.sparkSession
    every = usable(vectors, key, vector).distinct()
    order = Window.partitionBy("v").orderBy("id")
    stock = materialize(every.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).select("id", "v"), "vectors")
    asked = materialize(usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v")), "queries")
    stats = stock.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    out = "query_id long, rank int, id long, score double"
    if not stats.n:
        return spark.createDataFrame([], out)
    # SAMPLE rows at most come to the driver.
    picked = stock.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).collect()
    depth = max(0, min(int(np.ceil(np.log2(max(1, stats.n / leaf)))), int(np.log2(max(1, len(picked) / 8)))))
    forest = spark.sparkContext.broadcast(fit(np.array([r.v for r in picked], float), float(np.sqrt(stats.top)), depth, trees, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                cells = forest.value.cells(forest.value.lift(x))
                ids = b.column("id").to_numpy()
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                for c in cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.ones(len(ids), bool)), pa.array(ids), raw], names=["cell", "candidate", "id", "v"])

    cell = T.StructType([T.StructField("cell", T.LongType()), T.StructField("candidate", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType())])
    placed = materialize(stock.mapInArrow(place, cell), "cells")
    sizes = np.zeros(trees * 2**depth, np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row for each leaf of the forest
        sizes[r.cell] = r["count"]
    counts = spark.sparkContext.broadcast(sizes)
    want = share * stats.n

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                ids = b.column("id").to_numpy()
                for i, q in enumerate(forest.value.lift(x, True)):
                    found = forest.value.search(q, counts.value, want)
                    raw = x[i].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([False] * len(found)), pa.array([int(ids[i])] * len(found), pa.int64()), pa.array([raw] * len(found), pa.binary())], names=["cell", "candidate", "id", "v"])

    one = asked.groupBy("v").agg(F.min("id").alias("id"))
    routed = one.select("id", "v").mapInArrow(route, cell)
    best = T.StructType([T.StructField("id", T.LongType()), T.StructField("found", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def given(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([x.tolist() for x, _ in held.values()], pa.list_(pa.int64())), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], names=["id", "found", "scores"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a cell come before its candidates, which stream by."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        now, asks = None, []
        block = None
        for b in batches:
            cells, flags = b.column("cell").to_numpy(), b.column("candidate").to_numpy(zero_copy_only=False)
            marks = np.flatnonzero((cells[1:] != cells[:-1]) | (flags[1:] != flags[:-1])) + 1
            for i, j in zip([0, *marks.tolist()], [*marks.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                if cells[i] != now:
                    now, asks, block = cells[i], [], None
                    if len(held) > 100_000:
                        yield given(held)
                        held = {}
                ids = b.column("id").to_numpy()[i:j]
                x = np.frombuffer(b"".join(b.column("v").slice(i, j - i).to_pylist()), np.float64).reshape(j - i, -1)
                if not flags[i]:
                    asks.append((ids, x))
                    block = None
                    continue
                if not asks:
                    continue
                if block is None:
                    block = np.concatenate([q for q, _ in asks]), np.concatenate([y for _, y in asks])
                for lo in range(0, len(block[0]), 1024):
                    qs, y = block[0][lo : lo + 1024], block[1][lo : lo + 1024]
                    near = y @ x.T
                    edge = np.partition(near, -min(k + 1, near.shape[1]), axis=1)[:, -min(k + 1, near.shape[1])]
                    r, c = np.nonzero(near >= (edge - 1e-9 * np.abs(edge) - 1e-12)[:, None])
                    # Products of matrices round by position; these sums don't, so that equal vectors tie.
                    s = (y[r] * x[c]).sum(1)
                    cut = np.searchsorted(r, np.arange(len(qs) + 1))
                    for m, q in enumerate(qs.tolist()):
                        a, z = ids[c[cut[m] : cut[m + 1]]], s[cut[m] : cut[m + 1]]
                        if q in held:
                            a, z = np.concatenate([held[q][0], a]), np.concatenate([held[q][1], z])
                        held[q] = _best(a, z, k + 1)
        if held:
            yield given(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for q, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if q not in held and held:
                    yield given(held)
                    held = {}
                a, z = np.array(a, np.int64), np.array(z)
                if q in held:
                    a, z = np.concatenate([held[q][0], a]), np.concatenate([held[q][1], z])
                held[q] = _best(a, z, k + 1)
        if held:
            yield given(held)

    scored = placed.unionByName(routed).repartition("cell").sortWithinPartitions("cell", "candidate").mapInArrow(scan, best)
    merged = scored.repartition("id").sortWithinPartitions("id").mapInArrow(merge, best).withColumnRenamed("id", "one")
    names = asked.join(one.select("v", F.col("id").alias("one")), "v").select("one", F.col("id").alias("query_id"))
    rows = names.join(merged, "one").withColumn("z", F.filter(F.arrays_zip("found", "scores"), lambda p: p["found"] != F.col("query_id")))
    return rows.select("query_id", F.posexplode(F.slice("z", 1, k))).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.found").alias("id"), F.col("col.scores").alias("score"))
