"""Golden graphs, and the invariants of vertex programs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import bsp, coloring, linkgraph, pagerank, paths
from webloom.functions.uuids import NoPartitionDataError, Range, partition_info, uuid_of


def _graph(spark, edges, extra=()):
    ids = sorted({x for e in edges for x in e} | set(extra))
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "src string, dst string")


def _plain_ranks(edges, rounds=200):
    """Power iteration; a vertex without out-edges gives to all."""
    ids = sorted({x for e in edges for x in e})
    out = {i: [b for a, b in edges if a == i] for i in ids}
    score = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        lost = sum(score[i] for i in ids if not out[i]) / len(ids)
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * lost)
        for i in ids:
            for b in out[i]:
                new[b] += 0.85 * score[i] / len(out[i])
        score = new
    return score


@pytest.mark.parametrize(
    "edges",
    [
        [("w", "x"), ("x", "y"), ("y", "z"), ("z", "w")],
        [("hub", "a"), ("hub", "b"), ("hub", "c"), ("a", "hub"), ("b", "hub")],
        [("a", "b"), ("a", "c"), ("c", "d"), ("d", "a"), ("b", "end")],
    ],
)
def test_pagerank_of_small_graphs(spark, edges):
    got = {r.id: r.score for r in pagerank.pagerank(*_graph(spark, edges)).vertices.collect()}
    assert got == pytest.approx(_plain_ranks(edges), abs=0.005)
    assert sum(got.values()) == pytest.approx(1, abs=0.001)


def test_pagerank_rules(spark):
    v, e = _graph(spark, [("A", "A"), ("A", "B"), ("A", "B"), ("B", "A")])
    assert {r.id: r.degree for r in pagerank.out_degrees(v, e).collect()} == {"A": 2, "B": 1}
    lost = spark.createDataFrame([("A", "X")], "src string, dst string")
    with pytest.raises(bsp.UnknownVertexError):
        pagerank.pagerank(v, lost)
    assert pagerank.pagerank(v, lost, strict=False, steps=1).vertices.count() == 2
    assert pagerank.pagerank(v.where("false"), e.where("false")).vertices.count() == 0
    with pytest.raises(ValueError):
        pagerank.Config(damping=2)


def test_shortest_paths_worked_by_hand(spark):
    """The straight road from home to school costs more than the way round; nothing leads to the island."""
    edges = [("home", "school", 20), ("home", "shop", 3), ("shop", "park", 4), ("park", "school", 5), ("shop", "school", 15), ("park", "home", 1), ("school", "pond", 2), ("home", "pond", 14)]
    e = spark.createDataFrame(edges, "src string, dst string, cost long")
    v = spark.createDataFrame([(x,) for x in ("home", "school", "shop", "park", "pond", "island")], "id string")
    found = paths.shortest_paths(v, e, "home").vertices
    got = {r.id: (r.distance, r.path) for r in paths.path_to(found, v).collect()}
    assert got == {
        "home": (0, ["home"]),
        "shop": (3, ["home", "shop"]),
        "park": (7, ["home", "shop", "park"]),
        "school": (12, ["home", "shop", "park", "school"]),
        "pond": (14, ["home", "pond"]),  # as far by way of school, whose name is the larger
        "island": (None, None),
    }
    with pytest.raises(RuntimeError):
        paths.path_to(found, v, max_hops=2)
    with pytest.raises(ValueError):
        paths.shortest_paths(v, e.withColumn("cost", F.lit(-1)), "0")


def test_shortest_paths_random(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 9)) for _ in range(120)]
    dist, queue = {}, [(0, 0)]
    while queue:
        d, x = heapq.heappop(queue)
        if x in dist:
            continue
        dist[x] = d
        for a, b, c in edges:
            if a == x:
                heapq.heappush(queue, (d + c, b))
    v = spark.range(40).select("id")
    got = {r.id: r.distance for r in paths.shortest_paths(v, spark.createDataFrame(edges, "src long, dst long, cost long"), 0).vertices.collect()}
    assert got == {i: dist.get(i) for i in range(40)}


def test_coloring_is_greedy_by_rank(spark):
    rng = random.Random(5)
    edges = [(str(a), str(b)) for a in range(20) for b in range(a) if rng.random() < 0.2]
    v = spark.createDataFrame([(str(i), 7 if i == 3 else None) for i in range(20)], "id string, color int")
    done = coloring.color(v, spark.createDataFrame(edges, "src string, dst string"))
    got = {r.id: r.color for r in done.vertices.collect()}
    rank = {r.id: (r.r, r.id) for r in v.select("id", F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(1 << 31)).alias("r")).collect()}
    near = {str(i): {b if a == str(i) else a for a, b in edges if str(i) in (a, b)} for i in range(20)}
    want = {"3": 7}
    for i in sorted((x for x in rank if x != "3"), key=lambda x: rank[x], reverse=True):
        used = {want[n] for n in near[i] if n in want}
        want[i] = next(c for c in range(1, 99) if c not in used)
    assert got == want and done.totals["colors"] == max(want.values())


def test_coloring_steps_follow_blocks_not_chains(spark, monkeypatch):
    """A clique's vertices wait for each other; they and a graph with coloured and unknown ends take a step a block."""
    rng = random.Random(7)
    edges = [(a, b) for a in range(12) for b in range(a)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(3, 99), (99, 4)]
    v = spark.createDataFrame([(i, {5: 3, 40: 1, 41: 1}.get(i)) for i in range(60)], "id long, color int")
    e = spark.createDataFrame(edges, "src long, dst long")
    one = coloring.color(v, e)
    assert one.steps == 1
    monkeypatch.setattr(coloring, "VERTICES", 15)
    four = coloring.color(v, e)
    rank = {r.id: (r.r, r.id) for r in v.select("id", F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(1 << 31)).alias("r")).collect()}
    want = {5: 3, 40: 1, 41: 1}
    for i in sorted(rank.keys() - want.keys(), key=rank.get, reverse=True):
        used = {want.get(b if a == i else a) for a, b in edges if i in (a, b) and a != b}
        want[i] = next(c for c in range(1, 99) if c not in used)
    for done in (one, four):
        assert {r.id: r.color for r in done.vertices.collect()} == want and done.totals["colors"] == max(want.values())
    assert four.steps == 4


def test_link_store(spark):
    links = spark.createDataFrame([], "id string, url string, retrieved_at timestamp")
    batch = lambda *rows: spark.createDataFrame(rows, "url string, t string").select("url", F.col("t").cast("timestamp").alias("retrieved_at"))
    one = linkgraph.upsert_links(links, batch(("a", "2024-01-02"), ("b", None)))
    two = linkgraph.upsert_links(one, batch(("a", "2024-01-01"), ("a", "2024-01-03"), ("c", None)))
    ids = {r.url: r.id for r in one.collect()}
    got = {r.url: (r.id, r.retrieved_at) for r in two.collect()}
    assert got["a"][0] == ids["a"] and got["a"][1].day == 3 and got["b"] == (ids["b"], None) and len(got) == 3
    edges = spark.createDataFrame([], "id string, src string, dest string, updated_at timestamp")
    with pytest.raises(linkgraph.UnknownEdgeLinksError):
        linkgraph.upsert_edges(edges, spark.createDataFrame([("x", ids["a"])], "src string, dest string"), two, F.lit("2024-01-01"))
    first = linkgraph.upsert_edges(edges, spark.createDataFrame([(ids["a"], ids["b"]), (ids["a"], ids["a"])], "src string, dest string"), two, "2024-01-01")
    again = linkgraph.upsert_edges(first, spark.createDataFrame([(ids["a"], ids["b"])], "src string, dest string"), two, "2024-01-05")
    assert {r.id for r in again.collect()} == {r.id for r in first.collect()}
    limits = spark.createDataFrame([(ids["a"], "2024-01-03")], "src string, b string").select("src", F.col("b").cast("timestamp").alias("before"))
    assert [r.dest for r in linkgraph.remove_stale_edges(again, limits).collect()] == [ids["b"]]
    assert linkgraph.links_in(two, "0", "g", F.lit("2024-01-03").cast("timestamp")).count() == 2
    with pytest.raises(linkgraph.NotFoundError):
        linkgraph.find_link(two, "nobody")


def test_totals_know_their_change(spark):
    v = spark.createDataFrame([(1, 5), (2, 1)], "id long, n long")
    seen, begun = [], []
    program = bsp.Program(message={"x": F.lit(1)}, combine={"x": F.sum("x")}, apply=lambda step, totals: {"n": F.col("n") * 2}, sends=lambda step: F.lit(False), totals={"sum": F.sum("n"), "most": F.max("n")})
    none = spark.createDataFrame([], "src long, dst long")
    bsp.run(v, none, program, max_steps=3, before=begun.append, after=lambda step, totals: seen.append((totals["sum"], totals.delta["sum"], totals.delta["most"])))
    assert seen == [(12, 12, 10), (24, 12, 10), (48, 24, 20)] and begun == [0, 1, 2]


def test_a_vertex_added_again_is_overwritten(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", None, 3), ("b", 7, 1), ("a", 2, 2)], "id string, v int, at int")
    assert {(r.id, r.v) for r in bsp.last_wins(rows, "at").collect()} == {("a", None), ("b", 7)}


def test_partition_info():
    assert partition_info("web-index-3", lambda: ["a", "b", "c", "d"]) == (3, 4)
    assert partition_info("web-0", 2) == (0, 2)
    with pytest.raises(ValueError):
        partition_info("web", 2)

    def nobody():
        raise OSError("no such service")

    with pytest.raises(NoPartitionDataError):
        partition_info("web-1", nobody)


@pytest.mark.parametrize("parts", [1, 3, 300])
def test_part_of_an_id(spark, parts):
    bounds = Range(parts).bounds()
    ids = [r.u for r in spark.range(200).select(uuid_of(F.col("id")).alias("u")).collect()] + [a for a, _ in bounds]
    got = {r.u: r.i for r in spark.createDataFrame([(i,) for i in ids], "u string").select("u", Range(parts).index(F.col("u")).alias("i")).collect()}
    assert got == {i: next(k for k, (a, b) in enumerate(bounds) if a <= i < b) for i in ids}
    assert spark.range(1).select(Range(parts).index(F.lit(bounds[-1][1])).alias("i")).first().i is None


def test_ranges():
    assert [b[1][:2] for b in Range(4).bounds()] == ["40", "80", "c0", "ff"]
    assert [b[1][:2] for b in Range(3).bounds()] == ["55", "aa", "ff"]
    assert Range(300).bounds()[1][0] == Range(300).bounds()[0][1]
    with pytest.raises(ValueError):
        Range(0)
    with pytest.raises(IndexError):
        Range(2).part(2)
