"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The rows are the leaves' stock in a tree, by default domain, language, source.
A node's budget is split over its children by weight.  A child that can't use
its share, because its stock times ``epochs`` is smaller, leaves the shortage
to its siblings by weight (water filling); what all siblings together can't use
is left to the parent's siblings, since a node's capacity is the sum of its
children's.  Budgets are whole tokens, and each level's add up exactly.

A leaf reads its stock in seeded epochs, each a fixed random order of its rows:
whole epochs first, then the longest run from the front of the next epoch whose
tokens fit.  That run is found without sorting a leaf: tokens are summed over
ranges of the order's hash, and only the range in which the budget ends is
ordered.

Defined cases: null levels are a node of their own; null and wordless texts
have no tokens; rows with equal keys (repeated ids) stand at the same place in
an epoch and are taken together; nodes of weight 0 get nothing; a budget above
the capacity of the whole tree is cut to it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, materialize

#: A plan of at most so many leaves is broadcast; a larger one is joined.
BROADCAST_LEAVES = 100_000
#: Rows of a leaf in one hash range, about.
RANGE_ROWS = 2048

_WIDE = "decimal(19,0)"


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def _fill(children: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """``budget`` of each child from its parent's (``given``), ``w`` and ``cap``."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("w") <= 0, 0.0).otherwise(F.col("cap").cast("double") / F.col("w"))
    order = by.orderBy("ratio", child)
    rows = children.withColumn("ratio", ratio)
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    wide = lambda c: F.col(c).cast(_WIDE)
    rows = rows.withColumn("full", wide("cap") * wide("rest") <= (wide("given") - wide("before")) * wide("w"))
    rows = rows.withColumn("free", F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by))
    open_w = F.when(F.col("full"), 0).otherwise(F.col("w"))
    rows = rows.withColumn("all", F.sum(open_w).over(by)).withColumn("upto", F.sum(open_w).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("under", F.col("upto") - F.when(F.col("full"), 0).otherwise(F.col("w")))
    share = F.expr(f"(cast(free as {_WIDE}) * cast(upto as {_WIDE})) div `all` - (cast(free as {_WIDE}) * cast(under as {_WIDE})) div `all`")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share).cast("long")).drop("ratio", "before", "rest", "full", "free", "all", "upto", "under")


def budgets(stock: DataFrame, levels: Sequence[str], weights: Mapping[str, Column], budget: int | None, share: float, epochs: int) -> DataFrame:
    """Per leaf: ``tokens, rows, budget``.  ``stock`` has the levels, ``tokens`` and ``rows``."""
    nodes = {}
    leaf = stock.withColumn("w", weights[levels[-1]].cast("long")).withColumn("cap", F.when(F.col("w") > 0, F.col("tokens") * epochs).otherwise(0))
    nodes[len(levels)] = leaf
    for k in range(len(levels) - 1, 0, -1):
        up = nodes[k + 1].groupBy(*levels[:k]).agg(F.sum("cap").alias("cap")).withColumn("w", weights[levels[k - 1]].cast("long"))
        nodes[k] = up.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
    if budget is None:
        budget = stock.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share).cast("long").alias("b")).first().b
    goal = F.lit(int(budget)).cast("long")
    done = _fill(nodes[1].withColumn("given", F.least(goal, F.sum("cap").over(Window.partitionBy(F.lit(0))))), [], levels[0])
    for k in range(2, len(levels) + 1):
        parent = list(levels[: k - 1])
        given = done.select(*(F.col(c).alias(f"__{c}") for c in parent), F.col("budget").alias("given"))
        match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in parent]
        done = _fill(nodes[k].join(given, match).drop(*(f"__{c}" for c in parent)), parent, levels[k - 1])
    return done.select(*levels, "tokens", "rows", "budget")


def _place(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def _range() -> Column:
    return F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32)


def _attach(rows: DataFrame, leaves: DataFrame, levels: Sequence[str], n: int) -> DataFrame:
    """``rows`` with their leaf's columns; the leaves are broadcast only if they are few."""
    right = leaves.select(*(F.col(c).alias(f"__{c}") for c in levels), *(c for c in leaves.columns if c not in levels))
    right = F.broadcast(right) if n <= BROADCAST_LEAVES else right
    return rows.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels]).drop(*(f"__{c}" for c in levels))


def plan(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Column], budget: int | None = None, share: float = 1.0, epochs: int = 2, seed: int = 17, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """``(rows, leaves, number of leaves)``.

    ``rows``: ``key``, the levels and ``n_tokens`` of every row.  ``leaves``: the
    levels, ``tokens, budget``, whole epochs (``epoch``) and where the next one
    ends (``ranges, last, cut``).  ``budget`` in tokens, or else ``share`` of all.
    """
    names = list(levels)
    rows = materialize(docs.select(F.col(key).alias("key"), *(c.alias(n) for n, c in levels.items()), n_tokens(text).alias("n_tokens")), "stock")
    stock = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = budgets(materialize(stock, "leaves"), names, weights, budget, share, epochs).where("tokens > 0 AND budget > 0")
    leaves = leaves.withColumn("epoch", F.expr("budget div tokens")).withColumn("left", F.col("budget") % F.col("tokens")).withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS).cast("long"))
    leaves = materialize(leaves, "budgets")
    n = leaves.count()
    placed = _attach(rows, leaves.select(*names, "epoch", "left", "ranges"), names, n).withColumn("place", _place(seed, "key")).withColumn("range", _range())
    sums = placed.groupBy(*names, "range").agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left"))
    upto = F.sum("t").over(Window.partitionBy(*names).orderBy("range"))
    last = sums.withColumn("upto", upto).where("upto > left").groupBy(*names).agg(F.min(F.struct("range", (F.col("upto") - F.col("t")).alias("before"))).alias("l")).select(*names, F.col("l.range").alias("last"), F.col("l.before").alias("before"))
    last = materialize(last, "last")
    inside = _attach(placed, last, names, n).where(F.col("range") == F.col("last"))
    inside = inside.groupBy(*names, "place").agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left"), F.first("before").alias("before"))
    run = F.sum("t").over(Window.partitionBy(*names).orderBy("place"))
    cut = inside.withColumn("run", F.col("before") + run).where("run <= left").groupBy(*names).agg(F.max("place").alias("cut"))
    match = lambda d, p: [F.col(c).eqNullSafe(F.col(f"{p}{c}")) for c in names]
    renamed = lambda d, p: d.select(*(F.col(c).alias(f"{p}{c}") for c in names), *(c for c in d.columns if c not in names))
    full = leaves.join(renamed(last.drop("before"), "__a"), match(last, "__a"), "left").join(renamed(cut, "__b"), match(cut, "__b"), "left")
    return rows, materialize(full.select(*leaves.columns, "last", "cut"), "plan"), n


def _copies() -> Column:
    part = (F.col("range") < F.col("last")) | ((F.col("range") == F.col("last")) & (F.col("place") <= F.coalesce(F.col("cut"), F.lit(""))))
    return (F.col("epoch") + F.when(part, 1).otherwise(0)).cast("long")


def chosen(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Column], seed: int = 17, key: str = "doc_id", **options) -> DataFrame:
    """``key``, the levels, ``n_tokens, copies`` (above 0), ``leaf_tokens, leaf_budget`` of the rows taken."""
    rows, leaves, n = plan(docs, levels, weights, seed=seed, key=key, **options)
    names = list(levels)
    placed = _attach(rows, leaves, names, n).withColumn("place", _place(seed, "key")).withColumn("range", _range())
    return placed.withColumn("copies", _copies()).where("copies > 0").select(F.col("key").alias(key), *names, "n_tokens", "copies", F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"))


def mixed(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Column], seed: int = 17, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as it is taken; texts are not shuffled."""
    _, leaves, n = plan(docs, levels, weights, seed=seed, key=key, **options)
    inner = {f"__level_{name}": c for name, c in levels.items()}
    plan_ = leaves.select(*(F.col(name).alias(f"__level_{name}") for name in levels), "epoch", "ranges", "last", "cut")
    held = docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), *(c.alias(name) for name, c in inner.items()))
    placed = _attach(held, plan_, list(inner), n).withColumn("place", _place(seed, "key")).withColumn("range", _range())
    return placed.withColumn("copies", _copies()).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
