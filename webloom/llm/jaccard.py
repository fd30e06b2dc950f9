"""Exact Jaccard join on word n-grams: size-banded tiles, bitmap bounds, sorted arrays.

1. Each text becomes the sorted array of its distinct shingles' 64-bit hashes.
   Texts with equal sets make one node.
2. Two sets of Jaccard similarity t share one of their first ``n - ceil(tn) + 1``
   shingles in any global order.  A tile is the nodes that share such a
   shingle, in order of size, so that a node meets only nodes of its size
   band.  The order puts frequent shingles last, judged by a counting sketch
   of fixed size over all texts, which keeps common passages out of the tiles.
3. In a tile, each node is paired with its predecessor and with the first node
   of its band: as many pairs as rows, however large the tile.  The ``FIRST``
   pairs of a node that occur in most tiles are decided, and their links give
   first components, which swallow large groups of near copies.
4. Tiles that still hold several components are compared in full across
   components, large ones in blocks of one size band or of two that adjoin.
   Places in the order of shingles and hashed bitmaps bound the overlap from
   above: ``|A & B| <= |A| - popcount(a & ~b)``.  Each pair that is left is put
   down in one tile; pairs leave a task as lists of ids, one row a node.
5. The sorted arrays of a block's nodes are then brought to it once, not once a
   pair, and intersected.  Components that a link has joined need no further
   link, so a block gives fewer links than it has components.

No link between different sets is lost: a pair that is never compared lies in
one component already.  Hashes of 64 bits stand for shingles and 128 bits for
sets.

Defined cases: null and wordless texts have no shingles and link with nothing;
texts of fewer words than a shingle have one, the whole sequence; repeated ids
are separate rows, and a null id never names a component that has another id.
Texts of any length are taken whole; only one batch of texts (4 MB, or one
text) is in a task's Python memory.  Columns other than the key and the text
aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, fields, map_arrow, materialize, slices, trimmed
from .components import components, extended

WORDS = 5
#: Similarity at least ``PERCENT`` / 100.
PERCENT = 80
#: Counters of the sketch, as powers of two; its merged form has one byte for each.
SKETCH_BITS = (18, 24)
#: Bits of a set's bitmap: the power of two from twice its size on, in these bounds.
SIGNATURE_BITS = (512, 1 << 17)
#: Bits of the filter that spares texts without candidates an exchange.
FILTER_BITS = 1 << 24
#: Tiles of at most so many rows are compared together with others, until so many rows or bytes have come.
SMALL, TOGETHER, TOGETHER_BYTES = 48, 1 << 13, 1 << 23
#: Rows of a tile, and shingles of all their sets, that are compared in one block, about.
BLOCK, WEIGHT = 4096, 1 << 20
#: Pairs of a node that are decided before tiles are compared in full.
FIRST = 4
#: A tile expected to be larger than this is dealt over several tasks.
TILE = 1 << 17

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, _U)
    seen: dict[bytes, int] = {}
    w = np.array([seen[x] if x in seen else seen.setdefault(x, xxh64_intdigest(x)) for x in words], _U)
    n = len(w)
    if n < width:
        h = _U(n)
        with np.errstate(over="ignore"):
            for x in w:
                h = (h ^ x) * _ODD[n]
        return _mix(np.array([h], _U))
    m = n - width + 1
    h = w[:m] * _ODD[0]
    for k in range(1, width):
        h = _mix(h) + w[k : k + m] * _ODD[k % len(_ODD)]
    return np.unique(_mix(h))


def signature(h: np.ndarray) -> bytes:
    """A bitmap of hashed shingles; halves laid over each other make the bitmap of half the bits."""
    low, high = SIGNATURE_BITS
    bits = min(high, max(low, 1 << (2 * len(h) - 1).bit_length()))
    flags = np.zeros(bits, bool)
    flags[(h & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _folded(sig: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows x words) brought down to ``words``."""
    while sig.shape[1] > words:
        half = sig.shape[1] // 2
        sig = sig[:, :half] | sig[:, half:]
    return sig


class _Bitmaps:
    """The bitmaps of many sets, kept by length."""

    def __init__(self, sigs: list[bytes]) -> None:
        self.words = np.array([len(x) // 8 for x in sigs], np.int64)
        self.at = np.zeros(len(sigs), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == w)
            self.at[rows] = np.arange(len(rows))
            self.of[w] = np.frombuffer(b"".join([sigs[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), w)

    def overlap(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Bounds from above on the overlaps of sets ``a[i]`` and ``b[i]``, whose sizes are ``na`` and ``nb``."""
        out = np.empty(len(a), np.int64)
        kind = self.words[a] << 32 | self.words[b]
        for k in np.unique(kind).tolist():
            every = np.flatnonzero(kind == k)
            wa, wb = k >> 32, k & 0xFFFFFFFF
            w = min(wa, wb)
            step = max(1, (1 << 20) // w)
            for i in range(0, len(every), step):
                m = every[i : i + step]
                x, y = _folded(self.of[wa][self.at[a[m]]], w), _folded(self.of[wb][self.at[b[m]]], w)
                out[m] = np.minimum(na[m] - np.bitwise_count(x & ~y).sum(1), nb[m] - np.bitwise_count(y & ~x).sum(1))
        return out


def needed(total: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of two sets whose sizes add up to ``total``."""
    return -(-percent * total // (100 + percent))


def _sketch(docs: DataFrame, text: str, width: int, bits: int) -> np.ndarray:
    """Levels (about twice the binary logarithm of a bound on the frequency) of ``2**bits`` hash ranges."""
    blocks = 64
    part = (1 << bits) // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        some = False
        for whole in batches:
            for batch in slices(whole, 1 << 22):
                hs = [shingles(t, width) for t in batch.column(0).to_pylist()]
                if hs:
                    at, n = np.unique((np.concatenate(hs) >> _U(64 - bits)).astype(np.int64), return_counts=True)
                    counts[at] += n.astype(np.uint32)
                    some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([zlib.compress(counts[i * part : (i + 1) * part].tobytes(), 1) for i in range(blocks)], pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([(2 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], names=["block", "levels"])

    parts = docs.select(text).mapInArrow(trimmed(count), "block int, counts binary")
    levels = np.zeros(1 << bits, np.uint8)
    for r in parts.repartition(blocks, "block").mapInArrow(trimmed(merge), "block int, levels binary").collect():  # 2**bits bytes
        levels[r.block * part : (r.block + 1) * part] = np.frombuffer(r.levels, np.uint8)
    return levels


def _sets(docs: DataFrame, key: str, text: str, width: int, percent: int, levels: np.ndarray, bits: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())
    schema = T.StructType([*fields(docs, key), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("splits", T.ArrayType(T.IntegerType())), T.StructField("sig", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        level = np.frombuffer(shared.value, np.uint8)
        ns, sets, prefixes, splits, sigs = [], [], [], [], []
        for t in batch.column(1).to_pylist():
            h = shingles(t, width)
            n = len(h)
            ns.append(n)
            if not n:
                for x in (sets, prefixes, splits, sigs):
                    x.append(None)
                continue
            lv = level[(h >> _U(64 - bits)).astype(np.int64)]
            first = np.lexsort((h, lv))[: n - -(-percent * n // 100) + 1]
            sets.append(xxh3_128_digest(h.tobytes()))
            prefixes.append(h[first].view(np.int64))
            parts = np.maximum(1, np.exp2(lv[first] / 2).astype(np.int64) // TILE)
            splits.append(parts.astype(np.int32) if (parts > 1).any() else None)
            sigs.append(signature(h))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(splits, pa.list_(pa.int32())), pa.array(sigs, pa.binary())], names=schema.names)

    return map_arrow(docs.select(key, text), run, schema)


def _tiles(nodes: DataFrame, percent: int) -> DataFrame:
    """Rows of tiles of two nodes or more, each with its predecessor and the first node of its band.

    ``pos`` is the token's place among the node's shingles in the common order.
    The sketch counts texts, copies too; a token is dealt by the nodes that have it.
    """
    hot = nodes.where("splits IS NOT NULL").select(F.explode(F.arrays_zip("prefix", "splits")).alias("x")).where("x.splits > 1")
    often = hot.groupBy(F.col("x.prefix").alias("token")).agg((F.count(F.lit(1)) / TILE).cast("int").alias("deals")).where("deals > 1")  # no more rows than prefixes / TILE
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).join(F.broadcast(often), "token", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    rows = rows.select("token", F.pmod("node", "deals").cast("int").alias("deal"), "n", "node", "deals", "pos")
    return rows.repartition("token", "deal").sortWithinPartitions("token", "deal", "n", "node").mapInArrow(trimmed(_runs(percent)), "token long, deal int, n long, node long, pos int, prev long, pivot long, head boolean")


def _runs(percent: int):
    names = ["token", "deal", "n", "node", "pos", "prev", "pivot", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # the last row of what came before: its tile may go on
        pivot = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(6)]
            if not len(cols[0]):
                continue
            token, deal, n, node, deals, pos = cols
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (deal[1:] == deal[:-1])
            joins = last is not None and token[0] == last[0] and deal[0] == last[1]
            same[0] = joins
            prev, prev_n, prev_pos = np.empty_like(node), np.empty_like(n), np.empty_like(pos)
            prev[1:], prev_n[1:], prev_pos[1:] = node[:-1], n[:-1], pos[:-1]
            prev[0], prev_n[0], prev_pos[0] = (last[3], last[2], last[4]) if joins else (0, 0, 0)
            near = same & (np.minimum(prev_n - prev_pos, n - pos) >= needed(prev_n + n, percent))
            at = np.flatnonzero(same)
            first = np.zeros(len(node), np.int64)
            ok = np.zeros(len(node), bool)
            for i in at:
                if i == 0:
                    p = pivot
                elif not same[i - 1]:
                    p = (node[i - 1], n[i - 1], pos[i - 1])
                if 100 * p[1] < percent * n[i]:
                    p = (node[i], n[i], pos[i])
                else:
                    first[i], ok[i] = p[0], min(p[1] - p[2], n[i] - pos[i]) >= needed(p[1] + n[i], percent)
                pivot = p
            if not same[-1]:
                pivot = (node[-1], n[-1], pos[-1])
            # The first row of a tile is given when the second is met; that of a dealt token at once, as its others may lie in other deals.
            starts = np.flatnonzero(~same & (np.append(same[1:], False) | (deals > 1)))
            rows = np.concatenate([starts, at])
            head = np.concatenate([np.ones(len(starts), bool), np.zeros(len(at), bool)])
            out = [token[rows], deal[rows], n[rows], node[rows], pos[rows]]
            pr = pa.array(np.concatenate([np.zeros(len(starts), np.int64), prev[at]]), mask=np.concatenate([np.ones(len(starts), bool), ~near[at]]))
            pv = pa.array(np.concatenate([np.zeros(len(starts), np.int64), first[at]]), mask=np.concatenate([np.ones(len(starts), bool), ~ok[at]]))
            if joins and not last[5] and deals[0] == 1:
                out = [np.append(o, last[i]) for i, o in enumerate(out)]
                pr, pv = pa.concat_arrays([pr, pa.nulls(1, pa.int64())]), pa.concat_arrays([pv, pa.nulls(1, pa.int64())])
                head = np.append(head, True)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(o) for o in out), pr, pv, pa.array(head)], names=names)
            last = [token[-1], deal[-1], n[-1], node[-1], pos[-1], bool(same[-1])]

    return run


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps allow the overlap that a link needs."""
    sig = nodes.select("node", "n", "sig")
    rows = pairs.join(sig.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = batch.num_rows
        bitmaps = _Bitmaps([*batch.column("sa").to_pylist(), *batch.column("sb").to_pylist()])
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        ok = pa.array(bitmaps.overlap(np.arange(m), m + np.arange(m), na, nb) >= needed(na + nb, percent))
        return pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return map_arrow(rows.select("a", "b", "na", "nb", "sa", "sb"), run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


#: Where pairs are decided, and the lists of pairs: node ``a`` and its partners there.
_PLACE = "token long, x int, y int"
_LISTS = f"{_PLACE}, a long, partners array<long>"


def _lists(cols: list[np.ndarray], b: np.ndarray) -> pa.RecordBatch:
    """Rows of ``token, x, y, a, partners`` from one pair an entry."""
    order = np.lexsort((*cols[2::-1], cols[3]))
    cols, b = [c[order] for c in cols], b[order]
    new = np.ones(len(b), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    start = np.flatnonzero(new)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
    made = [pa.array(c[start], k) for c, k in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array(np.append(start, len(b)), pa.int32()), pa.array(b))], names=["token", "x", "y", "a", "partners"])


def _pairs(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """The reverse of ``_lists``."""
    lists = batch.column("partners")
    times = np.diff(lists.offsets.to_numpy())
    return [np.repeat(batch.column(c).to_numpy(), times) for c in ("token", "x", "y", "a")], lists.flatten().to_numpy()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, x, y, node`` of all nodes in lists that lie together by place; the last place of a batch waits for the next."""
    wait = np.empty((4, 0), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        (token, x, y, _), b = _pairs(batch)
        one = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "x", "y", "a")])
        every = np.concatenate([wait, one, np.stack([token, x, y, b])], axis=1)
        every = every[:, np.lexsort(every[::-1])]
        keep = np.ones(every.shape[1], bool)
        keep[1:] = (every[:, 1:] != every[:, :-1]).any(0)
        every = every[:, keep]
        open_ = (every[:3] == one[:3, -1:]).all(0)
        wait = every[:, open_]
        yield pa.RecordBatch.from_arrays([pa.array(c[~open_], k) for c, k in zip(every, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["token", "x", "y", "node"])
    if wait.size:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(wait, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["token", "x", "y", "node"])


def _verified(percent: int):
    """``a, b`` of links by place: arrays of a place's nodes come first, then its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, up = None, {}, {}

        def root(c: int) -> int:
            while (p := up.get(c, c)) != c:
                up[c] = c = up.get(p, p)
            return c

        def links(a: int, partners: list[int]) -> Iterator[tuple[int, int]]:
            mine, h = held[a]
            todo = [b for b in partners if root(held[b][0]) != root(mine)]
            while todo:
                size = 0
                now = []
                while todo and (not now or size + len(held[todo[-1]][1]) <= WEIGHT):
                    now.append(todo.pop())
                    size += len(held[now[-1]][1])
                now = [b for b in now if root(held[b][0]) != root(mine)]
                if not now:
                    continue
                arrays = [held[b][1] for b in now]
                n = np.array([len(x) for x in arrays])
                cat = np.concatenate(arrays)
                both = np.add.reduceat(h[np.minimum(np.searchsorted(h, cat), len(h) - 1)] == cat, n.cumsum() - n, dtype=np.int64)
                for b in np.flatnonzero(100 * both >= percent * (len(h) + n - both)).tolist():
                    r, s = root(mine), root(held[now[b]][0])
                    if r != s:
                        up[max(r, s)] = min(r, s)
                        yield a, now[b]

        for batch in batches:
            found: list[tuple[int, int]] = []
            for t, x, y, node, comp, h, partners in zip(*(batch.column(c).to_pylist() for c in ("token", "x", "y", "node", "comp", "h", "partners")), strict=True):
                if (t, x, y) != place:
                    place, held, up = (t, x, y), {}, {}
                if h is not None:
                    held[node] = comp, np.frombuffer(h, _U)
                else:
                    found.extend(links(node, partners))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    return run


def _exact(lists: DataFrame, docs: DataFrame, nodes: DataFrame, comp: DataFrame | None, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``a, b``: links among the pairs of ``lists`` (written), enough of them to join the components that all of them join."""
    place = ["token", "x", "y"]
    members = need = materialize(lists.repartition(*place).sortWithinPartitions(*place).mapInArrow(trimmed(_members), f"{_PLACE}, node long"), "members")
    used = materialize(nodes.join(need.select("node").distinct(), "node", "left_semi").select("node", "set", F.col("id").alias("rep")), "used")
    sets = materialize(_arrays(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), used, width).join(used.select("node", "set"), "set").select("node", "h"), "sets")
    if comp is not None:
        need = need.join(comp.withColumnRenamed("root", "comp"), "node", "left")
    else:
        need = need.withColumn("comp", F.lit(None).cast("long"))
    rows = need.join(sets, "node").select(*place, "node", F.coalesce("comp", "node").alias("comp"), "h", F.lit(None).cast("array<long>").alias("partners"))
    rows = rows.unionByName(lists.select(*place, F.col("a").alias("node"), F.lit(None).cast("long").alias("comp"), F.lit(None).cast("binary").alias("h"), "partners"))
    rows = rows.withColumn("late", F.col("h").isNull()).repartition(*place).sortWithinPartitions(*place, "late")
    links = materialize(rows.mapInArrow(trimmed(_verified(percent)), "a long, b long"), "links")
    discard(members, used, sets)
    return links


def _arrays(docs: DataFrame, used: DataFrame, width: int) -> DataFrame:
    """``set, h``: the sorted arrays of ``docs`` (id, text) whose id may be a ``rep`` of ``used``, each set once.

    A bitmap of ``FILTER_BITS`` hashed ids spares most other texts; however full
    it is, no row is lost, as the join that follows decides.
    """
    place = F.pmod(F.xxhash64(F.lit(1), F.col("rep")), F.lit(FILTER_BITS)).cast("int")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            flags[batch.column(0).to_numpy()] = True
        if flags.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary())], names=["bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in used.select(place.alias("p")).mapInArrow(trimmed(mark), "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        flags = np.frombuffer(shared.value, np.uint8)
        p = batch.column("p").to_numpy()
        made = [shingles(t, width).tobytes() for t in batch.column("text").filter(pa.array(flags[p >> 3] >> (7 - (p & 7)) & 1 > 0)).to_pylist()]
        made = [h for h in made if h]
        return pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(h) for h in made], pa.binary()), pa.array(made, pa.binary())], names=["set", "h"])

    mine = docs.select("text", F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.lit(FILTER_BITS)).cast("int").alias("p"))
    return map_arrow(mine, run, T.StructType([T.StructField("set", T.BinaryType()), T.StructField("h", T.BinaryType())])).dropDuplicates(["set"])


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Lists of pairs of different components in the blocks of tiles, as far as sizes, places and bitmaps allow links.

    Nodes meet in many tiles: lists are merged by node, and a pair stays in the
    tile of the smallest token in which it was met.
    """

    def few(t: pa.Table, run_: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All pairs within runs of few rows, for many runs at once."""
        n, node, comp, pos = (t.column(c).to_numpy() for c in ("n", "node", "comp", "pos"))
        left, right = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero(run_[d:] == run_[:-d])
            if not len(i):
                break
            j = i + d
            ok = (comp[i] != comp[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i] + n[j], percent))
            left.append(i[ok])
            right.append(j[ok])
        yield from decide(t, np.concatenate([*left, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.empty(0, np.int64)]).astype(np.int64), n, node)

    def decide(t: pa.Table, i: np.ndarray, j: np.ndarray, n: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(i):
            return
        # Nodes meet in many tiles: each pair of a batch is looked at once.
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = order[new]
        i, j, a, b = i[first], j[first], a[first], b[first]
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        bitmaps = _Bitmaps(t.column("sig").take(pa.array(used)).to_pylist())
        keep = bitmaps.overlap(at[: len(i)], at[len(i) :], n[i], n[j]) >= needed(n[i] + n[j], percent)
        if keep.any():
            i = i[keep]
            yield _lists([*(t.column(c).to_numpy()[i] for c in ("token", "x", "y")), a[keep]], b[keep])

    def many(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """One large run, or two blocks of one."""
        n, node, comp, pos, own = (t.column(c).to_numpy() for c in ("n", "node", "comp", "pos", "own"))
        one = t.column("x")[0].as_py() == t.column("y")[0].as_py()
        left = np.arange(len(n)) if one else np.flatnonzero(own == 0)
        right = left if one else np.flatnonzero(own == 1)
        step = max(1, (1 << 17) // max(1, len(right)))
        for k in range(0, len(left), step):
            p = left[k : k + step]
            ok = np.minimum((n - pos)[p][:, None], (n - pos)[right][None]) >= needed(n[p][:, None] + n[right][None], percent)
            ok &= comp[p][:, None] != comp[right][None]
            if one:
                ok &= p[:, None] < right[None]
            u, v = np.nonzero(ok)
            yield from decide(t, p[u], right[v], n, node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole runs of equal (token, x, y); the last run of a batch waits for the next."""
        wait: list[pa.RecordBatch] = []

        def split(t: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            size = np.diff(np.append(0, ends))
            x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
            light = (size <= SMALL) & (x[ends - 1] == y[ends - 1])
            label = np.repeat(np.arange(len(size)), size)
            rows = np.flatnonzero(np.repeat(light, size))
            if len(rows):
                yield from few(t.take(pa.array(rows)).combine_chunks(), label[rows])
            for r in np.flatnonzero(~light).tolist():
                yield from many(t.slice(int(ends[r] - size[r]), int(size[r])).combine_chunks())

        for batch in (part for whole in batches for part in slices(whole, TOGETHER_BYTES)):
            if not batch.num_rows:
                continue
            wait.append(batch)
            k = np.stack([batch.column(c).to_numpy() for c in ("token", "x", "y")])
            cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
            last = wait[-2] if len(wait) > 1 else None
            opens = last is not None and any(last.column(c)[last.num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in ("token", "x", "y"))
            if not len(cut) and not opens or sum(b.num_rows for b in wait) < TOGETHER and sum(b.nbytes for b in wait) < TOGETHER_BYTES:
                continue
            hold = int(cut[-1]) if len(cut) else 0
            t = pa.Table.from_batches([*wait[:-1], batch.slice(0, hold)]).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("token", "x", "y")])
            yield from split(t, np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, t.num_rows))
            wait = [batch.slice(hold)]
        if wait:
            t = pa.Table.from_batches(wait).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("token", "x", "y")])
            yield from split(t, np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, t.num_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of one node lie together; the last node of a batch waits for the next, unless it has very many partners."""
        wait: list[np.ndarray] = [np.empty(0, np.int64)] * 5
        for batch in batches:
            if not batch.num_rows:
                continue
            cols, b = _pairs(batch)
            token, x, y, a, b = (np.concatenate(p) for p in zip(wait, [*cols, b], strict=True))
            order = np.lexsort((y, x, token, b, a))
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            token, x, y, a, b = (c[order[new]] for c in (token, x, y, a, b))
            open_ = a == a[-1]
            if open_.sum() > WEIGHT:
                open_[:] = False
            wait = [c[open_] for c in (token, x, y, a, b)]
            if not open_.all():
                yield _lists([c[~open_] for c in (token, x, y, a)], b[~open_])
        if len(wait[0]):
            yield _lists(wait[:4], wait[4])

    lists = rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(trimmed(run), _LISTS)
    return lists.repartition("a").sortWithinPartitions("a").mapInArrow(trimmed(merge), _LISTS)


def _blocks(held: DataFrame, percent: int) -> DataFrame:
    """Rows of tiles of several components, put in the pairs of blocks (``x``, ``y``) in which they meet others.

    A tile of few rows is one block.  Others are cut by size bands, and wide
    bands by hash; a pair that may link lies in one band or in two that adjoin.
    """
    mixed = held.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight")).where("c0 <> c1")
    mixed = mixed.select("token", ((F.col("rows") > BLOCK) | (F.col("weight") > WEIGHT)).alias("large"))
    width = float(np.log(100 / percent)) * 1.0001 or 1e-4  # a little wider than the widest ratio, against rounding
    rows = held.join(mixed, "token").withColumn("band", F.floor(F.log("n") / width).cast("int"))
    bands = rows.where("large").groupBy("token", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / WEIGHT)).cast("int").alias("k"))
    bands = bands.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("bands"))  # a few dozen entries
    rows = rows.join(bands, "token", "left")
    rows = rows.withColumn("s", F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.element_at("bands", F.col("band")))).otherwise(0).cast("int"))

    def number(band: Column, s: Column) -> Column:
        return (F.shiftleft(band + 1, 20) + s).cast("int")

    def others(step: int) -> Column:
        k = F.coalesce(F.try_element_at("bands", F.col("band") + step), F.lit(0))
        return F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))

    me = number(F.col("band"), F.col("s"))
    at = lambda x, y, own: F.struct(x.alias("x"), y.alias("y"), own.cast("int").alias("own"))
    same = F.transform(others(0), lambda o: at(number(F.col("band"), F.least("s", o)), number(F.col("band"), F.greatest("s", o)), F.col("s") > o))
    over = F.transform(others(1), lambda o: at(me, number(F.col("band") + 1, o), F.lit(0)))
    under = F.transform(others(-1), lambda o: at(number(F.col("band") - 1, o), me, F.lit(1)))
    where_ = F.when(F.col("large"), F.concat(same, over, under)).otherwise(F.array(at(F.lit(0), F.lit(0), F.lit(0))))
    return rows.select("token", F.explode(where_).alias("at"), "n", "node", "comp", "pos").select("token", "at.x", "at.y", "at.own", "n", "node", "comp", "pos")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(rows, nodes, links, components)``.

    ``rows``: ``key, n, set`` of every row of ``docs``.  ``nodes``: ``node, id, n, set, sig``
    of every distinct set, ``id`` being its smallest key.  ``links``: ``a, b``, a
    set of links between nodes that joins exactly the components of all links.
    ``components``: ``node, root`` of nodes with links.
    """
    docs = docs.select(key, text)
    low, high = SKETCH_BITS
    bits = min(high, max(low, (16 * docs.count()).bit_length()))
    levels = _sketch(docs, text, width, bits)
    sets = materialize(_sets(docs, key, text, width, percent, levels, bits), "shingles")
    rows = materialize(sets.select(key, "n", "set"), "rows")
    one = sets.where("n > 0").groupBy("set").agg(F.min(key).alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("splits").alias("splits"), F.first("sig").alias("sig"))
    whole = materialize(one.withColumn("node", F.monotonically_increasing_id()), "prefixes")
    discard(sets)
    nodes = materialize(whole.select("node", "id", "n", "set", "sig"), "nodes")
    tiles = materialize(_tiles(whole, percent), "tiles")
    discard(whole)
    near = tiles.select(F.explode(F.array("prev", "pivot")).alias("p"), "node").where("p IS NOT NULL")
    # Tiles dealt over several tasks are tied together by their first rows.
    heads = tiles.where("head").groupBy("token").agg(F.min("node").alias("p"), F.max("deal").alias("most")).where("most > 0")
    near = near.unionByName(tiles.where("head").join(heads, "token").select("p", "node").where("p <> node"))
    # A node has no more pairs than prefix shingles, twice over; what is left out here is compared below.
    met = near.groupBy(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    pairs = met.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("times"), "a"))).where(F.col("rn") <= FIRST).select("a", "b")
    chosen = _bounded(pairs, nodes, percent).groupBy("b").agg(F.collect_list("a").alias("partners"))
    lists = materialize(chosen.select(F.col("b").alias("token"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("b").alias("a"), "partners"), "pairs")
    first = _exact(lists, docs, nodes, None, key, text, width, percent)
    comp = materialize(components(first), "components")
    held = materialize(tiles.select("token", "n", "node", "pos").join(comp.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "held")
    discard(tiles, lists)
    put = _blocks(held, percent).join(nodes.select("node", "sig"), "node")
    lists = materialize(_across(put, percent), "pairs")
    discard(held)
    more = _exact(lists, docs, nodes, comp, key, text, width, percent)
    discard(lists)
    return rows, nodes, first.unionByName(more), extended(comp, more)


def _named(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """``set, root, component_id`` of every distinct set."""
    named = nodes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return materialize(named.join(least, "root").select("set", "root", "component_id"), "classes")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, n_shingles, component_id`` (the smallest key reachable) of every row."""
    rows, nodes, _, comp = join(docs, key, text, **options)
    of = _named(nodes, comp).drop("root")
    return rows.join(of, "set", "left").select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key (and then set); rows without a key or a word stay.

    Rows of a repeated key are told apart by their sets.
    """
    rows, nodes, _, comp = join(docs, key, text, width=width, **options)
    rows = rows.where(F.col(key).isNotNull())
    own = rows.join(_named(nodes, comp), "set").where(F.col(key) == F.col("component_id")).groupBy("root").agg(F.first(key).alias(key), F.min("set").alias("set"))
    own = own.select(key, "set").unionByName(rows.where("n = 0").select(key, "set")).groupBy(key).agg(F.collect_set("set").alias("__sets"))
    kept = own.join(rows.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("__many")), key)

    @F.udf("binary", useArrow=True)
    def digest(t):
        from xxhash import xxh3_128_digest

        h = shingles(t, width)
        return xxh3_128_digest(h.tobytes()) if len(h) else None

    found = docs.where(F.col(key).isNotNull()).join(kept, key).withColumn("__set", digest(F.when(F.col("__many"), F.col(text))))
    found = found.where("NOT __many OR __set IS NULL OR array_contains(__sets, __set)").withColumn("__row", F.when(F.col("__set").isNull(), F.monotonically_increasing_id()))
    return found.dropDuplicates([key, "__set", "__row"]).select(docs.columns).unionByName(docs.where(F.col(key).isNull()))
