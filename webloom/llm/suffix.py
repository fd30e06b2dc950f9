"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if a string of ``length`` bytes covers it that also starts earlier
in the table (smaller key, or the same text at an earlier offset).

1. Every window of ``length`` bytes is assigned the smallest hash among its
   ``GRAM``-grams, its anchor.  Equal windows have equal anchors, and
   neighbouring windows mostly share one, so a text becomes a few segments.
   Segments whose anchor occurs once in the table and once in themselves hold
   no repeated window.
2. The other segments' bytes are brought together by anchor, in order of place.
   Equal segments collapse to the first.
3. The suffixes of the rest are put in buckets by their first 8 bytes.  Buckets
   are refined by sorting on pairs of bucket pointers, a suffix's own and that
   of the suffix 8, 16, 32 and at last 36 bytes on, each pass reusing what the
   last one found, until a bucket holds equal ``length``-byte strings only.
   All but the first of a bucket are repeats.
4. An anchor with more than ``DEAL`` bytes of segments is dealt over several
   groups in order of place.  First occurrences in each then meet by a digest
   of their window, where the smallest place wins.

Anchors only route windows: that two windows are equal is decided on their
bytes, or in step 4 on 128-bit digests of them.

Defined cases: a null text counts as empty; texts below ``length`` lose
nothing but others may not repeat them either; where keys are null or occur
more than once the rows are put in order of key and text first (nulls last),
and that order is the table's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, materialize, slices

LENGTH = 100
GRAM = 24
#: Bytes of segments in one group, and windows in one segment, at most.
DEAL = 2 << 20
LONGEST = 2048
#: Bytes of segments that are sorted together.
BATCH = 2 << 20

_COUNT, _AGAIN = (1 << 31) - 1, 1 << 31

_U = np.uint64
_A, _B, _C, _M = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8-byte word at every offset."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours, by doubling."""
    span, y = 1, x
    while 2 * span <= width:
        y = best(y[:-span], y[span:])
        span *= 2
    n = len(x) - width + 1
    return best(y[:n], y[width - span : width - span + n])


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text index, first window, windows, anchor, again)`` of all texts' segments.

    ``again``: the anchor may occur more than once within the segment.
    """
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], size.cumsum()[:-1]])
    total = int(size.sum())
    none = np.empty(0, np.int64)
    if total < length:
        return none, none, none, none, none.astype(bool)
    w = _words(np.frombuffer(b"".join(texts), np.uint8))
    h = w[: total - GRAM + 1] * _A + w[8 : total - GRAM + 9] * _B + w[16 : total - GRAM + 17] * _C
    h ^= h >> _U(31)
    h *= _M
    h ^= h >> _U(29)
    width = length - GRAM + 1
    low = _sliding(h, width, np.minimum)
    edge = np.zeros(total + 1, np.int8)
    big = size >= length
    np.add.at(edge, start[big], 1)
    np.add.at(edge, start[big] + size[big] - length + 1, -1)
    valid = edge.cumsum()[: len(low)] > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(fresh)
    over = valid.copy()
    over[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
    count = np.flatnonzero(over) - first + 1
    if len(count) and count.max() > LONGEST:
        times = -(-count // LONGEST)
        k = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
        first, count = np.repeat(first, times) + k * LONGEST, np.minimum(LONGEST, np.repeat(count, times) - k * LONGEST)
    anchor = low[first].view(np.int64)
    # A gram is an anchor if it is the smallest of some window; two equal ones in reach of each other belong to one segment.
    pad = np.zeros(width - 1, _U)
    spots = np.flatnonzero(_sliding(np.concatenate([pad, np.where(valid, low, _U(0)), pad]), width, np.maximum) == h)
    twin = spots[:-1][(h[spots[1:]] == h[spots[:-1]]) & (np.diff(spots) <= width)]
    marks = np.concatenate([[0], np.bincount(twin, minlength=len(h)).cumsum()])
    again = marks[first + count + width - 1] > marks[first]
    which = np.searchsorted(start, first, "right") - 1
    # Empty texts share their start with the next one, which is the one meant.
    return which, first - start[which], count, anchor, again


def _ordered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ord, text`` with unique longs ``ord`` in the order of the table."""
    kind = docs.schema[key].dataType
    docs = docs.select(key, text)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        n = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(1).count()
        if not n:
            return docs.select(key, F.col(key).cast("long").alias("ord"), F.col(text).alias("text"))
    put = docs.orderBy(F.col(key).asc_nulls_last(), F.col(text)).withColumn("ord", F.monotonically_increasing_id())
    return materialize(put, "ordered").select(key, "ord", F.col(text).alias("text"))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, ord, place`` (first window, ``again`` and number of windows in one long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1 << 21):
                which, first, count, anchor, again = segments([(t or "").encode() for t in batch.column(1).to_pylist()], length)
                if len(which):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(batch.column(0).to_numpy()[which]), pa.array(first << 32 | again.astype(np.int64) << 31 | count)], names=["anchor", "ord", "place"])

    return docs.select("ord", "text").mapInArrow(run, "anchor long, ord long, place long")


def _repeated(rows: DataFrame, length: int) -> DataFrame:
    """The rows whose anchor occurs more than once, in the table or in the segment, each with the number of its deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row so far, as its anchor may go on: (anchor, ord, place, already given)
        sent = 0  # bytes of the last anchor's segments so far
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, ord_, place = (batch.column(i).to_numpy() for i in range(3))
            size = (place & _COUNT) + length - 1
            joins = last is not None and anchor[0] == last[0]
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            starts = np.flatnonzero(new)
            runs = np.diff(np.append(starts, len(anchor)))
            total = size.cumsum() - size
            before = total - np.repeat(total[starts], runs)
            if joins:
                before[: runs[0]] += sent
            many = np.repeat(runs > 1, runs) | (place & _AGAIN > 0)
            if joins:
                many[: runs[0]] = True
            # The last run may go on; until then a single row waits.
            out = [anchor[many], ord_[many], place[many], (before // DEAL)[many]]
            if joins and not last[3]:
                out = [np.append(o, x) for o, x in zip(out, (last[0], last[1], last[2], 0), strict=True)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(o) for o in out[:3]] + [pa.array(out[3].astype(np.int32))], names=["anchor", "ord", "place", "deal"])
            sent = int(before[-1] + size[-1])
            last = (anchor[-1], ord_[-1], place[-1], bool(many[-1]))

    return rows.repartition("anchor").sortWithinPartitions("anchor", "ord", "place").mapInArrow(run, "anchor long, ord long, place long, deal int")


def repeats(segs: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in the joined segments, and which of them repeat an earlier one.

    Bucket-pointer refinement: ``at[i]`` points to the bucket of the suffix at ``i``.
    """
    size = np.array([len(s) for s in segs], np.int64)
    buf = np.frombuffer(b"".join([*segs, bytes(8)]), np.uint8)
    windows = size - length + 1
    begin = size.cumsum() - size
    starts = np.repeat(begin - (windows.cumsum() - windows), windows) + np.arange(windows.sum())
    at, depth = np.unique(_words(buf), return_inverse=True)[1], 8
    while depth < length:
        step = min(depth, length - depth)
        if depth + step == length:
            pair = at[starts] * len(at) + at[starts + step]
        else:
            pair = at[:-step] * len(at) + at[step:]
            at = np.unique(pair, return_inverse=True)[1]
        depth += step
    order = np.argsort(pair, kind="stable")
    later = np.zeros(len(starts), bool)
    later[order[1:]] = pair[order[1:]] == pair[order[:-1]]
    return starts, later


def _intervals(rows: DataFrame, length: int) -> DataFrame:
    """``ord, start, end`` of repeated stretches; from dealt anchors also ``digest`` of first windows (``end`` 0)."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        """held: (ord, first, bytes, open) of distinct segments."""
        starts, later = repeats([s for _, _, s, _ in held], length)
        count = np.array([len(s) - length + 1 for _, _, s, _ in held], np.int64)
        which = np.repeat(np.arange(len(held)), count)
        ord_ = np.array([x[0] for x in held], np.int64)[which]
        place = np.array([x[1] for x in held], np.int64)[which] + np.arange(len(which)) - np.repeat(count.cumsum() - count, count)
        if later.any():
            go = later.copy()
            go[1:] &= ~later[:-1] | (which[1:] != which[:-1])
            stop = later.copy()
            stop[:-1] &= ~later[1:] | (which[1:] != which[:-1])
            yield made(ord_[go], place[go], place[stop] + length, None)
        firsts = np.flatnonzero(np.array([x[3] for x in held])[which] & ~later)
        if len(firsts):
            from xxhash import xxh3_128_digest

            digests = []
            for i in firsts:
                _, first, seg, _ = held[which[i]]
                k = int(place[i]) - first
                digests.append(xxh3_128_digest(seg[k : k + length]))
            yield made(ord_[firsts], place[firsts], np.zeros(len(firsts), np.int64), digests)

    def made(o, a, b, digests) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(o), pa.binary()) if digests is None else pa.array(digests, pa.binary())], names=["ord", "start", "end", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        seen: set[bytes] = set()
        mark = None
        copies: list[tuple[int, int, int]] = []
        for whole in batches:
            for batch in slices(whole, 1 << 22):
                for anchor, deal, ord_, first, seg, is_open in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if (anchor, deal) != mark:
                        mark = (anchor, deal)
                        seen = set()
                        if weight >= BATCH:
                            yield from flush(held)
                            held, weight = [], 0
                    if seg in seen:
                        copies.append((ord_, first, first + len(seg)))
                    else:
                        seen.add(seg)
                        held.append((ord_, first, seg, is_open))
                        weight += len(seg)
                if copies:
                    yield made(*zip(*copies, strict=True), None)
                    copies = []
        if held:
            yield from flush(held)

    put = rows.repartition("anchor", "deal").sortWithinPartitions("anchor", "deal", "ord", "first")
    return put.mapInArrow(run, "ord long, start long, end long, digest binary")


def _cut(docs: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """The bytes of the segments in ``hits``: ``anchor, deal, ord, first, seg, open``."""
    each = hits.groupBy("ord").agg(F.collect_list(F.struct("anchor", "place", "deal", "open")).alias("parts"))
    rows = docs.select("ord", "text").join(each, "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1 << 22):
                parts = batch.column("parts")
                flat = parts.flatten()
                anchor, place, deal, is_open = (flat.field(i) for i in range(4))
                where = place.to_numpy()
                first, count = where >> 32, where & _COUNT
                lens = np.diff(parts.offsets.to_numpy())
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                which = np.repeat(np.arange(len(texts)), lens)
                segs = [texts[t][a : a + n + length - 1] for t, a, n in zip(which.tolist(), first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, deal, pa.array(batch.column("ord").to_numpy()[which]), pa.array(first), pa.array(segs, pa.binary()), is_open], names=["anchor", "deal", "ord", "first", "seg", "open"])

    return rows.mapInArrow(run, "anchor long, deal int, ord long, first long, seg binary, open boolean")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key, kept`` (bytes), ``spans`` (maximal removed runs of bytes) and ``n_bytes`` of every row."""
    if length < 64 or length > 128:
        raise ValueError("length must be from 64 to 128 bytes")
    rows = _ordered(docs, key, text)
    hits = materialize(_repeated(_anchors(rows, length), length), "anchors")
    dealt = hits.where("deal > 0").groupBy("anchor").agg(F.lit(True).alias("open"))
    hits = hits.join(dealt, "anchor", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    found = materialize(_intervals(_cut(rows, hits, length), length), "intervals")
    firsts = found.where("digest IS NOT NULL")
    least = firsts.groupBy("digest").agg(F.min(F.struct("ord", "start")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = firsts.join(least, "digest").where(F.struct("ord", "start") != F.col("least")).select("ord", "start", (F.col("start") + length).alias("end"))
    every = found.where("digest IS NULL").select("ord", "start", "end").unionByName(again)
    each = every.groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    joined = rows.join(each, "ord", "left").select(key, "text", "cuts")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields(docs, key), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", spans)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sizes, kept, out = [], [], []
                for t, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                    raw = (t or "").encode()
                    runs: list[dict] = []
                    for a, b in sorted((c["start"], c["end"]) for c in cuts or ()):
                        if runs and a <= runs[-1]["end"]:
                            runs[-1]["end"] = max(b, runs[-1]["end"])
                        else:
                            runs.append({"start": a, "end": b})
                    edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(raw)]
                    sizes.append(len(raw))
                    kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                    out.append(runs)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(out, kind)], names=schema.names)

    return joined.mapInArrow(run, schema)
