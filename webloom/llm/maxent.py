"""A hashed maximum-entropy language model with a class-factored softmax.

``P(word | context) = P(class | context) * P(part | class, context) * P(word | part)``.
Frequent words are classes of their own, other words share classes by their
endings, and such a class has parts by the hash of the word.  Both the classes
and the parts in a class have a softmax over hashed features of the context
(previous word, pair of previous classes, word before the last as a skip, and
the class before that), which start from the counts; the features' weights of
the parts are shared by all classes.  Words of one part follow the counts of
all training words, with one unseen word in reserve, so that probabilities add
up to one over the vocabulary and one unseen word in each part.

Training passes read every training text once: a first pass over a small slice
and a second over the rest.  In a pass, each task runs stochastic gradient
steps from the weights broadcast to it.  A step takes the model's expectation
by about ``DRAWS`` draws a token from its softmax over all classes, which is
unbiased and leaves a sparse gradient.  Row-wise means of the tasks' changes, weighted by
the tokens that met a row and sent in eight bits a weight, give the next
weights.  A task takes ``SHARE`` tokens or more, so that the changes sent stay
in proportion to the input.  Rows of weights grow with the root of the training
tokens, about as distinct words do, up to ``MAX_ROWS`` a feature, and are
broadcast whole; the counts stay distributed: the ``TOP`` most frequent words at
most are broadcast, and the others' counts come by a join.

Steps follow the order of the rows in their files and the number of tasks, so
``score`` changes a little with them; ``base_score`` and the counts don't.

Defined cases: a null text is the empty text and has one token, its end;
repeated ids are scored row by row; without training texts the weights stay
zero and every count is zero; equally frequent words are ranked by their bytes.
Texts are read whole in batches of 4 MB or one text.  Columns other than the
key, the text and those asked for aren't read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, id_crc, materialize, slices

#: Words whose counts every task holds, at most.
TOP = 1 << 17
#: Classes: single frequent words, endings, and one for the end of a text.
SINGLES, ENDINGS = 64, 63
CLASSES = SINGLES + ENDINGS + 1
END = CLASSES - 1
#: Parts of a class of several words; as many as classes, so that weights lie in one table.
PARTS = CLASSES
#: Rows of weights of each feature, at least and at most (537 MB for all weights).
ROWS, MAX_ROWS = 1 << 12, 1 << 17
FEATURES = 4
#: Tokens of one gradient step, its rate, and draws a token for the model's expectation.
STEP, RATE, DRAWS = 2048, 0.2, 4
#: Logits of a step stay between this and its negative where their powers would not be finite.
LOGIT = np.float32(60)
#: Steps of a weight to one, in scoring.
UNIT = 512
#: Training tokens of a task, at least, where that leaves two tasks a core.
SHARE = 1 << 24
#: Bytes of texts whose words a task counts together.
COUNTED = 1 << 24
#: The first pass reads this share of the training texts.
WARM = 8
PRIOR = 0.1

_END_TOKEN = b""


@dataclass
class Vocabulary:
    """Counts of the frequent words and what all tasks need of the others."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    mass: np.ndarray

    def log_mass(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log10(self.mass)

    def log_share(self) -> np.ndarray:
        """Natural logarithms of the parts' shares in their classes, before any context."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(self.mass / self.mass.sum(1, keepdims=True)).astype(np.float32)

    @property
    def rows(self) -> int:
        """Rows of weights of each feature: the power of two from the root of the training tokens on."""
        return min(MAX_ROWS, max(ROWS, 1 << (math.isqrt(max(self.total, 1)) - 1).bit_length()))

    @cached_property
    def table(self) -> _Lookup:
        """``lookup()``, made once a worker."""
        return self.lookup()

    def lookup(self) -> _Lookup:
        table = _Lookup()
        rows = table.rows = self.rows
        singles = 0
        for i, w in enumerate(self.words):
            if w == _END_TOKEN:
                c = END
            elif singles < SINGLES:
                c, singles = singles, singles + 1
            else:
                c = _part(w) << 36 | _ending(w)
            table[w] = (i + 1) << 44 | (zlib.crc32(w) % rows) << 8 | c
        if _END_TOKEN not in table:
            table[_END_TOKEN] = END
        return table


def _ending(word: bytes) -> int:
    return SINGLES + zlib.crc32(word[-3:]) % ENDINGS


def _part(word: bytes) -> int:
    return zlib.crc32(word) % PARTS


class _Lookup(dict):
    """Words to ``rank + 1`` (0: not frequent), part, weight row and class, in one integer of 19, 8, 28 and 8 bits."""

    rows = ROWS

    def __missing__(self, w: bytes) -> int:
        return self.every([w])[0]

    def every(self, words: list[bytes]) -> list[int]:
        """The numbers of words; no number is zero."""
        known, hash_, rows = self.get, zlib.crc32, self.rows
        return [known(w) or ((h := hash_(w)) % PARTS) << 36 | (h % rows) << 8 | SINGLES + hash_(w[-3:]) % ENDINGS for w in words]


@dataclass
class _Texts:
    """The tokens of some texts, laid end to end as places in ``distinct`` (the end first), and the texts' sizes."""

    distinct: pa.Array
    which: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> _Texts:
        """The words of texts, lower-cased, and an end after each text that no word equals."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
        flat, edges = split.flatten(), split.offsets.to_numpy()
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # not those before and after all words
        size = np.diff(np.concatenate([[0], full.cumsum()])[edges - edges[0]])
        words = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
        which = np.zeros(len(words) + len(size), np.int64)
        which[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = words.indices.to_numpy() + 1
        distinct = pa.concat_arrays([pa.array([_END_TOKEN], pa.binary()), words.dictionary.cast(pa.binary())])
        return cls(distinct, which, size + 1)

    def codes(self, table: _Lookup) -> np.ndarray:
        return np.array(table.every(self.distinct.to_numpy(zero_copy_only=False).tolist()), np.int64)[self.which]

    def counted(self, at: np.ndarray) -> pa.Array:
        """Each text's distinct tokens among the places ``at`` with their numbers, as lists of ``token, tf``."""
        n = len(self.distinct)
        found, tf = np.unique(np.repeat(np.arange(len(self.size)), self.size)[at] * n + self.which[at], return_counts=True)
        each = pa.StructArray.from_arrays([self.distinct.take(pa.array(found % n)), pa.array(tf, pa.int64())], names=["token", "tf"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(found // n, np.arange(len(self.size) + 1)), pa.int32()), each)

    @property
    def begins(self) -> np.ndarray:
        out = np.zeros(len(self.which), bool)
        out[self.size.cumsum() - self.size] = True
        return out


def _context(code: np.ndarray, begins: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Weight rows (features x tokens) of texts laid end to end; ``begins`` marks first tokens."""
    n = len(code)
    row, cls = code >> 8 & 0xFFFFFFF, code & 0xFF
    first = np.flatnonzero(begins)

    def back(x: np.ndarray, k: int, void: int) -> np.ndarray:
        y = np.empty(n, np.int64)
        y[k:] = x[: n - k]
        y[:k] = void
        for j in range(k):
            at = first + j  # of this text or, if it is so short, near the start of a later one
            y[at[at < n]] = void
        return y

    c1, c2, c3 = (back(cls, k, END) for k in (1, 2, 3))
    pairs = np.arange(CLASSES * CLASSES)
    out = np.empty((FEATURES, n), np.int64)
    out[0] = back(row, 1, rows - 1)
    out[1] = (rows + pairs * 40503 % 65521 % rows)[c1 * CLASSES + c2]
    out[2] = 2 * rows + back(row, 2, rows - 1)
    out[3] = (3 * rows + pairs * 30011 % 65521 % rows)[c3 * CLASSES + c1]
    return out


def _gathered(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of each token's rows."""
    z, more = (np.empty((at.shape[1], weights.shape[1]), weights.dtype) for _ in range(2))
    weights.take(at[0], 0, z, "clip")  # no row is outside, and other modes copy once more
    for f in range(1, FEATURES):
        z += weights.take(at[f], 0, more, "clip")
    return z


def _scores(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logits."""
    z = _gathered(weights, at)
    z += bias
    return z


def _fixed(weights: np.ndarray) -> np.ndarray:
    """Weights in units of ``1 / UNIT``, so that ``FEATURES`` of them add up in 16 bits."""
    most = 32767 // FEATURES
    return np.clip(np.rint(weights * UNIT), -most, most).astype(np.int16)


def _fixed_scores(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``_scores`` of weights from ``_fixed``."""
    z = _gathered(weights, at)
    out = z.astype(np.float32)
    out *= np.float32(1 / UNIT)
    out += bias
    return out


def _log10(z: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Logarithms of the softmax of ``z`` at ``of``; uses ``z`` up."""
    own = z[np.arange(len(of)), of]
    np.exp(z, out=z)
    return (own - np.log(np.einsum("ij->i", z))) / math.log(10)


@lru_cache(1)
def _noise() -> np.ndarray:
    """Uniform numbers that all steps share, each from a start of its own."""
    return np.random.default_rng(11).random(1 << 21, np.float32)


def _set(flags: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of flags of which few are set."""
    if len(flags) % 8:
        flags = np.append(flags, np.zeros(-len(flags) % 8, bool))
    some = np.flatnonzero(flags.view(np.uint64) != 0)
    at = np.flatnonzero(flags.reshape(-1, 8).take(some, 0))
    return (some.take(at >> 3) << 3) + (at & 7)


def _descend(weights: np.ndarray, square: np.ndarray, touched: np.ndarray, bias: np.ndarray, at: np.ndarray, cls: np.ndarray, seed: int = 0) -> None:
    """One gradient step on a batch of tokens; rows move at rates that fall with their own past gradients.

    The gradient is the model's share of each class less one for the class that
    came.  A share under ``1 / DRAWS`` counts as that much or as nothing, by
    chance and right on average; larger ones count as they are.
    """
    n, k = len(cls), weights.shape[1]
    every = np.arange(n)
    p = _scores(weights, bias, at)
    with np.errstate(over="ignore"):
        np.exp(p, out=p)
        whole = np.einsum("ij->i", p)
    if not (np.isfinite(whole) & (whole > 0)).all():  # far-off logits
        p = np.exp(np.clip(_scores(weights, bias, at), -LOGIT, LOGIT))
        whole = np.einsum("ij->i", p)
    p *= (DRAWS / whole)[:, None]
    miss = 1 - p[every, cls] / DRAWS
    noise = _noise()
    start = seed * 7919 % (len(noise) - min(n * k, len(noise)) + 1)
    hit = _set(p.ravel() > (noise[start : start + n * k] if n * k <= len(noise) else np.resize(noise, n * k)))
    of = hit // k
    flat, p = weights.reshape(-1), p.ravel()
    # Features have rows of their own, so one pass serves all.
    rows = np.ascontiguousarray(at).reshape(-1)
    off = np.tile(miss, FEATURES)
    # A row's gradient has about the length of its tokens' misses, added up, in two of its k places.
    before = square.take(rows)
    np.add.at(square, rows, off)
    own = (square.take(rows) - before) * (off * np.float32(2 / k))
    square[rows] = before
    np.add.at(square, rows, own)
    np.add.at(touched, rows, 1)
    rate = RATE / np.sqrt(square.take(rows))
    first, rate = (rows * k).reshape(FEATURES, n), rate.reshape(FEATURES, n)
    np.subtract.at(flat, (first.take(of, 1) + (hit - of * k)).reshape(-1), (np.maximum(p[hit], 1) / DRAWS * rate.take(of, 1)).reshape(-1))
    np.add.at(flat, (first + cls).reshape(-1), rate.reshape(-1))


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """``token`` (binary; empty: the end) and ``c`` over all texts; counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0

        def flush() -> pa.RecordBatch:
            texts = _Texts.of(pa.concat_arrays(held))
            held.clear()
            return pa.RecordBatch.from_arrays([texts.distinct, pa.array(np.bincount(texts.which))], names=["token", "c"])

        for whole in batches:
            for batch in slices(whole, 1 << 22):
                if batch.num_rows:
                    held.append(batch.column(0))
                    weight += batch.nbytes
                if weight >= COUNTED:
                    yield flush()
                    weight = 0
        if held:
            yield flush()

    return train.select(text).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, top: int = TOP) -> Vocabulary:
    """From all counts: totals and masses of classes by part (sums of fixed number), and the words above a frequency."""
    ending = F.pmod(F.crc32(F.substring("token", -3, 3)), F.lit(ENDINGS)).cast("int")
    sums = counts.groupBy(F.when(F.octet_length("token") == 0, -1).otherwise(ending).alias("e"), F.pmod(F.crc32("token"), F.lit(PARTS)).cast("int").alias("p")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    total, distinct = sum(r.c for r in sums), sum(r.v for r in sums)
    # Frequencies that at least one word has; the least one that leaves `top` words or fewer.
    steps = counts.groupBy(F.least(F.col("c"), F.lit(1 << 20)).alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    floor, left = 1 << 20, 0
    for r in sorted(steps.collect(), key=lambda r: -r.c):  # 2**20 rows at most
        if left + r.n > top:
            break
        floor, left = r.c, left + r.n
    rows = sorted(((-r.c, bytes(r.token)) for r in counts.where(F.col("c") >= floor).collect()), key=lambda x: x) if left else []
    # A class of one word has all in its first part.
    mass = np.zeros((CLASSES, PARTS))
    mass[SINGLES:END] = mass[:SINGLES, 0] = mass[END, 0] = PRIOR
    for r in sums:
        mass[(END, 0) if r.e < 0 else (SINGLES + r.e, r.p)] += r.c + PRIOR * r.v
    made = Vocabulary([w for _, w in rows], np.array([-c for c, _ in rows], np.float64), total, distinct, mass)
    singles = [(i, w) for i, w in enumerate(made.words) if w != _END_TOKEN][:SINGLES]
    for k, (i, w) in enumerate(singles):
        mass[_ending(w), _part(w)] -= made.counts[i] + PRIOR
        mass[k, 0] = made.counts[i] + PRIOR
    return made


def fit(train: DataFrame, vocab: Vocabulary, text: str = "text", key: str = "doc_id", words: Broadcast | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (of the classes, then of the parts) and the classes' bias after the training passes; ``words``: ``vocab`` as broadcast before."""
    spark = train.sparkSession
    bias = np.log(vocab.mass.sum(1) / vocab.mass.sum()).astype(np.float32)
    weights = np.zeros((2 * FEATURES * vocab.rows, CLASSES), np.float32)
    words = words or spark.sparkContext.broadcast(vocab)
    blocks = 64
    part = len(weights) // blocks
    share = F.pmod(F.xxhash64(key), F.lit(WARM))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-vocab.total // SHARE))
    for slice_ in (share == 0, share != 0):
        now = spark.sparkContext.broadcast(weights.astype(np.float16))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            table, w = words.value.table, now.value.astype(np.float32)
            square, touched = np.full(len(w), 1.0, np.float32), np.zeros(len(w), np.int64)
            half, share_ = len(w) // 2, words.value.log_share()
            met = 0
            for whole in batches:
                for batch in slices(whole, 1 << 22):
                    if not batch.num_rows:
                        continue
                    texts = _Texts.of(batch.column(0))
                    code = texts.codes(table)
                    at = _context(code, texts.begins, table.rows)
                    for i in range(0, len(code), STEP):
                        a, c = at[:, i : i + STEP], code[i : i + STEP]
                        cls = c & 0xFF
                        _descend(w[:half], square[:half], touched[:half], bias, a, cls, met)
                        m = np.flatnonzero((cls >= SINGLES) & (cls < END))
                        if len(m):
                            _descend(w[half:], square[half:], touched[half:], share_.take(cls[m], 0), a[:, m], c[m] >> 36 & 0xFF, met)
                        met += 1
            for b in range(blocks):
                rows = np.flatnonzero(touched[b * part : (b + 1) * part]) + b * part
                if len(rows):
                    delta = w[rows] - now.value[rows]
                    scale = np.abs(delta).max(1) / 127 + np.float32(1e-12)
                    eight = np.rint(delta / scale[:, None]).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int32), touched[rows], scale, eight))], names=["block", "rows", "touched", "scale", "delta"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for b, rows, n, scale, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = np.frombuffer(rows, np.int32) - b * part
                    n = np.frombuffer(n, np.int64)
                    total, change = sums.setdefault(b, (np.zeros(part), np.zeros((part, CLASSES))))
                    total[at] += n
                    change[at] += np.frombuffer(d, np.int8).reshape(len(at), CLASSES) * (n * np.frombuffer(scale, np.float32))[:, None]
            for b, (total, change) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([(change / np.maximum(total, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], names=["block", "change"])

        changes = train.where(slice_).select(text).coalesce(tasks).mapInArrow(run, "block int, rows binary, touched binary, scale binary, delta binary")
        weights = now.value.astype(np.float32)
        for r in changes.repartition(blocks, "block").mapInArrow(merge, "block int, change binary").toLocalIterator():  # the size of the weights
            weights[r.block * part : (r.block + 1) * part] += np.frombuffer(r.change, np.float32).reshape(part, CLASSES)
        now.unpersist()
    return weights, bias


def _scored(docs: DataFrame, words: Broadcast, weights: np.ndarray, bias: np.ndarray, key: str, text: str, extra: list[str]) -> DataFrame:
    """Each text's class part, what frequent words give it, and its other words with their numbers."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast((_fixed(weights), bias))
    rare = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("tf", T.LongType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), *fields(docs, key, *extra), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("counted", T.DoubleType()), T.StructField("classed", T.DoubleType()), T.StructField("rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc, (w, b) = words.value, model.value
        table = voc.table
        log_count = np.concatenate([[0.0], np.log10(voc.counts + PRIOR)])
        log_mass, share_ = voc.log_mass(), voc.log_share()
        half = len(w) // 2
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, 1 << 22):
                if not batch.num_rows:
                    continue
                texts = _Texts.of(batch.column(text))
                code, size = texts.codes(table), texts.size
                first = size.cumsum() - size
                at, cls, part, rank = _context(code, texts.begins, table.rows), code & 0xFF, code >> 36 & 0xFF, code >> 44
                logp = np.empty(len(code))
                for i in range(0, len(code), STEP):
                    a, c = at[:, i : i + STEP], cls[i : i + STEP]
                    z = _fixed_scores(w[:half], b, a)
                    logp[i : i + STEP] = _log10(z, c)
                    m = np.flatnonzero((c >= SINGLES) & (c < END))
                    if len(m):
                        z = _fixed_scores(w[half:], share_.take(c[m], 0), a[:, m])
                        logp[i + m] += _log10(z, part[i + m])
                logp -= log_mass[cls, part]
                others = texts.counted(np.flatnonzero(rank == 0))
                made = [pa.array(row + np.arange(len(size))), *(batch.column(n) for n in (key, *extra)), pa.array(size), pa.array(np.add.reduceat((rank > 0).astype(np.int64), first)), pa.array(np.add.reduceat(log_count[rank], first)), pa.array(np.add.reduceat(logp, first)), others]
                row += len(size)
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return docs.select(key, text, *extra).mapInArrow(run, schema)


def score(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = (), top: int = TOP) -> DataFrame:
    """``key, extra, n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities) of every row of ``docs``.

    Learns from every row of ``train``.  ``base_score`` is the smoothed unigram's.
    """
    counts = materialize(count_words(train, text), "counts")
    vocab = vocabulary(counts, top)
    words = docs.sparkSession.sparkContext.broadcast(vocab)
    weights, bias = fit(train, vocab, text, key, words)
    rows = materialize(_scored(docs, words, weights, bias, key, text, list(extra)), "scored")
    each = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.tf").join(counts, "token", "left")
    seen = F.coalesce("c", F.lit(0))
    others = each.groupBy("row").agg(F.sum(F.col("tf") * F.log10(seen + PRIOR)).alias("more"), F.sum(F.when(seen > 0, F.col("tf")).otherwise(0)).alias("known_more"))
    zero = F.lit(0)
    counted = F.col("counted") + F.coalesce("more", zero)
    norm = float(np.log10(vocab.total + PRIOR * (vocab.distinct + 1)))
    return rows.drop("rare").join(others, "row", "left").select(key, *extra, "n_tokens", (F.col("known") + F.coalesce("known_more", zero)).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), (counted - F.col("n_tokens") * norm).alias("base_score"), (counted + F.col("classed")).alias("score"))


def held_out(key: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 10."""
    return id_crc(key) % 10 == 0
