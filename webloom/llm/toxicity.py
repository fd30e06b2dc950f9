"""A weighted lexicon, matched by Aho-Corasick in folded text.

Folding lowers case, maps homoglyphs and digits that stand for letters, and
drops invisible characters, so that disguised words meet the entries.  Entries
are words or word beginnings.  They come from a seed list and from labelled
rows: a matching pursuit picks beginnings one by one for what they explain of
the labels, and their weights are those of a logistic curve refitted after each
choice.  Word pairs around an entry that occur in clean rows only become
exception phrases, whose hits don't count.  A text's sum of weights is divided
by the logarithm of its length; the same curve makes it a probability.

Labels are read for at most ``MAX_ROWS`` rows, those with the smallest hash of
their id (a documented bound); scoring covers all rows and whole texts.

Defined cases: null counts as the empty text, whose score is that of a text
without hits; without labels the seed list and a default curve serve; repeated
ids are scored row by row.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, id_crc, map_arrow, materialize, slices, small_batches, trimmed

#: Labelled rows that are read for learning, at most.
MAX_ROWS = 16_000
#: A candidate is found in at least so many toxic rows, and this share of them, with at least these log odds.
MIN_ROWS, MIN_SHARE, MIN_ODDS = 5, 0.006, 1.2
#: Candidates and entries at most, with the log likelihood that an entry must add.
MAX_CANDIDATES, MAX_ENTRIES, MIN_GAIN = 4_000, 80, 6.0
RIDGE = 0.02
#: Share of the toxic rows that makes a candidate found in hardly any other row an entry in any case.
SURE_SHARE = 0.05
#: Lengths of word beginnings that may become entries.
SHORTEST, LONGEST = 3, 12
THRESHOLD = 0.3

# Common English insults, used before and beside what is learned.
SEEDS = ("idiot", "moron", "scum", "stupid", "pathetic", "worthless", "disgusting", "loser")
# Phrases in which an entry is harmless.
EXCEPTIONS = ("clown fish", "trash can", "trash bin")
SEED_WEIGHT = 4.0

# Letters of other scripts that look like Latin ones.
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Digits that stand for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_FOLD = str.maketrans({**_LOOKS, **_LEET, **dict.fromkeys(_HIDDEN, None)})
_FOLD_ASCII = str.maketrans(_LEET)
_SIGNS = re.compile(r"(?<=[a-z])[@$!](?=[a-z])")
_SIGN = {"@": "a", "$": "s", "!": "i"}
_WIDE = re.compile("[\u0300-\u036f\uff00-\uffef\U0001d400-\U0001d7ff]")
_WORDS = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> list[str]:
    """The words of a text after folding."""
    if not text:
        return []
    if text.isascii():
        text = text.lower().translate(_FOLD_ASCII)
    else:
        if _WIDE.search(text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower().translate(_FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGNS.sub(lambda m: _SIGN[m[0]], text)
    return _WORDS.findall(text)


def beginnings(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


@dataclass
class Lexicon:
    """``entries``: word beginnings and weights.  ``exceptions``: pairs of words in which a hit doesn't count."""

    entries: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, SEED_WEIGHT))
    exceptions: set[str] = field(default_factory=lambda: set(EXCEPTIONS))
    slope: float = 4.0
    offset: float = -3.0

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for phrase in self.exceptions:
            made.add_word(f" {phrase} ", (0, len(phrase) + 2, ""))
        for entry in self.entries:
            made.add_word(f" {entry}", (1, len(entry) + 1, entry))
        if len(made):
            made.make_automaton()
        return made

    def hits(self, words: list[str], automaton) -> list[tuple[int, str]]:
        """Offsets in the joined words, and entries."""
        if not words or not len(automaton):
            return []
        found, spared = [], []
        for end, (kind, n, entry) in automaton.iter(f" {' '.join(words)} "):
            start = end - n + 1
            if kind:
                found.append((start, entry))
            else:
                spared.append((start, end))
        if not spared:
            return found
        spared.sort()
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        return [(at, e) for at, e in found if not (i := bisect_right(starts, at)) or reach[i - 1] <= at]

    def strength(self, hits: list[tuple[int, str]], n_words: int) -> float:
        return sum(self.entries[e] for _, e in hits) / math.log2(4 + n_words)

    def probability(self, strength: float) -> float:
        z = self.slope * strength + self.offset
        return 1 / (1 + math.exp(-z)) if z > -60 else 0.0


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """``text`` and label of the labelled rows with the smallest id hashes, ``max_rows`` at most.

    Written once, since learning reads them several times.
    """
    some = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    some = some.orderBy(F.xxhash64(key), key).limit(max_rows)
    # max_rows ids of 16 bytes: the broadcast has a fixed bound.
    rows = docs.select(key, text).join(F.broadcast(some), key).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    return materialize(rows, "labelled")


def _counts(train: DataFrame) -> DataFrame:
    """``entry, pos, neg``: rows of either label that hold a word beginning; counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            every = sorted(sides[0].keys() | sides[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([sides[1][e] for e in every], pa.int64()), pa.array([sides[0][e] for e in every], pa.int64())], names=["entry", "pos", "neg"])
            sides[0].clear()
            sides[1].clear()
            return out

        for whole in batches:
            for batch in slices(whole):
                for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sides[y].update(beginnings(set(folded(t))))
                    if len(sides[0]) + len(sides[1]) > 400_000:
                        yield flush()
        yield flush()

    return train.mapInArrow(trimmed(run), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn(train: DataFrame) -> Lexicon:
    """A lexicon from ``text, label`` rows, whose number the caller has bounded (see ``labelled``)."""
    size = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos_n, neg_n = size.get(1, 0), size.get(0, 0)
    lex = Lexicon()
    if pos_n < MIN_ROWS or neg_n < MIN_ROWS:
        return lex
    odds = F.log((F.col("pos") + 0.5) / (pos_n + 1)) - F.log((F.col("neg") + 0.5) / (neg_n + 1))
    least = max(MIN_ROWS, MIN_SHARE * pos_n)
    likely = _counts(train).where((F.col("pos") >= least) & (odds > MIN_ODDS)).orderBy(F.desc(odds * F.col("pos")), "entry").limit(MAX_CANDIDATES)
    counts = {r.entry: (r.pos, r.neg) for r in likely.collect()}
    names = sorted(counts.keys() | lex.entries.keys())
    index = {e: i for i, e in enumerate(names)}

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Candidate hits of each row, each divided by the logarithm of its length."""
        rows = []
        for t in batch.column(0).to_pylist():
            words = folded(t)
            c = Counter(w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1) if w[:k] in index)
            rows.append([(index[e], n / math.log2(4 + len(words))) for e, n in sorted(c.items())])
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([[i for i, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[x for _, x in r] for r in rows], pa.list_(pa.float64()))], names=["label", "at", "x"])

    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = sorted((r.label, tuple(r.at), tuple(r.x)) for r in map_arrow(train, found, schema).toLocalIterator())
    y = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([i for r in rows for i in r[1]], np.int64)
    val = np.array([x for r in rows for x in r[2]])
    sure = {e: p for e, (p, n) in counts.items() if p >= SURE_SHARE * pos_n and 50 * n <= p}
    chosen, weights, offset = _pursuit(y, row, col, val, names, sure)
    lex.entries = {e: SEED_WEIGHT for e in lex.entries if not (col == index[e]).any()}
    lex.entries |= {names[i]: round(float(w), 6) for i, w in zip(chosen, weights, strict=True) if w > 0}
    lex.slope, lex.offset = 1.0, round(float(offset), 6)
    lex.exceptions |= _exceptions(train, lex)
    return lex


def _pursuit(y: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, names: list[str], sure: dict[str, int]) -> tuple[list[int], np.ndarray, float]:
    """Entries chosen one by one for what they explain of the labels, with refitted logistic weights and offset."""
    n, m = len(y), len(names)
    chosen: list[int] = []
    dense = np.ones((n, 1))
    w = np.array([math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))])
    barred = np.zeros(m, bool)
    for _ in range(MAX_ENTRIES):
        p = 1 / (1 + np.exp(-np.clip(dense @ w, -40, 40)))
        up = np.bincount(col, (y - p)[row] * val, m)
        down = np.bincount(col, (p * (1 - p))[row] * val * val, m) + RIDGE
        gain = np.where((up > 0) & ~barred, up * up / down / 2, 0)
        best = int(gain.argmax())
        if gain[best] < MIN_GAIN:
            break
        # A longer beginning that explains as much is safer in texts not seen yet.
        longer = [i for i in np.flatnonzero(gain >= 0.98 * gain[best]) if names[i].startswith(names[best])]
        best = max(longer, key=lambda i: (len(names[i]), gain[i]))
        x = np.zeros(n)
        x[row[col == best]] = val[col == best]
        chosen.append(best)
        barred[best] = True
        dense = np.column_stack([dense, x])
        w = _fit(dense, y, np.append(w, 0.0))
    # Entries that are as telling but always stand beside chosen ones explain nothing more here; alone in a text they would.
    for e in sorted(sure, key=lambda e: (-sure[e], -len(e), e)):
        if not any(e.startswith(names[i]) or names[i].startswith(e) for i in chosen):
            at = names.index(max((x for x in sure if x.startswith(e) and sure[x] >= 0.98 * sure[e]), key=len))
            x = np.zeros(n)
            x[row[col == at]] = val[col == at]
            chosen.append(at)
            dense = np.column_stack([dense, x])
            w = np.append(w, max(w[1:], default=SEED_WEIGHT))
    w = _fit(dense, y, w)
    return chosen, w[1:], w[0]


def _exceptions(train: DataFrame, lex: Lexicon, least: int = 4) -> set[str]:
    """Word pairs around hits that ``least`` clean rows hold and no toxic row."""

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto, out = lex.automaton(), []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = folded(t)
            hit = {at for at, _ in lex.hits(words, auto)}
            if hit:
                at, got = 0, set()
                for i, w in enumerate(words):
                    if at in hit:
                        got |= {" ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])}
                    at += len(w) + 1
                out += [(p, y) for p in sorted(got) if " " in p]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int64())], names=["pair", "label"])

    found = map_arrow(train, pairs, T.StructType([T.StructField("pair", T.StringType()), T.StructField("label", T.LongType())]))
    rows = found.groupBy("pair").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).where((F.col("pos") == 0) & (F.col("n") >= least))
    return {r.pair for r in rows.orderBy(F.desc("n"), "pair").limit(1000).collect()}


def _fit(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method; the first column is the offset and bears no ridge."""
    ridge = np.full(a.shape[1], RIDGE)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), grad)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``score``, ``predicted`` and ``matches`` (JSON of entries and counts) of every row."""
    schema = T.StructType([*fields(df, key), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("matches", T.StringType())])
    made = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(lexicon.automaton())
        ps, ms = [], []
        for t in batch.column(1).to_pylist():
            words = folded(t)
            hits = lexicon.hits(words, made[0])
            ps.append(lexicon.probability(lexicon.strength(hits, len(words))))
            ms.append(json.dumps(dict(sorted(Counter(e for _, e in hits).items())), ensure_ascii=False) if hits else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ps, pa.float64()), pa.array([int(p >= threshold) for p in ps], pa.int32()), pa.array(ms, pa.string())], names=schema.names)

    return map_arrow(df.select(key, text), run, schema)


def reject(df: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose score is below ``threshold``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for whole in batches:
            for batch in slices(whole):
                keep = []
                for t in batch.column(text).to_pylist():
                    words = folded(t)
                    keep.append(lexicon.probability(lexicon.strength(lexicon.hits(words, auto), len(words))) < threshold)
                yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(trimmed(run), df.schema)


def training_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The label rows that may be learned from: crc32 of the id mod 4 is not 2."""
    return labels.where(id_crc(key) % 4 != 2)
