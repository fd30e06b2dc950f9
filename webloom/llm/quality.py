"""Compression bands: zstandard ratios that betray repetitive or incompressible text.

The ratio of compressed to raw bytes falls with the length of a text, so each
length class has a band of its own.  Whole texts are compared with it, and so
are fixed chunks, which find a repetitive stretch inside a long clean text.

Defined cases: a null text has no words and fails the base rule; texts below
the first length class are too short to judge and pass the bands; trailing
chunks under half a chunk are not judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, map_arrow

# Fixed values: (bytes from, lowest ratio, highest ratio) at zstandard level 3.
BANDS = (
    (128, 0.58, 1.05),
    (256, 0.55, 0.92),
    (512, 0.48, 0.82),
    (1024, 0.44, 0.74),
    (2048, 0.425, 0.68),
    (4096, 0.405, 0.66),
    (8192, 0.395, 0.66),
    (16384, 0.37, 0.66),
    (65536, 0.32, 0.66),
    (1048576, 0.28, 0.66),
)

#: Chunks of so many bytes, with the band of a full chunk; a shorter one has the band of its length.
CHUNK = 4096
CHUNK_BAND = (0.40, 0.68)

#: Characters that the base counts as symbols.
SYMBOLS = "#*$%&|<>"

_BLANKS = " \t\n\x0b\x0c\r"


def limits(n: int, bands=BANDS) -> tuple[float, float] | None:
    found = None
    for least, low, high in bands:
        if n >= least:
            found = (low, high)
    return found


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    m = n - width + 1
    key, span = ids[:m].copy(), len(seen)
    for k in range(1, width):
        if span > (1 << 62) // len(seen):  # the next product would not fit: rank what there is
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            span = m
        key = key * len(seen) + ids[k : k + m]
        span *= len(seen)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((edge.cumsum()[:n] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, level: int = 3) -> DataFrame:
    """One row per row of ``df``: counts, ratios and verdicts, under ``key``."""
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    doubles = ("ratio", "chunk_min", "chunk_max")
    flags = ("base_failed", "in_band", "kept")
    schema = T.StructType([*fields(df, key), *(T.StructField(x, T.LongType()) for x in longs), *(T.StructField(x, T.DoubleType()) for x in doubles), *(T.StructField(x, T.BooleanType()) for x in flags)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level).compress
        rows = []
        for t in batch.column(1).to_pylist():
            t = t or ""
            raw = t.encode()
            words = raw.split()
            n, rep = len(words), repeated_words(words)
            failed = n < 10 or 100 * rep > 20 * n
            ratio = len(squeeze(raw)) / len(raw) if raw else None
            cut = [raw[i : i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
            sized = [(len(x), len(squeeze(x)) / len(x)) for x in cut if 2 * len(x) >= chunk]
            each = [x for _, x in sized]
            band = limits(len(raw), bands)
            ok = band is None or band[0] <= ratio <= band[1]
            for size, x in sized:
                low, high = chunk_band if size == chunk else limits(size, bands) or (0.0, np.inf)
                ok = ok and low <= x <= high
            rows.append((n, len(t) - sum(map(t.count, _BLANKS)), sum(map(t.count, SYMBOLS)), duplicate_lines(t), rep, ratio, min(each, default=None), max(each, default=None), failed, ok, ok and not failed))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.bool_()] * 3, strict=True))], names=schema.names)

    return map_arrow(df.select(key, text), run, schema)
