"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` splits long texts where the splitting pattern is certain to end a
match, so that one huge text is never handed to the regex engine whole, and its
ids equal those of the unsplit text.  ``decode`` joins raw bytes; ids that cut
a character in two still give back the exact bytes.

Defined cases: a null text encodes as the empty text (no ids); empty texts give
no ids; special-token strings inside texts are ordinary text; ids outside the
vocabulary and null ids lists decode to null; other columns pass through
untouched under their own names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, small_batches, trimmed

#: Texts above so many characters are encoded in pieces of about this size.
PIECE = 1 << 16

#: A letter, digit or closing mark before white space.  No alternative of the
#: pattern crosses from a non-blank to a following blank, so a match ends there,
#: and a match beginning at the blank does not look at what precedes it.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n\r\t])")

_encodings: dict = {}


def _encoding(ranks: bytes, pattern: str):
    key = (hash(ranks), pattern)
    if key not in _encodings:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters, cut at safe boundaries only.

    A stretch without such a boundary stays whole.
    """
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found or found.start() >= len(text):
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _ids(enc, text: str | None, size: int) -> np.ndarray:
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text, size)])


def _ranks(path: str) -> bytes:
    """The driver reads the rank file (a few MB at most); executors need no copy of it."""
    with open(path, "rb") as f:
        got = f.read()
    if len(got) > 64 << 20:
        raise ValueError(f"{path} is too large for a rank file")
    return got


def _raw(enc, ids: bytes | None) -> bytes | None:
    if ids is None or len(ids) % 4:
        return None
    try:
        return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())
    except KeyError:
        return None


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", count: str = "n_tokens", size: int = PIECE, decoded: str | None = None) -> DataFrame:
    """Adds ``out`` (binary: ids as little-endian unsigned 32-bit integers) and ``count`` (long).

    With ``decoded``, also the raw bytes that the ids decode to, from the same
    worker: a table that needs both holds one encoding a task, not two.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(_ranks(ranks_path))
    new = [T.StructField(out, T.BinaryType()), T.StructField(count, T.LongType()), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    keep = [f for f in df.schema.fields if f.name not in [x.name for x in new]]
    schema = T.StructType([*keep, *new])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [_ids(enc, t, size) for t in part.column(text).to_pylist()]
                packed = [x.tobytes() for x in ids]
                made = [pa.array(packed, pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
                if decoded:
                    made.append(pa.array([_raw(enc, x) for x in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=schema.names)

    return df.mapInArrow(trimmed(run), schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the raw bytes of ``ids``."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(_ranks(ranks_path))
    keep = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.BinaryType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared.value, pattern)
        for batch in batches:
            for part in slices(batch):
                made = pa.array([_raw(enc, x) for x in part.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), made], names=[*names, out])

    return df.mapInArrow(trimmed(run), schema)
