"""Personal data: expressions propose spans, checksums confirm, nearby words adjust the score.

Four base kinds are always reported where their rule holds: ``email``, ``ip``,
``card`` (Luhn) and ``phone``.  Further recognisers add ``iban`` (mod-97),
``ssn``, national phone numbers and ``secret`` (keys and tokens).  A candidate
starts from its recogniser's score; a checksum that holds raises it to 1 and
one that fails drops it; a context word nearby adds ``CONTEXT_GAIN``.  It is
kept from ``ACCEPT`` on.  Added spans never overlap base spans or each other.

Expressions are anchored so that each is linear in the text's length, and
whole texts are read.

Defined cases: null and empty texts have no spans; offsets are code points,
end exclusive; equal texts give equal spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow, slices, small_batches, trimmed

ACCEPT = 0.5
CONTEXT_GAIN = 0.35
#: Characters before and after a candidate in which context words count.
REACH = (48, 16)

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits is consumed whole, so a match can begin only where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of international bank account numbers."""
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` is tried with the longest local part that no earlier match took."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in emails(text)]
    first = _DIGIT.search(text)
    if first:
        begin = first.start()
        for m in _IP.finditer(text, begin):
            if all(map(_small, m[0].split("."))):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text, begin):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text, max(0, begin - 1)):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


@dataclass(frozen=True)
class Recogniser:
    kind: str
    pattern: re.Pattern
    score: float
    check: Callable[[str], bool] | None = None
    context: frozenset[str] = frozenset()


# Context words of each added kind.
EXTRA = (
    Recogniser("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0.4, mod97, frozenset({"iban", "account", "konto", "cuenta", "compte", "bank"})),
    Recogniser("ssn", re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), 0.3, None, frozenset({"ssn", "social", "security"})),
    Recogniser("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"), 0.3, None, frozenset({"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"})),
    Recogniser("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,128}(?![A-Za-z0-9+/_-])"), 0.3, None, frozenset({"token", "secret", "password", "apikey", "api_key", "key", "passwd"})),
)

_WORD = re.compile(r"\w+")


def extra_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    found = []
    for r in EXTRA:
        for m in r.pattern.finditer(text):
            a, b = m.span()
            score = r.score
            if r.check:
                if not r.check(m[0]):
                    continue
                score = 1.0
            near = text[max(0, a - REACH[0]) : a] + " " + text[b : b + REACH[1]]
            if r.context.intersection(w.lower() for w in _WORD.findall(near)):
                score = min(1.0, score + CONTEXT_GAIN)
            if score >= ACCEPT:
                found.append((r.kind, a, b, score))
    kept = []
    for kind, a, b, score in sorted(found, key=lambda x: (-x[3], x[1], -x[2], x[0])):
        i = bisect_left(taken, (a, b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            kept.append((kind, a, b, score))
            taken.insert(i, (a, b))
    return kept


def spans(text: str | None) -> list[dict]:
    """All spans of a text by start, then by the order of ``KINDS``."""
    if not text:
        return []
    base = base_spans(text)
    more = extra_spans(text, base) if _DIGIT.search(text) else []
    every = [(k, a, b, 1.0, True) for k, a, b in base] + [(k, a, b, s, False) for k, a, b, s in more]
    every.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in every]


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` of every row."""
    schema = T.StructType([*fields(df, key), T.StructField("spans", SPANS)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans(t) for t in batch.column(1).to_pylist()], _ARROW)], names=schema.names)

    return map_arrow(df.select(key, text), run, schema)


def masked(text: str) -> str:
    """``text`` with every span replaced by its kind; overlapping spans make one, named by the first."""
    out, end = [], 0
    for s in spans(text):
        if s["start"] >= end:
            out += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
        end = max(end, s["end"])
    return "".join([*out, text[end:]]) if out else text


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` masked, all columns in place; null stays null."""
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                made = pa.array([t and masked(t) for t in batch.column(text).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([made if n == text else batch.column(n) for n in names], names=names)

    return df.mapInArrow(trimmed(run), df.schema)


def counted(column: str, kind: str):
    """How many base spans of a kind there are."""
    return F.size(F.filter(column, lambda s: s["base"] & (s["kind"] == F.lit(kind)))).cast("long")


def added(column: str):
    """How many spans the method adds to the base ones."""
    return F.size(F.filter(column, lambda s: ~s["base"])).cast("long")


def joined(column: str, base_only: bool = False):
    """``kind:start:end`` of the spans, joined by commas."""
    each = F.filter(column, lambda s: s["base"]) if base_only else F.col(column)
    return F.array_join(F.transform(each, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
