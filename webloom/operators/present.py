"""How hits are shown: sentences, summaries, highlights and page links; all in the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.html import escaped

SUMMARY = 256
# A sentence ends after . ! ? behind a lower letter, symbol, number or blank, before one more of what may follow and any character.
_BREAK = r"(?<=[\p{Ll}\p{S}\p{N}\s][.!?])(?=[\p{P}\p{S}\p{N}\p{Lu}\s](?s:.))"


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, _BREAK, -1), lambda s: F.length(s) > 0)


def terms_of(expression: str) -> list[str]:
    """The words of a query as typed, without quotes around it."""
    return expression.strip('"').split()


def folded(text: Column) -> Column:
    """For comparison but for case, in any script.

    Letters that case conversion would merge with others (sharp s with ss, the
    dotless i with i) stay apart; the signs of Kelvin, Angstrom and Ohm are letters.
    """
    return F.upper(F.translate(text, "\u1e9e\u00df\u0131\u212a\u212b\u2126", "\ue000\ue000\ue001k\u00e5\u03c9"))


def match_ratio(sentence: Column, terms: list[str]) -> Column:
    """Share of a sentence's words that equal a term but for case."""
    wanted = F.array(*(folded(F.lit(t)) for t in terms)) if terms else F.array().cast("array<string>")
    words = F.filter(F.split(folded(sentence), r"\s+"), lambda w: F.length(w) > 0)
    hits = F.size(F.filter(words, lambda w: F.array_contains(wanted, w)))
    return (hits / F.greatest(F.size(words), F.lit(1))).cast("float")


def matched(text: Column, terms: list[str]) -> Column:
    """Array of ``position, text, ratio`` of the sentences with a match, in order."""
    each = F.transform(sentences(text), lambda s, i: F.struct(i.alias("position"), s.alias("text"), match_ratio(s, terms).alias("ratio")))
    return F.filter(each, lambda s: s["ratio"] > 0)


def selected(text: Column, terms: list[str], limit: int = SUMMARY) -> Column:
    """The best sentences while characters are left, the last one cut, in their order in the text."""
    ranked = F.array_sort(matched(text, terms), lambda a, b: F.when(a["ratio"] > b["ratio"], -1).when(a["ratio"] < b["ratio"], 1).otherwise(a["position"] - b["position"]))
    kind = "struct<left:int,taken:array<struct<position:int,text:string>>>"
    start = F.struct(F.lit(limit).alias("left"), F.array().cast("array<struct<position:int,text:string>>").alias("taken")).cast(kind)

    def take(acc: Column, s: Column) -> Column:
        cut = F.when(F.length(s["text"]) > acc["left"], F.concat(F.substring(s["text"], F.lit(1), acc["left"]), F.lit("..."))).otherwise(s["text"])
        more = F.struct((acc["left"] - F.length(cut)).alias("left"), F.array_append(acc["taken"], F.struct(s["position"].alias("position"), cut.alias("text"))).alias("taken")).cast(kind)
        return F.when(acc["left"] > 0, more).otherwise(acc)

    return F.array_sort(F.aggregate(ranked, start, take)["taken"], lambda a, b: a["position"] - b["position"])


def summary(text: Column, terms: list[str], limit: int = SUMMARY) -> Column:
    """The selected sentences joined: dots where some are missing between, and each ending in a dot."""
    kind = "struct<last:int,out:string>"
    start = F.struct(F.lit(-1).alias("last"), F.lit("").alias("out")).cast(kind)

    def add(acc: Column, s: Column) -> Column:
        gap = F.when((acc["last"] != -1) & (s["position"] - acc["last"] != 1), F.lit("...")).otherwise(F.lit(""))
        dot = F.when(s["text"].endswith("."), F.lit("")).otherwise(F.lit("."))
        return F.struct(s["position"].alias("last"), F.concat(acc["out"], gap, s["text"], dot).alias("out")).cast(kind)

    return F.trim(F.aggregate(selected(text, terms, limit), start, add)["out"])


def highlight(text: Column, terms: list[str]) -> Column:
    """Every occurrence of a term, whole word or not and in any case, within ``<em>``; longer terms first."""
    if not terms:
        return text
    either = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, f"(?iu)(?:{either})", "<em>$0</em>")


def title(title_: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(title_, F.lit("")), url)


def item(url: Column, title_: Column, summary_: Column) -> Column:
    """A hit as an item of a result page; ``summary_`` is HTML already."""
    return F.concat(F.lit('<li><a href="'), escaped(url), F.lit('">'), escaped(title_), F.lit("</a><p>"), F.coalesce(summary_, F.lit("")), F.lit("</p></li>"))


@dataclass(frozen=True)
class Pages:
    start: int
    end: int
    total: int
    previous: str | None
    next: str | None


def pages(terms: str, offset: int, shown: int, total: int, size: int = 10, path: str = "/search") -> Pages:
    """Where a result page stands, and its neighbours' addresses."""
    link = lambda k: f"{path}?{urlencode({'q': terms, 'offset': k})}"
    before = link(max(offset - size, 0)) if offset > 0 else None
    after = link(offset + shown) if offset + shown < total else None
    return Pages(offset + 1 if shown else 0, offset + shown, total, before, after)
