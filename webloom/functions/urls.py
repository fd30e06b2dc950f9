"""URL functions: parsing, resolution, and the predicates of link extraction."""

from __future__ import annotations

from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .bind import let

# Endings of URLs that hold no HTML.
SKIPPED = ("jpg", "jpeg", "png", "gif", "ico", "css", "js")
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"


def scheme(url: Column) -> Column:
    """Lower-case scheme, or null."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.lower(F.nullif(found, F.lit("")))


def host(url: Column) -> Column:
    """Host without user, port and the brackets of IPv6, or null."""
    found = F.regexp_extract(url, _AUTHORITY + r"(\[[^\]]*\]|[^:/?#]*)", 1)
    return F.nullif(F.translate(found, "[]", ""), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def with_slash(url: Column) -> Column:
    """A base address ends in a slash; an empty one is no base."""
    given = F.nullif(url, F.lit(""))
    return F.when(given.endswith("/"), given).otherwise(F.concat(given, F.lit("/")))


def is_page(url: Column) -> Column:
    """Whether the ending of the whole URL, query included, isn't one of ``SKIPPED``."""
    return ~url.rlike(r"(?i)\.(" + "|".join(SKIPPED) + r")$")


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def _joined(base: str | None, target: str | None) -> str | None:
    if not base or not target:
        return None
    try:
        made = urljoin(base, target)
    except ValueError:
        return None
    head, sep, rest = made.partition("://")
    if not sep:
        return made
    place, slash, path = rest.partition("/")
    return head + sep + place + slash + quote(path, safe="/?#[]@!$&'()*+,;=%:~-._")


def _absolute(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([_joined(b, t) for b, t in zip(base, target, strict=True)], dtype=object)


def _absolute_in(page: pd.Series, declared: pd.Series, target: pd.Series) -> pd.DataFrame:
    """``base`` of the rows with a declared one, and ``to``: the target as seen from it or, without one, from the page."""
    bases = [_joined(p, d) if d else None for p, d in zip(page, declared, strict=True)]
    seen_from = [p if b is None else b for p, b in zip(page, bases, strict=True)]
    return pd.DataFrame({"base": pd.Series(bases, dtype=object), "to": pd.Series([_joined(b, t) for b, t in zip(seen_from, target, strict=True)], dtype=object)})


# Not deterministic to the planner, so that they run once for each row and are not copied into later expressions.
_resolve = F.pandas_udf(_absolute, StringType()).asNondeterministic()
_resolve_in = F.pandas_udf(_absolute_in, StructType().add("base", StringType()).add("to", StringType())).asNondeterministic()


def _native(base: Column, target: Column) -> Column:
    """``target`` as an absolute URL if it is plain ASCII and absolute or begins at the root, else null."""

    def made(p: Column) -> Column:
        b, t = p["b"], p["t"]
        plain = t.rlike(r"^[!-~]+$") & ~t.rlike(r"(^|/)\.\.?(/|$|\?|#)") & ~t.rlike(r'["<>\\^`{|}]')
        root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        return F.when(plain, F.when(t.startswith("//"), F.concat(scheme(b), F.lit(":"), t)).when(t.rlike(_SCHEME), t).when(t.startswith("/") & (F.length(root) > 0), F.concat(root, t)))

    return let(F.struct(base.alias("b"), target.alias("t")), made)


def resolve(base: Column, target: Column) -> Column:
    """``target`` as an absolute URL: empty is null, ``//host`` takes the scheme, the rest by RFC 3986.

    Plain ASCII targets that are absolute or begin at the root stay in the
    JVM; only others (relative paths, dot segments, characters to escape) go
    through Arrow.
    """
    pair = F.struct(base.alias("b"), target.alias("t"))
    other = let(pair, lambda p: F.when(_native(p["b"], p["t"]).isNull() & (F.length(p["t"]) > 0), p))
    return F.coalesce(_native(base, target), _resolve(other["b"], other["t"]))


def resolve_within(rows: DataFrame, page: str, declared: str, target: str) -> DataFrame:
    """``rows`` with ``base``, the declared base as seen from ``page`` or else ``page``, and ``to``, the target as seen from that.

    As ``resolve`` twice, but in one visit to Python: what a task's worker
    takes is taken once.
    """
    p, d, t = F.col(page), F.col(declared), F.col(target)
    rows = rows.withColumn("__near", _native(p, d))
    rows = rows.withColumn("__open", F.col("__near").isNull() & (F.coalesce(F.length(d), F.lit(0)) > 0))
    rows = rows.withColumn("__near", F.when(~F.col("__open"), F.coalesce("__near", p)))
    rows = rows.withColumn("__to", _native(F.col("__near"), t))
    asks = F.col("__open") | F.col("__to").isNull() & (F.length(t) > 0)
    made = _resolve_in(F.when(asks, F.coalesce("__near", p)), F.when(F.col("__open"), d), F.when(asks, t))
    rows = rows.withColumn("__made", made)
    rows = rows.withColumn("base", F.coalesce("__near", F.col("__made.base"), p))
    to = F.coalesce(F.when(F.col("__open"), _native(F.col("base"), t)).otherwise(F.col("__to")), F.col("__made.to"))
    return rows.withColumn("to", to).drop("__near", "__open", "__to", "__made")
