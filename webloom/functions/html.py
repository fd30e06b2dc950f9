"""What a page holds: base, anchors, title and text.

Patterns follow a line-based regex reading of HTML, not a parser: ``.`` stops
at a newline, attributes need double quotes, and a tag that merely begins with
``<a`` counts.  Java needs ``(?d)`` for that reading of the dot.
"""

from __future__ import annotations

import html
import re
from html import entities

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from webloom.scratch import small_batches

from . import urls
from .net import resolve_hosts

# The patterns that define bases, anchors, nofollow marks and titles.
BASE = r'(?id)<base.*?href\s*?=\s*?"(.*?)\s*?"'
ANCHOR = r'(?id)<a.*?href\s*?=\s*?"\s*?(.*?)\s*?".*?>'
NOFOLLOW = r'(?id)rel\s*?=\s*?"?nofollow"?'
TITLE = r"(?id)<title.*?>(.*?)</title>"
# Elements whose content is no text.
SILENT = r"(?is)<(script|style|title|noscript|iframe|object|embed|head\s*/)\b[^>]*>.*?</\1\s*>"
#: Unicode white space.
SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
TAG = r"(?s)<!--.*?-->|<[!?/a-zA-Z][^>]*>"


def base_href(page: Column) -> Column:
    return F.nullif(F.regexp_extract(page, BASE, 1), F.lit(""))


def anchors(page: Column) -> Column:
    """Array of ``tag, href`` in page order."""
    tags, hrefs = F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(0)), F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(1))
    return F.arrays_zip(tags.alias("tag"), hrefs.alias("href"))


def is_nofollow(tag: Column) -> Column:
    return tag.rlike(NOFOLLOW)


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"[\t\n\f\r ]+", " ")


def stripped(page: Column) -> Column:
    """Without tags and comments, nothing put in their place, and without silent elements."""
    return F.regexp_replace(F.regexp_replace(page, SILENT, ""), TAG, "")


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: html.unescape(x) if x else x)


@F.pandas_udf(StringType())
def _unescape_ended(text: pd.Series) -> pd.Series:
    def one(m) -> str:
        known = m[1][0] == "#" or m[1] + ";" in entities.html5
        return html.unescape(m[0]) if known else m[0]

    return text.map(lambda x: re.sub(REFERENCE, one, x) if x else x)


def unescaped(text: Column, ended: bool = False) -> Column:
    """Entities decoded, with ``ended`` only those that a semicolon ends; texts without ``&`` don't leave the JVM's value."""
    decode = _unescape_ended if ended else _unescape
    return F.when(text.contains("&"), decode(F.when(text.contains("&"), text))).otherwise(text)


def escaped(text: Column) -> Column:
    # The five characters and their entities.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends, which decoded entities may have put there."""
    return F.regexp_replace(text, rf"^{SPACE}++|{SPACE}++$", "")


def title(page: Column, ended: bool = False) -> Column:
    return trimmed(unescaped(collapsed(stripped(F.regexp_extract(page, TITLE, 1))), ended))


def text(page: Column, ended: bool = False) -> Column:
    return trimmed(unescaped(collapsed(stripped(page)), ended))


def extract_links(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", resolver: DataFrame | None = None) -> DataFrame:
    """``key, url, nofollow, pos``: each page's outgoing links, the first occurrence of each URL deciding.

    Kept are absolute http(s) URLs on the base's host or on hosts that are not
    private; a host neither literal nor in ``resolver`` counts as public if no
    resolver is given and is dropped if one is.  Fragments go before links are
    compared.
    """
    small_batches(pages.sparkSession)
    each = pages.select(F.col(key), F.col(url).alias("page_url"), urls.with_slash(base_href(F.col(page))).alias("declared"), F.posexplode(anchors(F.col(page))).alias("pos", "a"))
    each = each.select(key, "page_url", "declared", "pos", is_nofollow(F.col("a.tag")).alias("nofollow"), F.col("a.href").alias("href"))
    each = urls.resolve_within(each, "page_url", "declared", "href")
    each = each.where(urls.is_web(F.col("to"))).withColumn("to_host", urls.host(F.col("to")))
    each = resolve_hosts(each, "to_host", resolver)
    public = ~F.coalesce("private", F.lit(resolver is not None))
    each = each.where(F.col("to_host").eqNullSafe(urls.host(F.col("base"))) | public)
    each = each.select(key, "pos", "nofollow", urls.without_fragment(F.col("to")).alias("url")).where(urls.is_page(F.col("url")))
    first = Window.partitionBy(key, "url").orderBy("pos")
    return each.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(key, "url", "nofollow", "pos")
