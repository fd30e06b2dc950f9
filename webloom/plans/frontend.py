"""A search request from its text to what a result page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html
from webloom.operators import present, textindex


def run_query(docs: DataFrame, text: str, offset: int = 0, size: int = textindex.PAGE, rank: str = "rank", best_fields: bool = False, index: textindex.Index | None = None) -> tuple[DataFrame, present.Pages]:
    """``link_id, url, title, summary, text_score, score`` of one page of hits, best first, and where the page stands.

    Quotes make a phrase.  Titles fall back to URLs; summaries are escaped and
    then highlighted.  A request without hits, or past their end, has no rows.
    """
    query = textindex.Query.parse(text, offset)
    index = index or textindex.build(docs)
    light = docs.select("link_id", *(["page_rank"] if "page_rank" in docs.columns else []))  # texts are read for the page's hits only
    hits = textindex.search(light, query, rank=rank, best_fields=best_fields, index=index)
    total = textindex.total(hits)
    terms = present.terms_of(text)
    summary = present.highlight(html.escaped(present.summary(F.col("content"), terms)), terms)
    found = textindex.page(hits, query, size=size).select("link_id", "text_score", "score")
    rows = docs.join(F.broadcast(found), "link_id").orderBy(F.desc("score"), F.desc("text_score"), "link_id").select("link_id", "url", present.title(F.col("title"), F.col("url")).alias("title"), summary.alias("summary"), "text_score", "score")
    shown = max(0, min(size, total - offset))
    return rows, present.pages(text, offset, shown, total, size)
