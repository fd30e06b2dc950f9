"""Full-text index and search: analysis, postings, match and phrase, rank, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.bind import let
from webloom.scratch import cut, release, unsorted_writes

PAGE = 10

# English words that are not indexed.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down during "
    "each few for from further had hadn't has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself let's me more most mustn't my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same shan't she should shouldn't so some such than that the their theirs them themselves then there these they this those through to too under until up "
    "very was wasn't we were weren't what when where which while who whom why with won't would wouldn't you your yours yourself yourselves"
).split()
WORD = r"[\p{L}\p{N}_]+"


class MissingLinkIdError(ValueError):
    """A document to be indexed has no id."""


def analyse(text: Column, stop: bool = True) -> Column:
    """Lower-case words in order, repeats kept, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    if not stop:
        return words
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def index(docs: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """``docs`` with ``batch`` (link_id, url, title, content, page_rank): known documents keep their rank.

    Of several rows of a link in a batch the smallest by url, title and content is taken.
    """
    if batch.where("link_id IS NULL").limit(1).count():
        raise MissingLinkIdError("a document needs a link id")
    rank = F.col("page_rank") if "page_rank" in batch.columns else F.lit(0.0)
    one = batch.groupBy("link_id").agg(F.min(F.struct("url", "title", "content", rank.alias("rank"))).alias("b"))
    new = one.select("link_id", *(F.col(f"b.{c}").alias(f"n_{c}") for c in ("url", "title", "content", "rank")), F.lit(True).alias("n"))
    both = docs.withColumn("o", F.lit(True)).join(new, "link_id", "full_outer")
    pick = lambda c: F.when(F.col("n"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    rank = F.when(F.col("o"), F.col("page_rank")).otherwise(F.coalesce("n_rank", F.lit(0.0)))
    return both.select("link_id", pick("url"), pick("title"), pick("content"), rank.alias("page_rank"), F.when(F.col("n"), F.lit(as_of).cast("timestamp")).otherwise(F.col("indexed_at")).alias("indexed_at"))


def update_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``docs`` with the ranks of ``scores`` (id, score); unknown ids become placeholders."""
    both = docs.join(scores.select(F.col("id").alias("link_id"), F.col("score").alias("__s")), "link_id", "full_outer")
    return both.select("link_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "content")), F.coalesce("__s", "page_rank").alias("page_rank"), "indexed_at")


def _grouped(words: Column, places: bool = True) -> Column:
    """Array of ``term, tf`` and ``positions`` of an array of words, each term once.

    Words are sorted within their row, and runs of equal ones are cut out: a
    task needs no more memory than its largest text, and no exchange.
    """

    def runs(s: Column) -> Column:
        term = (lambda e: e["term"]) if places else (lambda e: e)
        starts = F.array_compact(F.transform(s, lambda e, i: F.when(~term(e).eqNullSafe(term(F.get(s, i - 1))), i)))

        def run(b: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                n = F.coalesce(F.get(b, j + 1), F.size(s)) - x
                found = [term(F.get(s, x)).alias("term"), n.cast("long").alias("tf")]
                return F.struct(*found, F.transform(F.slice(s, x + 1, n), lambda e: e["pos"]).alias("positions")) if places else F.struct(*found)

            return F.transform(b, one)

        return let(starts, run)

    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos"))) if places else words), runs)


def _counted(docs: DataFrame, key: str) -> tuple[int, bool]:
    """The number of documents, and whether a key is found twice."""
    found = docs.groupBy(key).count().agg(F.sum("count"), F.max("count")).first()
    return found[0] or 0, (found[1] or 0) > 1


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of one document's term as one, where keys repeat."""
    positions = [F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if "positions" in rows.columns else []
    return rows.groupBy(*by).agg(F.sum("tf").alias("tf"), *positions)


def postings(docs: DataFrame, key: str, text: Column, stop: bool = True, places: bool = True) -> DataFrame:
    """``term, key, tf``, and with ``places`` ``positions``, of every document.

    Texts are dealt by their key and then turned into postings row by row;
    only where keys repeat, rows are grouped.
    """
    each = docs.select(F.col(key), text.alias("__text")).repartition(key).select(key, F.inline(_grouped(analyse(F.col("__text"), stop), places)))
    if _counted(docs, key)[1]:
        each = _merged(each, key, "term")
    return each.select("term", key, "tf", *(["positions"] if places else []))


#: Parts of an index's postings, by the hash of the term.
BUCKETS = 64


@dataclass(frozen=True)
class Index:
    """Written postings of several fields: ``bucket, term, key, field, tf, positions, length``, and the number of documents.

    A query reads the buckets of its terms only, whatever the corpus holds.
    """

    postings: DataFrame
    key: str
    fields: tuple[str, ...]
    documents: int
    stop: bool = True

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of ``terms``."""
        buckets = {r[0] for r in self.postings.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(_bucket()).collect()}
        return self.postings.where(F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(terms))

    def release(self) -> None:
        release(self.postings)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, key: str = "link_id", fields: tuple[str, ...] = ("title", "content"), stop: bool = True) -> Index:
    """The index of ``docs``, whose keys are unique; every text is analysed once.

    Each task writes its documents' postings to all buckets at once, without sorting or exchanging them.
    """
    count, repeated = _counted(docs, key)
    texts = docs.select(F.col(key), *(F.col(f).alias(f"__{i}") for i, f in enumerate(fields))).repartition(key)
    words = F.array(*(F.struct(F.lit(f).alias("field"), analyse(F.col(f"__{i}"), stop).alias("words")) for i, f in enumerate(fields)))
    each = texts.select(key, F.explode(words).alias("f")).select(key, "f.field", F.size("f.words").alias("length"), F.inline(_grouped(F.col("f.words"))))
    if repeated:
        each = _merged(each, key, "field", "term", "length")
    rows = each.select("term", F.col(key), "field", "tf", "positions", "length", _bucket().alias("bucket"))
    with unsorted_writes(docs.sparkSession, BUCKETS):
        return Index(cut(rows, "postings", "bucket"), key, tuple(fields), count, stop)


@dataclass(frozen=True)
class Query:
    """``kind``: ``match`` (any term) or ``phrase`` (all terms, in a row)."""

    expression: str
    kind: str = "match"
    offset: int = 0

    @classmethod
    def parse(cls, text: str, offset: int = 0) -> Query:
        """Quotes at both ends make a phrase."""
        phrase = text.startswith('"') and text.endswith('"')
        return cls(text.strip('"'), "phrase" if phrase else "match", offset)


def _terms(query: Query, stop: bool) -> list[str]:
    """The query's words, analysed as texts are."""
    import re

    words = re.findall(r"[^\W]+", query.expression.lower())
    return [w for w in words if not (stop and w in STOP_WORDS)]


def _in_a_row(terms: list[str]) -> Column:
    """Whether the terms stand in a row, of ``at``: a map of terms to their positions in one field."""
    distinct = list(dict.fromkeys(terms))
    every = F.size("at") == len(distinct)
    following = F.lit(True)
    starts = F.element_at("at", F.lit(terms[0]))

    def goes_on(p: Column) -> Column:
        found = following
        for i, t in enumerate(terms[1:], 1):
            found = found & F.array_contains(F.element_at("at", F.lit(t)), p + i)
        return found

    return every & F.exists(starts, goes_on)


def search(docs: DataFrame, query: Query, key: str = "link_id", fields: tuple[str, ...] = ("title", "content"), rank: str = "rank", stop: bool = True, best_fields: bool = False, index: Index | None = None) -> DataFrame:
    """All hits: the columns of ``docs`` and ``text_score``, ``score``.

    ``rank="rank"`` orders by page rank, then text score; ``"blended"`` by
    ``q * (q + page rank)``.  A field's text score is the sum over terms of
    ``sqrt(tf) * idf``, divided by the root of its length; a document's is the
    sum of its fields' or, with ``best_fields``, the largest of them.  Without
    an ``index`` one is built for this search and stays until the session ends.
    """
    terms = _terms(query, stop)
    if not terms:
        return docs.where("false").select("*", F.lit(0.0).alias("text_score"), F.lit(0.0).alias("score"))
    index = index or build(docs, key, fields, stop)
    rows = index.of(list(dict.fromkeys(terms)))
    seen = rows.groupBy("term").agg(F.countDistinct(index.key).alias("df"))  # a row for each term of the query
    rows = rows.join(F.broadcast(seen), "term")
    idf = F.log(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.sqrt("tf") * idf / F.sqrt(F.greatest("length", F.lit(1)))
    by_field = rows.groupBy(F.col(index.key).alias("__key"), "field").agg(F.sum(part).alias("q"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    hit = _in_a_row(terms) if query.kind == "phrase" else F.lit(True)
    found = by_field.groupBy("__key").agg((F.max("q") if best_fields else F.sum("q")).alias("text_score"), F.bool_or(hit).alias("__hit")).where("__hit").drop("__hit")
    found = docs.join(found, docs[key] == found["__key"]).drop("__key")
    pr = F.coalesce("page_rank", F.lit(0.0)) if "page_rank" in docs.columns else F.lit(0.0)
    final = F.col("text_score") * (F.col("text_score") + pr) if rank == "blended" else pr
    return found.select(*docs.columns, "text_score", final.alias("score"))


def page(hits: DataFrame, query: Query, key: str = "link_id", size: int = PAGE) -> DataFrame:
    """One page of hits, best first, ties by text score and key; past the end it is empty."""
    return hits.orderBy(F.desc("score"), F.desc("text_score"), key).offset(query.offset).limit(size)


def total(hits: DataFrame) -> int:
    return hits.count()


def find_document(docs: DataFrame, link_id: str):
    from webloom.operators.linkgraph import NotFoundError

    row = docs.where(F.col("link_id") == link_id).limit(1).first()
    if row is None:
        raise NotFoundError(link_id)
    return row
