"""URL and page goldens, search conformance, presentation, pipelines and services."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import html, net, urls
from webloom.operators import present, textindex
from webloom.plans import crawl, frontend, pipeline
from webloom.plans.crawl import State
from webloom.sources.stores import open_store, submit_links
from webloom.streaming import services

_RESOLVED = [
    ("https://a.test/one", "//b.test/two", "https://b.test/two"),
    ("https://a.test/one", "http://b.test/two", "http://b.test/two"),
    ("http://a.test/dir/", "sub/leaf", "http://a.test/dir/sub/leaf"),
    ("http://a.test/dir/", "/top", "http://a.test/top"),
    ("http://a.test/dir/file", "./leaf", "http://a.test/dir/leaf"),
    ("http://a.test/dir/sub/", "../leaf", "http://a.test/dir/leaf"),
    ("http://a.test/", "/grün", "http://a.test/gr%C3%BCn"),
    ("http://a.test/", "", None),
]


def test_resolve(spark):
    df = spark.createDataFrame(_RESOLVED, "b string, t string, want string")
    for r in df.select("want", urls.resolve(F.col("b"), F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_private(spark):
    yes = ["127.0.0.1", "10.0.0.128", "192.168.0.127", "172.16.10.10", "169.254.169.254", "::1", "fe80::1", "fd00::2"]
    no = ["8.8.8.8", "172.32.0.1", "2001:db8::1", "1.2.3.4"]
    df = spark.createDataFrame([(x,) for x in [*yes, *no, "host", "256.1.1.1", None]], "ip string")
    got = {r.ip: r.p for r in df.select("ip", net.is_private(F.col("ip")).alias("p")).collect()}
    assert all(got[x] for x in yes) and not any(got[x] for x in no) and got["host"] is None and got["256.1.1.1"] is None and got[None] is None
    assert spark.range(1).select(net.is_private(F.lit("8.8.8.8"), ["8.8.8.8/16"])).first()[0]


def test_links(spark):
    page = '<base href="http://example.com/d"><a href="x#1">a</a><a rel="nofollow" href="y">b</a><a href="x#2" rel=nofollow>c</a><a href="ftp://q/">d</a><a href="/i.PNG">e</a><a href="http://10.0.0.1/">f</a>\n<a href="//other.org/z">g</a>'
    df = spark.createDataFrame([(1, "http://example.com/p", page)], "page_id long, url string, html string")
    got = {r.url: r.nofollow for r in html.extract_links(df).collect()}
    assert got == {"http://example.com/d/x": False, "http://example.com/d/y": True, "http://other.org/z": False}


def test_text(spark):
    page = "<html><title>Test  title</title><script>var a='</p>';</script><body>Some <b>content</b> rock &amp; roll<!-- x -->\n\tSearch</body></html>"
    r = spark.createDataFrame([(page,)], "h string").select(html.title(F.col("h")).alias("t"), html.text(F.col("h")).alias("x")).first()
    assert (r.t, r.x) == ("Test title", "Some content rock & roll Search")


def _docs(spark, n=50):
    rows = [(f"{i:03d}", f"http://x/{i}", f"doc with ID {i}", "Updated Document Body" if i % 5 == 0 else "This should be the body text of the document", float(n - i), None) for i in range(n)]
    return spark.createDataFrame(rows, schemas.DOCUMENTS)


def test_search(spark):
    docs = _docs(spark)
    for text in ('"Updated Document Body"', "updated"):
        q = textindex.Query.parse(text)
        hits = textindex.search(docs, q)
        assert [r.link_id for r in textindex.page(hits, q).collect()] == [f"{i:03d}" for i in range(0, 50, 5)]
    q = textindex.Query.parse("body", 20)
    hits = textindex.search(docs, q)
    assert [r.link_id for r in textindex.page(hits, q, size=30).collect()] == [f"{i:03d}" for i in range(20, 50)] and textindex.total(hits) == 50
    assert textindex.page(hits, textindex.Query.parse("body", 200)).count() == 0
    assert textindex.search(docs, textindex.Query.parse('"')).count() == 0
    scores = spark.createDataFrame([(f"{i:03d}", float(i)) for i in range(50)] + [("new", 1.0)], "id string, score double")
    turned = textindex.update_scores(docs, scores)
    assert textindex.page(textindex.search(turned, q), textindex.Query.parse("body")).first().link_id == "049"
    assert turned.where("link_id = 'new'").first().title == ""
    again = textindex.index(turned, docs.limit(1).withColumn("title", F.lit("t")), F.lit(datetime(2024, 1, 1)))
    assert again.where("title = 't'").first().page_rank == 0.0
    with pytest.raises(textindex.MissingLinkIdError):
        textindex.index(docs, docs.limit(1).withColumn("link_id", F.lit(None).cast("string")), F.lit(datetime(2024, 1, 1)))


def _split(text):
    """Sentences by scanning three characters at a time."""
    import unicodedata

    kind = lambda c, *k: any(unicodedata.category(c).startswith(x) for x in k) or ("s" in k and c.isspace())
    out, start = [], 0
    for i in range(1, len(text) - 2):
        if text[i] in ".!?" and kind(text[i - 1], "Ll", "S", "N", "s") and kind(text[i + 1], "P", "S", "N", "Lu", "s"):
            out.append(text[start : i + 1])
            start = i + 1
    return [s for s in [*out, text[start:]] if s]


def test_sentences(spark, small):
    fixed = "Dot without space.Ending in ! Ending in $foo$.1 number at start or end 1. Question?"
    df = spark.read.parquet(f"{small}/documents.parquet").select("text").union(spark.createDataFrame([(fixed,), ("",), ("a.",)], "text string"))
    for r in df.select("text", present.sentences(F.col("text")).alias("s")).collect():
        assert r.s == _split(r.text)


def test_summary_and_highlight(spark):
    text = "Nothing here. The KEY is here. More nothing. Another key and key. Last"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(present.summary(F.col("t"), ["key"])).first()[0] == "The KEY is here.... Another key and key."
    assert df.select(present.summary(F.col("t"), ["key"], 10)).first()[0] == "The KEY i..."
    assert df.select(present.highlight(F.lit("Foo food e.m"), ["foo", "e.m"])).first()[0] == "<em>Foo</em> <em>foo</em>d <em>e.m</em>"
    assert present.pages("q", 10, 10, 25).previous.endswith("offset=0") and present.pages("q", 20, 5, 25).next is None


def test_crawl_pass(spark):
    page = '<html><title>A title</title><a href="http://l.org/1">1</a><a rel="nofollow" href="http://l.org/2">2</a><a href="http://l.org/3">3</a></html>'
    pages = spark.createDataFrame([("http://a.org/", 200, "text/html", page), ("http://b.org/", 200, "application/html", page), ("http://c.org/", 500, "text/html", page), ("http://d.org/x.jpg", 200, "text/html", page)], "url string, status int, content_type string, html string")
    start = State(crawl.seeds(pages), spark.createDataFrame([], schemas.EDGES), spark.createDataFrame([], schemas.DOCUMENTS))
    state, used = crawl.crawl_pass(start, pages, F.lit(datetime(2024, 1, 1)))
    assert used == 2 and state.links.count() == 7 and state.edges.count() == 4 and {r.title for r in state.docs.collect()} == {"A title"}
    assert state.links.where("retrieved_at IS NOT NULL").count() == 2
    less = pages.withColumn("html", F.lit('<a href="http://l.org/3">3</a>'))
    later, _ = crawl.crawl_pass(state, less.where("url = 'http://a.org/'"), F.lit(datetime(2024, 1, 2)))
    assert later.edges.count() == 3 and {r.id for r in later.edges.collect()} <= {r.id for r in state.edges.collect()}


def test_live_fetch(spark):
    links = spark.createDataFrame([("http://a.org/",), ("http://a.org/x.css",), ("http://gone.org/",)], "url string")
    got = crawl.fetch_live(links, lambda u: None if "gone" in u else (200, "text/html", "<p>" + u))
    assert [r.html for r in got.collect()] == ["<p>http://a.org/"]


def test_pipeline(spark):
    p = pipeline.Pipeline(pipeline.fixed_pool(lambda d: d.where("id % 2 = 0"), 3), pipeline.dynamic_pool(lambda d: d, 2), pipeline.broadcast(lambda d: d, lambda d: d), counted=True)
    assert p.execute(spark.range(10), lambda d: pipeline.counting_sink(d, 2)) == 5
    assert p.counts[0] == 5
    with pytest.raises(ValueError):
        pipeline.fixed_pool(lambda d: d, 0)


def test_stores(spark, tmp_path):
    for uri in ("memory://", f"parquet://{tmp_path}/s"):
        store = open_store(spark, uri)
        assert store.load().links.count() == 0
        for batch in (["http://a/#x", "ftp://b/"], ["http://a/", "https://c/"], ["http://a/"]):
            store.save(submit_links(store.load(), spark.createDataFrame([(u,) for u in batch], "url string")))
        assert sorted(r.url for r in store.load().links.collect()) == ["http://a/", "https://c/"]
    with pytest.raises(ValueError):
        open_store(spark, "ftp://x")


def test_rank_pass_and_supervision(spark, tmp_path):
    links = spark.createDataFrame([("u1", "http://1", None), ("u2", "http://2", None)], schemas.LINKS)
    edges = spark.createDataFrame([("e1", "u1", "u2", None), ("e2", "u2", "u1", None), ("e3", "u1", "gone", None)], schemas.EDGES)
    done = services.rank_pass(State(links, edges, spark.createDataFrame([], schemas.DOCUMENTS)), datetime(2024, 1, 1))
    assert {r.link_id: round(r.page_rank, 6) for r in done.docs.collect()} == {"u1": 0.5, "u2": 0.5}

    def broken(batch, batch_id):
        raise RuntimeError("boom")

    stream = spark.readStream.format("rate").load()
    bad = stream.writeStream.foreachBatch(broken).option("checkpointLocation", f"{tmp_path}/c1").start()
    good = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c2").start()
    with pytest.raises(services.ServiceError):
        services.supervise([bad, good], 60)
    assert not good.isActive


def test_trim_takes_unicode_blanks(spark):
    page = "<html><title>&nbsp; T t&nbsp;</title><body>\u2003a&nbsp;b\u00a0 </body></html>"
    row = spark.createDataFrame([(page,)], "h string").select(html.title(F.col("h")).alias("t"), html.text(F.col("h")).alias("x")).first()
    assert row.t == "T t" and row.x == "a\u00a0b"


def test_fetch_live_asks_for_allowed_pages_only(spark):
    names = ["http://ok.test/a", "http://10.0.0.1/a", "ftp://ok.test/a", "http://inside.test/a", "http://ok.test/i.png", "http://unknown.test/"]
    links = spark.createDataFrame([(u,) for u in names], "url string")
    known = spark.createDataFrame([("ok.test", "8.8.8.8"), ("inside.test", "192.168.1.1")], "host string, ip string")
    got = crawl.fetch_live(links, lambda u: (200, "text/html", u), known)
    assert [r.url for r in got.collect()] == ["http://ok.test/a"]
    assert sorted(r.url for r in crawl.fetch_live(links, lambda u: (200, "text/html", u)).collect()) == ["http://inside.test/a", "http://ok.test/a", "http://unknown.test/"]


def test_run_query(spark):
    rows = [(f"{i:02d}", f"http://t.test/{i}", "" if i % 2 else f"Title {i}", f"First words. The red fox & the hare {i}. Last words.", i / 100, None) for i in range(25)]
    docs = spark.createDataFrame(rows, "link_id string, url string, title string, content string, page_rank double, indexed_at timestamp")
    index = textindex.build(docs)
    page, shown = frontend.run_query(docs, '"red fox"', 10, index=index)
    got = page.collect()
    assert [r.link_id for r in got] == [f"{i:02d}" for i in range(14, 4, -1)] and (shown.start, shown.end, shown.total) == (11, 20, 25)
    assert got[0].title == "Title 14" and got[1].title == "http://t.test/13"
    assert got[0].summary == "The <em>red</em> <em>fox</em> &amp; the hare 14."
    assert frontend.run_query(docs, '"fox red"', index=index)[1].total == 0 and frontend.run_query(docs, "fox nowhere", index=index)[1].total == 25
    assert frontend.run_query(docs, "fox", 30, index=index)[0].count() == 0
    plan = index.of(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    index.release()


def test_best_fields_take_the_larger_field(spark):
    docs = spark.createDataFrame([("a", "u", "fox", "fox cat"), ("b", "u", "", "fox")], "link_id string, url string, title string, content string")
    q = textindex.Query("fox")
    both = {r.link_id: r.text_score for r in textindex.search(docs, q).collect()}
    best = {r.link_id: r.text_score for r in textindex.search(docs, q, best_fields=True).collect()}
    assert best["a"] == best["b"] == both["b"] < both["a"]


def test_comparison_but_for_case(spark):
    pairs = [("Straße", "STRAẞE", True), ("Straße", "strasse", False), ("ΛΌΓΟΣ", "λόγος", True), ("K", "k", True), ("ſ", "S", True), ("é", "e", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r.got == r.same for r in rows.select("same", (present.folded(F.col("a")) == present.folded(F.col("b"))).alias("got")).collect())
    assert rows.select(present.match_ratio(F.lit("Der ΛΌΓΟΣ  der"), ["λόγος"]).alias("r")).first().r == pytest.approx(1 / 3)


def test_item_of_a_result_page(spark):
    got = spark.range(1).select(present.item(F.lit('/a?"b"'), F.lit("<T>"), F.lit("<em>x</em>")).alias("h")).first().h
    assert got == '<li><a href="/a?&#34;b&#34;">&lt;T&gt;</a><p><em>x</em></p></li>'


def _metrics(df):
    """The nodes of a plan, executed as one query would be."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_group_within_rows(spark):
    """No exchange of words; keys that repeat are still one document's."""
    rows = [(1, "the b a B"), (2, None), (3, ""), (4, "x " * 5000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    one = textindex.postings(docs, "id", F.col("text"))
    assert "Aggregate" not in _metrics(one)
    got = {(r.id, r.term): (r.tf, r.positions) for r in one.collect()}
    assert got == {(1, "b"): (2, [0, 1]), (4, "x"): (5000, list(range(5000)))}
    few = {(r.id, r.term): r.tf for r in textindex.postings(docs, "id", F.col("text"), stop=False, places=False).collect()}
    assert few == {(1, "the"): 1, (1, "b"): 2, (1, "a"): 1, (4, "x"): 5000}
    twice = textindex.postings(docs.union(docs.where("id = 1")), "id", F.col("text"), stop=False, places=False)
    assert {(r.id, r.term): r.tf for r in twice.where("id = 1").collect()} == {(1, "the"): 2, (1, "b"): 4, (1, "a"): 2}


def test_index_is_written_without_sort_or_word_exchange(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"t{i}", "fox den fox") for i in range(20)], "link_id string, title string, content string")
    seen = []
    cut = textindex.cut
    monkeypatch.setattr(textindex, "cut", lambda df, *a: seen.append((_metrics(df), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))) or cut(df, *a))
    index = textindex.build(docs)
    plan, writers = seen[0]
    assert "Aggregate" not in plan and "Sort" not in plan and plan.count("Exchange") == 1 and int(writers) >= textindex.BUCKETS
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 0
    rows = {(r.link_id, r.field, r.term): (r.tf, r.positions, r.length) for r in index.postings.where("link_id = '7'").collect()}
    assert rows == {("7", "title", "t7"): (1, [0], 1), ("7", "content", "fox"): (2, [0, 2], 3), ("7", "content", "den"): (1, [1], 3)}
    index.release()


def test_links_visit_python_once(spark):
    """One Python node a task, whatever bases and hosts need; addresses of IPv6 stay in the JVM."""
    body = '<a href="x y">1</a>\n<a href="/z">2</a>\n<a rel=nofollow href="http://[fe80::1]/">3</a>\n<a href="http://[2001:db8::1]/q">4</a>'
    bases = {1: "", 2: '<base href="../up">', 3: '<base href="//[bé">', 4: '<base href="http://[fe80::1]/d">', 5: '<base href="">'}
    df = spark.createDataFrame([(k, "http://p.org/a/b", b + body) for k, b in bases.items()], "page_id long, url string, html string")
    found = html.extract_links(df)
    assert _metrics(found).count("ArrowEvalPython [") == 1
    got = {k: [] for k in bases}
    for r in found.orderBy("pos").collect():
        got[r.page_id].append((r.url, r.nofollow))
    last = ("http://[2001:db8::1]/q", False)
    plain = [("http://p.org/a/x%20y", False), ("http://p.org/z", False), last]
    assert got[1] == got[3] == got[5] == plain
    assert got[2] == [("http://p.org/up/x%20y", False), ("http://p.org/z", False), last]
    assert got[4] == [("http://[fe80::1]/d/x%20y", False), ("http://[fe80::1]/z", False), ("http://[fe80::1]/", True), last]


def test_private_ipv6_in_the_jvm(spark):
    yes = ["::1", "FE80::1", "febf:ffff::", "fe80::1%eth0", "fdff::", "::ffff:10.0.0.1", "::FFFF:a00:1", "0:0:0:0:0:0:0:1"]
    no = ["::", "::2", "fec0::1", "fbff::1", "::ffff:8.8.8.8", "::10.0.0.1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4"]
    none = [":", ":::", "::1\n", "::1%", "::1%a%b", "fe80::1/64", "1::2::3", "1:2:3:4:5:6:7", "1::2:3:4:5:6:7:8", "::12345", "::g", "::ffff:010.0.0.1", "::1.2.3", ":1.2.3.4", "host:80"]
    df = spark.createDataFrame([(x,) for x in [*yes, *no, *none]], "ip string").select("ip", net.is_private(F.col("ip")).alias("p"))
    assert "Python" not in _metrics(df)
    got = {r.ip: r.p for r in df.collect()}
    assert all(got[x] is True for x in yes) and all(got[x] is False for x in no) and all(got[x] is None for x in none)
    assert spark.range(1).select(net.is_private(F.lit("2001:db8:7fff::"), ["2001:db8::/33"])).first()[0]
