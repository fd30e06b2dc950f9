"""The pipeline's stages, each against a plain version on its own input, and the queries that have SQL."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import common, queries, toxicity


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        held[name] = (docs, out)
        if name != "tokens":
            assert out.columns == columns
        docs = out
    before, after = held["toxicity"]
    lex = toxicity.learn(toxicity.labelled(before, toxicity.training_ids(spark.read.parquet(f"{small}/labels.parquet"))))
    bad = {r.doc_id for r in toxicity.score(before, lex).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad

    before, after = held["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after.collect()) == sorted({find(i) for i in sets})

    before, after = held["personal_data"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text) and "@" not in r.text.replace(texts[r.doc_id], "") and (r.text == texts[r.doc_id] or "[" in r.text)

    before, after = held["mixing"]
    assert after.join(before, "doc_id", "left_anti").count() == 0 and after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3

    before, after = held["tokens"]
    assert after.where("decoded_sha256 IS NULL").count() == 0 and after.count() == before.count()
    same = after.join(before.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).distinct(), "doc_id").where("h <> decoded_sha256")
    assert same.count() == 0


def test_run_gives_what_the_stages_give(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    want = sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, small).collect()) == want


def test_mixing_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    a, b = queries.op1_mixing(spark, small).toPandas(), con.sql(queries.oracle_sql()["op1_mixing"]).df()
    cols = sorted(a.columns)
    pd.testing.assert_frame_equal(*(d[cols].sort_values(cols).reset_index(drop=True) for d in (a, b)), check_dtype=False)


def test_queries_keep_their_contracts(spark, small):
    want = {
        "op2_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op3_maxent": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op4_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op5_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op6_jaccard": {"doc_id", "n_shingles", "component_id"},
        "op7_suffix": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op8_neighbours": {"query_id", "rank", "vec_id", "score"},
        "op9_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    }
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name, columns in want.items():
        df = queries.queries()[name](spark, small)
        assert columns <= set(df.columns)
        if name != "op8_neighbours":
            assert df.count() == n


def test_workers_give_back_what_a_task_freed():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    held = []

    def run(batches):
        blocks = [np.ones(8192) for _ in range(4096)]  # 268 MB, in pieces that the C library does not map one by one
        held.append([np.ones(8192) for _ in range(64)])  # lies above them and keeps them from going by themselves
        yield len(blocks)

    before = resident()
    assert list(common.trimmed(run)(iter([]))) == [4096]
    assert resident() - before < 100


def test_every_stage_trims_its_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two three four five six seven " * (i % 3), "en", "web", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars int")
    seen, kind = [], type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, **b: seen.append(run) or plain(self, run, *a, **b))
    corpus_pipeline.drop_near_duplicates(spark, docs, "")
    corpus_pipeline.mask_personal_data(spark, docs, "")
    corpus_pipeline.tokenize(spark, docs, "")
    toxicity.reject(docs, toxicity.Lexicon({}))
    assert len(seen) > 10 and all(hasattr(run, "__wrapped__") for run in seen)
