"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, maxent, mixing, mixing_sql, neighbours, pii, quality, sharding, suffix, toxicity
from .common import id_crc, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing_sql
    return mixing.chosen(table(spark, sf_dir, "documents"), p.levels(), p.weights(), share=p.SHARE, epochs=p.EPOCHS, seed=p.SEED)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 8).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", maxent.held_out())
    return maxent.score(docs, docs.where("NOT held_out"), extra=("held_out",))


def op4_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded").drop("text")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    n = [pii.counted("spans", k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *n, F.sha2(pii.joined("spans", True), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), pii.added("spans").alias("n_added"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(toxicity.labelled(docs, toxicity.training_ids(labels)))
    return toxicity.score(docs, lexicon).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "score", "predicted", "matches")


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_sharding, op3_maxent, op4_bpe, op5_quality, op6_jaccard, op7_suffix, op8_neighbours, op9_pii, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing_sql.SQL}
