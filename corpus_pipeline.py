"""From raw documents to token ids in five stages, each written as Parquet and read again.

1. ``toxicity``: documents that the weighted lexicon rejects go.
2. ``near_duplicates``: one document of each component of the Jaccard join stays, that of the smallest id.
3. ``personal_data``: spans are replaced by their kinds.
4. ``mixing``: documents are taken to target weights of domain, language and source; some more than once.
5. ``tokens``: byte-level BPE ids, with digests of the ids and of the bytes that they decode to.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, jaccard, mixing, mixing_sql, pii, toxicity
from webloom.llm.common import materialize, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = toxicity.training_ids(table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, toxicity.learn(toxicity.labelled(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.dedupe(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = mixing_sql
    return mixing.mixed(docs, p.levels(), p.weights(), share=1.0, epochs=p.EPOCHS, seed=p.SEED)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, ranks: str | None = None) -> DataFrame:
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded").drop("text")
    return both.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: SQL has no match for the lexicon, the spans or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
