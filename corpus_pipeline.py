"""A training corpus from documents, in stages that are each written as Parquet and read again.

Toxic documents go; of exact copies and of near copies one stays; sources are mixed to their target weights, which drops
or repeats documents; what is left becomes token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact, mixing, simhash, toxicity
from tidemark.llm.common import stage_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labels of documents that aren't held out, and drops what is predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.reject(docs, toxicity.learn(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: Fingerprints, grammar and tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them stands in the folder that the cluster shares."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = stage_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(place)
        docs = spark.read.parquet(place)
    return docs
