"""A corpus pipeline: documents to token ids, in stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of documents. Documents without a determined language go;
of each group of near copies the one with the smallest doc_id stays; secrets in
texts are replaced by their kind; sources are mixed to target weights, with
whole epochs repeated as rows and the document across a cut shortened; the last
stage encodes the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.llm import jaccard_join, language_id, mixing, secret_scan, sentencepiece_codec
from tessergraph.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, ("doc_id", "lang", "source")).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs


#: Neither the battery of tests nor the search for pieces can be put in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
