"""The corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, mixing of sources, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.

Results for special cases: null, empty and very short texts go with the quality rules; very long texts are whole (the mix cuts a
document only where its source's budget ends); rows that repeat identifier and text are one document from the exact dedup on; rows
that share an identifier but not the text stay apart, but where one of them is a near copy of another document all of the
identifier go or stay; null identifiers are kept apart from all others; null sources are a source; other columns are carried up to
the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from eventloom.llm.queries import BYTE_BPE
from eventloom.llm.shared import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity of 0.8), the document with the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document may stand in it up to three times, the ones at the sources' cuts in part."""
    out = mixing.mixed_docs(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix."""
    return bpe.encode(docs, BYTE_BPE)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("ngram_jaccard", near), ("mixing", mixed), ("bpe", encoded)]
#: SQL can't express BPE, nor components over similar sets; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
