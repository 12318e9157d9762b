"""A corpus from documents to packed sequences: quality rules, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents, whatever
other columns docs have. In every stage an empty table gives an empty result, repeated rows are treated alike, a null
doc_id, lang, source or n_chars is kept, and texts are worked on whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetframe.llm.common import shared_folder, table
from facetframe.llm.decontaminate import decontaminate
from facetframe.llm.near_dedup import keep_one
from facetframe.llm.packing import default_tokenizer, pack_documents
from facetframe.llm.pii import replace_entities, session_key
from facetframe.llm.quality_rules import quality_cascade

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts go, as they have under 20 words."""
    return quality_cascade(docs).where("rule_facts.rejected_by is null").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least doc_id, of rows that repeat id and text any one. Null texts all stay; texts without words are one class if they are equal."""
    return keep_one(docs).select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark; n_chars follows. Null and empty texts stay as they are; a text that is one passage becomes empty."""
    found = decontaminate(docs.select(*COLUMNS, F.col("text").alias("whole")), table(spark, sf_dir, "benchmark"), with_clean=True, keep=("whole", "lang", "source", "n_chars"))
    return found.select("doc_id", F.coalesce("clean", "whole").alias("text"), "lang", "source", F.when(F.col("clean").isNotNull(), F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows. Null and empty texts stay as they are."""
    return replace_entities(docs.select(*COLUMNS), session_key(spark)).withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. A null or empty text is a piece of one id; repeated rows have places of their own."""
    return pack_documents(docs, default_tokenizer())


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("decontaminate", clean_of_benchmark), ("pii", without_pii), ("packing", packed)]
#: The tokenizer is not expressible in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what lies between them goes through the shared checkpoint folder."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
