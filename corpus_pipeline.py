"""The corpus pipeline: quality, near duplicates, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as
Parquet and read again before the next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.packing import pack_documents
from stratalens.llm.pairwise_quality import score_documents
from stratalens.llm.parity_join import near_duplicates
from stratalens.llm.pseudonyms import free_name, pseudonymise_documents
from stratalens.llm.queries import DEMO_KEY, table, vocabulary
from stratalens.llm.runtime import Scratch
from stratalens.llm.winnow import decontaminate

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def _only(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """The rows whose doc_id is (left_semi) or is not (left_anti) among ``wanted.id``; nulls are a value."""
    own = free_name(docs, "wanted_id")
    return docs.join(wanted.select(F.col("doc_id").alias(own)).distinct(), F.col("doc_id").eqNullSafe(F.col(own)), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise classifier rejects go.

    A doc_id that stands in several rows stays, with all its rows, if one of them is accepted.
    """
    scored = score_documents(docs, table(spark, sf_dir, "labels"), cut=0.3)
    return _only(docs, scored.where("predicted = 1"), "left_semi")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the one of least doc_id stays."""
    groups = near_duplicates(docs)
    return _only(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (a whole shorter item) go."""
    return _only(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"), "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and secrets become keyed pseudonyms; n_chars follows the text."""
    kinds = free_name(docs, "pii_kinds")
    out = pseudonymise_documents(docs, DEMO_KEY)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(kinds) != "", length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("PII pseudonyms", pii),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tables = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = tables.table(stage(spark, docs, sf_dir), name.split()[0])
        if k:
            tables.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
