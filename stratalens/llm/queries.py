"""The registered queries of this subpackage, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .divergence import ORACLE as _divergence_sql
from .winnow import ORACLE as _winnow_sql

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the BPE file are read as unigram scores; on sf0.001 194 of 200 documents differ from sentencepiece, 218,524 tokens against 191,304."""
    from .viterbi import count_tokens, load_unigrams

    return count_tokens(table(spark, sf_dir, "documents"), load_unigrams(vocabulary("piece_bpe_32k.model")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pairwise_quality import score_documents

    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


#: The key of the registered query; real runs pass their own secret.
DEMO_KEY = b"stratalens demonstration key"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymise_documents

    return pseudonymise_documents(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "pii_kinds")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bottomk import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import token_table

    return token_table(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merge_automaton import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_fingerprints": op5_fingerprints,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_token_files": op8_token_files,
    "op9_ngram_join": op9_ngram_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_bpe_automaton": op12_bpe_automaton,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {"op6_decontamination": _winnow_sql, "op13_source_divergence": _divergence_sql}
