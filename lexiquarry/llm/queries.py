"""The queries of the corpus operators, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, langid, neardup, quality_model, sentencepiece_sa, substrings, token_counts
from .mixing import mix
from .oracles import ORACLES
from .quality_rules import apply_rules
from .secrets import joined, scan
from .shared import read_table


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "cut_words")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("rule")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read_table(spark, sf_dir, "documents")).drop("text_hash", "n_links")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 3, 1)
    found = langid.identify(docs, langid.learn(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, calibrate = langid.held_out("doc_id", 5, 0), langid.held_out("doc_id", 5, 1)
    found = quality_model.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held & ~calibrate, calibrate)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every block of 1,000 characters; one that crosses a border counts where it begins."""
    docs = read_table(spark, sf_dir, "documents")
    found = token_counts.attribute(docs, token_counts.blocks(F.col("text"), 1000))
    return found.select("doc_id", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing", "doc_tokens")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sa.encode(read_table(spark, sf_dir, "documents"))


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no sound: a document's UTF-8 bytes are its samples. Ids divisible by 50 are searched against all."""
    return chroma.match_recordings(read_table(spark, sf_dir, "documents"), lambda i: i % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_mix_sources": op2_mix_sources,
    "op5_quality_rules": op5_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op7_language_id": op7_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op1_token_counts": op1_token_counts,
    "op6_sentencepiece": op6_sentencepiece,
    "op3_chroma_fingerprints": op3_chroma_fingerprints,
}

__all__ = ["ORACLES", "QUERIES"]
