"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import langid, mixing, neardup, secrets, sentencepiece_sa
from lexiquarry.llm.shared import Scratch, fresh_prefix, read_table

#: An identification is rejected where no learned language parses the text better than this many bits a letter.
MOST_BITS = 12.0
#: Documents are near copies from this Jaccard similarity of their word shingles on.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no text, no letter, or letters of no learned language."""
    samples = langid.learn(docs, ~langid.held_out("doc_id", 3, 1))
    p = fresh_prefix(docs.columns)
    inner = [p + c for c in ("lang_pred", "score", "bits")]
    found = langid.identify(docs.select(*docs.columns), samples, keep=tuple(c for c in docs.columns if c != "doc_id"), names=tuple(inner))
    return found.where((F.col(inner[0]) != "und") & (F.col(inner[2]) <= MOST_BITS)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the least id; of repeated rows, one.

    Links at a Jaccard similarity of 0.80 or more, where op8_minhash_near_dedup links from 0.85.
    """
    p = fresh_prefix(docs.columns)
    kept = neardup.classes(docs, percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}th")).distinct()
    # of the rows of one id and text, that with the least hash of all columns stays; rows equal in all of them are interchangeable
    keyed = docs.withColumn(f"{p}h", F.xxhash64("text")).withColumn(f"{p}r", F.xxhash64(*docs.columns))
    named = keyed.where(F.col("doc_id").isNotNull())
    least = named.groupBy("doc_id", f"{p}h").agg(F.min(f"{p}r").alias(f"{p}m"))
    same = (F.col("doc_id") == F.col(f"{p}id")) & (F.col(f"{p}h") == F.col(f"{p}th"))
    chosen = least.join(kept, same, "left_semi").select(F.col("doc_id").alias(f"{p}id"), F.col(f"{p}h").alias(f"{p}th"), f"{p}m")
    named = named.join(chosen, same & (F.col(f"{p}r") == F.col(f"{p}m")), "left_semi").dropDuplicates(["doc_id", f"{p}h", f"{p}r"])
    return named.unionByName(keyed.where(F.col("doc_id").isNull())).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of a secret by a mark; documents stay, null texts stay null."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    p = fresh_prefix(docs.columns)
    found = secrets.scan(docs, keep=rest, prefix=p, own_class=True, overlapping=True)
    clean = secrets.redacted(F.col("text"), F.col(f"{p}spans"))
    return found.withColumn("text", clean).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents so that each source's words come near its target.

    The document at the edge of a source's sample, which mixing.mix cuts, is given whole or left out,
    whichever lands nearer; a source misses its target by at most half that document.
    """
    rest = tuple(c for c in docs.columns if c != "doc_id")
    p = fresh_prefix(docs.columns)
    mixed = mixing.mix(docs, keep=rest, prefix=p)
    edge = (F.col(f"{p}cut_words") > 0) & (2 * F.col(f"{p}cut_words") >= F.col(f"{p}size"))
    copies = (F.col(f"{p}copies") + edge.cast("long")).cast("int")
    return mixed.where(copies > 0).withColumn(f"{p}copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids."""
    return sentencepiece_sa.encode(docs, keep=("doc_id", "source", "lang"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_to_targets),
    ("pieces", encode_pieces),
]

#: Hashing by MinHash, the language model and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
