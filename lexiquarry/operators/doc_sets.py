"""Boolean operators as relational ones, on sets of (doc_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect(*sets: DataFrame) -> DataFrame:
    """Documents of all sets, scores added. No set at all gives nothing."""
    if not sets:
        raise ValueError("intersect needs a set to know the session; the intersection of none is empty")
    out = sets[0]
    for s in sets[1:]:
        out = out.join(s.withColumnRenamed("score", "_s"), "doc_id").select("doc_id", (F.col("score") + F.col("_s")).alias("score"))
    return out


def union(*sets: DataFrame) -> DataFrame:
    """Documents of any set, once, scores added."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy("doc_id").agg(F.sum("score").alias("score"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left side's documents and scores without the right side's documents."""
    return left.join(right.select("doc_id"), "doc_id", "left_anti")


def phrase_join(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, tf of a phrase by joining places: term i at the first term's place + i."""
    out = tokens.where(F.col("term") == terms[0]).select("doc_id", "pos").distinct()
    for i, t in enumerate(terms[1:], 1):
        nxt = tokens.where(F.col("term") == t).select("doc_id", (F.col("pos") - i).alias("pos")).distinct()
        out = out.join(nxt, ["doc_id", "pos"], "left_semi")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tf"))
