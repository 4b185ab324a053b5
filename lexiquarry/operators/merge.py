"""Compaction: which segments to rewrite, and the rewrite as joins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MergePolicy:
    max_deleted: float = 0.3
    min_members: int = 4
    max_members: int = 10
    floor_bytes: int = 1 << 20
    max_bytes: int = 512 << 20


def plan_merges(segments, policy: MergePolicy = MergePolicy()) -> list[list]:
    """Groups of segments: each with too many deletions alone, then size tiers of enough members.

    Segments of over ``max_bytes`` in all, deletions included, are left alone. The tier of the others
    goes by the live share of their size.
    """
    out, tiers = [], {}
    for s in segments:
        if s.total_bytes > policy.max_bytes:
            continue
        deleted = s.num_deleted / s.num_docs if s.num_docs else 0.0
        if deleted > policy.max_deleted:
            out.append([s])
            continue
        tiers.setdefault(int(math.log2(max(s.total_bytes * (1 - deleted), policy.floor_bytes))), []).append(s)
    for _, members in sorted(tiers.items()):
        if len(members) >= policy.min_members:
            chunks = [members[i : i + policy.max_members] for i in range(0, len(members), policy.max_members)]
            out += [c for c in chunks if len(c) > 1]
    return out


def renumber(docs: DataFrame, base: int) -> DataFrame:
    """old_id, doc_id: survivors in id order from ``base`` up."""
    return docs.select(F.col("doc_id").alias("old_id"), (F.row_number().over(W.orderBy("doc_id")) - 1 + base).cast("long").alias("doc_id"))


def rewrite(docs: DataFrame, postings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and postings of the survivors under their new ids. The two narrow numbers of a document are hashed, so the many postings need no sort."""
    new_docs = docs.withColumnRenamed("doc_id", "old_id").join(ids, "old_id").drop("old_id")
    return new_docs, postings.withColumnRenamed("doc_id", "old_id").join(ids.hint("shuffle_hash"), "old_id").drop("old_id")


def carry_forward(ids: DataFrame, tombstones: DataFrame) -> DataFrame:
    """New ids of survivors that were deleted while the rewrite ran."""
    return ids.join(tombstones.select(F.col("doc_id").alias("old_id")), "old_id", "left_semi").select("doc_id")
