"""Phrase matching on position arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _back(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - F.lit(by)) if by else positions


def phrase_tf(positions: list[Column]) -> Column:
    """How many places have term i at place + i, for all i; 0 where a term is missing."""
    hits = positions[0]
    for i, p in enumerate(positions[1:], 1):
        hits = F.array_intersect(hits, _back(p, i))
    return F.greatest(F.coalesce(F.size(hits), F.lit(0)), F.lit(0))
