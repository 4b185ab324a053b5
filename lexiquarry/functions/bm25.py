"""BM25 as Column arithmetic: k1 = 1.2, b = 0.75."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    """Natural logarithm of one plus the odds against the term, half a document added to either side; df is n at most."""
    d = F.least(df, n).cast("double")
    return F.log(1 + (n - d + 0.5) / (d + 0.5))


def score(weight: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    """0 where the term doesn't occur; a corpus of empty documents counts as of average length 1."""
    mean = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    t = tf.cast("double")
    return F.when(t > 0, weight * t * (K1 + 1) / (t + K1 * (1 - B + B * length / mean))).otherwise(F.lit(0.0))
