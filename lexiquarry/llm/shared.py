"""Small helpers shared by the corpus operators.

* ``read_table`` opens one table below a data folder through Spark's reader.
* ``Scratch`` (see ``lexiquarry/scratch.py``) writes an intermediate table and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir  # noqa: F401  for the operators

#: The white space of the word contracts: space and the controls 9 to 13.
WHITE = "\\x20\\x09-\\x0D"
WORD_REGEX = f"[^{WHITE}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: Column) -> Column:
    """Array of words; null text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_REGEX), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_REGEX)).cast("long")


def fresh_name(stem: str, taken) -> str:
    """``stem``, or ``stem`` with underscores until no column of ``taken`` has that name in any case."""
    low = {c.lower() for c in taken}
    while stem.lower() in low:
        stem += "_"
    return stem


def fresh_prefix(taken) -> str:
    """Underscores until no column of ``taken`` begins with them."""
    prefix = "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def null_key(column: Column) -> Column:
    """A non-null string that is equal exactly for equal values, null included."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def until_stable(step: Callable[[int], bool], most: int = 64) -> None:
    """Runs ``step(round)`` until it returns False; a run of over ``most`` rounds is an error."""
    for i in range(most):
        if not step(i):
            return
    raise RuntimeError(f"no fixed point after {most} rounds")
