"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Each source gets a target number of words. Its documents first get ``floor(rate)`` certain
whole copies; the rest of the target is a fixed-size sample drawn without replacement: every
document ranks by its random odds ``u/(1-u)`` divided by its inclusion odds ``p/(1-p)``, and the
sample takes ranks until the words still missing are reached. Inclusion probabilities are
``rate - floor(rate)`` times the document's relative weight, which is the whole part of the square root
of its words, or a column of the caller's. So longer documents are likelier drawn, and a document
whose probability reaches 1 is certain. Default weights are whole numbers, so their sums, and with
them the draw, do not depend on the order in which rows are added up.

No source is sorted as a whole. The rank is a number in [0, 1); words are summed by a source's
4096 rank cells, then by 4096 cells within the one cell where the target falls, and only the rows
of that last cell (a 16-millionth of the source) are ordered one by one. A source may hold any
share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, count_words, null_key

CELLS = 4096


def source_targets(by_source: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(key, source, source_size) -> the same with a double ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times
    the total; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight. The fixed point is found at once: with sources ordered by cap over weight,
    the first k are capped, k being the least for which the level of the rest is under the next
    cap. One row per source passes through one task here, never one row per document.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = by_source.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    rising = W.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    every = W.partitionBy(F.lit(0))
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    rest = rising.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    levelled = weighed.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    # the first open source's level holds for all open ones
    first = levelled.withColumn("_level", F.first("_level", ignorenulls=True).over(rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return first.withColumn("target", target).drop("_w", "_cap", "_level")


def _rank(seed: int, ident: Column, p: Column) -> Column:
    """Pareto key mapped to [0, 1): random odds over inclusion odds, q -> q / (1 + q)."""
    digits = F.substring(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(1.0 - 2.0**-53)).otherwise(F.least(odds / (1 + odds), F.lit(1.0 - 2.0**-53)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    weight_col: str | None = None,
    seed: int = 20,
    keep: tuple[str, ...] = (),
    prefix: str = "",
) -> DataFrame:
    """One row per input row: id, ``keep`` columns, and, their names behind ``prefix``,
    source, size, source_size, target, copies, cut_words, taken.

    ``copies`` are whole copies and ``cut_words`` the words of one further, cut copy: the document
    at the edge of a source's sample gives only the words still missing, so a source's taken words
    are its target rounded down (or all of ``most`` copies). ``taken = copies * size + cut_words``.

    Null or empty text: size 0, taken 0. Null sources form one source, ordered last. Repeated rows
    are drawn as rows of their own; rows equal in id and text tie in rank and are interchangeable.
    A null id is an id like any other. An empty table gives an empty result. Other columns are
    ignored. The draw depends on ids and ``seed`` alone, so reruns agree.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    given = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(None).cast("double")
    own = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), null_key(F.col(source_col)).alias("key"), count_words(F.col(text_col)).alias("size"), given.alias("given")]
    weighed = lambda frame: frame.withColumn("weight", F.coalesce("given", F.floor(F.sqrt("size")).cast("double"))).drop("given")
    sized = scratch.keep(weighed(docs.select(*own)), "sized")
    totals = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("_weighed"))
    plan = source_targets(totals, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(rate + 1e-12), F.lit(int(most))).cast("long")
    plan = scratch.keep(
        plan.withColumn("whole", whole)
        .withColumn("part", F.greatest(rate - F.col("whole"), F.lit(0.0)))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("unit", F.when(F.col("_weighed") > 0, F.col("part") * F.col("source_size") / F.col("_weighed")).otherwise(F.lit(0.0))),
        "plan",
    )

    def rank_all(frame: DataFrame) -> DataFrame:
        out = frame.join(plan.drop("source"), "key").withColumn("rank", _rank(seed, F.col("id"), F.least(F.col("unit") * F.col("weight"), F.lit(1.0))))
        return out.withColumn("c1", F.floor(F.col("rank") * CELLS).cast("int")).withColumn("c2", F.floor(F.col("rank") * (CELLS * CELLS) - F.col("c1") * F.lit(CELLS)).cast("int"))

    ranked = rank_all(sized)
    edge1 = _edge(ranked.groupBy("key", "c1").agg(F.sum("size").alias("words"), F.first("missing").alias("missing")), "c1", "missing", "e1", "left1")
    edge1 = scratch.keep(edge1, "edge1")
    inside = ranked.join(edge1, "key").where(F.col("c1") == F.col("e1"))
    edge2 = scratch.keep(_edge(inside.groupBy("key", "c2").agg(F.sum("size").alias("words"), F.first("left1").alias("left1")), "c2", "left1", "e2", "left2"), "edge2")
    kept = [f"_k{i}" for i in range(len(keep))]
    last = rank_all(weighed(docs.select(*own, *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)]))) if keep else ranked
    placed = last.join(edge1, "key", "left").join(edge2, "key", "left")
    at_edge = (F.col("c1") == F.col("e1")) & (F.col("c2") == F.col("e2"))
    before = F.when(F.col("e1").isNull(), F.lit(True)).otherwise((F.col("c1") < F.col("e1")) | ((F.col("c1") == F.col("e1")) & (F.col("c2") < F.col("e2"))))
    out = ["id", "source", "size", "source_size", "target", "whole", "extra", *kept]
    plain = placed.where(~F.coalesce(at_edge, F.lit(False))).withColumn("extra", F.when(F.coalesce(before, F.lit(False)) & (F.col("missing") > 0), F.col("size")).otherwise(F.lit(0))).select(out)
    line = W.partitionBy("key").orderBy("rank", "id", "size")
    run = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = placed.where(at_edge).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("left2") + 1e-6) - (run - F.col("size"))))).select(out)
    copies = F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), F.col("whole") + 1).otherwise(F.col("whole"))
    copies = F.least(copies, F.lit(int(most))).cast("long")
    cut = F.when((F.col("extra") < F.col("size")) & (F.col("whole") < int(most)), F.col("extra")).otherwise(F.lit(0)).cast("long")
    own_out = {"source": F.col("source"), "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "cut_words": cut, "taken": copies * F.col("size") + cut}
    return plain.unionByName(edge).select(F.col("id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], *[v.alias(prefix + n) for n, v in own_out.items()])


def _edge(cells: DataFrame, cell: str, want: str, name: str, left: str) -> DataFrame:
    """Per key, the first cell by which the running words reach ``want``, and the words wanted from that cell."""
    line = W.partitionBy("key").orderBy(cell).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = cells.withColumn("_run", F.sum("words").over(line))
    return run.where((F.col("_run") >= F.col(want)) & (F.col("_run") - F.col("words") < F.col(want))).groupBy("key").agg(
        F.min(cell).alias(name), F.min_by(F.col(want) - (F.col("_run") - F.col("words")), F.col(cell)).alias(left)
    )
