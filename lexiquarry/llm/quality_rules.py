"""Quality rules with risk-controlled cutoffs (DataFrame operations only).

Fixed base rules reject very short and very repetitive texts. Further rules each compare one rate
of the text with a cutoff. Cutoffs are not guessed: within every stratum the labelled good
documents that pass the base are a holdout (the rates are not fitted to labels), and a cutoff is
certified when the exact binomial test rejects "this rule wrongly rejects ``alpha / rules`` or more
of the stratum's good documents" at level ``delta / (rules * strata)`` (Bonferroni). Along one
rule's cutoffs, from lax to strict, rejection regions are nested, so they are tested in that fixed
sequence up to the first failure without further correction. With probability ``1 - delta`` no
stratum loses over ``alpha`` of its good documents. Among certified cutoffs the one with the
largest surplus of bad over good rejections is used, the laxest of equals; a stratum with too few
labels to certify anything keeps what passes the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, null_key, words_column

WINDOW = 8
BINS = 256
#: rule -> (numerator, denominator, rate of the last bin)
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.5),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 0.4),
    "capitals": ("n_capitals", "word_chars", 1.0),
    "marks": ("n_marks", "word_chars", 0.5),
    "long_words": ("word_chars", "n_words", 32.0),
}


def text_statistics(docs: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """id, stratum and the counts of every whole text; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    frame = docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"), text.alias("text")).withColumn("words", words_column(F.col("text")))
    frame = frame.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "grams",
        F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    frame = frame.withColumn("lines", lines)
    # sorted hashes, then the hashes equal to their left neighbour: only texts with repeats go on
    frame = frame.withColumn("again", F.size(F.array_distinct("grams")) < F.size("grams"))
    frame = frame.withColumn("pairs", F.when(F.col("again"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("pairs") - 1
    starts = F.array_sort(
        F.transform(
            F.filter(
                F.transform(
                    "pairs",
                    lambda p, j: F.struct(
                        p["i"].alias("i"),
                        (
                            F.when(j > 0, F.get(F.col("pairs"), j - 1)["h"] == p["h"]).otherwise(F.lit(False)) | F.when(j < last, F.get(F.col("pairs"), j + 1)["h"] == p["h"]).otherwise(F.lit(False))
                        ).alias("twice"),
                    ),
                ),
                lambda p: p["twice"],
            ),
            lambda p: p["i"],
        )
    )
    frame = frame.withColumn("starts", starts)
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("p"), (a["n"] + F.least(F.lit(WINDOW), i - a["p"])).alias("n")),
    )["n"]
    bare = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", "")
    return frame.select(
        "id",
        "stratum",
        "n_words",
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace("text", "[^!?]+", "")).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rate_bin(rule: str) -> Column:
    """The rule's rate as a bin from 0 to 255; 0 where the denominator is 0. Integer arithmetic, so every engine agrees."""
    top, below, full = RULES[rule]
    scaled = F.floor(F.col(top) * F.lit(BINS) / (F.col(below) * F.lit(full)))
    return F.when(F.col(below) > 0, F.least(scaled, F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def _lgamma(x: Column) -> Column:
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: Column, terms: int = 1000) -> Column:
    """P(X <= k) for X ~ Bin(n, p), and 1 where k >= n p (of no use as evidence).

    The terms from k downwards shrink by ever smaller ratios; after ``terms`` of them the rest is
    bounded by the geometric series of the last ratio, so the value is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(p) + (n - k) * F.log(1 - p))
    odds = (1 - p) / p
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int")),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t"), F.lit(0.0).alias("r")),
        lambda a, i: F.struct(
            (a["s"] + a["t"]).alias("s"),
            (a["t"] * (k - i) / (n - k + i + 1) * odds).alias("t"),
            ((k - i) / (n - k + i + 1) * odds).alias("r"),
        ),
    )
    rest = F.when(summed["r"] < 1, summed["t"] / (1 - summed["r"])).otherwise(F.lit(float("inf")))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * (summed["s"] + rest)))


def certified_cutoffs(scored: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, good boolean, one ``b_<rule>`` bin per rule) -> per stratum one cutoff per rule; a bin over it is rejected."""
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"b_{r}").alias("bin")) for r in RULES]))
    counts = (
        scored.select("stratum", "good", bins.alias("x"))
        .groupBy("stratum", "x.rule", "x.bin")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    per_rule = W.partitionBy("stratum", "rule")
    strict = per_rule.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    grid = (
        counts.withColumn("n", F.sum("good").over(per_rule))
        .withColumn("good_out", F.coalesce(F.sum("good").over(strict), F.lit(0)))
        .withColumn("bad_out", F.coalesce(F.sum("bad").over(strict), F.lit(0)))
        # rejecting what lies above this bin is rejecting from the next bin with rows on, and the laxest such cutoff is right under that
        .withColumn("lax", F.coalesce(F.lead("bin").over(per_rule.orderBy("bin")) - 1, F.lit(BINS - 1)))
    )
    strata = grid.select("stratum").distinct().withColumn("m", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    grid = grid.join(strata, "stratum")
    level = F.lit(alpha / len(RULES))
    tested = grid.withColumn("sure", (F.col("n") > 0) & (binomial_tail(F.col("good_out"), F.col("n"), level) <= F.lit(delta / len(RULES)) / F.col("m")))
    lax_first = per_rule.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    tested = tested.withColumn("sure", F.min(F.col("sure").cast("int")).over(lax_first) == 1)
    best = tested.where("sure").groupBy("stratum", "rule").agg(F.max_by("lax", F.struct(F.col("bad_out") - F.col("good_out"), F.col("bin"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    strata_cols: tuple[str, ...] = ("lang",),
    alpha: float = 0.05,
    delta: float = 0.05,
) -> DataFrame:
    """One row per input row: id, the counts, base_failed, kept, and the first rule that rejects (null if none).

    ``labels`` has ``id_col`` and ``quality``; rows of one id count as good if all are 1, and null
    labels or ids count for nothing. Null text: all counts 0, base_failed. Null stratum values are a
    stratum of their own. Repeated rows stay. Empty tables give empty results, and without labels
    only the base decides. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    stratum = F.concat_ws("\x1f", *[null_key(F.col(c)) for c in strata_cols]) if strata_cols else F.lit("")
    stats = scratch.keep(text_statistics(docs, id_col, text_col, stratum), "stats")
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
    scored = stats.where(~base_failed()).join(known, "id").select("stratum", (F.col("quality") == 1).alias("good"), *[rate_bin(r).alias(f"b_{r}") for r in RULES])
    cutoffs = scratch.keep(certified_cutoffs(scored, alpha, delta), "cutoffs")
    hit = F.coalesce(*[F.when(rate_bin(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES])
    joined = stats.join(cutoffs, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), hit))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule"
    )
