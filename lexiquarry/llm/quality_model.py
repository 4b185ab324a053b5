"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Each whole text gives 20 statistics (shares of letter classes, word and line shape, repetition).
Random cosine features of the standardised statistics approximate a Gaussian kernel; a ridge
regression on them has normal equations that are sums over documents, so every partition returns one
matrix and the cluster adds them up. One part of the labelled rows is kept from the ridge: its raw
scores, in 512 bins, fit a non-decreasing curve from score to probability by pooling adjacent
violators. Text alone is the input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .shared import Scratch

WIDE, RIDGE, SCALE, BINS = 256, 1e-3, 0.35, 512
#: byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 newline, 6 symbols, 7 ! and ?, 8 other ASCII marks, 9 lead bytes, 10 continuation bytes
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = 4
_CLASS[10] = 5
for _c in b"#*$%&|<>":
    _CLASS[_c] = 6
for _c in b"!?":
    _CLASS[_c] = 7
for _c in range(33, 127):
    if _CLASS[_c] == 0:
        _CLASS[_c] = 8
_CLASS[0xC0:] = 9
_CLASS[0x80:0xC0] = 10
N_CLASSES = 11
FEATURES = 20


def _distinct(values: np.ndarray, at: np.ndarray, drop: int = 0) -> np.ndarray:
    """Distinct values of each document's slice, ``drop`` values left out at its end."""
    out = np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - drop > a:
            s = np.sort(values[a : b - drop])
            out[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 20) finite statistics of whole texts; an empty text gives zeros."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _CLASS[data]
    if len(data) > 1:  # capitals of the Latin-1 block
        high = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        kinds = kinds.copy()
        kinds[:-1][high] = 2
    count = np.bincount(owner * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    chars = count.sum(1) - count[:, 10]
    starts, ends, at = X.words(data, offsets)
    words = np.diff(at).astype(float)
    size = (ends - starts).astype(float)
    total, squares = (np.concatenate(([0.0], np.cumsum(v)))[at] for v in (size, size * size))
    mean = np.diff(total) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.diff(squares) / np.maximum(words, 1) - mean**2, 0))
    longest = np.zeros(n)
    full = words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(size, at[:-1][full])
    hashes = X.word_hashes(data, starts, ends, lower=True)
    kinds_of = [_distinct(hashes, at)]
    for k in (2, 4, 8):
        grams = X.window_hashes(hashes, k)
        kinds_of.append(_distinct(grams, np.minimum(at, len(grams) + k - 1), k - 1))
    body = (data != 10) & (np.ones(len(data), bool))
    first, last = body.copy(), body.copy()
    first[1:] &= ~body[:-1]
    last[:-1] &= ~body[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = body[cuts], body[cuts - 1]
    ls, le = np.flatnonzero(first), np.flatnonzero(last) + 1
    lat = np.searchsorted(ls, offsets)
    lines = np.diff(lat).astype(float)
    line_kinds = _distinct(X.word_hashes(data, ls, le), lat)
    c, w = np.maximum(chars, 1), np.maximum(words, 1)
    letters = np.maximum(count[:, 1] + count[:, 2] + count[:, 9], 1)
    return np.column_stack(
        [
            np.log1p(words),
            mean,
            spread,
            np.log1p(longest),
            count[:, 2] / letters,
            count[:, 3] / c,
            count[:, 4] / c,
            count[:, 5] / c * 10,
            np.minimum(count[:, 6] / w, 4),
            np.minimum(count[:, 7] / w, 4),
            np.minimum(count[:, 8] / w, 4),
            count[:, 9] / c,
            kinds_of[0] / w,
            kinds_of[1] / np.maximum(words - 1, 1),
            kinds_of[2] / np.maximum(words - 3, 1),
            kinds_of[3] / np.maximum(words - 7, 1),
            np.log1p(lines),
            line_kinds / np.maximum(lines, 1),
            np.log1p(chars / np.maximum(lines, 1)),
            count[:, 0] / c,
        ]
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.text_bytes(batch.column(1))
        for a, b in X.pieces(offsets, 2 << 20):
            x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["_row", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def features(x: np.ndarray, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Cosine features of the standardised statistics, held within 4 spreads, and a constant."""
    rng = np.random.default_rng(4)
    weights, phase = rng.normal(0, SCALE, (FEATURES, WIDE)), rng.uniform(0, 2 * np.pi, WIDE)
    z = np.clip((x - center) / spread, -4, 4)
    return np.column_stack([np.sqrt(2 / WIDE) * np.cos(z @ weights + phase), np.ones(len(x))])


_UPPER = np.triu_indices(WIDE + 1)


def _equations(center: np.ndarray, spread: np.ndarray):
    """One set of normal equations for each partition, as (i, v): the upper triangle, then the right side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, any_ = np.zeros((WIDE + 1, WIDE + 1)), np.zeros(WIDE + 1), False
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                f = features(_matrix(part.column(0)), center, spread)
                a += f.T @ f
                b += f.T @ part.column(1).to_numpy().astype(float)
                any_ = True
        if any_:
            values = np.concatenate([a[_UPPER], b])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "v"])

    return run


def _raw(center: np.ndarray, spread: np.ndarray, beta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for i in range(0, batch.num_rows, 4096):
                parts.append(features(_matrix(batch.slice(i, 4096).column(1)), center, spread) @ beta)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["_row", "raw"])

    return run


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pools adjacent violators: the non-decreasing means of bins with label sums y and counts n."""
    blocks: list[list[float]] = []
    for s, c in zip(y, n, strict=True):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, c1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + c1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), (s + 0.5) / (c + 1.0) if c else 0.5) for s, c, k in blocks]) if blocks else np.zeros(0)


def _bin(raw: Column) -> Column:
    """Raw scores from -0.5 to 1.5 in 512 bins."""
    return F.least(F.greatest(F.floor((raw + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).cast("int")


def score_quality(
    docs: DataFrame, labels: DataFrame, learn_from: Column, calibrate_on: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: id, ``keep`` columns, score (0 to 1).

    ``learn_from`` and ``calibrate_on`` are conditions on ``id_col``: labelled rows of the first fit the
    ridge, those of the second the calibration (where there are none, the raw score is cut to 0..1).
    An id labelled twice counts as the lesser label; null labels and ids teach nothing. Without any
    label every score is 0.5. Null text counts as empty. Repeated rows stay; empty tables give empty
    results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    packed = docs.select(F.struct(F.col(id_col), *keep).alias("_row"), F.col(text_col).alias("_text"))
    row_type = packed.schema["_row"].dataType.simpleString()
    measured = scratch.keep(packed.mapInArrow(_measure, f"_row {row_type}, x array<double>"), "measured")
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("y"))
    taught = measured.select(F.col(f"_row.{id_col}").alias(id_col), "x").join(known.withColumnRenamed("id", id_col), id_col)
    taught = scratch.keep(taught.select("x", "y", learn_from.alias("fit"), calibrate_on.alias("cal")).where("fit or cal"), "taught")
    fit = taught.where("fit")
    moments = [f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(FEATURES) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    shape = fit.agg(F.count(F.lit(1)).alias("n"), *moments).first()
    if not shape.n:
        return measured.select("_row.*", F.lit(0.5).alias("score"))
    center = np.array([shape[f"m{i}"] for i in range(FEATURES)])
    spread = np.maximum(np.array([shape[f"s{i}"] for i in range(FEATURES)]), 1e-3)
    sums = fit.select("x", "y").mapInArrow(_equations(center, spread), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # 33,410 numbers at any size
    values = np.zeros(len(_UPPER[0]) + WIDE + 1)
    for r in sums:
        values[r.i] = r.v
    a = np.zeros((WIDE + 1, WIDE + 1))
    a[_UPPER] = values[: len(_UPPER[0])]
    a = a + np.triu(a, 1).T
    beta = np.linalg.solve(a + RIDGE * shape.n * np.diag(np.append(np.ones(WIDE) / WIDE, 1e-6)), values[len(_UPPER[0]) :])
    raw = _raw(center, spread, beta)
    tried = taught.where("cal").select(F.struct(F.col("y")).alias("_row"), "x").mapInArrow(raw, "_row struct<y:int>, raw double")
    bins = tried.groupBy(_bin(F.col("raw")).alias("bin")).agg(F.sum("_row.y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # at most 512 rows
    scored = measured.select("_row", "x").mapInArrow(raw, f"_row {row_type}, raw double")
    if not bins:
        return scored.select("_row.*", F.least(F.greatest("raw", F.lit(0.0)), F.lit(1.0)).alias("score"))
    curve = isotonic(np.array([r.y for r in bins], float), np.array([r.n for r in bins], float))
    whole = np.interp(np.arange(BINS), [r.bin for r in bins], curve)
    return scored.select("_row.*", F.element_at(F.array(*[F.lit(float(v)) for v in whole]), _bin(F.col("raw")) + 1).alias("score"))
