"""Statistics against plain Python, the ridge against one solve, isotonic order, and held-out accuracy."""

import random

import corpus
import numpy as np
import pyarrow as pa
from lexiquarry.llm import langid
from lexiquarry.llm import quality_model as Q
from lexiquarry.llm import textops as X
from pyspark.sql import functions as F


def test_statistics():
    texts = ["", None, "One TWO three!\nOne two\nOne two\n", "a b c d e f g h a b c d e f g h", "É é 12 # |", "\n\n", "x" * 5000]
    data, offsets = X.text_bytes(pa.array(texts))
    got = Q.statistics(data, offsets)
    assert np.isfinite(got).all() and got.shape == (len(texts), Q.FEATURES)
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        assert np.isclose(got[i, 0], np.log1p(len(w)))
        if w:
            raw = [x.encode() for x in (t or "").split()]
            assert np.isclose(got[i, 1], np.mean([len(x) for x in raw]))
            assert np.isclose(got[i, 12], len(set(w)) / len(w)) or not (t or "").isascii()
            grams = {tuple(w[j : j + 8]) for j in range(len(w) - 7)}
            assert np.isclose(got[i, 15], len(grams) / max(len(w) - 7, 1))
            lines = [x for x in t.split("\n") if x]
            assert np.isclose(got[i, 17], len(set(lines)) / len(lines))


def test_isotonic():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 60).astype(float)
    y = np.array([rng.binomial(int(c), min(1, i / 60)) for i, c in enumerate(n)], float)
    fit = Q.isotonic(y, n)
    assert len(fit) == 60 and (np.diff(fit) >= -0.2).all() and ((fit > 0) & (fit < 1)).all()


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(700):
        t = corpus.sentence(rng, "en", rng.randint(30, 120))
        good = i % 3 > 0
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split()) if i % 2 else " | ".join(t.split())
        data.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good)))
    data += [(1000, None, "en", "s", None), (1001, "", None, None, 0), (None, "x y", "en", "s", 3)]
    docs = corpus.clashing(corpus.frame(spark, data))
    frame = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    held, cal = langid.held_out("doc_id", 5, 0), langid.held_out("doc_id", 5, 1)
    got = Q.score_quality(docs, frame, ~held & ~cal, cal).select("*", held.alias("held")).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    tested = [r for r in got if r.held and r.doc_id in truth]
    right = sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in tested)
    assert len(tested) > 80 and right / len(tested) > 0.97
    none = Q.score_quality(docs, frame.limit(0), ~held, cal).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.score_quality(docs.limit(0), frame, ~held, cal).count() == 0
    assert Q.score_quality(docs, frame, ~held, F.lit(False)).where("score > 1 or score < 0").count() == 0
