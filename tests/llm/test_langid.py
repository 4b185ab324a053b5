"""Cross parsing against a plain longest-match search, and held-out accuracy."""

import random

import corpus
import numpy as np
import pyarrow as pa
from lexiquarry.llm import langid
from lexiquarry.llm import textops as X
from pyspark.sql import functions as F


def brute_phrases(sample, text):
    n = i = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        i += max(k, 1)
        n += 1
    return n


def test_phrases():
    rng = random.Random(3)
    samples = {"x": corpus.sentence(rng, "en", 80), "y": corpus.sentence(rng, "fr", 60)}
    model = langid.Model(samples)
    texts = ["", "12 !", "zzz ЖЖ", corpus.sentence(rng, "en", 50), corpus.sentence(rng, "fr", 70), None, samples["x"][40:90], "Q" * 30, "ﬀ İ ǅ"]
    data, offsets = X.text_bytes(pa.array(texts))
    points, at = langid.spelled(data, offsets)
    got = model.phrases(model.symbol[points], at)
    for j, lang in enumerate(model.langs):
        raw = np.frombuffer(samples[lang].encode(), np.uint8)
        own = "".join(chr(65 + s) for s in model.symbol[langid.spelled(raw, np.array([0, len(raw)]))[0]])
        for i in range(len(texts)):
            t = "".join(chr(65 + s) for s in model.symbol[points[at[i] : at[i + 1]]])
            assert got[i, j] == brute_phrases(own, t), (lang, texts[i])


def test_identify(spark):
    docs = corpus.clashing(corpus.frame(spark, corpus.rows(n=150)))
    held = langid.held_out("doc_id", 3, 1)
    samples = langid.learn(docs, ~held)
    assert set(samples) == {"en", "de", "fr"}
    got = langid.identify(docs, samples, keep=("text", "lang")).select("*", held.alias("held")).collect()
    assert len(got) == docs.count()
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in samples and 0 <= r.score <= 1
    plain = [r for r in got if r.held and r.doc_id < 150]
    assert len(plain) > 30 and all(r.lang_pred == r.lang for r in plain)


def test_nothing_learned_and_empty(spark):
    docs = corpus.frame(spark)
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0), {"en": "abc"}).count() == 0
    assert langid.learn(docs, F.lit(False)) == {}
