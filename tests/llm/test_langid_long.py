"""Texts of several blocks: phrases of each block as by plain search, and nothing lost at the borders."""

import random

import corpus
import numpy as np
import pyarrow as pa
from lexiquarry.llm import langid
from lexiquarry.llm import textops as X
from test_langid import brute_phrases


def test_long_texts():
    rng = random.Random(14)
    model = langid.Model({"x": corpus.sentence(rng, "en", 150), "y": corpus.sentence(rng, "fr", 150)})
    raw = [np.frombuffer(t.encode(), np.uint8) for t in (corpus.sentence(random.Random(14), "en", 150),)]
    texts = [corpus.sentence(rng, "en", 900), "a" * 3000, corpus.sentence(rng, "fr", 500), "short one"]
    data, offsets = X.text_bytes(pa.array(texts))
    points, at = langid.spelled(data, offsets)
    assert at[1] - at[0] > 3 * langid.BLOCK
    got = model.phrases(model.symbol[points], at)
    own = "".join(chr(65 + s) for s in model.symbol[langid.spelled(raw[0], np.array([0, len(raw[0])]))[0]])
    for i in range(len(texts)):
        t = "".join(chr(65 + s) for s in model.symbol[points[at[i] : at[i + 1]]])
        blocks = [t[k : k + langid.BLOCK] for k in range(0, len(t), langid.BLOCK)]
        assert got[i, 0] == sum(brute_phrases(own, b) for b in blocks)
        assert 0 <= got[i, 0] - brute_phrases(own, t) <= len(blocks) - 1
