"""Scripts of thousands of letters: every letter counts, and letters of no sample match nothing."""

import random

import numpy as np
import pyarrow as pa
from lexiquarry.llm import langid
from lexiquarry.llm import textops as X
from test_langid import brute_phrases


def written(rng, first, n, size=2500):
    return "".join(chr(first + int(size * rng.random() ** 2)) for _ in range(n))


def test_large_scripts():
    rng = random.Random(4)
    samples = {"ko": written(rng, 0xAC00, 6000), "zh": written(rng, 0x4E00, 6000), "en": "hello world this is some text " * 60}
    model = langid.Model(samples)
    texts = [samples["ko"][100:160], samples["zh"][50:90] + "hello", written(rng, 0xAC00, 80), written(rng, 0x4E00, 80), written(rng, 0xA000, 60, 1000), "", "hello 文 wor"]
    data, offsets = X.text_bytes(pa.array(texts))
    points, at = langid.spelled(data, offsets)
    got = model.phrases(model.symbol[points], at)
    for j, lang in enumerate(model.langs):
        raw = np.frombuffer(samples[lang].encode(), np.uint8)
        own = "".join(map(chr, langid.spelled(raw, np.array([0, len(raw)]))[0]))
        for i in range(len(texts)):
            assert got[i, j] == brute_phrases(own, "".join(map(chr, points[at[i] : at[i + 1]]))), (lang, i)
    assert got[4].tolist() == [60, 60, 60]  # of an unlearned script, each letter is a phrase
