"""The search for recordings against alignment of all pairs, on copies that are unaligned or noisy."""

import random

import corpus
import numpy as np
import pyarrow as pa
from lexiquarry.llm import chroma as C
from lexiquarry.llm import textops as X


def test_search_misses_nothing_that_alignment_accepts(spark):
    rng = random.Random(9)
    texts = {0: corpus.sentence(rng, "en", 600), 50: corpus.sentence(rng, "de", 500), 100: "la " * 700, 7: "la " * 500, 9: corpus.sentence(rng, "fr", 500)}
    for k, q in enumerate((0, 50)):
        for j, n in enumerate((5, 16, 40, 333)):  # starts that are no multiple of the hop
            texts[10 * k + j + 201] = texts[q][n:]
        noisy = list(texts[q])
        for i in rng.sample(range(len(noisy)), len(noisy) // 60):
            noisy[i] = rng.choice("aeiou")
        texts[10 * k + 301] = "".join(noisy)
    names = sorted(texts)
    data, offsets = X.text_bytes(pa.array([texts[i] for i in names]))
    ints, at = C.fingerprints(data, offsets)
    own = {i: ints[at[k] : at[k + 1]] for k, i in enumerate(names)}
    want = set()
    for q in (0, 50, 100):
        for c in names:
            offset, votes, errors, n = C.align(own[q], own[c])
            if not np.array_equal(own[q], own[c]) and n >= max(C.LEAST_INTS, min(len(own[q]), len(own[c])) / 2) and errors <= C.MOST_ERRORS * 32 * n:
                want.add((q, c, offset, votes, errors, n))
    assert {(0, 201), (0, 202), (50, 211), (50, 212)} <= {w[:2] for w in want}
    docs = corpus.frame(spark, [(i, t, "en", "s", len(t)) for i, t in texts.items()])
    got = C.match_recordings(docs, lambda i: i.isin(0, 50, 100)).where("is_query").collect()
    assert {(r.doc_id, *m) for r in got for m in r.matches} == want
