"""The near-duplicate stage against all pairs at 80 per cent, with pairs between 80 and 85."""

import random
from collections import Counter

import corpus
import corpus_pipeline as P
from test_neardup import brute, shingles


def test_links_from_80_percent(spark):
    rng = random.Random(8)
    data = []
    for g in range(12):
        w = corpus.sentence(rng, "en", 150).split()
        for i in range(3):  # two edits apart from the first: about 0.87; three: about 0.81; four: about 0.76
            v = list(w)
            for at in ((), (30, 60, 90), (30, 60, 90, 120) if g % 2 else (20, 100))[i]:
                v[at] = f"edit{g}x{i}x{at}"
            data.append((10 * g + i, " ".join(v)))
    sets = [shingles(t) for _, t in data]
    jaccard = [len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k]]
    assert sum(0.80 <= j < 0.85 for j in jaccard) >= 10 and sum(j >= 0.85 for j in jaccard) >= 5
    want = brute(data, 80)
    assert len(set(want.values())) < len(set(brute(data, 85).values()))
    docs = corpus.frame(spark, [(i, t, "en", "s", len(t)) for i, t in data])
    got = Counter(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter(i for i, t in data if want[frozenset(shingles(t))] == i)
