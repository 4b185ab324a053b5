"""Repeated windows against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

import corpus
import pytest
from lexiquarry.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, k):
    ws = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in ws for i in range(len(w) - k + 1))
    out = []
    for w in ws:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("k", "m", "limit"), [(35, 10, 8192), (6, 3, 2)])
def test_remove_repeats(spark, k, m, limit):
    rng = random.Random(2)
    data = [(r[0], r[1]) for r in corpus.rows()]
    data += [(500, "loop " * 200), (501, "a b c " * 60), (502, data[3][1] + "\t" + data[4][1])]
    data += [(600 + i, " ".join(rng.choice("abc") for _ in range(300))) for i in range(5)]
    docs = corpus.clashing(corpus.frame(spark, [(i, t, "en", "s", 0) for i, t in data]))
    got = substrings.remove_repeats(docs, k=k, m=m, bucket_limit=limit).collect()
    want = Counter((i, *x) for (i, _), x in zip(data, brute([t for _, t in data], k), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    for r in got:
        assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_empty(spark):
    assert substrings.remove_repeats(corpus.frame(spark).limit(0)).count() == 0
