"""Near-duplicate classes against all pairs of full shingle sets."""

import random
import re

import corpus
import numpy as np
import pyarrow as pa
from lexiquarry.llm import neardup
from lexiquarry.llm import textops as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingles(t)), set()).add(i)
    sets.pop(frozenset(), None)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both = len(keys[i] & keys[j])
            if 100 * both >= percent * (len(keys[i]) + len(keys[j]) - both):
                root[find(i)] = find(j)
    name = {}
    for i, k in enumerate(keys):
        name[find(i)] = min([*sets[k], name.get(find(i), 1 << 60)])
    return {k: name[find(i)] for i, k in enumerate(keys)}


def near_rows():
    """Copies edited to similarities around the limit, chains, and one large group round a base."""
    rng = random.Random(5)
    data = [(r[0], r[1]) for r in corpus.rows() if r[0] is not None]
    n = 1000
    for _ in range(6):
        w = corpus.sentence(rng, "en", 150).split()
        for _ in range(8):
            w = list(w)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = f"edit{n}"
            data.append((n, " ".join(w)))
            n += 1
    base = corpus.sentence(rng, "de", 300).split()
    for _ in range(40):  # each near the base (which comes last), less near to one another
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"x{n}"
        data.append((n, " ".join(w)))
        n += 1
    data.append((n, " ".join(base)))
    return data


def test_words_and_hashes():
    texts = ["a b", "", None, "b\x0bC  d\n", "é 😀", " x"]
    data, offsets = X.text_bytes(pa.array(texts))
    starts, ends, at = X.words(data, offsets)
    got = [[bytes(data[s:e]).decode() for s, e in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(at[:-1], at[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    h = X.word_hashes(data, starts, ends)
    assert h[1] == h[2] and len(set(h.tolist())) == len(h) - 1
    low = X.word_hashes(data, starts, ends, lower=True)
    assert low[3] == X.word_hashes(np.frombuffer(b"c", np.uint8), np.array([0]), np.array([1]))[0]
    rng = np.random.default_rng(0)
    w = rng.integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 5, 7, 35):
        win = X.window_hashes(w, k)
        seen = {}
        for i, x in enumerate(win.tolist()):
            assert seen.setdefault(tuple(w[i : i + k].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)


def test_classes(spark):
    data = near_rows() + [(0, near_rows()[5][1])]  # one id with two texts
    docs = corpus.clashing(corpus.frame(spark, [(i, t, "en", "s", 0) for i, t in data] + [(None, data[0][1], "en", "s", 0)]))
    want = brute(data)
    got = neardup.classes(docs).collect()
    text_of = {}
    for i, t in data:
        text_of.setdefault((i, len(shingles(t))), []).append(t)
    assert len(got) == len(data) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        t = text_of[r.doc_id, r.n_shingles][0]
        expect = want.get(frozenset(shingles(t)), r.doc_id)
        assert r.component_id == expect, (r, expect)
        assert r.kept == (r.doc_id == expect)


def test_empty(spark):
    assert neardup.classes(corpus.frame(spark).limit(0)).count() == 0
    only = neardup.classes(corpus.frame(spark, [(1, None, None, None, None), (2, "a b", "x", "y", 3)])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in only} == {(1, 0, 1, True), (2, 1, 2, True)}
