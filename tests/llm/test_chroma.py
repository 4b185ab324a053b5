"""Filters against direct sums, alignment against a loop, and planted excerpts."""

import random

import corpus
import numpy as np
import pyarrow as pa
from lexiquarry.llm import chroma as C
from lexiquarry.llm import textops as X


def direct(data):
    """One recording's integers without integral images or batches."""
    rows, _ = C.chroma(data, np.array([0, len(data)]))
    out = []
    for t in range(len(rows) - C.WIDEST + 1):
        x = 0
        for i, (kind, y, h, w, step) in enumerate(C.FILTERS):
            win = rows[t : t + w, y : y + h]
            p, q, third_h, third_w = h // 2, w // 2, h // 3, w // 3
            if kind == "time":
                a, b = win[q:].sum(), win[:q].sum()
            elif kind == "pitch":
                a, b = win[:, p:].sum(), win[:, :p].sum()
            elif kind == "check":
                a, b = win[q:, :p].sum() + win[:q, p:].sum(), win[:q, :p].sum() + win[q:, p:].sum()
            elif kind == "pitch3":
                a, b = win[:, third_h : h - third_h].sum(), win[:, :third_h].sum() + win[:, h - third_h :].sum()
            else:
                a, b = win[third_w : w - third_w].sum(), win[:third_w].sum() + win[w - third_w :].sum()
            v = np.log((C.UNIT + (2.0 if kind in ("pitch3", "time3") else 1.0) * a) / (C.UNIT + b))
            x |= (0, 1, 3, 2)[int(v >= -step) + int(v >= 0) + int(v >= step)] << (2 * i)
        out.append(x)
    return out


def test_fingerprints():
    rng = random.Random(1)
    texts = [corpus.sentence(rng, "en", 300), "short", None, corpus.sentence(rng, "fr", 200), "a" * 2000, ""]
    data, offsets = X.text_bytes(pa.array(texts))
    ints, at = C.fingerprints(data, offsets)
    for i, t in enumerate(texts):
        assert ints[at[i] : at[i + 1]].tolist() == direct(np.frombuffer((t or "").encode(), np.uint8)), i


def test_align():
    rng = np.random.default_rng(2)
    q = rng.integers(0, 50, 40).astype(np.uint32)
    c = np.concatenate((rng.integers(0, 50, 13), q[5:], rng.integers(0, 50, 9))).astype(np.uint32)
    votes = {}
    for i, x in enumerate(q):
        for j, y in enumerate(c):
            if x == y:
                votes[j - i] = votes.get(j - i, 0) + 1
    offset, n, errors, overlap = C.align(q, c)
    assert n == max(votes.values()) and offset == min(o for o, v in votes.items() if v == n) == 8
    lo, hi = max(0, -offset), min(len(q), len(c) - offset)
    assert overlap == hi - lo and errors == sum(bin(int(q[i]) ^ int(c[i + offset])).count("1") for i in range(lo, hi))
    assert C.align(q, np.array([99], np.uint32)) == (0, 0, 0, 0)


def test_match_recordings(spark):
    rng = random.Random(3)
    base = corpus.sentence(rng, "en", 500)
    data = [(0, base), (1, base), (2, base[320:]), (3, base[:1500] + "X" + base[1501:]), (4, None), (5, "tiny"), (6, corpus.sentence(rng, "de", 400)), (None, base), (100, corpus.sentence(rng, "fr", 400)), (100, base[640:])]
    docs = corpus.clashing(corpus.frame(spark, [(i, t, "en", "s", 0) for i, t in data]))
    got = C.match_recordings(docs, lambda i: i % 50 == 0).collect()
    assert len(got) == len(data)
    rows = {(r.doc_id, r.n_ints): r for r in got}
    zero = next(r for r in got if r.doc_id == 0)
    assert zero.is_query and {m.class_id: m.offset for m in zero.matches} == {2: -10, 3: 0, 100: -20}
    one = next(r for r in got if r.doc_id == 1)
    assert one.class_id == 0 and one.matches is None and not one.is_query
    assert all(r.n_ints == 0 and r.class_id == r.doc_id for r in got if r.doc_id in (4, 5))
    assert next(r for r in got if r.doc_id is None).class_id is None
    assert sum(r.n_matches > 0 for r in got if r.doc_id == 100) == 1 and len(rows) == len(got)
    assert C.match_recordings(docs.limit(0), lambda i: i % 50 == 0).count() == 0
