"""Attribution against whole-text encoding and a loop over tokens."""

import base64
import random

import corpus
import pytest
import tiktoken
from lexiquarry.llm import token_counts as C
from pyspark.sql import functions as F


@pytest.mark.parametrize("rule", C.RULES)
def test_attribute(spark, rule):
    rng = random.Random(6)
    odd = ["", None, "a  b\n\nc \n d", "x   y　\nz", "日本語 😀 é", "don't we'll  I'VE", " \t ", "tail \n\n", "\x1c a\x85 b", "12345 67 !!! ??"]
    odd += ["".join(rng.choice("ab '\n\t .é1") for _ in range(60)) for _ in range(80)]
    data = [(i, t) for i, t in enumerate(odd + [r[1] for r in corpus.rows()])]
    docs = corpus.clashing(corpus.frame(spark, [(i, t, "en", "s", 0) for i, t in data]))
    spans = F.concat(C.blocks(F.col("text"), 37), C.lines(F.col("text")), F.array(F.struct(F.lit("over").alias("name"), F.lit(5).alias("start"), F.lit(9999999).alias("end")), F.lit(None)))
    got = C.attribute(docs, spans, rule=rule).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(C.RANKS, "rb"))}
    encoder = tiktoken.Encoding("t", pat_str=C.SPLIT, mergeable_ranks=ranks, special_tokens={})
    borders, texts = {}, dict(data)
    for i, t in data:
        edge = [0]
        for x in encoder.encode_ordinary(t or ""):
            edge.append(edge[-1] + len(encoder.decode_single_token_bytes(x)))
        borders[i] = edge
    seen = set()
    for r in got:
        t, edge = texts[r.doc_id] or "", borders[r.doc_id]
        assert r.doc_tokens == len(edge) - 1
        lo, hi = len(t[: r.start].encode()), len(t[: r.end].encode())
        want, crossing = 0.0, 0
        for a, b in zip(edge, edge[1:]):
            crossing += hi > lo and (a < lo < b or a < hi < b)
            if rule == "share":
                want += max(0, min(b, hi) - max(a, lo)) / (b - a)
            else:
                want += lo <= (a if rule == "first" else (a + b) / 2) < hi
        assert abs(r.n_tokens - want) < 1e-6 and r.n_crossing == crossing, (r, want, crossing)
        seen.add(r.doc_id)
    assert seen == set(texts)


def test_empty(spark):
    docs = corpus.frame(spark).limit(0)
    assert C.attribute(docs, C.blocks(F.col("text"), 100)).count() == 0
