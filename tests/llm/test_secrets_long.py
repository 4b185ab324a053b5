"""Long candidates and many matches: spans as by plain Python, in time that grows with the length."""

import random
import string
import time

import corpus
from lexiquarry.llm import secrets
from pyspark.sql import functions as F
from test_native import brute_base, brute_entropy

SIGNS = string.ascii_letters + string.digits


def test_long_candidates(spark):
    rng = random.Random(11)
    run = lambda n, signs=SIGNS: "".join(rng.choice(signs) for _ in range(n))
    texts = [run(5000), "x " + run(700, "ab1") + run(300) + run(700, "ab1") + " y", run(2000, SIGNS + "+/-_") + "==", run(900, "0123456789abcdef"), run(30) + " " + "secret=" + run(400)]
    texts += [" ".join(run(32, "0123456789abcdef") for _ in range(1200)), " ".join("password: " + run(8) + " " + run(40) for _ in range(300)), "secret=" + "sample" * 5 + run(900)]
    docs = corpus.frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    got = secrets.scan(docs, keep=("text",)).select("*", secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    for r in got:
        want = sorted(brute_base(r.text) + brute_entropy(r.text))
        assert [(s.start, s.kind, s.end) for s in r.spans] == want, r.doc_id
        hidden = {i for s, _, e in want for i in range(s, e)}
        assert r.clean.replace("[SECRET]", "") == "".join(c for i, c in enumerate(r.text) if i not in hidden)


def test_time_grows_with_the_length(spark):
    rng = random.Random(12)

    def seconds(n):
        docs = corpus.frame(spark, [(1, "".join(rng.choice("uvwxyz") + str(rng.randint(0, 9)) for _ in range(n // 2)), "en", "s", n)])
        began = time.perf_counter()
        assert len(secrets.scan(docs).collect()[0].spans) <= 1
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(20_000), seconds(200_000)
    assert large < 10 * small + 20


def test_words_inside_long_candidates_stay_secret_in_the_stage(spark):
    rng = random.Random(13)
    part = "".join(rng.choice(SIGNS) for _ in range(80))
    docs = corpus.frame(spark, [(1, f"a {part}dummy{part} b", "en", "s", 1), (2, "a Zx9Kq2Lm7Pv4Rsample8Yw3Bn b", "en", "s", 1)])
    got = {r.doc_id: len(r.spans) for r in secrets.scan(docs, own_class=True).collect()}
    assert got == {1: 1, 2: 0}
