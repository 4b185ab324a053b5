"""The secret stage on random secrets behind marks, and next to base spans."""

import random
import string

import corpus
import corpus_pipeline as P

LOW = string.ascii_lowercase + string.digits
UPPER_HEX, BASE32 = "0123456789ABCDEF", string.ascii_uppercase + "234567"
MIXED = string.ascii_letters + string.digits


def hidden(spark, texts):
    docs = corpus.frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    return {r.doc_id: r.text for r in P.hide_secrets(spark, docs, "").collect()}


def test_marks_do_not_raise_the_cutoff(spark):
    rng = random.Random(6)
    shapes = [("SK_", UPPER_HEX, 32, ""), ("k_", LOW, 20, ""), ("sk_", LOW, 24, ""), ("", BASE32, 26, "=="), ("", MIXED + "+/", 20, "")]
    for head, signs, n, tail in shapes:
        made = ["".join(rng.choice(signs) for _ in range(n)) for _ in range(100)]
        out = hidden(spark, [f"use {head}{x}{tail} now" for x in made])
        assert sum("[SECRET]" in t for t in out.values()) >= 90, head or n
        if head == "SK_":
            assert sum(x[:12] in out[i] for i, x in enumerate(made)) <= 2


def test_random_head_of_a_base_span_is_hidden(spark):
    rng = random.Random(7)
    heads = ["".join(rng.choice(MIXED) for _ in range(32)) for _ in range(40)]
    tails = ["".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(40)]
    out = hidden(spark, [f"x {a}-{b} y" for a, b in zip(heads, tails, strict=True)])
    assert sum(out[i] == "x [SECRET] y" for i in range(40)) >= 36
    assert not any(b in out[i] for i, b in enumerate(tails))


def test_ordinary_candidates_stay(spark):
    texts = ["an_ordinary_name_of_words here", "verylongordinarywordwithoutdigits", "20240101-20240102-2024", "id 550e8400-e29b-41d4-a716-446655440000"]
    assert list(hidden(spark, texts).values()) == texts
