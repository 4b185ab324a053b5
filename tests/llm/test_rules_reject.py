"""Rules that reject: the whole operator against plain Python with exact binomial tails."""

import math
import random

import corpus
from lexiquarry.llm import quality_rules as Q
from test_native import brute_statistics

ALPHA = DELTA = 0.05


def tail(k, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))


def statistics(t):
    n, chars, symbols, dup, repeat = brute_statistics(t)
    lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in t.split("\n"))
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines, "n_capitals": sum("A" <= c <= "Z" for c in t), "n_marks": sum(c in "!?" for c in t)}


def bins(s):
    return {r: min(int(s[a] * 256 / (s[b] * full)), 255) if s[b] else 0 for r, (a, b, full) in Q.RULES.items()}


def cutoff(labelled, rule, strata):
    """The certified cutoff of most surplus, the laxest of equals; None without one."""
    seen = sorted({b[rule] for b, _ in labelled}, reverse=True)
    n, best = sum(good for _, good in labelled), None
    for i, at in enumerate(seen):
        out = [good for b, good in labelled if b[rule] > at]
        level = ALPHA / len(Q.RULES)
        if not n or sum(out) >= n * level or tail(sum(out), n, level) > DELTA / len(Q.RULES) / strata:
            break
        lax = seen[i - 1] - 1 if i else 255
        found = (len(out) - 2 * sum(out), at, lax)
        best = found if best is None or found[:2] > best[:2] else best
    return None if best is None else best[2]


def test_rules_reject(spark):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(1300):
        lang, good = ("en", "de")[i % 13 == 0], i % 7 > 0
        words = corpus.sentence(rng, "en", rng.randint(25, 40)).split()
        if not good:
            words = [w + rng.choice(["#", "$%", "|", "!!", ""]) for w in words]
        data.append((i, " ".join(words), lang, "s", 1))
        if i % 20 != 1:
            labels.append((i, int(good)))
    got = Q.apply_rules(corpus.frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    quality, stats = dict(labels), {i: statistics(t) for i, t, *_ in data}
    failed = {i: s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"] for i, s in stats.items()}
    lang = {r[0]: r[2] for r in data}
    cut = {}
    for stratum in ("en", "de"):
        labelled = [(bins(stats[i]), q == 1) for i, q in quality.items() if lang[i] == stratum and not failed[i]]
        cut[stratum] = {r: cutoff(labelled, r, 2) for r in Q.RULES}
    assert len(got) == len(data)
    for r in got:
        over = [c is not None and bins(stats[r.doc_id])[rule] > c for rule, c in cut[lang[r.doc_id]].items()]
        assert r.base_failed == failed[r.doc_id]
        assert r.kept == (not failed[r.doc_id] and not any(over)), r
    rejected = [r.doc_id for r in got if not r.kept and not r.base_failed]
    assert len(rejected) > 100 and all(lang[i] == "en" for i in rejected)  # too few of "de" to certify anything
    assert any(i not in quality for i in rejected)  # unlabelled ones too
    assert sum(quality.get(i) == 1 for i in rejected) <= ALPHA * sum(q == 1 for i, q in quality.items() if lang[i] == "en")
