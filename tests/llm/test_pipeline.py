"""Every stage against plain Python on its own input, and the whole run."""

import math
from collections import Counter, defaultdict

import corpus
import corpus_pipeline as P
import sentencepiece
from lexiquarry.llm import sentencepiece_sa
from test_native import brute_base, brute_entropy, words
from test_neardup import brute, near_rows, shingles


def test_stages(spark, tmp_path):
    data = corpus.rows() + [(i, t, "en", "s1", len(t)) for i, t in near_rows() if i >= 1000]
    docs = corpus.clashing(corpus.frame(spark, data))
    columns = docs.columns
    inputs, outputs = {}, {}
    for name, stage in P.STAGES:
        inputs[name] = docs.collect()
        frame = stage(spark, docs, "")
        if name != P.STAGES[-1][0]:
            assert frame.columns == columns
        frame.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outputs[name] = docs.collect()
    key = lambda r: (r.doc_id, r.text)
    kept = Counter(map(key, outputs["language"]))
    assert kept == Counter(key(r) for r in inputs["language"] if any(c.isalpha() for c in r.text or ""))
    rows = inputs["near_duplicates"]
    cls = brute([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
    want = {key(r) for r in rows if r.doc_id is None or cls.get(frozenset(shingles(r.text)), r.doc_id) == r.doc_id}
    assert Counter(map(key, outputs["near_duplicates"])) == Counter(want)
    hidden = []
    for r in inputs["secrets"]:
        out = {i for s, _, e in brute_base(r.text) + brute_entropy(r.text) for i in range(s, e)}
        hidden.append((r.doc_id, "".join(c for i, c in enumerate(r.text) if i not in out)))
    assert Counter((r.doc_id, r.text.replace("[SECRET]", "")) for r in outputs["secrets"]) == Counter(hidden)
    assert all(r.n_chars == len(r.text) for r in outputs["secrets"])
    size, taken = defaultdict(int), defaultdict(int)
    for r in inputs["mixing"]:
        size[r.source] += len(words(r.text))
    for r in outputs["mixing"]:
        taken[r.source] += len(words(r.text))
    assert math.isclose(sum(taken.values()), 1.5 * sum(size.values()), abs_tol=len(size) + 1)
    whole = {key(r) for r in inputs["mixing"]}
    assert sum(key(r) not in whole for r in outputs["mixing"]) <= len(size)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL)
    assert Counter((r.doc_id, tuple(library.encode(r.text))) for r in inputs["pieces"]) == Counter((r.doc_id, tuple(r.ids)) for r in outputs["pieces"])


def test_empty(spark):
    docs = corpus.frame(spark).limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_repeated_rows_stay_rows(spark):
    docs = corpus.frame(spark, [(1, "one two three", "en", "a", 13)] * 3 + [(1, "other text here", "en", "a", 15), (None, "x y", "en", None, 3)])
    assert P.drop_near_duplicates(spark, docs, "").count() == 3
    assert P.hide_secrets(spark, docs, "").count() == 5
