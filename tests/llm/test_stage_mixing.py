"""The mixing stage gives whole documents only, as near the targets as one document allows."""

from collections import Counter, defaultdict

import corpus
import corpus_pipeline as P
from lexiquarry.llm import mixing
from test_native import words


def test_no_text_is_cut(spark):
    docs = corpus.frame(spark, [*corpus.rows(), (500, corpus.sentence(corpus.random.Random(4), "fr", 900), "fr", "zz", 1)])
    key = lambda r: (r.doc_id, r.text, r.source, r.n_chars)
    given, got = Counter(map(key, docs.collect())), Counter(map(key, P.mix_to_targets(spark, docs, "").collect()))
    assert all(n <= 2 * given[k] for k, n in got.items())
    target, edge, taken = {}, defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        target[r.source] = r.target
        if r.cut_words:
            edge[r.source] = r["size"]
    assert any(edge.values())
    for (_, text, source, _), n in got.items():
        taken[source] += n * len(words(text))
    for s, want in target.items():
        assert abs(taken[s] - want) <= edge[s] / 2 + 1 + 1e-6, s
