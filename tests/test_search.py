"""Matching and ranking on small corpora."""

import pytest
from lexiquarry.operators import doc_sets, snippet
from lexiquarry.operators import index as I
from lexiquarry.plans import search as Q
from pyspark.sql import functions as F

CORPUS = ["the quick brown fox", "the lazy dog", "quick quick quick brown", "fox and dog", "parse_http_response returns HttpResponse", ""]
CASES = {
    "the": [0, 1], "THE": [0, 1], "fox": [0, 3], "zebra": [], "zebra OR fox": [0, 3], "quick brown": [0, 2], "quick AND fox": [0], "fox OR dog": [0, 1, 3], "lazy OR lazy": [1],
    '"fox quick"': [], '"quick fox"': [], "http": [4], "response": [4], "HttpResponse": [4], "parse http response": [4], "quick -fox": [2], "the -dog": [0], "the -dog -fox": [], "quick -zebra": [0, 2],
    "(fox OR dog) -the": [3], 'fox -"lazy dog"': [0, 3], '"quick brown"': [0, 2], '"brown fox"': [0], '"quick quick"': [2], '"parse http"': [], '"response returns"': [4], '"returns response"': [4],
}


def corpus(spark, texts):
    src = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return I.postings(src, "doc_id", "text").cache(), I.doc_table(src, "doc_id", "text").cache()


@pytest.fixture(scope="module")
def small(spark):
    return corpus(spark, CORPUS)


def ids(found):
    return sorted(r.doc_id for r in found.collect())


def test_sets(small):
    for q, want in CASES.items():
        assert ids(Q.match_all(*small, q)) == want, q


def test_deleted_documents_count_for_nothing(spark, small):
    live = I.live(small[1], spark.createDataFrame([(0,)], "doc_id long"))
    for q, want in {"the": [1], '"quick brown"': [2], "fox OR dog": [1, 3], "quick -fox": [2]}.items():
        assert ids(Q.match_all(small[0], live, q)) == want
    assert Q.corpus_stats(live).first().n == 5


def test_scores_add_over_leaves(small):
    s = lambda q: {r.doc_id: r.score for r in Q.match_all(*small, q).collect()}
    fox, dog = s("fox"), s("dog")
    assert s("fox dog")[3] == pytest.approx(fox[3] + dog[3]) and s("fox OR dog")[3] == pytest.approx(fox[3] + dog[3])
    assert s("fox fox")[0] == pytest.approx(2 * fox[0]) and s("quick -fox")[2] == pytest.approx(s("quick")[2])


def test_ranking_and_pages(spark):
    two = corpus(spark, ["a " * i for i in range(1, 5)] + ["b"])
    found = Q.search(*two, "a")
    assert [r.doc_id for r in found.hits.collect()] == [3, 2, 1, 0]
    cut = Q.search(*two, "a", limit=2, offset=1)
    assert [r.doc_id for r in cut.hits.collect()] == [2, 1] and cut.total() == 4
    none = Q.search(*two, "a", limit=0)
    assert none.hits.count() == 0 and none.total() == 4
    ties = corpus(spark, "x y|x z|x w".split("|"))
    assert [r.doc_id for r in Q.search(*ties, "x").hits.collect()] == [0, 1, 2]
    roots = Q.search_roots({"r1": two, "r2": ties}, "a OR x")
    assert roots.total() == 7 and [r.root for r in roots.hits.collect()].count("r2") == 3


def test_relational_forms(spark, small):
    a, b = Q.match_all(*small, "fox"), Q.match_all(*small, "dog")
    assert ids(doc_sets.intersect(a, b)) == [3] and ids(doc_sets.union(a, b, a)) == [0, 1, 3] and ids(doc_sets.difference(a, b)) == [0]
    src = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    assert {r.doc_id: r.tf for r in doc_sets.phrase_join(I.tokens(src, "doc_id", "text"), ["quick", "quick"]).collect()} == {2: 2}


def test_stored_layout_prunes(spark, small, tmp_path):
    I.stored_layout(small[0], 4).write.partitionBy("bucket").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    found = I.lookup(stored, "fox", 4)
    assert ids(found) == [0, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,fox)" in plan


def test_long_terms_are_not_stored_but_counted(spark):
    posts, docs = corpus(spark, ["a " + "x" * 600])
    assert [r.term for r in posts.collect()] == ["a"] and docs.first().len == 2


LINES = "intro line\nalpha only here\nalpha and beta together\nbeta alpha again"


def test_snippets(spark):
    s = snippet.snippet(LINES, "alpha beta")
    assert (s.line_no, s.text) == (3, "alpha and beta together") and snippet.render(s) == "[alpha] and [beta] together"
    assert snippet.snippet(LINES, "alpha -beta").line_no == 2 and snippet.snippet(LINES, "zebra") is None and snippet.snippet(None, "a") is None
    crlf = snippet.snippet("été\r\n  le café noir\r\n", "café")
    assert (crlf.line_no, crlf.text, crlf.highlights) == (2, "le café noir", ((3, 7),))
    assert snippet.render(snippet.snippet("call parseHttpResponse now", "http")) == "call [parseHttpResponse] now"
    long = "x " * 100 + "needle" + " y" * 100
    cut = snippet.snippet(long, "needle", 40)
    assert cut.text.startswith("…") and cut.text.endswith("…") and len(cut.text) == 42 and cut.text[cut.highlights[0][0] : cut.highlights[0][1]] == "needle"
    assert snippet.snippet(long, "needle", 0).text == long.strip()
    src = spark.createDataFrame([(1, LINES), (2, "nothing"), (3, None)], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 0.5)], "doc_id long, score double")
    got = {r.doc_id: r for r in snippet.with_snippets(hits, src, "alpha beta").collect()}
    assert got[1].line_no == 3 and got[2].snippet is None and got[3].line_no is None
    best = {r.doc_id: (r.line_no, r["distinct"]) for r in snippet.best_lines(src, ["alpha", "beta"]).collect()}
    assert best == {1: (3, 2)}
    assert F  # the column form and the Python form choose the same line
