"""Queries over a table look at its texts once, and bring together only what is narrow."""

import pytest
from lexiquarry import queries as E
from lexiquarry.functions import text as T
from lexiquarry.operators import index as I
from lexiquarry.plans import search as Q
from pyspark.sql import functions as F

TEXTS = [(1, "from the top of the tree"), (2, "with a view from AboveHere"), (3, None), (4, "the of and_the rest with"), (5, "from with from"), (6, "")]
#: These read what one look at the texts has left behind.
ONE_LOOK = ["set_union", "set_difference", "set_intersect", "search_snippets", "search_topk", "search_phrase3", "search_missing_term", "search_phrase_not", "tombstone_search", "search_not", "search_term", "search_total", "search_nested"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("data"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ONE_LOOK)
def test_texts_are_cut_once(spark, folder, name):
    assert "regexp_extract_all" not in plan(E.QUERIES[name](spark, folder))


def test_plain_texts_have_the_same_atoms(spark):
    """Each sign of the short way by itself and beside letters, by both ways."""
    one = spark.range(1, 0x2100).select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    texts = one.select(F.explode(F.array("c", F.concat(F.lit("a"), "c"), F.concat("c", F.lit("b")), F.concat(F.lit("x"), "c", F.lit("9 __")), F.concat(F.lit("_"), "c"))).alias("t"))
    found = F.regexp_extract_all("t", F.lit(T.ATOM), F.lit(0))
    assert texts.where(T.atoms(F.col("t")) != F.filter(found, lambda a: a.rlike(T.WORDY))).count() == 0
    assert texts.where(T.splittable(F.col("t")) != F.col("t").rlike(rf"_|{T.CASE_CHANGE}")).count() == 0


def test_rows_that_share_an_id(spark):
    """As the SQL has it: each row matches with the terms of all rows of its id, and statistics count documents."""
    src = spark.createDataFrame([(1, "from a b"), (1, "the from"), (2, "the x"), (None, "from")], "doc_id long, text string")
    terms = ["from", "the"]
    rows = Q.occurrences(src, terms, set(terms))
    assert sorted(r.doc_id for r in Q.match_rows(rows, terms, "from the").collect()) == [1, 1]
    assert Q.match_rows(rows, terms, '"the from"').count() == 2


def test_postings_need_no_exchange(spark, folder):
    made = I.postings(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.doc_id): r.positions for r in made.where("doc_id in (4, 5)").collect()} == {
        ("the", 4): [0, 3 - 1], ("of", 4): [1], ("and_the", 4): [2], ("and", 4): [2], ("rest", 4): [3], ("with", 4): [4], ("from", 5): [0, 2], ("with", 5): [1],
    }


def test_postings_of_rows_that_share_an_id(spark):
    """One row a term and id, each place once, as the SQL has it; a null id is an id."""
    src = spark.createDataFrame([(1, "a b"), (1, "b b"), (2, "b"), (None, "b"), (None, "c b")], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.positions for r in I.postings(src, "doc_id", "text").collect()}
    assert got == {(1, "a"): [0], (1, "b"): [0, 1], (2, "b"): [0], (None, "b"): [0, 1], (None, "c"): [0]}
    df = {r.term: (r.df, r.total_tf) for r in I.dictionary(I.frequencies(src, "doc_id", "text")).collect()}
    assert df == {"a": (1, 1), "b": (3, 5), "c": (1, 1)}


def test_page_passes_texts_by(spark, folder):
    """No exchange below the page's own few texts."""
    frame = E.search_snippets(spark, folder)
    assert "LeftSemi" in plan(frame)
    assert [r.doc_id for r in frame.collect()] == [1]


#: These group tokens by term alone; the pairs of term and document are never held.
BY_TERM = ["term_df_topk", "term_dictionary", "index_stats"]


@pytest.mark.parametrize("name", BY_TERM)
def test_terms_are_counted_within_rows(spark, folder, name):
    made = E.QUERIES[name](spark, folder)
    assert "hashpartitioning(doc_id" not in made._jdf.queryExecution().executedPlan().toString()
