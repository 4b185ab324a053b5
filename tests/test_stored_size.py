"""What a stored index does with all its postings grows with their number, not with a fixed number of tasks."""

from lexiquarry.operators import index as I
from lexiquarry.operators import merge
from lexiquarry.sources.store import Store

POSTS = [("a", 1, 1, [0]), ("a", 1, 1, [0]), ("b", 1, 1, [1]), ("a", 2, 1, [0])]


def posts(spark):
    return spark.createDataFrame(POSTS, "term string, doc_id long, tf int, positions array<int>")


def test_large_buckets_are_dealt_out(spark):
    made = I.stored_layout(posts(spark))._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in made


def test_stored_postings_look_for_no_shared_ids(spark):
    src = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    assert {r.term: r.positions for r in I.postings(src, "doc_id", "text", unique=True).collect()} == {"a": [0, 2], "b": [1]}


def test_merge_sorts_no_postings(spark):
    ids = spark.createDataFrame([(1, 7), (2, 8)], "old_id long, doc_id long")
    made = merge.rewrite(posts(spark).select("doc_id"), posts(spark), ids)[1]
    assert "ShuffledHashJoin" in made._jdf.queryExecution().executedPlan().toString() and {r.doc_id for r in made.collect()} == {7, 8}


def test_verify_groups_by_the_number_of_postings(spark, tmp_path):
    held = Store(spark, str(tmp_path))._by_document(posts(spark), 40_000_000)
    assert {r.doc_id: r.most for r in held.collect()} == {1: 2, 2: 1}
