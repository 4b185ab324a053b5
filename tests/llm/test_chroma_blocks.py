"""The search by blocks: bounded look at equal integers, and nothing shuffled that grows with the pairs."""

import random

import corpus
import numpy as np
import pyarrow as pa
from lexiquarry.llm import chroma as C


def block(recordings):
    at = np.concatenate(([0], np.cumsum([len(x) for x in recordings])))
    return C.Block(np.concatenate(recordings).astype(np.uint32), at)


def test_search_in_small_steps(monkeypatch):
    rng = np.random.default_rng(6)
    some = [rng.integers(0, 6, n) * 0x01234567 for n in (8, 9, 30, 31, 60, 200)] + [np.full(n, 5) for n in (8, 40, 120)]
    some += [np.concatenate((some[5][20:150], some[2])), some[4].copy(), rng.integers(0, 1 << 32, 50)]
    want = []
    for i, q in enumerate(some):
        for j, c in enumerate(some):
            offset, votes, errors, n = C.align(q.astype(np.uint32), c.astype(np.uint32))
            if votes and n >= max(C.LEAST_INTS, min(len(q), len(c)) / 2) and errors <= C.MOST_ERRORS * 32 * n and not np.array_equal(q, c):
                want.append((i, j, offset, votes, errors, n))
    assert len(want) > 20
    for most in (1 << 20, 300, 7):  # 7: single pairs have more
        monkeypatch.setattr(C, "HITS", most)
        assert sorted(map(tuple, C.search(block(some), block(some)).tolist())) == want, most


def test_blocks_hold_whole_recordings(monkeypatch):
    monkeypatch.setattr(C, "PACK", 10)
    ints = [bytes([i]) * 4 * n for i, n in enumerate((3, 7, 1, 25, 2, 10))]
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(6)]), pa.array(ints)], names=["name", "ints"])
    got = list(C._pack(iter([batch.slice(0, 4), batch.slice(4, 2)])))
    assert [x.column(0)[0].as_py() for x in got] == [b"\0\1", b"\2", b"\3", b"\4", b"\5"]
    assert b"".join(x.column(2)[0].as_py() for x in got) == b"".join(ints)
    assert [np.frombuffer(x.column(1)[0].as_py(), "<i4").tolist() for x in got] == [[3, 7], [1], [25], [2], [10]]


def shuffled(spark):
    """Bytes that all stages so far have written for exchanges."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_shuffles_what_the_input_has_not_its_pairs(spark):
    """All texts share a passage, somewhere: every pair has equal integers, hardly one aligns."""
    rng = random.Random(8)
    passage = corpus.sentence(rng, "en", 40)
    texts = [f"{corpus.sentence(rng, 'de', rng.randint(150, 250))} {passage} {corpus.sentence(rng, 'fr', rng.randint(150, 250))}" for _ in range(400)]
    docs = corpus.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = C.match_recordings(docs, lambda i: i % 4 == 0).collect()
        taken = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # once for the classes, for a quarter as queries, and ids
    assert taken < 2 * sum(4 * r.n_ints for r in got) + 80 * sum(r.n_matches for r in got)
