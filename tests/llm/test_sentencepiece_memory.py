"""Encoding a batch of words that are all new takes memory in proportion to a chunk, not to the batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from lexiquarry.llm import sentencepiece_sa as S


def test_memory_of_new_words():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aeioubcdst", k=9)) for _ in range(1000)) for _ in range(400)]  # 4 MB, as an Arrow batch has
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["_row", "_text"])
    with open(S.MODEL, "rb") as f:
        raw = f.read()
    model = S.load(raw)
    model.plain.clear()
    tracemalloc.start()
    try:
        counts = np.concatenate([x.column(1).to_numpy() for x in S._encode(raw)(iter([batch]))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(counts) == len(texts) and counts.min() > 1000
    assert peak < 150e6
