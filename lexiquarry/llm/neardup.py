"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has 24 coordinates of 32 bits (minima of 24 hash families over its distinct
5-word shingles), cut into 6 chunks of 4. By the pigeonhole principle two signatures that differ in
at most 11 coordinates have a chunk with at most one error; the allowed errors are enumerated by
leaving out each coordinate of a chunk in turn, so such a pair shares at least one of 24 keys of
three coordinates. A pair at Jaccard similarity 0.85 misses all keys with probability 2e-6.

Links are confirmed on the full shingle sets, fetched once from the texts of the documents that share a
key with another. Equal sets are one node from the start. Groups are never expanded into all pairs:

* A shingle that only one of those documents has can't be in an intersection. So the number of a
  document's other shingles, ``common``, bounds its intersections, and documents and pairs that the
  bound rules out are left out, exactly. Unrelated edits of one text are ruled out this way.
* Every member of a key's bucket is compared with the bucket's hub, the member with the greatest share
  of common shingles. Only buckets that still hold different components compare members across
  components, each pair in the first key it shares, and only pairs whose signatures agree in 11
  coordinates are confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .components import components
from .shared import Scratch

COORDINATES, CHUNK = 24, 4
LEAST_AGREE = 11
_RNG = np.random.default_rng(85)
_MULTIPLY = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
Q = [f"q{i}" for i in range(COORDINATES // 2)]  # two coordinates each
SIGNED = "doc_id long, text_hash long, n_shingles long, f0 long, f1 long, " + ", ".join(f"{q} long" for q in Q)
_LOW, _HIGH = 0xFFFFFFFF, -(1 << 32)


def signature(grams: np.ndarray) -> np.ndarray:
    """24 minima, of 32 bits each; long sets by blocks."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 8192):
        best = np.minimum(best, (grams[i : i + 8192, None] * _MULTIPLY + _ADD).min(axis=0))
    return (X.mix(best) >> np.uint64(32)).astype("<u4")


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers that are equal for equal sets."""
    return np.array([X.mix(grams).sum(dtype=np.uint64), X.mix(grams ^ X.BASES[1]).sum(dtype=np.uint64)])


def _longs(rows: list, width: int) -> list[pa.Array]:
    """Columns of 64-bit numbers from rows of ``width`` numbers; null where a row is None."""
    none = np.array([r is None for r in rows], bool)
    table = np.array([np.zeros(width, np.uint64) if r is None else r for r in rows], np.uint64).reshape(len(rows), width).view(np.int64)
    return [pa.array(np.ascontiguousarray(table[:, i]), mask=none) for i in range(width)]


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.text_bytes(batch.column(2))
            for a, b in X.pieces(offsets, 1 << 20):
                sets = X.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                prints = [fingerprint(s) if len(s) else None for s in sets]
                signs = [signature(s).view("<u8") if len(s) else None for s in sets]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *_longs(prints, 2), *_longs(signs, len(Q))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "f0", "f1", *Q])
        X.give_back()

    return run


def _with_sets(k: int):
    """(nid, f0, f1, text) -> (nid, grams): only rows whose text has the set of that fingerprint (an id may have several texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.text_bytes(batch.column(3))
            want = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in (1, 2)], axis=1)
            for a, b in X.pieces(offsets, 1 << 20):
                sets = X.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                good = [i for i, s in enumerate(sets) if len(s) and (fingerprint(s) == want[a + i]).all()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(good, pa.int64())), pa.array([sets[i].tobytes() for i in good], pa.binary())], names=["nid", "grams"])
        X.give_back()

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, grams) -> (nid, gram), one row a shingle."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1).slice(i, 256)]
            nids = np.repeat(batch.column(0).slice(i, 256).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nids), pa.array(np.concatenate(sets))], names=["nid", "gram"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column("ga"), batch.column("gb")
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")  # two sorted runs: a merge
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
        X.give_back()

    return run


def _keys() -> Column:
    """The 24 keys: per chunk, each coordinate left out in turn."""
    out = []
    for c in range(COORDINATES // CHUNK):
        left, right = F.col(Q[2 * c]), F.col(Q[2 * c + 1])
        part = lambda x, mask: x.bitwiseAND(F.lit(mask))
        for skip, pair in enumerate(((part(left, _HIGH), right), (part(left, _LOW), right), (left, part(right, _HIGH)), (left, part(right, _LOW)))):
            out.append(F.xxhash64(F.lit(c * CHUNK + skip), *pair))
    return F.array(*out)


def _equal(a: str, b: str) -> list[Column]:
    """1 or 0 for each coordinate: whether two signatures agree in it."""
    out = []
    for i in range(len(Q)):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        out += [(x.bitwiseAND(F.lit(_LOW)) == 0).cast("int"), (x.bitwiseAND(F.lit(_HIGH)) == 0).cast("int")]
    return out


def _first_key(a: str, b: str) -> Column:
    """The number of the first key that two signatures share."""
    same, out = _equal(a, b), F.lit(-1)
    for c in reversed(range(COORDINATES // CHUNK)):
        e = same[c * CHUNK : c * CHUNK + CHUNK]
        skip = (1 - e[1]) + (1 - e[2]) * 2 + (1 - e[3]) * 3  # 0 where all agree, else the one that doesn't
        out = F.when(sum(e[1:], e[0]) >= CHUNK - 1, skip + c * CHUNK).otherwise(out)
    return out


def _agree(a: str, b: str) -> Column:
    same = _equal(a, b)
    return sum(same[1:], same[0])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, n_links (confirmed links of the row's
    shingle set), text_hash (xxhash64 of its text, which with the id tells rows apart).

    Null text or no words: n_shingles 0, linked with nothing. Rows that repeat an id stay rows of
    their own; equal rows share class and ``kept``. A null id cannot be a class: such rows are linked
    with nothing, have a null component_id and are kept. Equal texts always share a class. Empty
    tables give empty results; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    signed = scratch.keep(plain.mapInArrow(_sign(k), SIGNED), "signed")
    usable = F.col("f0").isNotNull() & F.col("doc_id").isNotNull()
    least = signed.where(usable).groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(q).alias(q) for q in Q])
    nodes = scratch.keep(least.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")
    keyed = nodes.select(F.posexplode(_keys()).alias("ki", "key"), "nid")
    shared = scratch.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shared")
    buckets = scratch.keep(keyed.join(shared, "key"), "buckets")
    wanted = buckets.select("nid").distinct().join(nodes.select("nid", "rep", "f0", "f1"), "nid")
    texts = plain.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("rep")).select("nid", "f0", "f1", "text")
    sets = scratch.keep(texts.mapInArrow(_with_sets(k), "nid long, grams binary").dropDuplicates(["nid"]), "sets")
    grams = sets.select("nid", "grams").mapInArrow(_grams, "nid long, gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("nid").alias("nid"))
    single = grams.where("c = 1").groupBy("nid").agg(F.count(F.lit(1)).alias("own"))
    common = sets.select("nid").join(nodes.select("nid", "n", *Q), "nid").join(single, "nid", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    able = scratch.keep(common.where(100 * F.col("common") >= percent * F.col("n")), "able")

    def sides(pairs_of: DataFrame) -> DataFrame:
        """(a, b) with the sizes and signatures of both, as far as the bounds allow a link."""
        named = lambda side, n, s, q: able.select(F.col("nid").alias(side), F.col("n").alias(n), F.col("common").alias(s), *[F.col(x).alias(f"{q}{i}") for i, x in enumerate(Q)])
        return pairs_of.join(named("b", "m", "t", "p"), "b").join(named("a", "n", "s", "q"), "a").where(bounds & (_agree("q", "p") >= LEAST_AGREE)).select("a", "b")

    # an intersection is at most the lesser ``common``, a union at least both sizes less that
    bounds = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & ((100 + percent) * F.least("s", "t") >= percent * (F.col("n") + F.col("m")))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(sets.select(F.col("nid").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("nid").alias("a"), F.col("grams").alias("ga")), "a")
        return scratch.keep(both.mapInArrow(_confirm(percent), "a long, b long"), name)

    share = F.col("common") / F.col("n")
    live = scratch.keep(buckets.join(able.select("nid", share.alias("share")), "nid"), "live")
    hubs = scratch.keep(live.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("share", (-F.col("nid")).alias("back")))["back"].alias("back")).where("c > 1").select("key", (-F.col("back")).alias("hub")), "hubs")
    spokes = live.join(hubs, "key").where(F.col("nid") != F.col("hub")).select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b")).distinct()
    links = confirmed(sides(spokes), "links")
    labels = scratch.keep(_labels(links), "labels")
    placed = live.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("key", "ki", "nid", F.coalesce("label", "nid").alias("label"))
    mixed = scratch.keep(placed.groupBy("key").agg(F.min("label").alias("r0"), F.max("label").alias("r1")).where(F.col("r0") != F.col("r1")).select("key"), "mixed")
    members = scratch.keep(placed.join(mixed, "key").join(able, "nid").select("key", "ki", "nid", "label", "n", "common", *Q), "members")
    left = members.select("key", "ki", F.col("nid").alias("a"), F.col("label").alias("ra"), "n", F.col("common").alias("s"), *Q)
    right = members.select(F.col("key").alias("key2"), F.col("nid").alias("b"), F.col("label").alias("rb"), F.col("n").alias("m"), F.col("common").alias("t"), *[F.col(q).alias(f"p{i}") for i, q in enumerate(Q)])
    across = left.join(right, (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & bounds & (_agree("q", "p") >= LEAST_AGREE) & (F.col("ki") == _first_key("q", "p")))
    links = links.unionByName(confirmed(across.select("a", "b"), "across"))
    for name in ("sets", "members", "mixed", "hubs", "shared"):
        scratch.drop(name)
    roots = components(links, scratch, "c")
    degree = links.select(F.col("a").alias("nid")).unionByName(links.select(F.col("b").alias("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = scratch.keep(nodes.select("nid", "rep", "f0", "f1").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid")), "rooted")
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(rooted.join(names, "root").join(degree, "nid", "left").select("f0", "f1", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    shown = signed.where(usable).select("doc_id", "text_hash", "n_shingles", "f0", "f1").join(named, ["f0", "f1"]).select("doc_id", "text_hash", "n_shingles", "component_id", "n_links")
    alone = signed.where(~usable).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    every = shown.unionByName(alone)
    return every.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_links", "text_hash")


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): the least node within two links. Nodes of one label are connected; connected nodes may differ in label."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    return both.join(near, F.col("b") == F.col("node")).groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
