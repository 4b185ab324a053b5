"""Exact substring dedup over words by super-k-mer partitioning.

A window is 35 consecutive words; its minimiser is the least hash among its 10-word runs, the
leftmost of equals. Consecutive windows of a text that share the minimiser's place form a
super-k-mer, which travels as one packed string to the bucket of its minimiser; there, sorting the
windows counts them exactly (by 128-bit hashes of their words).

What keeps it small:

* Equal texts are one text with a number of copies; the windows of a text with copies are all
  repeated.
* Equal windows have equal minimisers, so a minimiser met once (copies counted) belongs to windows
  met once. Minimisers are counted first (one long each, pre-aggregated); only super-k-mers with a
  repeated minimiser are packed and shuffled.
* Equal packed strings are added up before they are shuffled. A minimiser with over ``bucket_limit``
  different strings (the edge of a very common passage, with a new neighbourhood in every text) is
  not counted in one task: its windows are spread by their own hash and summed by a pre-aggregated
  grouping, which has no limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .shared import Scratch

WINDOW, RUN = 35, 10
PACK = "h long, sid binary, packed string, tid binary, start int, copies long"


def super_kmers(hashes: np.ndarray, at: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents of a batch: (document, minimiser hash, first window, number of windows) of every super-k-mer."""
    none = np.zeros(0, np.int64)
    if len(hashes) < k:
        return none, none, none, none
    value = X.window_hashes(hashes, m)
    place = np.arange(len(value), dtype=np.int64)
    width, want = 1, k - m + 1
    # leftmost least of `want` runs: overlapping powers of two
    while width * 2 <= want:
        value, place = _least(value, place, width)
        width *= 2
    if width < want:
        value, place = _least(value, place, want - width)
    sizes = np.maximum(np.diff(at) - k + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(doc))
    if not len(doc):
        return none, none, none, none
    where = place[first]
    cut = np.concatenate(([True], (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])))
    heads = np.flatnonzero(cut)
    return doc[heads], value[first[heads]].view(np.int64), first[heads], np.diff(np.concatenate((heads, [len(doc)])))


def _least(value: np.ndarray, place: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    left = value[:-by] <= value[by:]
    return np.where(left, value[:-by], value[by:]), np.where(left, place[:-by], place[by:])


def _survey(k: int, m: int):
    """(doc_id, tid, text) -> (doc_id, tid, n_words, kept_sha256 of all words, hs: minimiser of each super-k-mer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.text_bytes(batch.column(2))
            for a, b in X.pieces(offsets, 2 << 20):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, at = X.words(part, off)
                doc, value, _, _ = super_kmers(X.word_hashes(part, starts, ends), at, k, m)
                whole = part.tobytes()
                sha = [hashlib.sha256(b" ".join(whole[i:j].split())).hexdigest() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()), pa.array(value, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(at), pa.int64()), pa.array(sha), lists],
                    names=["doc_id", "tid", "n_words", "kept_sha256", "hs"],
                )

    return run


def _pack(k: int, m: int):
    """(tid, copies, picked, text) -> one row per picked super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.text_bytes(batch.column(3))
            copies = batch.column(1).to_numpy()
            picked = batch.column(2)
            pick_at = np.asarray(picked.offsets)
            pick = picked.values.to_numpy(zero_copy_only=False)
            for a, b in X.pieces(offsets, 2 << 20):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, at = X.words(part, off)
                doc, value, first, count = super_kmers(X.word_hashes(part, starts, ends), at, k, m)
                base = np.searchsorted(doc, np.arange(b - a))
                own = np.repeat(np.arange(b - a), np.diff(pick_at[a : b + 1]))
                chosen = base[own] + pick[pick_at[a] : pick_at[b]]
                whole, packed, sid = part.tobytes(), [], []
                for x in chosen.tolist():
                    s = b" ".join(whole[starts[first[x]] : ends[first[x] + count[x] + k - 2]].split())
                    packed.append(s)
                    sid.append(hashlib.blake2b(s, digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value[chosen], pa.int64()),
                        pa.array(sid, pa.binary()),
                        pa.array(packed, pa.binary()).cast(pa.string()),
                        batch.column(0).take(pa.array(a + own)),
                        pa.array((first[chosen] - at[own]).astype(np.int32)),
                        pa.array(copies[a + own].astype(np.int64)),
                    ],
                    names=["h", "sid", "packed", "tid", "start", "copies"],
                )

    return run


def _windows(packed: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in the row's string, hash, second hash) of every window of packed strings."""
    data, offsets = X.text_bytes(packed)
    starts, ends, at = X.words(data, offsets)
    one, two = (X.window_hashes(X.word_hashes(data, starts, ends, which=w), k, which=w) for w in (0, 1))
    sizes = np.diff(at) - k + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    where = at[row] + offset
    return row, offset, one[where], two[where]


def _count(k: int):
    """Rows sorted by h, (h, sid, packed, copies) -> (sid, js): the windows met twice or more. Whole buckets, about 16 MB at a time."""

    def counted(table: pa.Table) -> pa.RecordBatch:
        row, offset, one, two = _windows(table.column("packed").combine_chunks(), k)
        weight = table.column("copies").to_numpy()[row]
        order = np.lexsort((two, one))
        o, t = one[order], two[order]
        cut = np.concatenate(([True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])))
        group = np.cumsum(cut) - 1
        many = np.bincount(group, weight[order])[group] >= 2
        hit = np.sort(order[many])
        rows, first = np.unique(row[hit], return_index=True)
        js = pa.ListArray.from_arrays(pa.array(np.append(first, len(hit)), pa.int32()), pa.array(offset[hit], pa.int32()))
        return pa.RecordBatch.from_arrays([table.column("sid").combine_chunks().take(pa.array(rows)), js], names=["sid", "js"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < 16 << 20:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
            if whole:
                yield counted(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield counted(pa.Table.from_batches(held))

    return run


def _spread(k: int):
    """(sid, packed, copies) -> one row per window, by its own 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                row, offset, one, two = _windows(part.column("packed"), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        part.column("sid").take(pa.array(row)),
                        pa.array(offset.astype(np.int32)),
                        part.column("copies").take(pa.array(row)),
                    ],
                    names=["w1", "w2", "sid", "j", "copies"],
                )

    return run


def _removed(k: int):
    """(tid, text, hits) -> (tid, n_removed, kept_sha256, kept); ``hits`` are (start, js) of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, kept = [], [], []
            hits = batch.column(2)
            at = np.asarray(hits.offsets)
            starts = hits.values.field("start").to_numpy()
            js, js_at = hits.values.field("js").values.to_numpy(), np.asarray(hits.values.field("js").offsets)
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                own = text.as_py().split()
                edge = np.zeros(len(own) + 1, np.int64)
                a, b = at[i], at[i + 1]
                first = np.repeat(starts[a:b], np.diff(js_at[a : b + 1])) + js[js_at[a] : js_at[b]]
                np.add.at(edge, first, 1)
                np.add.at(edge, first + k, -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                removed.append(len(own) - len(stay))
                kept.append(b" ".join([own[x] for x in stay.tolist()]))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], names=["tid", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = RUN, bucket_limit: int = 8192) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, kept (the kept words; null: nothing was removed).

    Null text has no words. Texts under ``k`` words lose nothing. Rows are rows: a row repeated
    with its text counts as two places, whatever its id; ids may be null. Empty tables give empty
    results; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("tid"), text.alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    seen = scratch.keep(plain.mapInArrow(_survey(k, m), f"doc_id {id_type}, tid binary, n_words long, kept_sha256 string, hs array<long>"), "seen")
    texts = scratch.keep(seen.where(F.size("hs") > 0).groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.first("hs").alias("hs")), "texts")
    each = texts.select("tid", "copies", F.posexplode("hs").alias("i", "h"))
    again = each.groupBy("h").agg(F.sum("copies").alias("c")).where("c > 1").select("h")
    picked = each.join(again, "h", "left_semi").groupBy("tid").agg(F.first("copies").alias("copies"), F.sort_array(F.collect_list("i")).alias("picked"))
    picked = scratch.keep(picked, "picked")
    found = plain.select("tid", "text").join(picked, "tid").dropDuplicates(["tid"]).select("tid", "copies", "picked", "text")
    affected = scratch.keep(found, "affected")
    packed = scratch.keep(affected.mapInArrow(_pack(k, m), PACK), "packed")
    strings = scratch.keep(packed.groupBy("h", "sid").agg(F.first("packed").alias("packed"), F.sum("copies").alias("copies")), "strings")
    hot = scratch.keep(strings.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > bucket_limit).select("h"), "hot")
    usual = strings.join(hot, "h", "left_anti").select("h", "sid", "packed", "copies").repartition("h").sortWithinPartitions("h")
    js = usual.mapInArrow(_count(k), "sid binary, js array<int>")
    spread = strings.join(hot, "h", "left_semi").select("sid", "packed", "copies").mapInArrow(_spread(k), "w1 long, w2 long, sid binary, j int, copies long")
    spread = scratch.keep(spread, "spread")
    twice = spread.groupBy("w1", "w2").agg(F.sum("copies").alias("c")).where("c > 1").select("w1", "w2")
    js_hot = spread.join(twice, ["w1", "w2"], "left_semi").groupBy("sid").agg(F.collect_list("j").alias("js"))
    repeated = scratch.keep(js.unionByName(js_hot), "repeated")
    hits = packed.where("copies = 1").select("tid", "sid", "start").join(repeated, "sid").groupBy("tid").agg(F.collect_list(F.struct("start", "js")).alias("hits"))
    cleaned = affected.where("copies = 1").select("tid", "text").join(hits, "tid").mapInArrow(_removed(k), "tid binary, n_removed long, kept_sha256 string, kept string")
    nothing = F.lit("")
    copied = texts.where("copies > 1").select("tid", F.lit(None).cast("long").alias("n_removed"), F.sha2(nothing, 256).alias("kept_sha256"), nothing.alias("kept"))
    changed = scratch.keep(cleaned.unionByName(copied), "changed")
    for name in ("spread", "strings", "packed", "affected", "repeated"):
        scratch.drop(name)
    new = changed.select("tid", F.coalesce("n_removed", F.lit(-1)).alias("r"), F.col("kept_sha256").alias("sha"), "kept")
    out = seen.select("doc_id", "tid", "n_words", "kept_sha256").join(new, "tid", "left")
    gone = F.when(F.col("r").isNull(), F.lit(0)).when(F.col("r") < 0, F.col("n_words")).otherwise(F.col("r")).cast("long")
    return out.select(F.col("doc_id").alias(id_col), "n_words", gone.alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"), "kept")
