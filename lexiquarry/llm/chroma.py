"""Chroma audio fingerprints of a media column, and alignment of recordings.

Samples (8-bit unsigned PCM) are cut into overlapping frames; each frame's spectrum is folded into
12 pitch classes, smoothed over five frames and normalised. On the image of pitch classes over
frames, 16 box filters compare areas through an integral image (of integers, so that equal sounds
give equal sums wherever they stand); each difference is quantised to two Gray-coded bits, and the 16
pairs are one 32-bit integer a frame.

Two recordings align at the offset that most of their equal integers vote for; the bit errors of the
overlap at that offset tell a match from chance. Equal fingerprints are one class. Classes are packed
into blocks of about a million integers, and every block meets every block of the queries, in one
task and without an exchange: an inverted index of the queries' integers gives all equal integers,
their votes are summed by pair and offset, and the winning offset of each pair is aligned at once.
Nothing that alignment would accept is missed, and only what it accepts leaves a task, so the search
shuffles and stores nothing that grows faster than its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .shared import Scratch

RATE, FRAME, HOP = 8000, 256, 32
LOW, HIGH = 28.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
UNIT = 4096
#: (kind, first pitch, pitches, frames, outer quantiser step)
FILTERS = (
    ("time", 0, 12, 16, 0.02), ("pitch", 0, 12, 16, 0.10), ("check", 0, 12, 16, 0.04), ("pitch", 0, 6, 14, 0.15),
    ("pitch", 6, 6, 14, 0.15), ("time", 0, 4, 12, 0.08), ("time", 4, 4, 12, 0.08), ("time", 8, 4, 12, 0.08),
    ("check", 0, 6, 10, 0.08), ("check", 6, 6, 10, 0.08), ("pitch3", 0, 12, 8, 0.15), ("time3", 0, 12, 15, 0.02),
    ("pitch3", 0, 6, 9, 0.20), ("pitch3", 6, 6, 9, 0.20), ("time3", 2, 8, 9, 0.05), ("pitch", 3, 6, 6, 0.20),
)
WIDEST = max(f[3] for f in FILTERS)
MOST_ERRORS, LEAST_INTS = 0.25, 8
#: The bit map of a query block's integers has 2**24 slots.
SLOT_BITS = 24
#: Integers of a block (or one longer recording), and equal integers looked at together.
PACK, HITS = 1 << 20, 1 << 20
#: Blocks are rows of some megabytes: files are cut by their bytes at every row, not by a count of rows.
PACK_FILES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _fold() -> np.ndarray:
    """Spectrum bins to pitch classes."""
    out = np.zeros((FRAME // 2 + 1, 12), np.float32)
    for i in range(1, FRAME // 2 + 1):
        f = i * RATE / FRAME
        if LOW <= f <= HIGH:
            out[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return out


_FOLD, _WINDOW = _fold(), np.hamming(FRAME).astype(np.float32)


def chroma(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed, normalised pitch-class rows (integers of 1/4096) of all recordings, and where each one's begin."""
    size = np.diff(offsets)
    frames = np.maximum((size - FRAME) // HOP + 1, 0)
    start = np.repeat(offsets[:-1] - HOP * (np.cumsum(frames) - frames), frames) + HOP * np.arange(int(frames.sum()))
    power = np.zeros((len(start), 12), np.float64)
    for i in range(0, len(start), 8192):
        block = (data[start[i : i + 8192, None] + np.arange(FRAME)].astype(np.float32) - 128) / 128
        spectrum = np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)
        power[i : i + 8192] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _FOLD
    at = np.concatenate(([0], np.cumsum(frames)))
    rows = np.maximum(frames - len(SMOOTH) + 1, 0)
    first = np.repeat(at[:-1] - (np.cumsum(rows) - rows), rows) + np.arange(int(rows.sum()))
    smooth = sum(w * power[first + j] for j, w in enumerate(SMOOTH)) if len(first) else np.zeros((0, 12))
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    unit = np.divide(smooth, norm, out=np.zeros_like(smooth), where=norm > 1e-3)
    return np.rint(unit * UNIT).astype(np.int64), np.concatenate(([0], np.cumsum(rows)))


def _areas(image: np.ndarray, at: np.ndarray, kind: str, y: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the two areas a filter compares, for windows that begin at frames ``at``."""
    box = lambda y0, y1, x0, x1: image[at + x1, y1] - image[at + x0, y1] - image[at + x1, y0] + image[at + x0, y0]
    y1, half_h, half_w, third_h, third_w = y + h, y + h // 2, w // 2, h // 3, w // 3
    if kind == "time":
        return box(y, y1, half_w, w), box(y, y1, 0, half_w)
    if kind == "pitch":
        return box(half_h, y1, 0, w), box(y, half_h, 0, w)
    if kind == "check":
        return box(y, half_h, half_w, w) + box(half_h, y1, 0, half_w), box(y, half_h, 0, half_w) + box(half_h, y1, half_w, w)
    if kind == "pitch3":
        return box(y + third_h, y1 - third_h, 0, w), box(y, y + third_h, 0, w) + box(y1 - third_h, y1, 0, w)
    return box(y, y1, third_w, w - third_w), box(y, y1, 0, third_w) + box(y, y1, w - third_w, w)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit integers of all recordings, one after another, and where each one's begin."""
    rows, row_at = chroma(data, offsets)
    image = np.zeros((len(rows) + 1, 13), np.int64)
    image[1:, 1:] = rows.cumsum(axis=0).cumsum(axis=1)
    many = np.maximum(np.diff(row_at) - WIDEST + 1, 0)
    at = np.repeat(row_at[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    out = np.zeros(len(at), np.uint32)
    for i, (kind, y, h, w, step) in enumerate(FILTERS):
        a, b = _areas(image, at, kind, y, h, w)
        scale = 2.0 if kind in ("pitch3", "time3") else 1.0  # the middle third against two
        v = np.log((UNIT + scale * a) / (UNIT + b))
        out |= _GRAY[(v >= -step).astype(int) + (v >= 0) + (v >= step)] << np.uint32(2 * i)
    return out, np.concatenate(([0], np.cumsum(many)))


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.text_bytes(batch.column(1))
        for a, b in X.pieces(offsets, 1 << 20):
            ints, at = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw = [ints[i:j].astype("<u4").tobytes() if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(raw, pa.binary())], names=["doc_id", "ints"])


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, ints) -> (names, sizes, ints): recordings one after another in blocks of up to ``PACK`` integers; one longer is a block of its own."""
    names, ints, total = [], [], 0

    def block() -> pa.RecordBatch:
        sizes = np.array([len(x) // 4 for x in ints], "<i4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (b"".join(names), sizes, b"".join(ints))], names=["names", "sizes", "ints"])

    for batch in batches:
        for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ints and total + len(x) // 4 > PACK:
                yield block()
                names, ints, total = [], [], 0
            names.append(name)
            ints.append(x)
            total += len(x) // 4
    if ints:
        yield block()


class Block:
    """Recordings one after another: their integers, where each one's begin, and an inverted index, made when first asked for."""

    def __init__(self, ints: np.ndarray, at: np.ndarray):
        self.ints, self.at, self.bits = ints, at, None

    def __len__(self) -> int:
        return len(self.at) - 1

    def part(self, a: int, b: int) -> Block:
        return Block(self.ints[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a])

    def index(self) -> None:
        if self.bits is None:
            slots = np.zeros(1 << SLOT_BITS, bool)
            slots[_slot(self.ints)] = True
            self.bits = np.packbits(slots, bitorder="little")
            self.order = np.argsort(self.ints, kind="stable")
            self.ranked = self.ints[self.order]
            self.owner = np.repeat(np.arange(len(self)), np.diff(self.at))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``keys`` of integers that stand here, and of each where in ``order`` they begin and how many there are."""
        self.index()
        slot = _slot(keys)
        place = np.flatnonzero((self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        low = np.searchsorted(self.ranked, keys[place], "left")
        same = self.ranked[np.minimum(low, len(self.ranked) - 1)] == keys[place]
        place, low = place[same], low[same]
        return place, low, np.searchsorted(self.ranked, keys[place], "right") - low


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))


def _from_to(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``many`` numbers each."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def search(qs: Block, cs: Block) -> np.ndarray:
    """Rows (q, c, offset, votes, bit errors, overlap) of all pairs that align, by place in the blocks; equal recordings are left out.

    At most ``HITS`` equal integers are held at once; a recording with more is searched in halves of the queries, at last pair by pair.
    """
    out = [np.zeros((0, 6), np.int64)]
    if not len(qs.ints) or not len(cs.ints):
        return out[0]
    place, low, many = qs.find(cs.ints)
    hits = np.concatenate(([0], np.cumsum(many)))
    begin = np.searchsorted(place, cs.at)
    for a, b in X.pieces(hits[begin], HITS):
        i, j = begin[a], begin[b]
        if hits[j] - hits[i] <= HITS:
            if j > i:
                out.append(_matched(qs, cs, _won(qs, cs, place[i:j], low[i:j], many[i:j])))
        elif len(qs) == 1:
            offset, votes, _, _ = align(qs.ints, cs.ints[cs.at[a] : cs.at[b]])
            out.append(_matched(qs, cs, np.array([[0, a, offset, votes]], np.int64)))
        else:
            half = len(qs) // 2
            for x, y in ((0, half), (half, len(qs))):
                found = search(qs.part(x, y), cs.part(a, b))
                found[:, :2] += (x, a)
                out.append(found)
    return np.concatenate(out)


def _won(qs: Block, cs: Block, place: np.ndarray, low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows (q, c, offset, votes): of each pair with an equal integer the offset of most votes, of equally voted ones the least, as in align."""
    here = qs.order[_from_to(low, many)]
    there = np.repeat(place, many)
    q, c = qs.owner[here], np.searchsorted(cs.at, there, "right") - 1
    offset = (there - cs.at[c]) - (here - qs.at[q])
    back = int(np.diff(qs.at).max())
    span = back + int(np.diff(cs.at).max()) + 1
    code = (c * len(qs) + q) * span + (offset + back)
    code.sort()
    first = _heads(code)
    votes = np.diff(np.append(first, len(code)))
    code = code[first]
    pair = code // span
    heads = _heads(pair)
    most = np.repeat(np.maximum.reduceat(votes, heads), np.diff(np.append(heads, len(pair))))
    win = np.flatnonzero(votes == most)
    win = win[_heads(pair[win])]
    return np.stack((pair[win] % len(qs), pair[win] // len(qs), code[win] % span - back, votes[win]), axis=1)


def _matched(qs: Block, cs: Block, won: np.ndarray) -> np.ndarray:
    """Those rows whose overlap is long enough and has few bit errors, with both numbers; equal recordings are left out."""
    q, c, offset = won[:, 0], won[:, 1], won[:, 2]
    nq, nc = np.diff(qs.at)[q], np.diff(cs.at)[c]
    start = np.maximum(0, -offset)
    n = np.minimum(nq, nc - offset) - start
    fits = np.flatnonzero((n >= LEAST_INTS) & (2 * n >= np.minimum(nq, nc)))
    won, q, c, offset, nq, nc, start, n = (x[fits] for x in (won, q, c, offset, nq, nc, start, n))
    errors = np.zeros(len(n), np.int64)
    for a, b in X.pieces(np.concatenate(([0], np.cumsum(n))), HITS):
        here, there = qs.at[q[a:b]] + start[a:b], cs.at[c[a:b]] + start[a:b] + offset[a:b]
        bits = np.bitwise_count(qs.ints[_from_to(here, n[a:b])] ^ cs.ints[_from_to(there, n[a:b])]).astype(np.int64)
        errors[a:b] = np.add.reduceat(bits, np.cumsum(n[a:b]) - n[a:b])
    good = (errors <= MOST_ERRORS * 32 * n) & ~((errors == 0) & (n == nq) & (n == nc))
    return np.concatenate((won, errors[:, None], n[:, None]), axis=1)[good]


def _block(row: dict, side: str) -> Block:
    sizes = np.frombuffer(row[f"{side}_sizes"], "<i4")
    return Block(np.frombuffer(row[f"{side}_ints"], "<u4"), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block of classes and a block of queries -> the pairs of recordings that align."""
    known: dict[int, Block] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            if row["q_block"] not in known:
                if len(known) > 2:
                    known.clear()
                known[row["q_block"]] = _block(row, "q")
            found = search(known[row["q_block"]], _block(row, "c"))
            fps = [row["q_names"][16 * k : 16 * k + 16] for k in found[:, 0].tolist()]
            ids = np.frombuffer(row["c_names"], ">i8")[found[:, 1]].astype(np.int64)
            for a in range(0, len(found), 1 << 15):
                b = a + (1 << 15)
                cols = [pa.array(fps[a:b], pa.binary()), pa.array(ids[a:b]), *(pa.array(np.ascontiguousarray(found[a:b, j])) for j in range(2, 6))]
                yield pa.RecordBatch.from_arrays(cols, names=["fp", "class_id", "offset", "votes", "bit_errors", "overlap"])
    known.clear()
    X.give_back()


def _pairs(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """(fp, class_id, offset, votes, bit_errors, overlap): an asked class's fingerprint and another class that aligns with it."""
    block = lambda frame, name, side: scratch.keep(
        frame.mapInArrow(_pack, "names binary, sizes binary, ints binary").select(F.monotonically_increasing_id().alias(f"{side}_block"), *[F.col(c).alias(f"{side}_{c}") for c in ("names", "sizes", "ints")]), name, PACK_FILES
    )
    asked = classes.where("asked").select("fp", "ints")
    ints = asked.agg(F.sum(F.octet_length("ints") / 4)).first()[0] or 0
    queries = block(asked.repartition(int(ints // PACK) + 1), "queries", "q")
    # the eight bytes of a long, highest first
    blocks = block(classes.select(F.unhex(F.lpad(F.hex("class_id"), 16, "0")), "ints"), "blocks", "c").drop("c_block")
    met = blocks.crossJoin(queries).mapInArrow(_meet, "fp binary, class_id long, offset long, votes long, bit_errors long, overlap long")
    return scratch.keep(met, "found")


def align(q: np.ndarray, c: np.ndarray) -> tuple[int, int, int, int]:
    """(offset, votes, bit errors, integers that overlap): position in c minus position in q; the least of equally voted offsets."""
    order = np.argsort(c, kind="stable")
    ranked = c[order]
    lo, hi = np.searchsorted(ranked, q, "left"), np.searchsorted(ranked, q, "right")
    ends = np.concatenate(([0], np.cumsum(hi - lo)))
    if not ends[-1]:
        return 0, 0, 0, 0
    votes = np.zeros(len(q) + len(c), np.int64)
    for a, b in X.pieces(ends, HITS):
        many = (hi - lo)[a:b]
        offset = order[_from_to(lo[a:b], many)] - np.repeat(np.arange(a, b), many)
        votes += np.bincount(offset + len(q), minlength=len(votes))
    best = int(np.argmax(votes)) - len(q)
    a, b = max(0, -best), min(len(q), len(c) - best)
    return best, int(votes.max()), int(np.bitwise_count(q[a:b] ^ c[a + best : b + best]).sum()), b - a


def match_recordings(media: DataFrame, queries, id_col: str = "doc_id", media_col: str = "text") -> DataFrame:
    """One row per input row: id, n_ints, class_id (least id of rows with the same fingerprint),
    is_query, n_matches, matches (for queries: an array of other classes by id with offset, votes,
    bit_errors, overlap).

    ``media_col`` holds samples as bytes, or text whose UTF-8 bytes are taken for samples; ``queries``
    is a condition on ``id_col``. Null media, and recordings too short for one integer (under 864 samples), have no integers and match nothing; their class is their own id.
    Rows without an id have no class and match nothing. Repeated rows stay; empty tables give empty
    results.
    """
    scratch = Scratch(media.sparkSession)
    plain = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("samples"))
    printed = scratch.keep(plain.mapInArrow(_print, "doc_id long, ints binary").withColumn("fp", F.when(F.col("ints").isNotNull(), F.unhex(F.md5("ints")))), "printed")
    is_query = queries(F.col("doc_id"))
    usable = printed.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("fp").agg(F.min(F.struct("doc_id", "ints")).alias("m"), F.max(is_query.cast("int")).alias("asked"))
    classes = scratch.keep(classes.select("fp", F.col("m.doc_id").alias("class_id"), F.col("m.ints").alias("ints"), (F.col("asked") == 1).alias("asked")), "classes")
    lists = _pairs(scratch, classes).groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("class_id", "offset", "votes", "bit_errors", "overlap"))).alias("matches"))
    # written, so that the join to the rows has exchanges of its own, which can be split where many rows are copies
    named = scratch.keep(classes.select("fp", "class_id").join(lists, "fp", "left"), "named")
    n_ints = F.coalesce(F.octet_length("ints") / 4, F.lit(0)).cast("long")
    shown = printed.select("doc_id", n_ints.alias("n_ints"), F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(named, "fp", "left")
    ask = F.coalesce(is_query, F.lit(False))
    kind = "array<struct<class_id:bigint,offset:bigint,votes:bigint,bit_errors:bigint,overlap:bigint>>"
    matches = F.when(ask, F.coalesce("matches", F.array().cast(kind)))
    return shown.select(F.col("doc_id").alias(id_col), "n_ints", F.coalesce("class_id", "doc_id").alias("class_id"), ask.alias("is_query"), F.coalesce(F.size(matches), F.lit(0)).cast("long").alias("n_matches"), matches.alias("matches"))
