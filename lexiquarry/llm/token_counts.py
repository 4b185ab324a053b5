"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once, by byte-level BPE. Its tokens tile its bytes, so token lengths
give every token's place, and sections (character spans, which may overlap or leave gaps) are joined
to them as intervals by binary search. Tokens that cross a section's border go by an explicit rule:

* ``first``   to the section that holds the token's first byte
* ``middle``  to the section that holds its middle
* ``share``   to each section by the share of its bytes there, so that counts are fractions and
  the counts of sections that tile a text add up to the text's count

The tokenizer's own pre-splitting never joins what stands before white space with what follows a
word, so a batch's distinct units (white space and the word behind it) are encoded once each and
remembered; texts with white space outside ASCII are encoded as they stand.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textops as X

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits text before merging (public, of its tokenizer's description).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBER, CHUNK = 300_000, 6 << 20
RULES = ("first", "middle", "share")
_WIDE_SPACE = "[\u0085   -     　]"
_LOADED: dict = {}


def load(raw: bytes):
    """The encoder and this worker's memory of units."""
    if raw not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        encoder = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(ranks.values()) + 1, np.uint16)
        for t, i in ranks.items():
            sizes[i] = len(t)
        _LOADED[raw] = encoder, sizes, {}
    return _LOADED[raw]


def token_sizes(loaded, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte lengths of all tokens of all texts, one after another, and the token count of each text."""
    encoder, sizes, memory = loaded
    texts = texts.fill_null("") if texts.null_count else texts
    data, offsets = X.text_bytes(texts)
    white = X._WHITE[data]
    starts = white.copy()
    starts[1:] &= ~white[:-1]
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(starts)
    at = np.searchsorted(starts, offsets)
    borders = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, borders, pa.py_buffer(data)]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    units = coded.dictionary.to_pylist()
    new = [u for u in units if u not in memory]
    if new:
        if len(memory) + len(new) > REMEMBER:
            memory.clear()
            new = units
        for u in new:
            memory[u] = sizes[encoder.encode_ordinary(u.decode())].tobytes()
    spelled = [memory[u] for u in units]
    table = np.frombuffer(b"".join(spelled), np.uint16)
    size = np.array([len(s) // 2 for s in spelled], np.int64)
    first = np.cumsum(size) - size
    many = size[code]
    ends = np.cumsum(many)
    out = table[np.repeat(first[code] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)] if len(code) else np.zeros(0, np.uint16)
    counts = np.diff(np.concatenate(([0], ends))[at])
    wide = pc.match_substring_regex(texts, _WIDE_SPACE).to_numpy(zero_copy_only=False).astype(bool)
    if wide.any():
        parts = np.split(out, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(wide).tolist():
            parts[i] = sizes[encoder.encode_ordinary(texts[i].as_py())]
        out, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
    return out.astype(np.int64), counts


def _attribute(raw: bytes, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load(raw)
        for batch in batches:
            _, offsets = X.text_bytes(batch.column(1))
            for a, b in X.pieces(offsets, CHUNK):
                yield from _sections(loaded, batch.slice(a, b - a), rule)

    return run


def _sections(loaded, batch: pa.RecordBatch, rule: str) -> Iterator[pa.RecordBatch]:
    data, offsets = X.text_bytes(batch.column(1))
    sizes, counts = token_sizes(loaded, batch.column(1))
    edge = np.concatenate(([0], np.cumsum(sizes)))  # token borders over the whole batch
    spans = batch.column(2)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(spans.offsets)))
    inner = spans.flatten()
    n_doc = np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets])
    sign = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    sign_at = np.concatenate(([0], np.cumsum(n_doc)))
    start, end = (np.clip(inner.field(f).to_numpy(zero_copy_only=False), 0, n_doc[owner]) for f in ("start", "end"))
    end = np.maximum(start, end)
    # a section's end is its document's end, not the next document's first sign, which is the same byte
    lo, hi = sign[sign_at[owner] + start], sign[sign_at[owner] + end]
    if rule == "share":
        place = np.arange(len(edge), dtype=float)
        n = np.interp(hi, edge, place) - np.interp(lo, edge, place)
    else:
        points = edge[:-1] if rule == "first" else (edge[:-1] + edge[1:]) / 2
        n = (np.searchsorted(points, hi, "left") - np.searchsorted(points, lo, "left")).astype(float)
    inside = lambda x: edge[np.minimum(np.searchsorted(edge, x), len(edge) - 1)] != x
    token = lambda x: np.searchsorted(edge, x, "right")
    cross_lo, cross_hi = inside(lo), inside(hi)
    some = hi > lo
    crossing = some * (cross_lo.astype(np.int64) + cross_hi - (cross_lo & cross_hi & (token(lo) == token(hi))))
    number = np.arange(len(owner)) - np.asarray(spans.offsets)[:-1][owner] + spans.offsets[0].as_py()
    yield pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(owner)),
            pa.array(number.astype(np.int32)),
            inner.field("name"),
            pa.array(start.astype(np.int32)),
            pa.array(end.astype(np.int32)),
            pa.array(n),
            pa.array(crossing.astype(np.int64)),
            pa.array(counts[owner].astype(np.int64)),
        ],
        names=["_row", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
    )


def attribute(docs: DataFrame, spans: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rule: str = "first", ranks: str = RANKS) -> DataFrame:
    """One row per section: ``keep`` columns, section (its number from 0), name, start, end, n_tokens
    (double), n_crossing (tokens that cross one of its borders), doc_tokens.

    ``spans`` is an array of (name, start, end) in code points, end exclusive; spans are cut to the
    text, null spans give no row. Null text has no tokens. Repeated rows stay; empty tables give
    empty results. Texts are encoded whole.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    kind = "array<struct<name:string,start:int,end:int>>"
    clean = F.filter(F.coalesce(spans.cast(kind), F.array().cast(kind)), lambda s: s.isNotNull() & s["start"].isNotNull() & s["end"].isNotNull())
    packed = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), clean.alias("_spans"))
    row = packed.schema["_row"].dataType.simpleString()
    with open(ranks, "rb") as f:  # on the driver; executors get the bytes
        raw = f.read()
    out = packed.mapInArrow(_attribute(raw, rule), f"_row {row}, section int, name string, start int, end int, n_tokens double, n_crossing long, doc_tokens long")
    return out.select("_row.*", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens")


def blocks(text: Column, size: int) -> Column:
    """Spans of ``size`` code points that tile the text; an empty text is one empty span."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.struct(F.lit("block").alias("name"), s.alias("start"), F.least(s + size, n).alias("end")))


def lines(text: Column) -> Column:
    """Spans of lines, the line break included."""
    parts = F.split(F.coalesce(text, F.lit("")), "(?<=\n)", -1)
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,start:int,end:int>>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.char_length(p)).alias("at"), F.concat(a["out"], F.array(F.struct(F.lit("line").alias("name"), a["at"].alias("start"), (a["at"] + F.char_length(p)).alias("end")))).alias("out")
        ),
    )
    return walked["out"]
