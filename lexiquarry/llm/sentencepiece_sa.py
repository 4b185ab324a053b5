"""SentencePiece encoding and decoding by suffix-array matching.

Spaces are the only place where text may be cut without changing the result (checked when the model
is loaded: no piece has the space mark behind another sign). So a batch's distinct segments that
this worker has not met before are concatenated and indexed by a suffix array (of eight bytes'
depth; longer pieces are compared on from there). Every piece is searched in it, its occurrence
range gives edges from start to end, the edges are sorted by position and relaxed:

* unigram models keep, at each place, the edge with the best summed score;
* BPE models keep the one edge that merging by rank would end there. The last token of a prefix's
  encoding extends that of a shorter prefix, and a token may follow another exactly when no merge
  across their border comes before the merges that formed them; undoing the later-formed of the
  two, step by step, decides that. The result is the one of merging, without simulating merges.

Signs without a piece become byte pieces (or the unknown piece). Decoding concatenates pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textops as X

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MARK = MARK.encode()
#: Encoded segments a worker remembers, bytes of text handled at a time, and bytes of new segments indexed at a time.
REMEMBER, CHUNK, PART = 200_000, 1 << 20, 1 << 17
_LOADED: dict[bytes, Model] = {}
_NEVER = np.iinfo(np.int64).max


class Model:
    """Pieces and merge order of a SentencePiece model file's bytes."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not (spec.escape_whitespaces and spec.add_dummy_prefix) or spec.remove_extra_whitespaces:
            raise ValueError("only identity normalisation with a dummy prefix and all spaces kept is supported")
        self.bpe = proto.trainer_spec.model_type == 2
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes_at = np.full(256, -1, np.int64)
        self.text = [b""] * len(proto.pieces)
        self.ids: dict[str, int] = {}
        self.score = np.zeros(len(proto.pieces) + 1)
        for i, p in enumerate(proto.pieces):
            self.score[i] = p.score
            if p.type == 6:
                self.bytes_at[int(p.piece[3:5], 16)] = i
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (1, 4):
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("a piece has the space mark behind another sign")
                self.ids[p.piece] = i
                self.text[i] = p.piece.encode()
        self.fallback = bool((self.bytes_at >= 0).all())
        self.none = len(proto.pieces)  # stands for a sign without a piece
        self.score[self.none] = min([0.0, *[self.score[i] for i in self.ids.values()]]) - 10
        if self.bpe:
            self._merge_trees()
        usable = sorted((t.encode(), i) for t, i in self.ids.items() if i not in self.irregular) if self.bpe else sorted((t.encode(), i) for t, i in self.ids.items())
        self.piece = np.array([i for _, i in usable], np.int64)
        self.size = np.zeros(len(proto.pieces) + 1, np.int64)
        for t, i in usable:
            self.size[i] = len(t)
        padded = [t + b"\0" * (-len(t) % 8) for t, _ in usable]
        self.blocks = [np.frombuffer(b"".join(t[j : j + 8] if len(t) > j else b"\0" * 8 for t in padded), ">u8").astype(np.uint64) for j in range(0, max(map(len, padded), default=8), 8)]
        lengths = np.array([len(t) for t, _ in usable])
        self.masks = [_mask(np.clip(lengths - 8 * j, 0, 8)) for j in range(len(self.blocks))]
        self.plain: dict[bytes, bytes] = {}

    def _merge_trees(self) -> None:
        """rank, left and right part of every piece; pieces that merging can't make, or that break the order of ranks, are irregular."""
        n = len(self.text) + 1
        order = sorted(self.ids.values(), key=lambda i: (-self.score[i], i))
        rank = np.full(n, -1, np.int64)
        for r, i in enumerate(order):
            if len(self.text[i].decode()) > 1:
                rank[i] = r
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        scores, times = np.unique(self.score[order], return_counts=True)
        shared = set(scores[times > 1].tolist())  # pieces of one score merge by place alone
        self.irregular: set[int] = {i for t, i in self.ids.items() if len(t) > 1 and self.score[i] in shared}
        rank[list(self.irregular)] = _NEVER
        for t, i in self.ids.items():
            if len(t) == 1 or i in self.irregular:
                continue
            parts, last = self._merge(t)
            if len(parts) > 1 or last is None or any(p in self.irregular or rank[p] >= rank[i] for p in last):
                self.irregular.add(i)
                rank[i] = _NEVER
            else:
                left[i], right[i] = last
        self.rank, self.left, self.right = rank, left, right
        good = [i for t, i in self.ids.items() if len(t) > 1 and i not in self.irregular]
        codes = np.array([left[i] * n + right[i] for i in good], np.int64)
        at = np.argsort(codes)
        self.pair, self.pair_rank = codes[at], rank[np.array(good, np.int64)][at] if good else np.zeros(0, np.int64)
        self.odd = [self.text[i] for i in self.irregular]

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Plain merging by score, leftmost of equals: ids, and the parts of the last merge."""
        sign = list(text)
        after, before = list(range(1, len(sign) + 1)), list(range(-1, len(sign) - 1))
        heap, last = [], None

        def push(a: int) -> None:
            b = after[a]
            if b < len(sign) and (t := sign[a] + sign[b]) in self.ids:
                heapq.heappush(heap, (-self.score[self.ids[t]], a, b, t))

        for a in range(len(sign) - 1):
            push(a)
        while heap:
            _, a, b, t = heapq.heappop(heap)
            if sign[a] is None or b >= len(sign) or sign[b] is None or after[a] != b or sign[a] + sign[b] != t:
                continue
            last = (self.ids.get(sign[a], self.none), self.ids.get(sign[b], self.none))
            sign[a], sign[b] = t, None
            after[a] = after[b]
            if after[a] < len(sign):
                before[after[a]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        out = []
        for s in sign:
            if s is not None:
                out += [self.ids[s]] if s in self.ids else self.spelled(s)
        return out, last

    def spelled(self, sign: str) -> list[int]:
        return [int(self.bytes_at[b]) for b in sign.encode()] if self.fallback else [self.unknown]

    def follows(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece ``two`` right behind piece ``one``."""
        out = np.ones(len(one), bool)
        live = np.arange(len(one))
        a, b, limit = one.copy(), two.copy(), np.full(len(one), _NEVER)
        n = len(self.text) + 1
        while len(live):
            code = a * n + b
            at = np.minimum(np.searchsorted(self.pair, code), max(len(self.pair) - 1, 0))
            crossed = (self.pair[at] == code) & (self.pair_rank[at] < limit) if len(self.pair) else np.zeros(len(live), bool)
            out[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            first = ra > rb  # the left one was formed later: undo it
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and their counts. Segments are UTF-8, the space mark included."""
        whole = b"\0".join(segments)
        odd_here = [o for o in self.odd if o in whole] if self.bpe else []
        odd = [i for i, s in enumerate(segments) if any(o in s for o in odd_here)] if odd_here else []
        special = {i: np.array(self._merge(segments[i].decode())[0], np.int64) for i in odd}
        joined = np.frombuffer(b"\0".join(b"" if i in special else s for i, s in enumerate(segments)) + b"\0" * 9, np.uint8)
        sizes = np.array([0 if i in special else len(s) for i, s in enumerate(segments)], np.int64)
        start = np.cumsum(sizes + 1) - sizes - 1
        n = len(joined) - 8
        # suffix array over the places where a sign begins
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key |= joined[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
        inside = np.zeros(n, bool)
        word = np.repeat(np.arange(len(segments)), sizes)
        offset = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside[start[word] + offset] = True
        begins = np.flatnonzero(inside & ((joined[:n] & 0xC0) != 0x80))
        order = begins[np.argsort(key[begins], kind="stable")]
        ranked = key[order]
        low, high = self.blocks[0], self.blocks[0] | ~self.masks[0]
        lo, hi = np.searchsorted(ranked, low, "left"), np.searchsorted(ranked, high, "right")
        many = hi - lo
        which = np.repeat(np.arange(len(many)), many)
        place = order[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        for j in range(1, len(self.blocks)):
            check = np.flatnonzero(self.masks[j][which] != 0)
            if len(check):
                ahead = np.minimum(place[check] + 8 * j, n - 1)
                bad = (key[ahead] & self.masks[j][which[check]]) != self.blocks[j][which[check]]
                keep = np.ones(len(which), bool)
                keep[check[bad]] = False
                which, place = which[keep], place[keep]
        piece = self.piece[which]
        end = place + self.size[piece]
        # a sign without a piece of its own is an edge too
        ends_of = np.append(begins[1:], n)
        sign_end = np.where(inside[np.minimum(ends_of, n - 1)] & (ends_of < n), ends_of, 0)
        own = np.zeros(n, np.int64)
        own[start[word] + offset] = (start + sizes)[word]
        sign_end = np.where((sign_end == 0) | (ends_of > own[begins]), own[begins], ends_of)
        single = np.zeros(n, bool)
        lone = end == _sign_end(joined, place)
        single[place[lone]] = True
        missing = ~single[begins]
        place, end = np.concatenate((place, begins[missing])), np.concatenate((end, sign_end[missing]))
        piece = np.concatenate((piece, np.full(int(missing.sum()), self.none)))
        depth = np.zeros(n, np.int64)
        depth[start[word] + offset] = offset
        by = np.argsort(depth[place].astype(np.uint16) if len(offset) and offset.max() < 65536 else depth[place], kind="stable")
        place, end, piece = place[by], end[by], piece[by]
        last = np.full(n + 1, -1, np.int64)
        best = np.full(n + 1, -np.inf)
        cuts = np.flatnonzero(np.diff(depth[place])) + 1
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(place)])).tolist(), strict=True):
            if a == b:
                continue
            s, e, p = place[a:b], end[a:b], piece[a:b]
            if self.bpe:
                if depth[s[0]]:
                    fits = self.follows(last[s], p)
                    e, p = e[fits], p[fits]
                last[e] = p
            else:
                total = self.score[p] + (best[s] if depth[s[0]] else 0.0)
                win = total > best[e]  # of equal paths the one whose last piece is longest stays
                best[e[win]], last[e[win]] = total[win], p[win]
        return self._walk(start, sizes, last, joined, special)

    def _walk(self, start: np.ndarray, sizes: np.ndarray, last: np.ndarray, joined: np.ndarray, special: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Back from every segment's end; unknown signs are spelled out."""
        at, live = start + sizes, np.flatnonzero(sizes > 0)
        seg, ids, place = [], [], []
        length = self.size.copy()
        while len(live):
            p = last[at[live]]
            step = length[p]
            unknown = np.flatnonzero(p == self.none)
            if len(unknown):  # back to the sign's first byte
                back = at[live[unknown]] - 1
                while len(on := np.flatnonzero((joined[back] & 0xC0) == 0x80)):
                    back[on] -= 1
                step = step.copy()
                step[unknown] = at[live[unknown]] - back
            at[live] -= step
            seg.append(live)
            ids.append(p)
            place.append(at[live].copy())
            live = live[at[live] > start[live]]
        none = np.zeros(0, np.int64)
        seg, ids, place = (np.concatenate([none, *x]) for x in (seg, ids, place))
        unknown = ids == self.none
        if unknown.any():
            wide = _sign_end(joined, place) - place if self.fallback else np.ones(len(place), np.int64)
            reps = np.where(unknown, wide, 1)
            first = np.repeat(np.cumsum(reps) - reps, reps)
            inner = np.arange(len(first)) - first
            was = np.repeat(unknown, reps)
            seg, place, ids = np.repeat(seg, reps), np.repeat(place, reps) + inner, np.repeat(ids, reps)
            ids = np.where(was, self.bytes_at[joined[place]] if self.fallback else self.unknown, ids)
        for i, x in special.items():
            seg, place, ids = np.concatenate((seg, np.full(len(x), i))), np.concatenate((place, np.arange(len(x)))), np.concatenate((ids, x))
        by = np.lexsort((place, seg))
        return ids[by], np.bincount(seg, minlength=len(sizes))

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes one after another and the offsets of each text."""
        if not hasattr(self, "_spelling"):
            lengths = np.array([len(t) for t in self.text], np.int64)
            self._spelling = np.frombuffer(b"".join(self.text), np.uint8), np.cumsum(lengths) - lengths, lengths
        data, first, lengths = self._spelling
        size = lengths[ids]
        ends = np.cumsum(size)
        out = data[np.repeat(first[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]


def _mask(lengths: np.ndarray) -> np.ndarray:
    """A big-endian word with ones in its first so many bytes."""
    table = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * i)) & 0xFFFFFFFFFFFFFFFF for i in range(9)], np.uint64)
    return table[lengths]


def _sign_end(joined: np.ndarray, place: np.ndarray) -> np.ndarray:
    lead = joined[place]
    return place + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


def load(raw: bytes) -> Model:
    if raw not in _LOADED:
        _LOADED[raw] = Model(raw)
    return _LOADED[raw]


def encode_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and their counts; null texts have none.

    Text that is not empty gets a space in front; segments are runs of spaces with what follows
    them, so they tile the text. The space mark itself, where a text has it, is a space to the model.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    texts = pc.replace_substring(texts, MARK, " ")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" ")))
    data, offsets = X.text_bytes(texts)
    space = data == 32
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(starts)
    at = np.searchsorted(starts, offsets)
    borders = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, borders, pa.py_buffer(data)]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    memory = model.plain
    new = [w for w in words if w not in memory]
    if new:
        if len(memory) + len(new) > REMEMBER:
            memory.clear()
            new = words
        for i, j in X.pieces(np.concatenate(([0], np.cumsum([len(w) + 1 for w in new]))), PART):
            part = new[i:j]
            ids, counts = model.encode_segments([w.replace(b" ", _MARK) for w in part])
            raw, ends = ids.astype(np.int32).tobytes(), (np.cumsum(counts) * 4).tolist()
            for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                memory[w] = raw[a:b]
    spelled = [memory[w] for w in words]
    table = np.frombuffer(b"".join(spelled), np.int32)
    size = np.array([len(s) // 4 for s in spelled], np.int64)
    first = np.cumsum(size) - size
    many = size[code] if len(code) else np.zeros(0, np.int64)
    ends = np.cumsum(many)
    out = table[np.repeat(first[code] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)] if len(code) else np.zeros(0, np.int32)
    counts = np.diff(np.concatenate(([0], ends))[at])
    return out, counts


def _encode(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(raw)
        for batch in batches:
            _, offsets = X.text_bytes(batch.column(1))
            for a, b in X.pieces(offsets, CHUNK):
                texts = batch.column(1).slice(a, b - a)
                ids, counts = encode_texts(model, texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), lists], names=["_row", "n_tokens", "ids"])
        X.give_back()

    return run


def _decode(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(raw)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                lists = part.column(1)
                at = np.asarray(lists.offsets)
                data, offsets = model.decode_bytes(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
                whole = data.tobytes()
                texts = [whole[x:y].decode("utf-8", "replace").replace(MARK, " ") for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t[1:] if t.startswith(" ") else t for t in texts], pa.string())], names=["_row", "text"])

    return run


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; executors get the bytes
        return f.read()


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """One row per input row: ``keep`` columns, n_tokens, ids (array of int).

    Null and empty texts have no tokens. Repeated rows stay; empty tables give empty
    results; columns not kept are ignored. Texts of any length are encoded whole.
    """
    ship(docs.sparkSession)
    packed = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    row = packed.schema["_row"].dataType.simpleString()
    return packed.mapInArrow(_encode(_model_bytes(model)), f"_row {row}, n_tokens long, ids array<int>").select("_row.*", "n_tokens", "ids")


def decode(coded: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """``keep`` columns and the text that the ids spell: the encoded text, a space mark shown as a space and null as empty."""
    ship(coded.sparkSession)
    packed = coded.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))
    row = packed.schema["_row"].dataType.simpleString()
    return packed.mapInArrow(_decode(_model_bytes(model)), f"_row {row}, text string").select("_row.*", "text")
