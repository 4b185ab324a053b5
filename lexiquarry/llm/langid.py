"""Language identification by cross-parsing entropy.

Each language is a suffix automaton of a bounded sample of its labelled text. A document is parsed
greedily against each: from where the last phrase ended, the longest match in the automaton is the
next phrase (a letter that the sample never has is a phrase of its own). The phrase count times the
bits that name a place in the sample, over the document's length, estimates the cross entropy; the
least one wins.

The automaton is stored as a transition table (dense, or sorted for a large script) whose failing
entries hold the restart state and the number of phrases that end there, so one look-up a letter
suffices and many texts advance together. Whole texts are parsed; blocks of 1024 letters are parsed side by side, each from a
fresh start, so a block border also ends a phrase (at most one phrase more in 1024 letters, for every language alike).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textops as X

BLOCK = 1024
#: Bounds of the fitted sample: documents a language, letters a language, letters in all.
SAMPLE_DOCS, SAMPLE_LETTERS, ALL_LETTERS = 64, 32768, 262144
#: A language of more letters has sparse transitions.
DENSE = 256
_LETTERS: list[np.ndarray] = []
_MODELS: dict = {}


def letters() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else 0."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one 0 for each run of anything else between them, and document offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    low = letters()[points]
    keep = low > 0
    after = np.zeros(len(low), bool)
    after[1:] = keep[:-1]
    heads = at[:-1][at[:-1] < len(low)]
    after[heads] = False
    keep |= after  # the first other sign after a letter stays as the separator
    return low[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in symbols:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class Table:
    """(state, column) -> next state * 4 + phrases that end: a mismatch ends one, and an unseen sign is one itself.

    Dense up to ``DENSE`` columns, else the transitions sorted, so a large script costs no more memory than its sample.
    """

    def __init__(self, step: list[dict[int, int]], width: int):
        self.width, self.dense = width, None
        root = np.full(width, -1, np.int64)
        root[list(step[0])] = list(step[0].values())
        self.restart = np.where(root >= 0, root * 4 + 1, 2).astype(np.int32)
        sizes = [len(out) for out in step]
        state = np.repeat(np.arange(len(step), dtype=np.int64), sizes)
        keys = state * width + np.fromiter((c for out in step for c in out), np.int64, sum(sizes))
        values = np.fromiter((t for out in step for t in out.values()), np.int64, sum(sizes)) * 4
        if width <= DENSE:
            full = np.tile(self.restart, (len(step), 1))
            full[0] = 1
            self.dense = full.reshape(-1)
            self.dense[keys] = values
        else:
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order].astype(np.int32)

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + column
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], np.where(state > 0, self.restart[column], 1))


class Model:
    """Automata of all languages: 0 other, 1 a letter of no sample, and every letter of the samples a symbol of its own.

    A table has columns for the letters of its own language only; those of others share its column 1, where nothing goes.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        most = min(SAMPLE_LETTERS, ALL_LETTERS // max(1, len(samples)))
        own = []
        for lang in self.langs:
            raw = np.frombuffer(samples[lang].encode(), np.uint8)
            own.append(spelled(raw, np.array([0, len(raw)]))[0][:most])
        seen = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint32))
        seen = seen[seen > 0]  # at most ALL_LETTERS
        self.symbol = np.ones(0x110000, np.int32)
        self.symbol[0] = 0
        self.symbol[seen] = np.arange(2, len(seen) + 2)
        self.tables, self.bits, self.columns = [], [], []
        for text in own:
            mine = np.unique(self.symbol[text])
            mine = mine[mine > 0]
            column = np.ones(len(seen) + 2, np.int32)
            column[0] = 0
            column[mine] = np.arange(2, len(mine) + 2)
            self.columns.append(column)
            self.tables.append(Table(suffix_automaton(column[self.symbol[text]].tolist()), len(mine) + 2))
            self.bits.append(np.log2(len(text) + 2))

    def phrases(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(documents, languages) counts of phrases."""
        sizes = np.diff(at)
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = at[:-1][doc] + place * BLOCK
        length = np.minimum(at[1:][doc] - start, BLOCK)
        order = np.argsort(-length, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
        steps = int(length[0]) if len(length) else 0
        live = np.searchsorted(-length, -np.arange(1, steps + 1), "right")  # lanes with a sign at each step
        out = np.zeros((len(sizes), len(self.tables)), np.int64)
        state = [np.zeros(len(doc), np.int32) for _ in self.tables]
        total = [np.zeros(len(doc), np.int32) for _ in self.tables]
        for t in range(steps):
            n = live[t]
            now = symbols[start[:n] + t]
            for j, table in enumerate(self.tables):
                v = table.step(state[j][:n], self.columns[j][now])
                state[j][:n] = v >> 2
                total[j][:n] += v & 3
        for j in range(len(self.tables)):
            np.add.at(out[:, j], doc, total[j] + (state[j] != 0))
        return out


def model_of(samples: dict[str, str]) -> Model:
    key = hash(tuple(sorted(samples.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(samples)
    return _MODELS[key]


def _predict(samples: dict[str, str]):
    """An Arrow function of a text column; a batch gives one struct a text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(samples)
        for batch in batches:
            data, offsets = X.text_bytes(batch)
            parts = []
            for a, b in X.pieces(offsets, 2 << 20):
                points, at = spelled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(at)
                bits = model.phrases(model.symbol[points], at) * np.array(model.bits) / np.maximum(n, 1)[:, None]
                parts.append(_result(n, bits, model.langs))
            yield pa.concat_arrays(parts) if parts else _result(np.zeros(0, np.int64), np.zeros((0, len(model.langs))), model.langs)
        X.give_back()

    return run


def _result(n: np.ndarray, bits: np.ndarray, langs: list[str]) -> pa.Array:
    known = (n > 0) & bool(langs)
    if langs:
        order = np.argsort(bits, axis=1, kind="stable")
        rows = np.arange(len(n))
        best = bits[rows, order[:, 0]]
        second = bits[rows, order[:, 1]] if len(langs) > 1 else np.full(len(n), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isinf(second), 1.0, np.where(best + second > 0, second / (best + second), 0.5))
        names = np.array(langs, object)[order[:, 0]]
    else:
        best, score, names = np.zeros(len(n)), np.zeros(len(n)), np.full(len(n), "und", object)
    columns = [pa.array(np.where(known, names, "und"), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, best, 0.0))]
    return pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "bits"])


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample text per language: of ``usable`` rows, at most 64 documents a language (one for each of 64
    hash slots, the least hash of its slot, texts of 20 characters or fewer only where a slot has no
    longer one), and of each a stretch from its middle. Texts without a letter teach nothing."""
    each = SAMPLE_LETTERS // SAMPLE_DOCS * 4
    rows = docs.where(usable).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    short = F.length("text") <= 20
    least = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("slot")).agg(F.min(F.struct(short.alias("short"), "h"))["h"].alias("h"))
    chosen = {(r.lang, r.h) for r in least.collect()}  # at most 64 numbers a language
    if not chosen:
        return {}
    size = F.length("text")
    part = F.substring("text", F.greatest(F.lit(1), F.floor((size - each) / 2).cast("int")), F.lit(each))
    found = rows.where(F.col("h").isin(sorted({h for _, h in chosen}))).groupBy("lang", "h").agg(F.min(part).alias("part")).collect()
    out: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.h)):
        if (r.lang, r.h) in chosen:
            out.setdefault(r.lang, []).append(r.part)
    return {lang: " \n".join(parts) for lang, parts in out.items()}


def identify(
    docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str, str] = ("lang_pred", "score", "bits")
) -> DataFrame:
    """One row per input row: id, ``keep`` columns, and by ``names`` lang_pred, score, bits (cross entropy a letter).

    Null text, and text without a letter, is ``und`` with score 0; so is all text where nothing was
    learned. The score is second/(best + second) of the two least cross entropies, 1 with a single
    language; ties go to the language first by name. Repeated rows stay; ids may be null; empty tables
    give empty results. Only the text is sent to Python, and only the result comes back; other columns
    stay where they are.
    """
    ship(docs.sparkSession)
    predict = F.arrow_udf(_predict(samples), "lang_pred string, score double, bits double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    rest = [F.col(c).alias(f"_k{i}") for i, c in enumerate((id_col, *keep))]
    found = docs.select(*rest, predict(F.col(text_col)).alias("_found"))
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate((id_col, *keep))], *[F.col(f"_found.{c}").alias(n) for c, n in zip(("lang_pred", "score", "bits"), names, strict=True)])


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts)) == part
