"""Secret scan: fixed patterns plus sliding-window Shannon entropy (DataFrame operations only).

Base kinds, each matched leftmost and without overlaps in itself:

* ``assign``  a keyword, an assignment sign and a value of 6 or more characters
* ``access``  ``AKIA`` and capitals or digits, 20 or more characters
* ``hex``     24 or more lower-case hexadecimal digits

The method adds kind ``entropy``: runs of 20 or more token characters are candidates; a window of
20 characters slides over each; the counts of its characters are kept, and with them the entropy: a
step changes the count of the one character that leaves and of the one that enters. Windows over the threshold of the
candidate's character class (hexadecimal, alphanumeric, base64) are joined into one span, unless
the candidate is on the allow-list or overlaps a base span.

Spans are code-point offsets, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KEYWORD = "(?i:passw(?:or)?d|secret|token|api_?key)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a failing shorter match ends where its run ends, so the length may stand in the pattern
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy")
WIDTH = 20
#: Characters are numbered from "+"; their counts take 7 longs. Spans are appended in runs.
FIRST, LONGS, RUN = ord("+"), 7, 256
#: class -> (pattern of the whole candidate, bits a character), tried in order
CLASSES = (("hex", "^[0-9a-f]+$|^[0-9A-F]+$", 3.0), ("alnum", "^[A-Za-z0-9]+$", 3.7), ("base64", "", 3.9))
#: Candidates that are no secrets: numbers, words and words joined by marks, UUIDs, placeholders, alphabets, repeated characters.
ALLOWED = (
    "^[0-9_+/-]+$",
    "^[A-Za-z_+/-]+$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "(?i:example|sample|dummy|placeholder|changeme|redacted)",
    "(?i:abcdefgh|123456789)",
    "(.)\\1{7}",
)
#: The first so many patterns are of whole candidates; with ``own_class`` the others let candidates of up to SHORT characters go.
WHOLE, SHORT = 3, 64
#: class of one window -> (pattern of its characters, bits), tried in order: the 1st percentile of the entropy of 20
#: random characters of 16, 32, 62 and 64 signs, so a random window of a class is under its cutoff in about 1 of 100 cases.
OWN_CLASSES = (("hex", "^[0-9a-f]+$|^[0-9A-F]+$", 2.9), ("one case", "^[0-9a-z]+$|^[0-9A-Z]+$", 3.34), ("alnum", "^[A-Za-z0-9]+$", 3.64), ("base64", "", 3.64))
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside lambdas every mention of an expression is a computation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, state: Column, kind: str, step) -> Column:
    """Outputs of a fold: ``step(state, item)`` gives a struct of the next ``st`` and the output ``y``, of type ``kind``.

    Outputs are appended in runs of ``RUN``, since appending to an array copies what is there.
    """
    empty = lambda st: F.struct(st.alias("st"), F.array().cast(f"array<{kind}>").alias("out"))
    one = lambda a, x: _let(step(a["st"], x), lambda r: F.struct(r["st"].alias("st"), F.concat(a["out"], F.array(r["y"])).alias("out")))

    def walked(items: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / RUN).cast("int"))
        join = lambda a, i: _let(F.aggregate(F.slice(items, i * RUN + 1, RUN), empty(a["st"]), one), lambda r: F.struct(r["st"].alias("st"), F.concat(a["out"], r["out"]).alias("out")))
        return F.aggregate(runs, empty(state), join)["out"]

    return _let(items, walked)


def _located(text: Column, pattern: str, kind: int, good=None) -> Column:
    """Spans of all matches: gaps and matches alternate, so running lengths give the offsets."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: x["m"].isNotNull())

    def step(at: Column, x: Column) -> Column:
        start = at + F.char_length(x["g"])
        return _let(F.struct(start.alias("s"), (start + F.char_length(x["m"])).alias("e")), lambda r: F.struct(
            r["e"].alias("st"), F.struct(r["s"].alias("start"), F.lit(kind).alias("kind"), r["e"].alias("end"), x["m"].alias("m")).alias("y")
        ))

    spans = _running(parts, F.lit(0), "struct<start:int,kind:int,end:int,m:string>", step)
    return F.filter(spans, lambda s: good(s["m"])) if good else spans


def _apart(hits: Column, base: Column) -> Column:
    """The hits that meet no base span: one walk from the left against the furthest end so far, one from the right against the nearest start."""
    y = lambda x, met: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), met.alias("met"))
    kind = "struct<start:int,kind:int,end:int,met:boolean>"
    left = lambda st, x: F.struct(F.when(x["kind"] < 3, F.greatest(st, x["end"])).otherwise(st).alias("st"), y(x, (x["kind"] == 3) & (st > x["start"])).alias("y"))
    right = lambda st, x: F.struct(F.when(x["kind"] < 3, F.least(st, x["start"])).otherwise(st).alias("st"), y(x, x["met"] | ((x["kind"] == 3) & (st < x["end"]))).alias("y"))
    once = _running(F.array_sort(F.concat(base, hits)), F.lit(0), kind, left)
    twice = _running(F.reverse(once), F.lit(2**31 - 1), kind, right)
    return F.when((F.size(hits) == 0) | (F.size(base) == 0), hits).otherwise(_bare(F.filter(twice, lambda x: (x["kind"] == 3) & ~x["met"])))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _bits(chars: Column, classes: tuple) -> Column:
    bits = F.lit(classes[-1][2])
    for _, pattern, b in classes[-2::-1]:
        bits = F.when(chars.rlike(pattern), F.lit(b)).otherwise(bits)
    return bits


def _signs(m: Column) -> Column:
    """Per character: its number, where its count stands (of 12 counts of 5 bits in a long), and the unit of its kind in a like long of counts of kinds."""

    def sign(c: Column) -> Column:
        n = F.ascii(c)
        inside = lambda x, y: (n >= ord(x)) & (n <= ord(y))
        unit = F.lit(1 << 25)
        for k, (x, y) in enumerate((("0", "9"), ("a", "f"), ("g", "z"), ("A", "F"), ("G", "Z"))):
            unit = F.when(inside(x, y), F.lit(1 << 5 * k)).otherwise(unit)
        code = n - FIRST
        bit = (code % 12) * 5
        return F.struct(n.alias("n"), F.floor(code / 12).cast("int").alias("w"), bit.alias("z"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"), unit.cast("long").alias("u"))

    return F.transform(F.slice(F.split(m, "", -1), 1, F.char_length(m)), sign)


def _own_bits(kinds: Column) -> Column:
    """The cutoff of a window's own class, from its counts of kinds."""
    none = lambda *ks: kinds.bitwiseAND(F.lit(sum(31 << 5 * k for k in ks)).cast("long")) == 0
    digits, low_hex, low, up_hex, up, marks = range(6)
    bits = [F.lit(b) for _, _, b in OWN_CLASSES]
    return (
        F.when(none(low, up_hex, up, marks) | none(low_hex, low, up, marks), bits[0])
        .when(none(up_hex, up, marks) | none(low_hex, low, marks), bits[1])
        .when(none(marks), bits[2])
        .otherwise(bits[3])
    )


def _entropy_span(start: Column, signs: Column, bits: Column, own_class: bool) -> Column:
    """From the first to the last window over the threshold; null if there is none.

    The fold's state holds the counts of all characters of the window (``LONGS`` longs of packed counts), the
    counts of kinds of characters, and the sum of c log c; a step takes one character off and adds one,
    so the time is in proportion to the length.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WIDTH + 2)])
    xlogx = lambda c: F.get(table, c.cast("int"))
    full = math.log2(WIDTH)
    count = lambda a, x: F.call_function("shiftright", F.get(a["counts"], x["w"]), x["z"]).bitwiseAND(F.lit(31).cast("long"))
    many_kinds = lambda k, *ks: k.bitwiseAND(F.lit(sum(31 << 5 * i for i in ks)).cast("long")) != 0

    def least(kinds: Column) -> Column:
        """The threshold of a window: with ``own_class``, its own class's too if it has digits and letters."""
        if not own_class:
            return bits
        return F.when(many_kinds(kinds, 0) & many_kinds(kinds, 1, 2, 3, 4), F.least(bits, _own_bits(kinds))).otherwise(bits)

    def seen(a: Column, j: Column, lo: Column, hi: Column) -> Column:
        """The state with the window at ``j`` judged."""
        return _let(F.lit(full) - a["s"] / WIDTH >= least(a["kinds"]) - 1e-9, lambda over: F.struct(
            a["counts"].alias("counts"), a["kinds"].alias("kinds"), a["s"].alias("s"), F.when(over, F.coalesce(lo, j)).otherwise(lo).alias("lo"), F.when(over, j).otherwise(hi).alias("hi")
        ))

    def enter(a: Column, x: Column) -> Column:
        counts = F.transform(a["counts"], lambda v, i: F.when(i == x["w"], v + x["b"]).otherwise(v))
        return F.struct(counts.alias("counts"), (a["kinds"] + x["u"]).alias("kinds"), (a["s"] + xlogx(count(a, x) + 1) - xlogx(count(a, x))).alias("s"))

    def slide(a: Column, j: Column) -> Column:
        def moved(x: Column) -> Column:
            gone, come = x["gone"], x["come"]
            counts = F.transform(a["counts"], lambda v, i: v + F.when(i == come["w"], come["b"]).otherwise(F.lit(0).cast("long")) - F.when(i == gone["w"], gone["b"]).otherwise(F.lit(0).cast("long")))
            s = F.when(gone["n"] == come["n"], a["s"]).otherwise(a["s"] + xlogx(count(a, gone) - 1) - xlogx(count(a, gone)) + xlogx(count(a, come) + 1) - xlogx(count(a, come)))
            return F.struct(counts.alias("counts"), (a["kinds"] + come["u"] - gone["u"]).alias("kinds"), s.alias("s"))

        ends = F.struct(F.get(signs, j - 1).alias("gone"), F.get(signs, j - 1 + WIDTH).alias("come"))
        return _let(_let(ends, moved), lambda b: seen(b, j, a["lo"], a["hi"]))

    none = F.lit(None).cast("int")
    blank = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0).cast("long").alias("kinds"), F.lit(0.0).alias("s"))
    first = _let(F.aggregate(F.slice(signs, 1, WIDTH), blank, enter), lambda a: seen(a, F.lit(0), none, none))
    n = F.size(signs)
    steps = F.when(n > WIDTH, F.sequence(F.lit(1), F.greatest(n - WIDTH, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    span = lambda w: F.when(w["lo"].isNotNull(), F.struct((start + w["lo"]).alias("start"), F.lit(3).alias("kind"), (start + w["hi"] + WIDTH).alias("end")))
    return _let(F.aggregate(steps, first, slide), span)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = (), keep: tuple[str, ...] = (), prefix: str = "", own_class: bool = False, overlapping: bool = False) -> DataFrame:
    """id, ``keep`` columns, and, their names behind ``prefix``, n_assign, n_access, n_hex, and arrays ``base`` and ``spans`` of (start, kind, end), sorted.

    ``allowed`` adds regular expressions to the allow-list. Null text counts as empty and gives no
    span; ids may be null or repeat; empty tables give empty results; a candidate of any length is
    scanned whole.

    With ``own_class`` each window is also judged by the class of its own characters, and words inside a
    candidate of over 64 characters don't let it go; with ``overlapping`` entropy spans that meet base spans stay. Both only add spans; without them the
    spans are those of the SQL.
    """
    none = F.array().cast(_SPAN)
    text = F.coalesce(F.col(text_col), F.lit(""))
    frame = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], text.alias("_t"))
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    kind = lambda quick, pattern, k, good=None: F.when(F.col("_t").rlike(quick), _bare(_located(F.col("_t"), pattern, k, good))).otherwise(none)
    base = F.array_sort(F.concat(kind(KEYWORD, ASSIGN, 0, value), kind(ACCESS, ACCESS, 1), kind(HEX, HEX, 2)))
    frame = frame.withColumn("base", base)
    either = lambda patterns: "|".join(f"(?:{p})" for p in patterns)
    known = lambda m: m.rlike(either((*ALLOWED, *allowed)))
    if own_class:  # a word somewhere inside a long run says nothing about the rest of it
        known = lambda m: m.rlike(either((*ALLOWED[:WHOLE], *allowed))) | ((F.char_length(m) <= SHORT) & m.rlike(either(ALLOWED[WHOLE:])))
    found = F.filter(_located(F.col("_t"), CANDIDATE, 3), lambda s: ~known(s["m"]))
    frame = frame.withColumn("found", F.when(F.col("_t").rlike(CANDIDATE), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>")))
    read = F.transform("found", lambda s: F.struct(s["start"].alias("start"), _signs(s["m"]).alias("signs"), _bits(s["m"], CLASSES).alias("bits")))
    hits = F.filter(F.transform(read, lambda s: _entropy_span(s["start"], s["signs"], s["bits"], own_class)), lambda e: e.isNotNull())
    hits = F.when(F.size("found") > 0, hits).otherwise(none)
    frame = frame.withColumn("hits", hits)
    apart = F.col("hits") if overlapping else _apart(F.col("hits"), F.col("base"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return frame.withColumn("spans", F.array_sort(F.concat("base", apart))).select(
        F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[number(k).alias(f"{prefix}n_{KINDS[k]}") for k in range(3)], F.col("base").alias(f"{prefix}base"), F.col("spans").alias(f"{prefix}spans")
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal stretch under spans replaced by ``mark``."""
    step = lambda at, s: F.struct(F.greatest(at, s["end"]).alias("st"), F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit("")).alias("y"))
    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    tail = F.substring(text, end + 1, F.greatest(F.char_length(text) - end, F.lit(0)))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(_running(spans, F.lit(0), "string", step), ""), tail)).otherwise(text)
