"""Small corpora for the operator tests: planted copies, junk, secrets, odd rows."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: names that the operators use inside, as further columns of the input
CLASHING = ["id", "key", "size", "words", "spans", "base", "rank", "target", "kept", "component_id", "h", "score", "n_words", "_t", "text_"]
VOWELS = {"en": "aeiou", "de": "äöüei", "fr": "éèêua"}


def sentence(rng, lang, n):
    """Words of one language's own syllables."""
    heads = {"en": ["th", "st", "wh", "n", "r"], "de": ["sch", "ch", "pf", "z", "g"], "fr": ["qu", "ç", "ll", "m", "v"]}[lang]
    word = lambda: "".join(rng.choice(heads) + rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4)))
    out, line = [], []
    for i in range(n):
        line.append(word() + ("." if i % 9 == 8 else ""))
        if rng.random() < 0.05:
            out.append(" ".join(line))
            line = []
    return "\n".join([*out, " ".join(line)])


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, sentence(rng, lang, rng.randint(20, 160)), lang, f"s{i % 4}"))
    base = out[0][1].split()
    out += [(n, out[0][1], "en", "s1"), (n + 1, " ".join([*base[:-1], "zz"]), "en", "s1"), (n + 2, out[0][1].upper(), "en", "s2")]
    out += [(n + 3, None, "en", "s1"), (n + 4, "", None, None), (n + 5, " \t\n ", "de", None), (n + 6, "one two three", "en", "s0"), (n + 6, "one two three", "en", "s0"), (None, "12 34", "fr", "s9")]
    out += [(n + 8, " ".join(["again and again the same eight words here now"] * 12), "en", "s0"), (n + 9, "a\x0bb\x0cc d e f g h", "en", "s3"), (n + 10, "😀 é́ 日本語 " * 9, "fr", "s2")]
    out += [(n + 11, sentence(rng, "de", 6000), "de", "s0"), (n + 12, "#" * 50 + " | ".join("tab" for _ in range(40)), "en", "s0")]
    passage = sentence(rng, "en", 60).replace("\n", " ")
    for j in range(4):
        out.append((n + 20 + j, sentence(rng, "en", 30) + " " + passage + " " + sentence(rng, "en", 25), "en", f"s{j}"))
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASHING})
