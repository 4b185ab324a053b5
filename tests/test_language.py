"""Tokens and the query language, without and with Spark."""

import pytest
from lexiquarry.functions import bm25, display, text
from lexiquarry.functions.phrase import phrase_tf
from lexiquarry.plans.parser import And, Or, Phrase, QueryError, Term, leaves, parse
from pyspark.sql import functions as F

VECTORS = {
    "parseHTTPResponse": "parsehttpresponse parse http response",
    "XMLHttpRequest": "xmlhttprequest xml http request",
    "utf8Decode": "utf8decode utf8 decode",
    "parseHTTP2Response": "parsehttp2response parse http2 response",
    "sha256": "sha256",
    "Foo": "foo",
    "HTTP": "http",
    "__init__": "__init__ init",
    "Foo_foo": "foo_foo foo",
    "read_HttpHeader_v2": "read_httpheader_v2 read http header v2",
    "std::fs::read_to_string(path)": "std fs read_to_string read to string path",
    "don't": "don t",
    "3.14": "3 14",
    "foo@bar.com": "foo bar com",
    "日本語 text": "日 本 語 text",
    "한국어": "한국어",
    "café ok": "café ok",
    "hello 👋 world ✓": "hello world",
    "___ -- ''": "",
    "x²": "x ²",
    "": "",
}


def test_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in VECTORS] + [(None,)], "s string")
    got = {r.s: r.t for r in rows.select("s", F.flatten(F.transform(text.atoms(F.col("s")), text.parts)).alias("t")).collect()}
    for k, want in VECTORS.items():
        want = want.split()
        assert got[k] == want, k
        assert [t for a, _, _ in text.atom_spans(k) for t in text.atom_terms(a)] == want, k
    assert got[None] == []
    assert text.query_atoms("parseHttp snake_case") == ["parsehttp", "snake_case"]


word = Term


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("  Foo  ", word("foo")),
        ("foo bar", And((word("foo"), word("bar")))),
        ("foo AND bar baz", And((word("foo"), word("bar"), word("baz")))),
        ("foo and bar", And((word("foo"), word("and"), word("bar")))),
        ("a b OR c d OR e", Or((And((word("a"), word("b"))), And((word("c"), word("d"))), word("e")))),
        ('"Hello, World!"', Phrase(("hello", "world"))),
        ('"hello"', word("hello")),
        ('a"b c"d', And((word("a"), Phrase(("b", "c")), word("d")))),
        ('foo "" bar', And((word("foo"), word("bar")))),
        ("std::fs::read", Phrase(("std", "fs", "read"))),
        ("snake_case", word("snake_case")),
        ("-bar foo", And((word("foo"),), (word("bar"),))),
        ("foo -(a OR b)", And((word("foo"),), (Or((word("a"), word("b"))),))),
        ("foo -bar-baz", And((word("foo"),), (Phrase(("bar", "baz")),))),
        ("foo - bar", And((word("foo"), word("bar")))),
        ("foo -", word("foo")),
        ("a(b)c", And((word("a"), word("b"), word("c")))),
        ("(a -b) OR c", Or((And((word("a"),), (word("b"),)), word("c")))),
        ("foo !!! bar", And((word("foo"), word("bar")))),
    ],
)
def test_parse(query, want):
    assert parse(query) == want


@pytest.mark.parametrize(
    ("query", "kind", "at", "found"),
    [
        ("", "Empty", None, None),
        ('"..."', "Empty", None, None),
        ("!!! ...", "Empty", None, None),
        ("foo OR !!!", "Empty", None, None),
        ("-foo -bar", "OnlyNegation", None, None),
        ("foo OR -bar", "OnlyNegation", None, None),
        ("(-foo) bar", "OnlyNegation", None, None),
        ("foo --bar", "Unexpected", 5, "-"),
        ("(foo", "UnbalancedParen", 0, None),
        ("foo)", "UnbalancedParen", 3, None),
        ("(a (b) c", "UnbalancedParen", 0, None),
        ("()", "Unexpected", 1, ")"),
        ("foo ()", "Unexpected", 5, ")"),
        ("AND foo", "Unexpected", 0, "AND"),
        ("foo AND", "Unexpected", 4, "AND"),
        ("OR foo", "Unexpected", 0, "OR"),
        ("foo OR", "Unexpected", 4, "OR"),
        ("foo AND OR bar", "Unexpected", 4, "AND"),
        ("foo OR AND bar", "Unexpected", 4, "OR"),
        ("foo -AND", "Unexpected", 5, "AND"),
        ('foo "bar baz', "UnterminatedPhrase", 4, None),
        ("Café )", "UnbalancedParen", 6, None),
    ],
)
def test_errors(query, kind, at, found):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert (e.value.kind, e.value.at, e.value.found) == (kind, at, found)


def test_leaves():
    node = parse('b "a b" -(c OR d) b')
    assert leaves(node) == ["b", "a", "c", "d"] and leaves(node, positive_only=True) == ["b", "a"]


def test_ranking_arithmetic(spark):
    one = spark.range(1)
    w = lambda n, df: one.select(bm25.idf(F.lit(n), F.lit(df))).first()[0]
    s = lambda tf, dl, avg: one.select(bm25.score(F.lit(1.0), F.lit(tf), F.lit(dl), F.lit(float(avg)))).first()[0]
    assert w(100, 1) > w(100, 50) > w(100, 100) > 0 and w(10, 20) == w(10, 10)
    assert s(0, 5, 5) == 0 and s(2, 5, 5) > s(1, 5, 5) and s(1, 5, 5) > s(1, 50, 5) and s(1, 0, 0) > 0
    p = lambda *xs: one.select(phrase_tf([F.array(*map(F.lit, x)) if x else F.lit(None).cast("array<int>") for x in xs])).first()[0]
    assert p([0, 1, 2], [0, 1, 2]) == 2 and p([5], [6], [7]) == 1 and p([5], [7]) == 0 and p([5], None) == 0


def test_display():
    assert display.commas(1234567) == "1,234,567" and display.human_bytes(1536) == "1.5 KiB" and display.human_bytes(-3) == "-3 B"
    assert display.display_path("/r/a/b", "/r") == "a/b" and display.display_path("/rx/a", "/r") == "/rx/a"
    assert display.display_path("/r", "/r") == "/r" and display.display_path("/r/a", "/r", absolute=True) == "/r/a" and display.display_path("/r/a", "") == "/r/a"
