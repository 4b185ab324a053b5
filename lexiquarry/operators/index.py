"""The inverted index as tables.

``docs``      doc_id, len (atoms), status, and whatever identifies the document
``postings``  term, doc_id, tf, positions (ascending, distinct); one row per term and document
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def doc_table(source: DataFrame, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """Every row is an indexed document; null or empty text has length 0 and still counts."""
    return source.select(F.col(id_col).cast("long").alias("doc_id"), F.size(T.atoms(F.col(text_col))).cast("long").alias("len"), F.lit("Indexed").alias("status"), *extra)


def tokens(source: DataFrame, id_col: str, text_col: str, terms: list[str] | None = None) -> DataFrame:
    """doc_id, term, pos: one row per term and place, parts of identifiers included.

    With ``terms`` only those are produced, and atoms that can't give any of them go before the split.
    """
    placed = source.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(T.atoms(F.col(text_col))).alias("pos", "atom"))
    if terms is not None:
        placed = placed.where(F.lower("atom").isin(terms) | T.splittable(F.col("atom")))
    out = placed.select("doc_id", "pos", F.explode(T.parts(F.col("atom"))).alias("term"))
    return out.where(F.octet_length("term") <= T.MAX_TERM_BYTES) if terms is None else out.where(F.col("term").isin(terms))


def _in_rows(source: DataFrame, terms: list[str] | None, places: bool = True) -> DataFrame:
    """doc_id, s (the document's terms, with their places or without, sorted), b (where each begins in s): all within its row, without an exchange."""
    a, s = F.col("a"), F.col("s")
    term = (lambda v: v["term"]) if places else (lambda v: v)
    made = (lambda t, i: F.struct(t.alias("term"), i.alias("pos"))) if places else (lambda t, i: t)
    wanted = (lambda v: term(v).isin(terms)) if terms is not None else (lambda v: F.octet_length(term(v)) <= T.MAX_TERM_BYTES)
    atoms = T.atoms(F.col("text"))
    if terms is None:
        placed = F.transform(a, lambda x, i: F.transform(T.parts(x), lambda t: made(t, i)))
    else:  # atoms that can't give any of them go first
        atoms = F.filter(F.transform(atoms, lambda x, i: F.when(F.lower(x).isin(terms) | T.splittable(x), F.struct(x.alias("x"), i.alias("i")))), lambda h: h.isNotNull())
        placed = F.transform(a, lambda h: F.transform(T.parts(h["x"]), lambda t: made(t, h["i"])))
    rows = source.select("doc_id", atoms.alias("a")).select("doc_id", F.sort_array(F.filter(F.flatten(placed), wanted)).alias("s"))
    begins = F.transform(s, lambda v, i: F.when((i == 0) | (term(v) != term(F.get(s, i - 1))), i))
    return rows.select("doc_id", "s", F.filter(begins, lambda i: i.isNotNull()).alias("b"))


def _each(rows: DataFrame, made) -> DataFrame:
    """One row for each term of a document; ``made`` gives its fields by (s, begin, length)."""
    s, b = F.col("s"), F.col("b")
    run = lambda at, j: F.struct(*made(s, at, F.coalesce(F.get(b, j + 1), F.size(s)) - at))
    return rows.select("doc_id", F.explode(F.transform(b, run)).alias("p")).select("doc_id", "p.*")


def _apart(source: DataFrame, unique: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other row has, and the rest, if any: their places have to be brought together. Only ids are read for it."""
    ids = None if unique else source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("twice"))
    if ids is None or ids.isEmpty():
        return source, None
    same = F.col("doc_id").eqNullSafe(F.col("twice"))
    return source.join(ids, same, "left_anti"), source.join(ids, same, "left_semi")


def postings(source: DataFrame, id_col: str, text_col: str, terms: list[str] | None = None, unique: bool = False) -> DataFrame:
    """Made within the row of each document; only rows that share an id (``unique``: none) are grouped."""
    one, rest = _apart(source.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), unique)
    out = _each(_in_rows(one, terms), lambda s, at, n: [F.get(s, at)["term"].alias("term"), F.transform(F.slice(s, at + 1, n), lambda v: v["pos"]).alias("positions")])
    if rest is not None:
        out = out.unionByName(tokens(rest, "doc_id", "text", terms).groupBy("doc_id", "term").agg(F.sort_array(F.collect_set("pos")).alias("positions")))
    return out.select("term", "doc_id", F.size("positions").alias("tf"), "positions")


def frequencies(source: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, term, tf: postings without places."""
    one, rest = _apart(source.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), False)
    out = _each(_in_rows(one, None, False), lambda s, at, n: [F.get(s, at).alias("term"), n.cast("long").alias("tf")])
    if rest is not None:
        out = out.unionByName(tokens(rest, "doc_id", "text").groupBy("doc_id", "term").agg(F.countDistinct("pos").alias("tf")))
    return out


def with_ids(files: DataFrame, base: int = 0) -> DataFrame:
    """doc_id by path order from ``base`` up. Metadata only: one narrow row per file meets in one task."""
    return files.withColumn("doc_id", (F.row_number().over(W.orderBy("path")) - 1 + base).cast("long"))


def dictionary(postings_: DataFrame) -> DataFrame:
    """term, df, total_tf."""
    return postings_.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


def index_stats(docs: DataFrame, postings_: DataFrame) -> DataFrame:
    """One row of counters of documents, tokens, postings and terms."""
    d = docs.agg(
        F.count(F.lit(1)).alias("docs_total"),
        F.count_if(F.col("status") == "Indexed").alias("docs_indexed"),
        F.count_if(F.col("status") != "Indexed").alias("docs_skipped"),
        F.coalesce(F.sum(F.when(F.col("status") == "Indexed", F.col("len"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.avg(F.when(F.col("status") == "Indexed", F.col("len"))), F.lit(0.0)).alias("avgdl"),
    )
    p = dictionary(postings_).agg(F.count(F.lit(1)).alias("unique_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return d.join(F.broadcast(p))  # two one-row aggregates


def live(docs: DataFrame, tombstones: DataFrame | None = None, overlay: DataFrame | None = None) -> DataFrame:
    """Documents without the deleted ones, with later paths and times laid over."""
    if tombstones is not None:
        docs = docs.join(tombstones.select("doc_id").distinct(), "doc_id", "left_anti")
    if overlay is not None:
        fields = [c for c in overlay.columns if c != "doc_id"]
        over = overlay.select("doc_id", *[F.col(c).alias(f"_o_{c}") for c in fields])
        docs = docs.join(over, "doc_id", "left").select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in fields else F.col(c) for c in docs.columns])
    return docs


def stored_layout(postings_: DataFrame, buckets: int = 16) -> DataFrame:
    """Postings spread by term hash and sorted, for ``partitionBy('bucket')`` writes with narrow row-group ranges. A large bucket is dealt to as many tasks as its size asks for."""
    return postings_.withColumn("bucket", term_bucket(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def bucket_of(term: str, buckets: int) -> int:
    """The value of ``term_bucket`` for a known term: Murmur3 with seed 42, which takes what is over a multiple of four bytes as signed bytes one by one."""
    data, h, full = term.encode(), 42, 0xFFFFFFFF

    def mixed(h: int, k: int) -> int:
        k = k * 0xCC9E2D51 & full
        k = (k << 15 | k >> 17) & full
        h ^= k * 0x1B873593 & full
        h = (h << 13 | h >> 19) & full
        return (h * 5 + 0xE6546B64) & full

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little"))
    for x in data[whole:]:
        h = mixed(h, (x - 256 if x > 127 else x) & full)
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def of_terms(stored: DataFrame, terms: list[str], buckets: int = 16) -> DataFrame:
    """Postings of some terms; of a stored layout only their bucket folders are listed, and the terms reach the scan."""
    if "bucket" in stored.columns:
        stored = stored.where(F.col("bucket").isin(sorted({bucket_of(t, buckets) for t in terms})))
    return stored.where(F.col("term").isin(terms))


def lookup(stored: DataFrame, term: str, buckets: int = 16) -> DataFrame:
    return of_terms(stored, [term], buckets)
