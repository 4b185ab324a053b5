"""One query for each operator, over whole tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Root
from .functions import text as T
from .operators import doc_sets, merge, reconcile, snippet
from .operators import index as I
from .plans import search as Q
from .plans.parser import And, Node, Or, Phrase, QueryError, Term, describe, leaves, parse, phrase_terms
from .scratch import Scratch
from .sources.store import Manifest, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

CORPORA = {
    "documents": ("doc_id", "text"),
    "pages": ("page_id", "html"),
    "conversations": ("conv_id * 1000 + turn", "text"),
    "benchmark": ("item_id", "text"),
    "part": ("p_partkey", "p_name"),
}


def source(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    """A table of texts. Where its files give fewer tasks than there are cores, its rows are dealt out; a large table stays as it is read."""
    key, text = CORPORA[name]
    rows = spark.read.parquet(f"{d}/{name}.parquet").select(F.expr(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _dealt(spark, rows)


def _dealt(spark: SparkSession, rows: DataFrame) -> DataFrame:
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def rows_of(spark: SparkSession, d: str, *queries: str, name: str = "documents", keep: bool = True) -> tuple[DataFrame, list[str]]:
    """A table's occurrences of the terms of some queries, and these terms. Kept, so that statistics and matches of all of them need one look at the texts."""
    nodes = [parse(q) for q in queries]
    terms = list(dict.fromkeys(t for n in nodes for t in leaves(n)))
    rows = Q.occurrences(source(spark, d, name), terms, {t for n in nodes for t in phrase_terms(n)})
    return Scratch(spark).keep(rows, "occurrences") if keep else rows, terms


def match(spark: SparkSession, d: str, query: str, name: str = "documents", keep: bool = True) -> DataFrame:
    """All matches of a query over a table."""
    return Q.match_rows(*rows_of(spark, d, query, name=name, keep=keep), query)


def rounded(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*(keys or ("doc_id",)), F.round("score", 6).alias("score"))


# SQL

_ATOMS = r"'[\p{L}\p{M}\p{N}_]+'"


def _corpus_sql(name: str = "documents", where: str = "") -> str:
    key, text = CORPORA[name]
    return rf"""l AS (SELECT CAST({key} AS BIGINT) AS doc_id, regexp_extract_all(coalesce({text}, ''), {_ATOMS}) AS w FROM {name} {where}),
      d AS (SELECT doc_id, len(w)::BIGINT AS len FROM l),
      placed AS (SELECT doc_id, unnest(w) AS atom, unnest(range(len(w))) AS pos FROM l),
      cut AS (SELECT doc_id, pos, atom, regexp_replace(regexp_replace(atom, '([\p{{Ll}}\p{{Lo}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}[\p{{Ll}}\p{{Lo}}])', '\1 \2', 'g') AS c FROM placed),
      tok AS (SELECT doc_id, pos, unnest(list_distinct(list_concat([lower(atom)], list_filter(list_transform(string_split(replace(c, '_', ' '), ' '), lambda x: lower(x)), lambda x: x <> '')))) AS term FROM cut)"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def match_sql(query: str | Node, name: str = "documents", where: str = "", tag: str = "") -> str:
    """CTEs ending in ``found{tag}`` (doc_id, score) for a query."""
    node = parse(query) if isinstance(query, str) else query
    lists: list[tuple[str, list[str]]] = []

    def leaf(terms: list[str]) -> str:
        if len(terms) == 1:
            sql = f"SELECT doc_id, count(*) AS tf FROM tok WHERE term = {_literal(terms[0])} GROUP BY doc_id"
        else:
            joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = {_literal(t)}" for i, t in enumerate(terms) if i)
            sql = f"SELECT t0.doc_id, count(DISTINCT t0.pos) AS tf FROM tok t0 {joins} WHERE t0.term = {_literal(terms[0])} GROUP BY t0.doc_id"
        lists.append((sql, terms))
        return f"x{len(lists) - 1}"

    def idf(t: str) -> str:
        df = f"(SELECT count(DISTINCT doc_id) FROM tok WHERE term = {_literal(t)})"
        return f"ln(1 + ((SELECT count(*) FROM d) - {df} + 0.5) / ({df} + 0.5))"

    def build(x: Node) -> tuple[str, str]:
        if isinstance(x, Term | Phrase):
            terms = [x.text] if isinstance(x, Term) else list(x.terms)
            a = leaf(terms)
            tf, weight = f"coalesce({a}.tf, 0)::DOUBLE", " + ".join(map(idf, terms))
            return f"({a}.tf IS NOT NULL)", f"(({weight}) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * d.len / (SELECT avg(len) FROM d))))"
        if isinstance(x, And):
            plus = [build(y) for y in x.must]
            return "(" + " AND ".join([m for m, _ in plus] + [f"NOT {build(y)[0]}" for y in x.must_not]) + ")", "(" + " + ".join(s for _, s in plus) + ")"
        some = [build(y) for y in x.any_of]
        return "(" + " OR ".join(m for m, _ in some) + ")", "(" + " + ".join(f"CASE WHEN {m} THEN {s} ELSE 0 END" for m, s in some) + ")"

    met, score = build(node)
    joins = " ".join(f"LEFT JOIN ({sql}) x{i} ON x{i}.doc_id = d.doc_id" for i, (sql, _) in enumerate(lists))
    return f"{_corpus_sql(name, where)}, found AS (SELECT d.doc_id, {score} AS score FROM d {joins} WHERE {met})"


def _sql(query: str, name: str = "documents", where: str = "", out: str = "SELECT doc_id, round(score, 6) AS score FROM found") -> str:
    return f"WITH {match_sql(query, name, where)} {out}"


# queries

SEARCHES = {
    "search_term": "from",
    "search_and": "of from",
    "search_or": "with OR were",
    "search_not": "the -of",
    "search_grouped": "(from OR with) the -was",
    "search_phrase": '"of the"',
    "search_phrase3": '"the of and"',
    "search_phrase_not": '"of the" -with',
    "search_repeated_terms": "from from OR from",
    "search_missing_term": "zzzz OR from",
    "search_nested": '((the OR of) AND (from OR "in the")) OR nicht -(die der)',
}
QUERIES: dict[str, Query] = {name: (lambda q: lambda s, d: rounded(match(s, d, q)))(q) for name, q in SEARCHES.items()}
ORACLES: dict[str, str] = {name: _sql(q) for name, q in SEARCHES.items()}

for _name in ("pages", "conversations", "benchmark", "part"):
    _q = {"pages": "the", "conversations": "the -of", "benchmark": "of", "part": "steel OR red"}[_name]
    QUERIES[f"search_{_name}"] = (lambda q, n: lambda s, d: rounded(match(s, d, q, n)))(_q, _name)
    ORACLES[f"search_{_name}"] = _sql(_q, _name)


def _add(name: str, sql: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


@_add("search_topk", _sql("from", out="SELECT doc_id, round(score, 6) AS score FROM found ORDER BY found.score DESC, doc_id LIMIT 20"))
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.page(match(spark, d, "from")))


@_add("search_page", _sql("of the", out="SELECT doc_id, round(score, 6) AS score FROM found ORDER BY found.score DESC, doc_id LIMIT 10 OFFSET 20"))
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.page(match(spark, d, "of the"), 10, 20))


@_add("search_total", _sql("of the", out="SELECT count(*) AS total FROM found"))
def search_total(spark: SparkSession, d: str) -> DataFrame:
    return match(spark, d, "of the").agg(F.count(F.lit(1)).alias("total"))


@_add("search_limit_zero", _sql("of the", out="SELECT doc_id, round(score, 6) AS score FROM found LIMIT 0"))
def search_limit_zero(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.page(match(spark, d, "of the", keep=False), 0))


@_add(
    "search_multi_root",
    f"SELECT 'conversations' AS root, doc_id, round(score, 6) AS score FROM (WITH {match_sql('the', 'conversations')} SELECT * FROM found) "
    f"UNION ALL SELECT 'documents', doc_id, round(score, 6) FROM (WITH {match_sql('the')} SELECT * FROM found)",
)
def search_multi_root(spark: SparkSession, d: str) -> DataFrame:
    found = [match(spark, d, "the", name).withColumn("root", F.lit(name)) for name in ("conversations", "documents")]
    return rounded(found[0].unionByName(found[1]), "root", "doc_id")


@_add("tombstone_search", _sql("from", where="WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def tombstone_search(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id")
    rows, terms = rows_of(spark, d, "from")
    return rounded(Q.match_rows(rows.join(gone, "doc_id", "left_anti"), terms, "from"))


@_add("search_snippets")
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The first page with lines and highlights."""
    hits = Q.page(match(spark, d, '"of the" from'))
    return snippet.with_snippets(hits, source(spark, d), '"of the" from')


@_add("atom_counts", f"WITH {_corpus_sql()} SELECT doc_id, len FROM d")
def atom_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.doc_table(source(spark, d), "doc_id", "text").select("doc_id", "len")


@_add("postings_build", f"WITH {_corpus_sql()} SELECT term, doc_id, count(*)::INT AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM (SELECT DISTINCT * FROM tok) GROUP BY term, doc_id")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(source(spark, d), "doc_id", "text").select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


@_add("postings_of_terms", f"WITH {_corpus_sql()} SELECT term, doc_id, count(*)::INT AS tf, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM (SELECT DISTINCT * FROM tok WHERE term IN ('from', 'nicht', 'le')) GROUP BY term, doc_id")
def postings_of_terms(spark: SparkSession, d: str) -> DataFrame:
    p = I.postings(source(spark, d), "doc_id", "text", ["from", "nicht", "le"])
    return p.select("term", "doc_id", "tf", F.array_min("positions").alias("first_pos"), F.array_max("positions").alias("last_pos"))


_DF = "SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS total_tf FROM (SELECT DISTINCT * FROM tok) GROUP BY term"


@_add("term_dictionary", f"WITH {_corpus_sql()} {_DF}")
def term_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies need no positions: tokens are counted by document, then by term."""
    return I.dictionary(I.frequencies(source(spark, d), "doc_id", "text"))


@_add("term_df_topk", f"WITH {_corpus_sql()} {_DF} ORDER BY df DESC, term LIMIT 50")
def term_df_topk(spark: SparkSession, d: str) -> DataFrame:
    return term_dictionary(spark, d).orderBy(F.desc("df"), "term").limit(50)


@_add(
    "index_stats",
    f"WITH {_corpus_sql()}, t AS ({_DF}) SELECT (SELECT count(*) FROM d) AS docs_total, (SELECT count(*) FROM d) AS docs_indexed, 0::BIGINT AS docs_skipped, "
    "(SELECT sum(len)::BIGINT FROM d) AS tokens, round((SELECT avg(len) FROM d), 6) AS avgdl, (SELECT count(*) FROM t) AS unique_terms, (SELECT sum(df)::BIGINT FROM t) AS postings",
)
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    src = source(spark, d)
    return I.index_stats(I.doc_table(src, "doc_id", "text"), I.frequencies(src, "doc_id", "text")).withColumn("avgdl", F.round("avgdl", 6))


@_add("phrase_join", f"WITH {_corpus_sql()} SELECT t0.doc_id, count(DISTINCT t0.pos) AS tf FROM tok t0 JOIN tok t1 ON t1.doc_id = t0.doc_id AND t1.pos = t0.pos + 1 AND t1.term = 'the' WHERE t0.term = 'of' GROUP BY t0.doc_id")
def phrase_join(spark: SparkSession, d: str) -> DataFrame:
    return doc_sets.phrase_join(I.tokens(source(spark, d), "doc_id", "text", ["of", "the"]), ["of", "the"])


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, terms = rows_of(spark, d, "from", "with")
    return Q.match_rows(rows, terms, "from"), Q.match_rows(rows, terms, "with")


_TWO = f"a AS (SELECT * FROM (WITH {match_sql('from')} SELECT * FROM found)), b AS (SELECT * FROM (WITH {match_sql('with')} SELECT * FROM found))"


@_add("set_union", f"WITH {_TWO} SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return rounded(doc_sets.union(*_two(spark, d)))


@_add("set_intersect", f"WITH {_TWO} SELECT doc_id, round(a.score + b.score, 6) AS score FROM a JOIN b USING (doc_id)")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return rounded(doc_sets.intersect(*_two(spark, d)))


@_add("set_difference", f"WITH {_TWO} SELECT doc_id, round(score, 6) AS score FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(doc_sets.difference(*_two(spark, d)))


def _as_files(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The documents as if they were files of folders named by source."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        "doc_id", F.format_string("%s/%08d.txt", F.coalesce("source", F.lit("none")), "doc_id").alias("path"), (F.col("doc_id") + 1).alias("inode"), F.col("n_chars").alias("mtime_ns"),
        F.octet_length("text").cast("long").alias("size"), F.lit("Indexed").alias("status"), F.md5("text").alias("content_hash"), "lang", F.lit("Text").alias("kind"), *more,
    )


_FILES = "f AS (SELECT doc_id, printf('%s/%08d.txt', coalesce(source, 'none'), doc_id) AS path, doc_id + 1 AS inode, n_chars AS mtime_ns, strlen(text)::BIGINT AS size, lang FROM documents)"


@_add("overlay_docs", f"WITH {_FILES} SELECT doc_id, CASE WHEN lang = 'de' THEN 'moved/' || path ELSE path END AS path, CASE WHEN lang = 'de' THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns FROM f WHERE lang <> 'es'")
def overlay_docs(spark: SparkSession, d: str) -> DataFrame:
    files = _as_files(spark, d)
    over = files.where("lang = 'de'").select("doc_id", F.concat(F.lit("moved/"), "path").alias("path"), (F.col("mtime_ns") + 1).alias("mtime_ns"))
    return I.live(files, files.where("lang = 'es'"), over).select("doc_id", "path", "mtime_ns")


@_add(
    "reconcile_plan",
    f"""WITH {_FILES}, q AS (SELECT f.*, quality FROM f LEFT JOIN labels USING (doc_id))
      SELECT 'Delete' AS action, doc_id, path FROM q WHERE lang = 'es'
      UNION ALL SELECT 'Patch', doc_id, 'moved/' || path FROM q WHERE lang = 'de'
      UNION ALL SELECT 'Patch', doc_id, path FROM q WHERE lang = 'fr' AND coalesce(quality, 1) <> 0
      UNION ALL SELECT 'Delete', doc_id, path FROM q WHERE lang IN ('fr', 'en') AND quality = 0
      UNION ALL SELECT 'Reindex', -1, path FROM q WHERE lang IN ('fr', 'en') AND quality = 0""",
)
def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    """es is deleted, de moved, fr touched, and what is labelled poor in en and fr rewritten."""
    docs = _as_files(spark, d)
    poor = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit(True).alias("labelled"), (F.col("quality") == 0).alias("poor"))
    now = docs.join(poor, "doc_id", "left").withColumn("poor", F.coalesce("poor", F.lit(False)) & F.col("lang").isin("en", "fr")).where("lang <> 'es'")
    touched = F.col("poor") | (F.col("lang") == "fr")
    now = now.select(
        F.when(F.col("lang") == "de", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "inode",
        F.when(touched, F.col("mtime_ns") + 7).otherwise(F.col("mtime_ns")).alias("mtime_ns"), "size", "kind",
        F.when(F.col("poor"), F.concat(F.lit("new"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    read = lambda files: now.join(files.select("path"), "path", "left_semi").select("path", "content_hash")
    return reconcile.reconcile(docs, now.drop("content_hash"), read).select("action", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "path")


@_add(
    "compact_postings",
    f"""WITH {_corpus_sql()}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 999999 AS new_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
      SELECT new_id AS doc_id, term, count(*)::INT AS tf FROM (SELECT DISTINCT * FROM tok WHERE term IN ('from', 'of', 'nicht')) JOIN ids USING (doc_id) GROUP BY new_id, term""",
)
def compact_postings(spark: SparkSession, d: str) -> DataFrame:
    src = source(spark, d)
    docs = I.live(I.doc_table(src, "doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1"))
    ids = merge.renumber(docs, 1_000_000)
    return merge.rewrite(docs, I.postings(src, "doc_id", "text", ["from", "of", "nicht"]), ids)[1].select("doc_id", "term", "tf")


@_add(
    "carry_forward",
    "WITH ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 499 AS new_id FROM documents) SELECT new_id AS doc_id FROM ids JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) USING (doc_id)",
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    ids = merge.renumber(source(spark, d), 500)
    return merge.carry_forward(ids, spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1"))


@_add(
    "best_snippet_line",
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
      n AS (SELECT doc_id, line_no, line, (list_contains(w, 'from')::INT + list_contains(w, 'with')::INT)::BIGINT AS "distinct"
            FROM (SELECT *, list_transform(regexp_extract_all(line, '[\p{L}\p{M}\p{N}_]+'), lambda x: lower(x)) AS w FROM lines))
      SELECT doc_id, line_no, line, "distinct" FROM n WHERE "distinct" > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "distinct" DESC, line_no) = 1""",
)
def best_snippet_line(spark: SparkSession, d: str) -> DataFrame:
    return snippet.best_lines(source(spark, d), ["from", "with"])


_VECTORS = {
    "parseHTTPResponse": "parsehttpresponse parse http response", "XMLHttpRequest": "xmlhttprequest xml http request", "utf8Decode": "utf8decode utf8 decode", "sha256": "sha256", "HTTP": "http",
    "__init__": "__init__ init", "Foo_foo": "foo_foo foo", "read_HttpHeader_v2": "read_httpheader_v2 read http header v2", "std::fs::read_to_string": "std fs read_to_string read to string",
    "don't 3.14": "don t 3 14", "日本語 text": "日 本 語 text", "한국어": "한국어", "hello 👋 world ✓": "hello world", "": "",
}


@_add("camel_tokens", "SELECT * FROM (VALUES " + ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in _VECTORS.items()) + ") AS t(input, terms)")
def camel_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k,) for k in _VECTORS], "input string")
    return rows.select("input", F.array_join(F.flatten(F.transform(T.atoms(F.col("input")), T.parts)), " ").alias("terms"))


_PARSED = {
    "foo AND bar baz": "(foo AND bar AND baz)", "a b OR c d OR e": "((a AND b) OR (c AND d) OR e)", "std::fs::read": '"std fs read"', "snake_case": "snake_case", "-bar foo": "(foo AND NOT bar)",
    "foo -": "foo", 'a"b c"d': '(a AND "b c" AND d)', "foo -(a OR b)": "(foo AND NOT (a OR b))", "foo OR -bar": "OnlyNegation", "foo --bar": "Unexpected - at byte 5", "()": "Unexpected ) at byte 1",
    "Café )": "UnbalancedParen at byte 6", 'foo "bar': "UnterminatedPhrase at byte 4", "!!! ...": "Empty", "foo -AND": "Unexpected AND at byte 5", "(foo": "UnbalancedParen at byte 0",
}


@_add("parse_queries", "SELECT * FROM (VALUES " + ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in _PARSED.items()) + ") AS t(query, parsed)")
def parse_queries(spark: SparkSession, d: str) -> DataFrame:
    def shown(q: str) -> str:
        try:
            return describe(parse(q))
        except QueryError as e:
            return str(e)

    return spark.createDataFrame([(q, shown(q)) for q in _PARSED], "query string, parsed string")


@_add("merge_plan", "SELECT * FROM (VALUES (0::BIGINT, 7::BIGINT), (1, 0), (1, 1), (1, 2), (1, 3)) AS t(merge_group, segment)")
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """Four small segments merge, one with many deletions is rewritten, the large ones are left, with few deletions or many."""
    from .sources.store import Segment

    mib = 1 << 20
    have = [Segment(str(i), i * 100, 100, 0, 0, mib) for i in range(4)] + [Segment("5", 500, 100, 0, 0, 600 * mib), Segment("6", 600, 100, 0, 30, 40 * mib), Segment("7", 700, 100, 0, 31, 40 * mib), Segment("8", 800, 100, 0, 25, 600 * mib), Segment("9", 900, 100, 0, 60, 600 * mib)]
    rows = [(g, int(s.name)) for g, group in enumerate(merge.plan_merges(have)) for s in group]
    return spark.createDataFrame(rows, "merge_group long, segment long")


def stored(spark: SparkSession, d: str, segments: int = 3) -> Root:
    """The documents as a stored index of some segments, in the shared folder: docs and postings written, named by a manifest."""
    root = Root(spark, shared_folder(spark))
    files = _dealt(spark, _as_files(spark, d, "text"))
    low, high = files.agg(F.min("doc_id"), F.max("doc_id")).first()
    bases = sorted({low + i * (high + 1 - low) // segments for i in range(segments)})
    made = [root.store.write_segment(files.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)), a) for a, b in zip(bases, [*bases[1:], high + 1], strict=True)]
    root.store.commit(Manifest(1, high + 1, 0, tuple(s for s in made if s)))
    return root


def _every(root: Root, query: str) -> DataFrame:
    """All matches in a stored index, with their paths."""
    return root.search(query).every.join(root.store.docs().select("doc_id", "path"), "doc_id")


_PATHS = "JOIN f USING (doc_id)"
_NO_ES = "WHERE lang <> 'es'"


@_add("stored_search", _sql('"of the" from', out="SELECT doc_id, round(score, 6) AS score FROM found"))
def stored_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stored(spark, d).search('"of the" from').every)


@_add("stored_boolean", _sql('(from OR "of the") the -nicht', out="SELECT doc_id, round(score, 6) AS score FROM found"))
def stored_boolean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stored(spark, d, 5).search('(from OR "of the") the -nicht').every)


@_add("stored_page", _sql("of the", out="SELECT doc_id, round(score, 6) AS score FROM found ORDER BY found.score DESC, doc_id LIMIT 10 OFFSET 20"))
def stored_page(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stored(spark, d).search("of the", 10, 20).hits)


@_add("stored_delete", _sql("from", where="WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def stored_delete(spark: SparkSession, d: str) -> DataFrame:
    """Tombstones leave the results and the statistics."""
    root = stored(spark, d)
    root.store.delete(spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id"))
    return rounded(root.search("from").every)


@_add("stored_overlay", f"WITH {_FILES}, {match_sql('nicht')} SELECT doc_id, CASE WHEN lang = 'de' THEN 'moved/' || path ELSE path END AS path, round(score, 6) AS score FROM found {_PATHS}")
def stored_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Moved files keep their ids and postings; only an overlay row is written."""
    root = stored(spark, d)
    moved = _as_files(spark, d).where("lang = 'de'").select("doc_id", F.concat(F.lit("moved/"), "path").alias("path"), "inode", "mtime_ns", "size")
    m = root.store.manifest()
    root.store.commit(replace(m, generation=2, overlay=root.store.write_overlay(moved)))
    return rounded(_every(root, "nicht"), "doc_id", "path")


def _merged(spark: SparkSession, d: str) -> Root:
    """Five segments, all of one language deleted, merged to one."""
    root = stored(spark, d, 5)
    root.store.delete(_as_files(spark, d).where("lang = 'es'").select("doc_id"))
    root.merge(merge.MergePolicy(max_deleted=0.9, min_members=2, floor_bytes=1 << 40, max_bytes=1 << 41))
    return root


@_add("stored_merge", f"WITH {_FILES}, {match_sql('of the', where=_NO_ES)} SELECT path, round(score, 6) AS score FROM found {_PATHS}")
def stored_merge(spark: SparkSession, d: str) -> DataFrame:
    """After a merge documents have new ids; paths, matches and scores are those of the survivors."""
    return rounded(_every(_merged(spark, d), "of the"), "path")


@_add(
    "stored_stats",
    f"WITH {_corpus_sql(where=_NO_ES)}, t AS ({_DF}) SELECT (SELECT count(*) FROM d) AS docs_total, (SELECT sum(len)::BIGINT FROM d) AS tokens, (SELECT count(*) FROM t) AS unique_terms, "
    "(SELECT sum(df)::BIGINT FROM t) AS postings, 1::BIGINT AS segments, 3::BIGINT AS generation",
)
def stored_stats(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a merged index: nothing of deleted documents is left in it."""
    s = _merged(spark, d).stats()
    return spark.createDataFrame([(s["docs_total"], s["tokens"], s["unique_terms"], s["postings"], s["segments"], s["generation"])], "docs_total long, tokens long, unique_terms long, postings long, segments long, generation long")


@_add(
    "stored_verify",
    f"WITH {_corpus_sql()} SELECT 3::BIGINT AS segments, (SELECT count(*) FROM d) AS docs, (SELECT count(*) FROM (SELECT DISTINCT term, doc_id FROM tok)) AS postings, 0::BIGINT AS problems",
)
def stored_verify(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's counts against the tables, and the number of problems that verification finds."""
    root = stored(spark, d)
    m = root.store.manifest()
    row = (len(m.segments), sum(s.num_docs - s.num_deleted for s in m.segments), sum(s.num_postings for s in m.segments), len(root.verify()))
    return spark.createDataFrame([row], "segments long, docs long, postings long, problems long")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Boolean, phrase and negation in one ranked search."""
    return rounded(Q.page(match(spark, d, '(from OR "of the") the -nicht')))
