"""The best line of a document for a query, cut to a window, with highlights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.parser import Node, leaves, parse
from ..shipping import ship


@dataclass(frozen=True)
class Snippet:
    line_no: int
    text: str
    highlights: tuple[tuple[int, int], ...]


def best_line(text: str, terms: list[str]) -> tuple[int, str, list[tuple[int, int]]] | None:
    """Number from 1, line, spans of whole matching atoms; most distinct terms, the earliest of equals."""
    wanted, best = set(terms), None
    for number, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        seen, spans = set(), []
        for atom, a, b in T.atom_spans(line):
            hit = wanted.intersection(T.atom_terms(atom))
            if hit:
                seen |= hit
                spans.append((a, b))
        if seen and (best is None or len(seen) > best[0]):
            best = (len(seen), number, line, spans)
            if len(seen) == len(wanted):
                break
    return best[1:] if best else None


def cut(line: str, spans: list[tuple[int, int]], width: int) -> tuple[str, list[tuple[int, int]]]:
    """The trimmed line in a window of ``width`` signs with the first hit a quarter in; 0 cuts nothing."""
    lead = len(line) - len(line.lstrip())
    line = line.strip()
    spans = [(a - lead, b - lead) for a, b in spans if a >= lead and b - lead <= len(line)]
    if not width or len(line) <= width or not spans:
        return (line, spans) if not width or len(line) <= width else (line[:width] + "…", spans)
    start = min(max(spans[0][0] - width // 4, 0), len(line) - width)
    end = start + width
    head, tail = "…" if start else "", "…" if end < len(line) else ""
    moved = [(a - start + len(head), b - start + len(head)) for a, b in spans if a >= start and b <= end]
    return head + line[start:end] + tail, moved


def snippet(text: str | None, query: str | Node, width: int = 160) -> Snippet | None:
    terms = leaves(parse(query) if isinstance(query, str) else query, positive_only=True)
    found = best_line(text, terms) if text and terms else None
    if not found:
        return None
    shown, spans = cut(found[1], found[2], width)
    return Snippet(found[0], shown, tuple(spans))


def render(s: Snippet, color: bool = False) -> str:
    out, at = "", 0
    for a, b in s.highlights:
        out += s.text[at:a] + ("\x1b[1;31m" + s.text[a:b] + "\x1b[0m" if color else "[" + s.text[a:b] + "]")
        at = b
    return out + s.text[at:]


def with_snippets(hits: DataFrame, texts: DataFrame, query: str | Node, width: int = 160) -> DataFrame:
    """Hits (a page of them) with line_no, snippet and highlights; null where no line matches."""
    ship(hits.sparkSession)
    node = parse(query) if isinstance(query, str) else query
    # a page has few ids, so texts are only passed by; those of the page alone meet it again
    texts = texts.select("doc_id", "text").join(hits.select("doc_id"), "doc_id", "left_semi")
    joined = hits.join(texts, "doc_id", "left")
    fields = joined.drop("text").schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [snippet(t if isinstance(t, str) else None, node, width) for t in part.text]
            yield part.drop(columns="text").assign(
                line_no=pd.array([s.line_no if s else None for s in found], dtype="Int32"),
                snippet=[render(s) if s else None for s in found],
                highlights=[[{"start": a, "end": b} for a, b in s.highlights] if s else None for s in found],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", line_no int, snippet string, highlights array<struct<start:int,end:int>>"
    return joined.mapInPandas(run, schema)


def best_lines(texts: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, line_no, line, distinct: the same choice of a line over whole tables, inside the JVM."""
    lines = texts.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("i", "line"))
    found = F.array_distinct(F.flatten(F.transform(T.atoms(F.col("line")), T.parts)))
    scored = lines.withColumn("distinct", F.size(F.array_intersect(found, F.array(*[F.lit(t) for t in terms])))).where("distinct > 0")
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct((F.col("i") + 1).alias("line_no"), "line", "distinct"), F.struct("distinct", -F.col("i"))).alias("b"))
    return best.select("doc_id", F.col("b.line_no").cast("long").alias("line_no"), F.col("b.line").alias("line"), F.col("b.distinct").cast("long").alias("distinct"))
