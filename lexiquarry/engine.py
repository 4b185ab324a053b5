"""The engine: indexes of directory trees and of tables, one lock a root, several roots in one search."""

from __future__ import annotations

import json
import os
import statistics
import threading
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index as I
from .operators import merge as M
from .operators import reconcile as R
from .operators import snippet as S
from .plans import search as Q
from .plans.parser import parse
from .sources.crawl import CrawlConfig, contents, crawl, crawl_stats
from .sources.store import Files, Manifest, NoIndex, Store
from .streaming.watch import Clock, Events, watch

SEGMENT_DOCS = 8192
SOURCE = ["doc_id", "path", "inode", "mtime_ns", "size", "status", "content_hash", "text"]


class Root:
    """One directory tree and its index."""

    def __init__(self, spark: SparkSession, path: str, config: CrawlConfig = CrawlConfig(), files: Files | None = None):
        self.spark, self.path, self.config = spark, os.path.realpath(path), config
        if not os.path.isdir(self.path):
            raise NotADirectoryError(path)
        self.store = Store(spark, os.path.join(self.path, config.own_dir), files)
        self.serial = threading.Lock()

    def _write(self, files: DataFrame, base: int) -> list:
        """Contents of ``files`` as segments of at most 8,192 documents, ids by path from ``base`` up."""
        numbered = I.with_ids(files, base)
        n = numbered.count()
        out = []
        read = contents(numbered.drop("doc_id"), self.path).join(numbered.select("path", "doc_id"), "path").select(*SOURCE)
        for start in range(base, base + n, SEGMENT_DOCS):
            part = read.where((F.col("doc_id") >= start) & (F.col("doc_id") < start + SEGMENT_DOCS))
            segment = self.store.write_segment(part, start)
            if segment:
                out.append(segment)
        return out, base + n

    def build(self) -> dict:
        """Indexes everything anew, as the next generation."""
        began = time.perf_counter()
        with self.serial, self.store.lock():
            before = self.store.manifest()
            files = crawl(self.spark, self.path, self.config)
            segments, bound = self._write(files, 0)
            self.store.commit(Manifest((before.generation if before else 0) + 1, bound, time.time_ns(), tuple(segments)))
        return {**self.stats(), **crawl_stats(files).first().asDict(), "seconds": time.perf_counter() - began}

    def update(self) -> dict:
        """Follows what has changed; without a base it builds, without a change it commits nothing."""
        if self.store.manifest() is None:
            return {**self.build(), "built": True}
        with self.serial, self.store.lock():
            m = self.store.manifest()
            docs = self.store.docs(m)
            changes = R.reconcile(docs, crawl(self.spark, self.path, self.config), lambda files: contents(files, self.path)).cache()
            counts = R.plan_counts(changes).first().asDict()
            if not any(counts.values()):
                changes.unpersist()
                return {**counts, "built": False, "generation": m.generation}
            files = changes.where("action = 'Reindex'").select("path", "inode", "mtime_ns", "size", "kind")
            segments, bound = self._write(files, m.id_bound)
            gone = changes.where("action = 'Delete'").select("doc_id")
            tombstones, deleted = m.tombstones, {}
            if counts["deletes"]:
                tombstones = self.store.write_ids(self.store.tombstones(m).unionByName(gone))
                deleted = {r.base: r["count"] for r in self.store._segment_of(gone.distinct(), m).groupBy("base").count().collect()}
            patches = changes.where("action = 'Patch'").select("doc_id", "path", "inode", "mtime_ns", "size")
            old = self.store.overlay(m).join(patches.select("doc_id"), "doc_id", "left_anti")
            merged = old.unionByName(patches).join(gone, "doc_id", "left_anti")
            overlay = self.store.write_overlay(merged) if counts["patches"] or (m.overlay and counts["deletes"]) else m.overlay
            kept = tuple(replace(s, num_deleted=s.num_deleted + deleted.get(s.base, 0)) for s in m.segments)
            new = self.store.commit(replace(m, generation=m.generation + 1, id_bound=bound, commit_ns=time.time_ns(), segments=kept + tuple(segments), tombstones=tombstones, overlay=overlay))
            changes.unpersist()
            return {**counts, "built": False, "generation": new.generation}

    def prepare_merge(self, policy: M.MergePolicy = M.MergePolicy()) -> list[tuple]:
        """Rewrites without the lock: per group the old segments, the new one, and old to new ids."""
        m = self.store.manifest()
        if m is None:
            raise NoIndex(self.path)
        out, base = [], m.id_bound
        for group in M.plan_merges(m.segments, policy):
            part = replace(m, segments=tuple(group))
            docs = self.store.docs(part)
            ids = M.renumber(docs, base)
            new_docs, new_posts = M.rewrite(docs, self.store.postings(part).drop("bucket"), ids)
            name = self._write_merged(new_docs, new_posts, base)
            mapping = self.store.write_overlay(ids)
            n = ids.count()
            out.append((tuple(group), name and replace(name, num_docs=n), mapping, base))
            base += n
        return out

    def _write_merged(self, docs: DataFrame, posts: DataFrame, base: int):
        import uuid

        from .sources.store import DOCS, Segment, _size

        name = f"seg-{uuid.uuid4().hex[:12]}"
        docs.select(*[c.split()[0] for c in DOCS.split(", ")]).write.parquet(self.store._path(name, "docs"))
        I.stored_layout(posts).select("term", "doc_id", "tf", "positions", "bucket").write.partitionBy("bucket").parquet(self.store._path(name, "postings"))
        return Segment(name, base, 0, self.store._count(name, "postings"), 0, _size(os.path.join(self.store.folder, name)))

    def commit_merges(self, prepared: list[tuple]) -> int:
        """One generation for all groups; a group whose sources have changed hands is dropped, deletions made meanwhile are carried over."""
        if not prepared:
            return 0
        with self.serial, self.store.lock():
            m = self.store.manifest()
            segments, tombs, bound, done = list(m.segments), self.store.tombstones(m), m.id_bound, 0
            overlay, late = self.store.overlay(m), None
            for group, new, mapping, _ in prepared:
                names = {s.name for s in group}
                if not names <= {s.name for s in segments} or new.base < m.id_bound:
                    self.store.files.remove(os.path.join(self.store.folder, new.name))
                    continue
                ids = self.spark.read.schema("old_id long, doc_id long").parquet(self.store._path(mapping))
                carried = M.carry_forward(ids, tombs)
                dead = carried.count()
                patched = overlay.withColumnRenamed("doc_id", "old_id").join(ids, "old_id").drop("old_id")
                late = (patched, carried) if late is None else (late[0].unionByName(patched), late[1].unionByName(carried))
                segments = [s for s in segments if s.name not in names]
                if new.num_docs:
                    segments.append(replace(new, num_deleted=dead))
                bound = max(bound, new.base + new.num_docs)
                done += 1
            if done:
                ranges = [(s.base, s.base + s.num_docs) for s in segments if s.name in {x.name for x in m.segments}]
                inside = F.lit(False)
                for a, b in ranges:
                    inside = inside | ((F.col("doc_id") >= a) & (F.col("doc_id") < b))
                ids_left = tombs.where(inside).unionByName(late[1])
                over_left = overlay.where(inside).select("doc_id", "path", "inode", "mtime_ns", "size").unionByName(late[0].select("doc_id", "path", "inode", "mtime_ns", "size"))
                self.store.commit(
                    replace(
                        m, generation=m.generation + 1, id_bound=bound, commit_ns=time.time_ns(), segments=tuple(sorted(segments, key=lambda s: s.base)),
                        tombstones=self.store.write_ids(ids_left), overlay=self.store.write_overlay(over_left) if m.overlay else None,
                    )
                )
            self.store.sweep()
            return done

    def merge(self, policy: M.MergePolicy = M.MergePolicy()) -> int:
        return self.commit_merges(self.prepare_merge(policy))

    def delete(self, ids: list[int]) -> Manifest | None:
        with self.serial, self.store.lock():
            return self.store.delete(self.spark.createDataFrame([(i,) for i in ids], "doc_id long"))

    def search(self, query: str, limit: int = Q.DEFAULT_LIMIT, offset: int = 0) -> Q.Result:
        node = parse(query)
        m = self.store.manifest()
        if m is None:
            self.build()
            m = self.store.manifest()
        return Q.search(self.store.postings(m), self.store.docs(m), node, limit, offset)

    def texts(self, docs: DataFrame) -> DataFrame:
        """doc_id and text of documents, read again from the tree."""
        files = docs.select("path", "inode", "mtime_ns", "size", F.lit("Text").alias("kind"))
        return contents(files, self.path).select("path", "text").join(docs.select("path", "doc_id"), "path")

    def show(self, query: str, limit: int = Q.DEFAULT_LIMIT, offset: int = 0, width: int = 160) -> DataFrame:
        """The page of hits with path, line and snippet."""
        found = self.search(query, limit, offset)
        hits = found.hits.join(self.store.docs().select("doc_id", "path", "inode", "mtime_ns", "size"), "doc_id")
        return S.with_snippets(hits.select("doc_id", "score", "path"), self.texts(hits), query, width).orderBy(F.desc("score"), "doc_id")

    def stats(self) -> dict:
        m = self.store.manifest()
        if m is None:
            raise NoIndex(self.path)
        row = I.index_stats(self.store.docs(m), self.store.postings(m)).first().asDict()
        return {**row, "segments": len(m.segments), "generation": m.generation, "bytes_on_disk": sum(s.total_bytes for s in m.segments)}

    def verify(self) -> list[str]:
        return self.store.verify()

    def watch(self, events: Events, debounce: float = 0.5, periodic: float = 600.0, clock: Clock | None = None) -> int:
        return watch(events, lambda: self.update() and None, debounce, periodic, clock)


class Engine:
    """A registry of roots."""

    def __init__(self, spark: SparkSession):
        self.spark, self.roots = spark, {}

    def add_root(self, path: str, config: CrawlConfig = CrawlConfig()) -> Root:
        key = os.path.realpath(path)
        if key not in self.roots:
            self.roots[key] = Root(self.spark, key, config)
            self.roots[key].update()
        return self.roots[key]

    def remove_root(self, path: str) -> bool:
        return self.roots.pop(os.path.realpath(path), None) is not None

    def list_roots(self) -> list[str]:
        return sorted(self.roots)

    def search(self, query: str, limit: int = Q.DEFAULT_LIMIT, offset: int = 0, roots: list[str] | None = None) -> Q.Result:
        chosen = [self.roots[os.path.realpath(r)] for r in roots] if roots is not None else list(self.roots.values())
        if not chosen:
            raise NoIndex("no root")
        return Q.search_roots({r.path: (r.store.postings(), r.store.docs()) for r in chosen}, query, limit, offset)

    def status(self) -> DataFrame:
        rows = []
        for path, r in sorted(self.roots.items()):
            s = r.stats()
            rows.append((path, s["generation"], s["segments"], s["docs_total"], s["docs_indexed"], s["tokens"], s["bytes_on_disk"]))
        return self.spark.createDataFrame(rows, "root string, generation long, segments int, docs_total long, docs_indexed long, tokens long, bytes_on_disk long")

    def bench(self, path: str, queries: list[str], iterations: int = 20) -> list[dict]:
        """Milliseconds of warm searches: mean, min, p50, max."""
        root, out = self.add_root(path), []
        for q in queries:
            total = root.search(q).total()
            times = []
            for _ in range(iterations):
                began = time.perf_counter()
                root.search(q).hits.collect()
                times.append((time.perf_counter() - began) * 1e3)
            times.sort()
            out.append({"query": q, "matches": total, "mean": statistics.fmean(times), "min": times[0], "p50": times[len(times) // 2], "max": times[-1]})
        return out

    # line protocol

    def handle_line(self, line: str) -> list[str]:
        """Answers one JSON request line {id, method, params} with JSON lines; errors keep the id where it can be read."""
        ident = None
        try:
            request = json.loads(line)
            ident = request.get("id") if isinstance(request, dict) else None
            method, p = request["method"], request.get("params") or {}
            if method == "Query":
                found = self.search(p["query"], p.get("limit", Q.DEFAULT_LIMIT), p.get("offset", 0), p.get("roots"))
                hits = [json.dumps({"id": ident, "type": "Hit", **r.asDict()}) for r in found.hits.collect()]
                return [*hits, json.dumps({"id": ident, "type": "Done", "total": found.total()})]
            if method == "AddRoot":
                answer = self.add_root(p["path"]).path
            elif method == "RemoveRoot":
                answer = self.remove_root(p["path"])
            elif method == "ListRoots":
                answer = self.list_roots()
            elif method == "Status":
                answer = [r.asDict() for r in self.status().collect()]
            elif method in ("Reconcile", "Merge"):
                chosen = [self.roots[os.path.realpath(p["root"])]] if p.get("root") else list(self.roots.values())
                answer = [r.update() if method == "Reconcile" else r.merge() for r in chosen]
            else:
                raise ValueError(f"unknown method {method}")
            return [json.dumps({"id": ident, "type": "Result", "result": answer})]
        except Exception as e:  # a bad request must not end the connection
            return [json.dumps({"id": ident, "type": "Error", "error": str(e).splitlines()[0] if str(e) else type(e).__name__})]
