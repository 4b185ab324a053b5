"""An index on disk: generations of Parquet tables under one commit file.

``MANIFEST`` names a generation's segments, tombstones and overlay; it is replaced by one atomic
rename, the only moment at which a change becomes visible. Folders are never changed once named;
those no manifest in use names are removed after the rename, best effort. Readers pin what they
opened. A missing or broken manifest is no index; another format version is an error.
"""

from __future__ import annotations

import atexit
import fcntl
import json
import os
import re
import shutil
import tempfile
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..scratch import Scratch

VERSION = 1
DOCS = "doc_id long, path string, inode long, mtime_ns long, size long, len long, status string, content_hash string"
POSTINGS = "term string, doc_id long, tf int, positions array<int>"


class StoreError(Exception):
    pass


class NoIndex(StoreError):
    pass


class Incompatible(StoreError):
    pass


class Locked(StoreError):
    pass


class Corrupt(StoreError):
    pass


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder for an index below the one that driver and executors share; a temporary one where nothing is configured and all run in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.master.split("[")[0] != "local":
        raise StoreError("spark.checkpoint.dir names no folder that all executors share")
    if named and not named.startswith(("file:", "/")):
        raise StoreError(f"a store needs a mounted folder, not {named}")
    top = re.sub("^file:/+", "/", named) if named else tempfile.mkdtemp(prefix="lexiquarry-")
    folder = os.path.join(top, "lexiquarry", f"store-{uuid.uuid4().hex[:12]}")
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder if named else top, ignore_errors=True)
    return folder


@dataclass(frozen=True)
class Segment:
    name: str
    base: int
    num_docs: int
    num_postings: int
    num_deleted: int = 0
    total_bytes: int = 0

    @property
    def live_fraction(self) -> float:
        return 1 - self.num_deleted / self.num_docs if self.num_docs else 0.0


@dataclass(frozen=True)
class Manifest:
    generation: int
    id_bound: int
    commit_ns: int
    segments: tuple[Segment, ...] = ()
    tombstones: str | None = None
    overlay: str | None = None
    version: int = VERSION

    def names(self) -> set[str]:
        return {s.name for s in self.segments} | {x for x in (self.tombstones, self.overlay) if x}


@dataclass
class Files:
    """The few file operations a commit needs; tests put a failing one in its place."""

    calls: list = field(default_factory=list)

    def write(self, path: str, text: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())

    def rename(self, old: str, new: str) -> None:
        os.replace(old, new)

    def sync(self, folder: str) -> None:
        fd = os.open(folder, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def remove(self, path: str) -> None:
        shutil.rmtree(path, ignore_errors=True)


class Store:
    def __init__(self, spark: SparkSession, folder: str, files: Files | None = None):
        self.spark, self.folder, self.files = spark, folder, files or Files()
        self.pinned: dict[str, int] = {}

    # manifest

    @property
    def _file(self) -> str:
        return os.path.join(self.folder, "MANIFEST")

    def manifest(self) -> Manifest | None:
        try:
            with open(self._file, encoding="utf-8") as f:
                raw = json.load(f)
        except (FileNotFoundError, NotADirectoryError, json.JSONDecodeError, UnicodeDecodeError):
            return None
        if not isinstance(raw, dict) or "version" not in raw:
            return None
        if raw["version"] != VERSION:
            raise Incompatible(f"format version {raw['version']}, this is {VERSION}")
        try:
            found = Manifest(**{**raw, "segments": tuple(Segment(**s) for s in raw["segments"])})
        except (TypeError, KeyError):
            return None
        at = 0
        for s in found.segments:
            if s.base < at or s.num_docs < 0 or not 0 <= s.num_deleted <= s.num_docs:
                raise Corrupt(f"segment {s.name} is out of order or miscounted")
            at = s.base + s.num_docs
        if at > found.id_bound:
            raise Corrupt("a segment goes beyond the id bound")
        return found

    def commit(self, new: Manifest) -> Manifest:
        os.makedirs(self.folder, exist_ok=True)
        before = self.manifest()
        self.files.sync(self.folder)
        self.files.write(self._file + ".tmp", json.dumps(asdict(new)))
        self.files.rename(self._file + ".tmp", self._file)
        self.files.sync(self.folder)
        if before:
            for name in before.names() - new.names() - set(self.pinned):
                self.files.remove(os.path.join(self.folder, name))
        return new

    @contextmanager
    def lock(self, wait: float = 0.5):
        """One writer at a time, across processes."""
        os.makedirs(self.folder, exist_ok=True)
        fd = os.open(os.path.join(self.folder, "LOCK"), os.O_CREAT | os.O_RDWR)
        try:
            end = time.monotonic() + wait
            while True:
                try:
                    fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() >= end:
                        raise Locked(self.folder) from None
                    time.sleep(0.02)
            yield
        finally:
            os.close(fd)

    def sweep(self) -> list[str]:
        """Removes folders that no manifest names; only to be called under the lock, and only with a manifest."""
        found = self.manifest()
        if found is None:
            return []
        gone = [n for n in os.listdir(self.folder) if os.path.isdir(os.path.join(self.folder, n)) and n not in found.names() and n not in self.pinned]
        for n in gone:
            self.files.remove(os.path.join(self.folder, n))
        return gone

    # reading

    def _path(self, name: str, table: str = "") -> str:
        return "file://" + os.path.join(os.path.abspath(self.folder), name, table)

    def _all(self, manifest: Manifest, table: str, schema: str) -> DataFrame:
        """Segments have ids of their own, so their rows are only put side by side."""
        out = None
        for s in manifest.segments:
            part = self.spark.read.schema(schema).parquet(self._path(s.name, table))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _need(self, manifest: Manifest | None) -> Manifest:
        found = manifest or self.manifest()
        if found is None:
            raise NoIndex(self.folder)
        return found

    def tombstones(self, manifest: Manifest | None = None) -> DataFrame:
        m = self._need(manifest)
        return self.spark.read.schema("doc_id long").parquet(self._path(m.tombstones)) if m.tombstones else self.spark.createDataFrame([], "doc_id long")

    def overlay(self, manifest: Manifest | None = None) -> DataFrame:
        schema = "doc_id long, path string, inode long, mtime_ns long, size long"
        m = self._need(manifest)
        return self.spark.read.schema(schema).parquet(self._path(m.overlay)) if m.overlay else self.spark.createDataFrame([], schema)

    def docs(self, manifest: Manifest | None = None) -> DataFrame:
        m = self._need(manifest)
        return I.live(self._all(m, "docs", DOCS), self.tombstones(m) if m.tombstones else None, self.overlay(m) if m.overlay else None)

    def postings(self, manifest: Manifest | None = None) -> DataFrame:
        m = self._need(manifest)
        return self._all(m, "postings", POSTINGS + ", bucket int")

    @contextmanager
    def snapshot(self):
        """A manifest whose files stay while it is in use."""
        m = self._need(None)
        for n in m.names():
            self.pinned[n] = self.pinned.get(n, 0) + 1
        try:
            yield m
        finally:
            for n in m.names():
                self.pinned[n] -= 1
                if not self.pinned[n]:
                    del self.pinned[n]

    # writing

    def write_segment(self, source: DataFrame, base: int, buckets: int = 16) -> Segment | None:
        """``source``: doc_id (from ``base`` up), DOCS' columns but len, and text. Written, not yet named by a manifest."""
        name = f"seg-{uuid.uuid4().hex[:12]}"
        docs = source.withColumn("len", F.when(F.col("status") == "Indexed", F.size(I.T.atoms(F.col("text")))).otherwise(F.lit(0)).cast("long"))
        docs.select(*[c.split()[0] for c in DOCS.split(", ")]).write.parquet(self._path(name, "docs"))
        indexed = source.where(F.col("status") == "Indexed")
        layout = I.stored_layout(I.postings(indexed, "doc_id", "text", unique=True), buckets)
        layout.select("term", "doc_id", F.col("tf").cast("int").alias("tf"), "positions", "bucket").write.partitionBy("bucket").parquet(self._path(name, "postings"))
        n = self.spark.read.parquet(self._path(name, "docs")).agg(F.count(F.lit(1)), F.max("doc_id")).first()
        if not n[0]:
            self.files.remove(os.path.join(self.folder, name))
            return None
        return Segment(name, base, n[1] - base + 1, self._count(name, "postings"), n[1] - base + 1 - n[0], _size(os.path.join(self.folder, name)))

    def _count(self, name: str, table: str) -> int:
        folder = os.path.join(self.folder, name, table)
        return self.spark.read.parquet("file://" + os.path.abspath(folder)).count() if any(f.endswith(".parquet") for _, _, fs in os.walk(folder) for f in fs) else 0

    def write_ids(self, ids: DataFrame) -> str:
        name = f"del-{uuid.uuid4().hex[:12]}"
        ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().write.parquet(self._path(name))
        return name

    def write_overlay(self, rows: DataFrame) -> str:
        name = f"ovl-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(self._path(name))
        return name

    def delete(self, ids: DataFrame) -> Manifest | None:
        """Adds tombstones; ids that are gaps or already deleted are passed over, and without any there is no commit."""
        m = self._need(None)
        hit = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(self._all(m, "docs", DOCS).select("doc_id"), "doc_id", "left_semi")
        hit = hit.join(self.tombstones(m), "doc_id", "left_anti")
        counts = {r.base: r.n for r in self._segment_of(hit, m).groupBy("base").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return None
        name = self.write_ids(self.tombstones(m).unionByName(hit))
        segments = tuple(replace(s, num_deleted=s.num_deleted + counts.get(s.base, 0)) for s in m.segments)
        return self.commit(replace(m, generation=m.generation + 1, commit_ns=time.time_ns(), tombstones=name, segments=segments))

    @staticmethod
    def _segment_of(ids: DataFrame, m: Manifest) -> DataFrame:
        base = F.lit(None).cast("long")
        for s in m.segments:
            base = F.when((F.col("doc_id") >= s.base) & (F.col("doc_id") < s.base + s.num_docs), F.lit(s.base)).otherwise(base)
        return ids.withColumn("base", base)

    # integrity

    def _by_document(self, posts: DataFrame, n: int) -> DataFrame:
        """doc_id, most: how often the most frequent hash of a term is there for a document. Kept, as two checks read it; a task groups about 4 million postings at most, however many there are."""
        dealt = posts.select("doc_id", F.xxhash64("term").alias("h")).repartition(max(self.spark.sparkContext.defaultParallelism, n // 4_000_000 + 1), "doc_id")
        return Scratch(self.spark).keep(dealt.groupBy("doc_id", "h").count().groupBy("doc_id").agg(F.max("count").alias("most")), "held")

    def verify(self) -> list[str]:
        """What is wrong with the index; an empty list if nothing is."""
        m = self._need(None)
        out = []
        for s in m.segments:
            if not os.path.isdir(os.path.join(self.folder, s.name)):
                return [f"{s.name} is missing"]
        try:
            docs, posts = self._all(m, "docs", DOCS), self.postings(m)
            d = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if((F.col("status") != "Indexed") & (F.col("len") > 0)).alias("odd")).first()
            if d.n != d.ids:
                out.append("a document id is there twice")
            if d.odd:
                out.append("a document that isn't indexed has a length")
            rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("positions") - 1, F.lit(1))), lambda i: F.coalesce(F.get("positions", i) > F.get("positions", i - 1), F.lit(True)))
            p = posts.agg(
                F.count(F.lit(1)).alias("n"),
                F.count_if(F.col("tf") != F.size("positions")).alias("tf"),
                F.count_if(~rising).alias("order"),
                F.count_if(F.octet_length("term") > I.T.MAX_TERM_BYTES).alias("long"),
            ).first()
            out += [text for bad, text in ((p.tf, "a frequency isn't the number of places"), (p.order, "places don't rise"), (p.long, "a term is too long")) if bad]
            if p.n != sum(s.num_postings for s in m.segments):
                out.append("the manifest counts other postings")
            held = self._by_document(posts, sum(s.num_postings for s in m.segments))
            twice = held.where("most > 1").select("doc_id")
            # equal hashes only name documents to look at; their terms are compared
            if not twice.isEmpty() and posts.join(twice, "doc_id", "left_semi").groupBy("term", "doc_id").count().where("count > 1").limit(1).count():
                out.append("a term is there twice for a document")
            if held.join(docs.where(F.col("status") == "Indexed"), "doc_id", "left_anti").limit(1).count():
                out.append("a posting belongs to no indexed document")
        except Exception as e:  # unreadable files are what verification is to find
            out.append(f"unreadable: {str(e).splitlines()[0][:200]}")
        return out


def _size(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
