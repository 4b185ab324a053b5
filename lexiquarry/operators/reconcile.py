"""Change plans: what must be deleted, patched or indexed anew to follow a changed tree.

Metadata decides first, by a full outer join on the path and, for paths not known, a join on the
inode of documents whose own path has gone (so a new hard link takes nothing away). Only files that
metadata leaves open are read and compared by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("inode", "mtime_ns", "size")
CHANGES = ["action", "doc_id", "path", *META, "kind"]


def _same(a: str, b: str, names=META):
    met = F.lit(True)
    for n in names:
        met = met & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return met


def _actions(rows: DataFrame, action: str, keep_id: bool) -> DataFrame:
    return rows.select(F.lit(action).alias("action"), (F.col("p.doc_id") if keep_id else F.lit(None).cast("long")).alias("doc_id"), *[F.col(f"f.{c}").alias(c) for c in ("path", *META, "kind")])


def reconcile(docs: DataFrame, files: DataFrame, hashes) -> DataFrame:
    """(live docs, crawled files) -> action (Delete, Patch, Reindex), doc_id, and the file's metadata.

    ``hashes(files)`` gives path and content_hash of files that must be read (null: unreadable). It
    is called once, with the ambiguous files only.
    """
    p, f = docs.alias("p"), files.alias("f")
    known = p.join(f, F.col("p.path") == F.col("f.path"), "inner")
    moved = known.where(~_same("p", "f"))
    readable = (F.col("f.kind") == "Text") & F.col("p.status").isin("Indexed", "Skipped")
    lost = docs.join(files.select("path"), "path", "left_anti")
    new = files.join(docs.select("path"), "path", "left_anti")
    # one lost document an inode, the first by path, and one new file
    one = lost.where("inode <> 0").groupBy("inode").agg(F.min_by(F.struct(*lost.columns), "path").alias("d")).select("d.*")
    taker = new.where("inode <> 0").groupBy("inode").agg(F.min_by(F.struct(*new.columns), "path").alias("d")).select("d.*")
    renamed = one.alias("p").join(taker.alias("f"), F.col("p.inode") == F.col("f.inode"), "inner")
    same_meta = _same("p", "f", ("mtime_ns", "size"))
    cases = [c.select(F.struct("p.*").alias("p"), F.struct("f.*").alias("f"), F.lit(w).alias("how")) for c, w in ((moved.where(readable), "path"), (renamed.where(readable & ~same_meta), "inode"))]
    open_cases = cases[0].unionByName(cases[1])
    read = hashes(open_cases.select("f.*").distinct()).select(F.col("path").alias("_path"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_read"))
    compared = open_cases.join(read, F.col("f.path") == F.col("_path"), "left")
    equal = F.col("_hash").isNotNull() & F.col("_hash").eqNullSafe(F.col("p.content_hash"))
    patch = _actions(compared.where(equal), "Patch", True)
    different = compared.where(~equal & F.col("_hash").isNotNull())
    broken = compared.where(F.col("_hash").isNull())
    replaced = moved.where(~readable).select(F.struct("p.*").alias("p"), F.struct("f.*").alias("f"))
    swapped = renamed.where(~readable & ~same_meta).select(F.struct("p.*").alias("p"), F.struct("f.*").alias("f"))
    drop = lambda rows: rows.select(F.lit("Delete").alias("action"), F.col("p.doc_id").alias("doc_id"), F.col("p.path").alias("path"), *[F.col(f"p.{m}").alias(m) for m in META], F.lit(None).cast("string").alias("kind"))
    out = patch
    for rows in (different, replaced, swapped):
        out = out.unionByName(drop(rows)).unionByName(_actions(rows, "Reindex", False))
    out = out.unionByName(drop(broken.where("how = 'path'")))  # it is there but can't be read
    again = broken.where("how = 'inode'")
    out = out.unionByName(drop(again)).unionByName(_actions(again, "Reindex", False))
    out = out.unionByName(_actions(renamed.where(same_meta).select(F.struct("p.*").alias("p"), F.struct("f.*").alias("f")), "Patch", True))
    used_files = taker.join(one.select("inode"), "inode", "left_semi").select("path")
    out = out.unionByName(_actions(new.join(used_files, "path", "left_anti").select(F.struct("*").alias("f")), "Reindex", False))
    used_docs = one.join(taker.select("inode"), "inode", "left_semi").select("doc_id")
    gone = lost.join(used_docs, "doc_id", "left_anti").select(F.struct("*").alias("p"))
    return out.unionByName(drop(gone)).select(*CHANGES)


def plan_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("Delete", "deletes"), ("Patch", "patches"), ("Reindex", "reindexes"))])
