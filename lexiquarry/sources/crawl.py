"""A directory tree as a table of files, and their contents read on the executors.

Spark's own file sources hide every path part that begins with a dot or an underscore, and show
neither inodes nor nanoseconds, so the walk is the driver's (metadata alone); contents are read,
sniffed, decoded and hashed in parallel from the table of paths. The tree must be at the same
place on every machine, as with any shared file system.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .ignore import NAMES, Rules, ignored

FILES = "path string, inode long, mtime_ns long, size long, kind string"
CONTENT = FILES + ", status string, text string, content_hash string"
SNIFF_BYTES = 8192


@dataclass(frozen=True)
class CrawlConfig:
    max_file_size: int = 10 << 20
    hidden: bool = True
    own_dir: str = ".lexiquarry"


def looks_binary(head: bytes) -> bool:
    return b"\0" in head[:SNIFF_BYTES]


def walk(root: str, config: CrawlConfig = CrawlConfig()) -> Iterator[tuple]:
    """(path, inode, mtime_ns, size) of every regular file that is not ignored; links are not followed."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)

    def below(folder: str, outer: list[Rules]) -> Iterator[tuple]:
        here = os.path.join(root, folder) if folder else root
        rules = list(outer)
        for name in NAMES:
            p = os.path.join(here, name)
            if os.path.isfile(p):
                with open(p, encoding="utf-8", errors="replace") as f:
                    rules.append(Rules(folder, f.read()))
        with os.scandir(here) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_symlink() or (not config.hidden and e.name.startswith(".")):
                    continue
                is_dir = e.is_dir(follow_symlinks=False)
                if is_dir and e.name in (".git", config.own_dir) or ignored(path, is_dir, rules):
                    continue
                if is_dir:
                    yield from below(path, rules)
                elif e.is_file(follow_symlinks=False):
                    s = e.stat(follow_symlinks=False)
                    yield path, s.st_ino, s.st_mtime_ns, s.st_size

    yield from below("", [])


def crawl(spark: SparkSession, root: str, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """The table of files: path, inode, mtime_ns, size, kind (Text, Binary or TooLarge)."""
    ship(spark)
    rows = sorted(walk(root, config))
    frame = spark.createDataFrame(rows, "path string, inode long, mtime_ns long, size long")
    most = config.max_file_size

    def sniff(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kinds = []
            for path, size in zip(part.path, part["size"], strict=True):
                if size > most:
                    kinds.append("TooLarge")
                    continue
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        kinds.append("Binary" if looks_binary(f.read(SNIFF_BYTES)) else "Text")
                except OSError:
                    kinds.append(None)
            yield part.assign(kind=kinds)

    tasks = max(1, min(len(rows) // 128 + 1, spark.sparkContext.defaultParallelism * 4))
    return frame.repartition(tasks).mapInPandas(sniff, FILES).where("kind IS NOT NULL")


def crawl_stats(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.count_if(F.col("kind") == "TooLarge").alias("too_large"),
        F.count_if(F.col("kind") == "Binary").alias("binary"),
        F.count_if(F.col("kind") == "Text").alias("indexable"),
        F.coalesce(F.sum(F.when(F.col("kind") == "Text", F.col("size"))), F.lit(0)).alias("bytes"),
    )


def contents(files: DataFrame, root: str) -> DataFrame:
    """Files with status (Indexed, Skipped, Binary, TooLarge), text and a hash of the raw bytes.

    Text must be UTF-8, a leading byte-order mark goes; what can't be read or decoded is Skipped.
    """

    ship(files.sparkSession)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            status, text, digest = [], [], []
            for path, kind in zip(part.path, part.kind, strict=True):
                s, t, h = (kind, None, None) if kind != "Text" else ("Skipped", None, None)
                if kind == "Text":
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            raw = f.read()
                        h = hashlib.sha256(raw).hexdigest()
                        t = raw.decode("utf-8").removeprefix("﻿")
                        s = "Indexed"
                    except (OSError, UnicodeDecodeError):
                        pass
                status.append(s)
                text.append(t)
                digest.append(h)
            yield part.assign(status=status, text=text, content_hash=digest)

    return files.mapInPandas(read, CONTENT)
