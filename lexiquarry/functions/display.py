"""Numbers, sizes, spans of time and paths for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def commas(n: int) -> str:
    return f"{n:,}"


def human_bytes(n: float) -> str:
    sign, n = ("-", -n) if n < 0 else ("", n)
    if n < 1024:
        return f"{sign}{int(n)} B"
    for unit in ("KiB", "MiB", "GiB", "TiB"):
        n /= 1024
        if n < 1024 or unit == "TiB":
            return f"{sign}{n:.1f} {unit}"
    raise AssertionError


def human_duration(seconds: float) -> str:
    if seconds < 1e-3:
        return f"{seconds * 1e6:.0f} µs"
    if seconds < 1:
        return f"{seconds * 1e3:.1f} ms"
    return f"{seconds:.2f} s"


def display_path(path: str, root: str, absolute: bool = False) -> str:
    """Below ``root`` without it; unchanged outside it, for the root itself, or if asked to be absolute."""
    if absolute or not root:
        return path
    base = root.rstrip("/")
    if path == base or not path.startswith(base + "/"):
        return path
    return path[len(base) :].lstrip("/") or path


def display_path_column(path: Column, root: str, absolute: bool = False) -> Column:
    if absolute or not root:
        return path
    base = root.rstrip("/")
    rest = F.ltrim(F.substring(path, len(base) + 1, 1 << 30), F.lit("/"))
    return F.when(path.startswith(base + "/") & (rest != ""), rest).otherwise(path)
