"""Ignore files: the common patterns of .gitignore and .ignore, honoured outside git too.

Supported: comments, negation, anchored and floating patterns, folder-only patterns, ``*``, ``?``,
``**`` and character classes, nested files overriding outer ones, later lines overriding earlier.
Not supported: global ignore files and .git/info/exclude.
"""

from __future__ import annotations

import re

NAMES = (".gitignore", ".ignore")


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if pattern.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return out


class Rules:
    """Rules of one ignore file, for paths below its folder."""

    def __init__(self, folder: str, text: str):
        self.folder = folder.strip("/")
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip("\r")
            if not line.endswith("\\ "):
                line = line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = _regex(line.lstrip("/"))
            self.rules.append((re.compile(body if anchored else f"(?:.*/)?{body}"), keep, only_dirs))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept by a negation, None: no rule says."""
        if self.folder:
            if not path.startswith(self.folder + "/"):
                return None
            path = path[len(self.folder) + 1 :]
        out = None
        for pattern, keep, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.fullmatch(path):
                out = not keep
        return out


def ignored(path: str, is_dir: bool, rules: list[Rules]) -> bool:
    """The innermost file with an opinion decides; ``rules`` go from outer to inner."""
    for r in reversed(rules):
        v = r.verdict(path, is_dir)
        if v is not None:
            return v
    return False
