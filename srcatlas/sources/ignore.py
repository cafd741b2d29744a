"""Ignore files: documented git rules for *, **, ?, [], ! and a trailing slash, compiled to regular expressions."""

from __future__ import annotations

import re

ALWAYS = [".git", "node_modules"]


def rewrite(line: str, folder: str = "") -> str:
    """A pattern of the ignore file in `folder`, as seen from the root. A leading slash is dropped and a folder put in front, which anchors it."""
    text = line.strip()
    if not text or text.startswith("#"):
        return ""
    keep = text.startswith("!")
    body = text[1:] if keep else text
    body = body.removeprefix("/")
    return ("!" if keep else "") + (f"{folder}/{body}" if folder else body)


def compile_pattern(pattern: str) -> tuple[str, bool]:
    """(regular expression over paths, negated). Without an inner slash a pattern matches at any depth; with a trailing one folders only."""
    negated = pattern.startswith("!")
    p = pattern[1:] if negated else pattern
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    out, i = [], 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out.append("/.+")
            i += 3
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            inner = p[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(p[i]).replace("/", "/"))
            i += 1
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if only_dir else "(?:/|$)"), negated


class Ignore:
    """Rules in order; the last one that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules = [compile_pattern(x) for x in [*ALWAYS, *(x for x in lines if x)]]
        self._compiled = [(re.compile(r), n) for r, n in self.rules]

    def __call__(self, path: str) -> bool:
        out = False
        for r, negated in self._compiled:
            if r.search(path):
                out = not negated
        return out

    def column(self, path):
        """The same decision as a column, inside the JVM."""
        from pyspark.sql import functions as F

        out = F.lit(False)
        for r, negated in self.rules:
            out = F.when(path.rlike(r), F.lit(not negated)).otherwise(out)
        return out
