"""Telling sources nobody wrote by hand in their repository from hand-written ones.

1. Layout statistics with thresholds per language: line lengths (longest and mean), the shares of white space and of
   letters and digits, the density of numeric literals, long encoded runs and how few line shapes a file repeats.
2. Copies: code, without comments and white space, that stands in MANY_REPOS repositories or more was not written
   in each of them. That is a count over all files, joined back on a hash.
3. What neither can see is read where tools and publishers put it: a notice that opens a comment at the start or end of
   the file, and the folders and versioned names that package managers give to copies. Code equal to that of a
   copy known by this is a copy as well.

Words like "generated" or "vendor" inside a sentence, a string, a file name or a folder decide nothing. `p3_reasons` tells which
of the three found a file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language.

    Each lies between the outermost thousandth of hand-written files and what the others show; the sample is every code file
    of the test table sf0.1 (about 13,600 latest rows) without notice, place or copies.
    """

    blank_share: float  # less white space than this outside of strings is minified
    mean_line: float  # with lines this long on average
    max_line: int  # or one this long
    numeric: float  # share of characters in numeric literals
    literal: float  # share of characters in literals, where there is no logic
    sparse: float  # so few letters and digits, or so many, where there is no logic
    dense: float
    encoded: float = 0.60  # share of characters in long encoded runs
    shapes: float = 0.30  # distinct line shapes to lines, where names are numbered
    least_lines: int = 12
    least_chars: int = 160


LIMITS = {
    "js": Limits(blank_share=0.050, mean_line=100.0, max_line=410, numeric=0.20, literal=0.55, sparse=0.43, dense=0.86),
    "cjs": Limits(blank_share=0.050, mean_line=100.0, max_line=410, numeric=0.20, literal=0.55, sparse=0.43, dense=0.88),
    "mjs": Limits(blank_share=0.050, mean_line=100.0, max_line=410, numeric=0.20, literal=0.55, sparse=0.43, dense=0.86),
    "ts": Limits(blank_share=0.051, mean_line=90.0, max_line=440, numeric=0.20, literal=0.55, sparse=0.43, dense=0.86),
    "jsx": Limits(blank_share=0.043, mean_line=190.0, max_line=480, numeric=0.22, literal=0.60, sparse=0.40, dense=0.87),
    "tsx": Limits(blank_share=0.047, mean_line=200.0, max_line=440, numeric=0.22, literal=0.60, sparse=0.40, dense=0.87),
    "vue": Limits(blank_share=0.035, mean_line=190.0, max_line=600, numeric=0.25, literal=0.65, sparse=0.35, dense=0.90),
}
MANY_REPOS = 3  # hand-written files of the sample stand in two at most

# Notices of generators, as they open a comment.
_GENERATED = re.compile(
    r"""^(?:@generated\b(?!\s+(?:ids|names)\b)
    |code\ (?:auto-?)?generated\ (?:by|from)\b.*do\ not\ edit
    |auto-?generated\ (?:file|code|by|from)\b
    |(?:this|the)\ (?:file|code|module|source)\ (?:was|is|has\ been)\ (?:automatically\ |auto-?|machine-?)?generated\b
    |(?:automatically|machine)[\ -](?:generated|made|produced)\b
    |generated\ (?:by|from|with|using)\ \S+.*(?:do\ not\ (?:edit|modify|change)|changes?\ will\ be\ (?:lost|overwritten))
    |(?:produced|emitted|written|created)\ by\ \S+\ from\ \S+\ at\ build\ time
    |do\ not\ (?:edit|modify)\b.{0,40}\bgenerated\b
    |(?:ce\ )?fichier\ (?:est\ )?généré\ automatiquement
    |(?:diese\ datei\ wurde\ )?automatisch\ (?:erzeugt|generiert|erstellt)
    |(?:este\ )?(?:archivo|fichero|código)?\s*(?:fue\ )?(?:auto)?generado\ automáticamente
    |(?:este\ )?(?:arquivo|ficheiro)?\s*(?:foi\ )?gerado\ automaticamente
    |(?:ten\ )?plik\ (?:został\ )?wygenerowany\ automatycznie|wygenerowano\ automatycznie
    |(?:этот\ )?файл\ (?:создан|сгенерирован)\ автоматически|сгенерировано\ автоматически)""",
    re.I | re.X | re.S,
)
# Notices of third-party releases, as they open the first comment.
_THIRD_PARTY = re.compile(
    r"""^(?:@license\ +[\w@/.-]+\ +v?\d+\.\d+
    |[\w@/.-]+\ +v?\d+\.\d+(?:\.\d+)?\S*\s*(?:\||-\ upstream|[(]c[)]|-\ (?:MIT|BSD|Apache))
    |bundled\ third[- ]party\ code\b
    |(?:build|release|version)\ v?\d+\.\d+\S*,?\ see\ upstream
    |version\ *:\ *v?\d+\.\d+
    |(?:copied|vendored|imported)\ (?:unchanged\ |verbatim\ )?from\ \S+@?v?\d)""",
    re.I | re.X,
)
_UPSTREAM = re.compile(r"^\W*(?:[\w@/. -]+\n)?\W*(?:build|release)\ v?\d+\.\d+\S*, see upstream|^\W*[\w@/.-]+\n\W*version *: *v?\d", re.I)
_COPY_DIR = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|third[_-]party|thirdparty|external|externals|deps|contrib|js/libs?)/", re.I)
_VERSIONED = re.compile(r"(?:^|/)[A-Za-z][\w.]*[-@.]v?\d+\.\d+\.\d+(?:[-.]\w+)*\.[mc]?jsx?$")
_GENERATED_NAME = re.compile(r"(?:^|/)__generated__/|\.(?:generated|gen|pb|g)\.[mc]?[jt]sx?$|_pb\.[mc]?[jt]sx?$", re.I)
_COMMENT = re.compile(r"/\*[\s\S]*?\*/|(?m:^[ \t]*//[^\n]*(?:\n[ \t]*//[^\n]*)*)")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`")
_NUMBER = re.compile(r"(?<![\w$])[-+]?(?:0[xX][\da-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{120,}|(?:\\x[0-9a-fA-F]{2}){24,}|(?:%[0-9a-fA-F]{2}){40,}")
_LOGIC = re.compile(r"\b(?:function|return|if|for|while|switch|class|interface|await|throw)\b|=>")
_LEAST_COPY = 160  # characters of code whose copies count
_SHAPE = re.compile(r"[A-Za-z_$][\w$]*|\d+")


_NOTICE = re.compile(r"[\s;]*(/\*[\s\S]*?\*/|//[^\n]*)")


def _strip(comment: str) -> str:
    lines = [re.sub(r"^[\s/*!#]+|[\s*/]+$", "", x) for x in comment.split("\n")]
    return "\n".join(x for x in lines if x)


def notices(content: str) -> tuple[list[str], list[str]]:
    """The comments before the first code and those after the last, without their marks."""
    head, at = [], 0
    if content.startswith("#!"):
        at = content.find("\n") + 1 or len(content)
    while True:
        m = _NOTICE.match(content, at)
        if not m:
            break
        head.append(_strip(m[1]))
        at = m.end()
    tail, rest = [], content.rstrip()
    while at < len(rest):
        if rest.endswith("*/"):
            start = rest.rfind("/*")
        else:
            start = rest.rfind("\n") + 1
            if not rest[start:].lstrip().startswith("//"):
                break
        if start < at:
            break
        tail.append(_strip(rest[start:]))
        rest = rest[:start].rstrip()
    return head, tail


def statistics(content: str) -> dict[str, float]:
    """Layout statistics of a source without its comments; line lengths and white space leave strings out. Comments only: n = 0."""
    return layout(_COMMENT.sub("", content).strip())


def layout(code: str) -> dict[str, float]:
    n = len(code)
    if not n:
        return {"n": 0}
    bare = _STRING.sub("''", code)
    lines = [x for x in code.splitlines() if x.strip()]
    outer = [x.strip() for x in bare.splitlines() if x.strip()]
    inner = sum(map(len, outer))
    blanks = sum(x.count(" ") + x.count("\t") for x in outer)
    strings = n - len(bare)
    numbers = sum(map(len, _NUMBER.findall(code)))
    outside = sum(map(len, _NUMBER.findall(bare)))
    shapes = [_SHAPE.sub(lambda m: "0" if m[0][0].isdigit() else "a", x.strip()) for x in lines]
    return {
        "n": n,
        "lines": len(lines),
        "max_line": max(map(len, outer)),
        "mean_line": inner / len(outer),
        "blank_share": blanks / max(1, inner),
        "alnum_share": sum(map(str.isalnum, code)) / n,
        "numeric": numbers / n,
        "literal": (strings + outside) / n,
        "encoded": sum(map(len, _RUN.findall(code))) / n,
        "logic": len(_LOGIC.findall(bare)),
        "shapes": len(set(shapes)) / len(lines),
        "numbered": sum(1 for x in lines if re.search(r"[A-Za-z_]\d+\b", x)) / len(lines),
    }


def by_layout(path: str, s: dict[str, float]) -> str | None:
    """minified, data or generated by the layout statistics of a source, or None."""
    lim = LIMITS.get(path.rsplit(".", 1)[-1].lower(), LIMITS["js"])
    if s["n"] < lim.least_chars:
        return None
    if s["logic"] <= 2 and (s["encoded"] >= lim.encoded or s["encoded"] >= lim.encoded / 2 and s["alnum_share"] >= lim.dense):
        return "data"
    if s["blank_share"] < lim.blank_share and (s["mean_line"] >= lim.mean_line or s["max_line"] >= lim.max_line) and s["logic"] > 0:
        return "minified"
    if s["logic"] <= 1 and s["lines"] >= 5 and s["shapes"] <= 0.5 and (s["numeric"] >= lim.numeric or s["literal"] >= lim.literal or s["alnum_share"] <= lim.sparse):
        return "data"
    if s["lines"] >= lim.least_lines and s["shapes"] <= lim.shapes and s["numbered"] >= 0.5:
        return "generated"
    return None


def by_notice(path: str, content: str) -> str | None:
    """vendored or generated by notices and places, or None."""
    if _COPY_DIR.search(path) or _VERSIONED.search(path):
        return "vendored"
    head, tail = notices(content)
    if any(_THIRD_PARTY.match(x) or _UPSTREAM.match(x) for x in head[:2]):
        return "vendored"
    if any(_GENERATED.match(x) for x in [*head, *tail]) or _GENERATED_NAME.search(path):
        return "generated"
    return None


def verdict(path: str | None, content: str | None) -> str | None:
    """Why a source by itself isn't hand-written: generated, minified, data or vendored; None where it may be."""
    return by_layout(path or "", statistics(content or "")) or by_notice(path or "", content or "")


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen, noted, hashes = [], [], []
        for p, c in zip(b["path"], b["content"]):
            p, c = p or "", c or ""
            code = _COMMENT.sub("", c).strip()
            seen.append(by_layout(p, layout(code)))
            noted.append(by_notice(p, c))
            tight = re.sub(r"\s+", "", code)
            hashes.append(hashlib.md5(tight.encode("utf-8", "surrogatepass")).hexdigest() if len(tight) >= _LEAST_COPY else None)
        yield pd.DataFrame({"file_id": b["file_id"], "repo_id": b["repo_id"], "path": b["path"], "seen": seen, "noted": noted, "code_hash": hashes})


def judged(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, reason, evidence) of every code row; reason is null for hand-written source.

    evidence: layout, copies or notice, the first of them that tells. Null paths and contents are judged by what is there; null types
    are not code. Repeated rows count once. Texts are judged whole, whatever their length. `size_bytes` may be null or stale and is not used.
    """
    rows = files.filter("type = 'code'").select(F.col("id").alias("file_id"), "repo_id", "path", "content")
    each = rows.mapInPandas(_judge, "file_id string, repo_id string, path string, seen string, noted string, code_hash string")
    rows, _ = Scratch(files.sparkSession, "handwritten").cut(each)
    # One row a repository first, so that code that stands very often is a small group.
    places = rows.filter("code_hash IS NOT NULL").groupBy("code_hash", "repo_id").agg(F.max(F.coalesce(F.col("noted") == "vendored", F.lit(False))).alias("known"))
    copies = places.groupBy("code_hash").agg(F.count("repo_id").alias("repos"), F.max("known").alias("known")).filter(f"repos >= {MANY_REPOS} OR known")
    met = rows.join(copies, "code_hash", "left")
    many = F.coalesce(F.col("repos") >= MANY_REPOS, F.lit(False))
    reason = F.coalesce("seen", F.when(many, "vendored"), "noted", F.when(F.col("known"), "vendored"))
    evidence = F.when(F.col("seen").isNotNull(), "layout").when(many, "copies").when(reason.isNotNull(), "notice")
    return met.select("file_id", "repo_id", "path", reason.alias("reason"), evidence.alias("evidence")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code file that is not hand-written source of its repository."""
    return judged(spark.read.parquet(f"{sf_dir}/files.parquet")).filter("reason IS NOT NULL").select("file_id").distinct()


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per repository, reason and evidence; hand-written ones under 'handwritten'."""
    j = judged(spark.read.parquet(f"{sf_dir}/files.parquet"))
    return j.groupBy("repo_id", F.coalesce("reason", F.lit("handwritten")).alias("reason"), F.coalesce("evidence", F.lit("none")).alias("evidence")).agg(F.countDistinct("file_id").alias("n_files"))
