"""Source files that do not parse: table-driven parsing of whole token streams.

The tables come from the grammars bundled in grammars/ (one script grammar for JavaScript and
TypeScript with or without JSX, one for JSON). A statement that takes one line is kept by its token
stream, so a stream that parsed once is not parsed again; the table decides on the tokens alone, so this
changes no result. The first token that has no entry is the file's first unrecoverable error.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexer import BAD, EOF, JSON_KINDS, KEYWORDS, KINDS, NL, LexError, json_kinds, script_kinds
from .ll1 import Grammar

SEMI, RETARG, LABEL, YIELDARG, TSEP, STATEMENTS, ITEMS = range(7)
_SPECIALS = {"SEMI": SEMI, "RETARG": RETARG, "LABEL": LABEL, "YIELDARG": YIELDARG, "TSEP": TSEP, "STATEMENTS": STATEMENTS, "ITEMS": ITEMS}
_DEEP = 1_000_000
_KEEP, _LINE = 200_000, 120  # streams kept, and tokens of the longest line that is: parsing stays linear in the length of a line
#: Extension -> dialect: (JSON?, TypeScript?, JSX?). Fixed values.
DIALECTS = {".js": (0, 0, 0), ".mjs": (0, 0, 0), ".cjs": (0, 0, 0), ".jsx": (0, 0, 1), ".ts": (0, 1, 0), ".tsx": (0, 1, 1), ".json": (1, 0, 0)}


@lru_cache
def grammar(is_json: bool, ts: bool, jsx: bool) -> tuple[Grammar, dict]:
    folder = Path(__file__).parent / "grammars"
    if is_json:
        return Grammar((folder / "json.grammar").read_text(), frozenset(), JSON_KINDS, {}, {}), {}
    flags = frozenset(f for f, on in (("ts", ts), ("jsx", jsx)) if on)
    return Grammar((folder / "script.grammar").read_text(), flags, KINDS, {"KEYWORD": KEYWORDS}, _SPECIALS, frozenset({"RETARG", "LABEL", "YIELDARG", "STATEMENTS", "ITEMS"})), {}


_STOP_RETURN = ";})]" + EOF + ":"
_STOP_YIELD = ")]},;:" + EOF + KINDS["in"] + KINDS["OF"]
_STOP_LIST = "}" + EOF + KINDS["case"] + KINDS["default"]


def parse(kinds: str, g: Grammar, good: dict) -> int:
    """The index of the first token that can't stand where it stands, or -1."""
    tables = g.tables
    script = bool(g.specials)
    pos, nl = 0, False
    if kinds[0] == NL:
        pos, nl = 1, True
    k = kinds[pos]
    if not script:
        stack: list = [tables[g.start]]
    else:
        stack = [EOF, ITEMS]
        stmt, item, expr, assign = tables["Stmt"], tables["Item"], tables["Expr"], tables["Assign"]
    while stack:
        top = stack.pop()
        what = top.__class__
        if what is dict:
            r = top.get(k)
            if r is None:
                r = top.get("")
                if r is None:
                    return pos
                stack += r
                continue
            stack += r
            if r.__class__ is list:
                continue
        elif what is str:
            if top != k:
                return pos
            if k == EOF:
                return -1
        elif what is int:
            if top == STATEMENTS or top == ITEMS:
                if k in _STOP_LIST and (top == STATEMENTS or k == "}" or k == EOF):
                    continue
                end = kinds.find(NL, pos, pos + _LINE)
                key = kinds[pos : end + 2] if end > 0 else ""
                stack.append(top)
                if key and top == STATEMENTS and key in good:
                    pos, nl = end + 1, True
                    k = kinds[pos]
                    continue
                if k == "I" and kinds[pos + 1] == ":":
                    pos += 2
                    nl = kinds[pos] == NL
                    pos += nl
                    k = kinds[pos]
                    stack.append(stmt)
                    continue
                if key and top == STATEMENTS:
                    stack.append([end + 1, key])
                stack.append(item if top == ITEMS else stmt)
                continue
            if top == SEMI:
                if k != ";":
                    if nl or k == "}" or k == EOF:
                        continue
                    return pos
            elif top == RETARG:
                if not nl and k not in _STOP_RETURN:
                    stack.append(expr)
                continue
            elif top == LABEL:
                if nl or k != "I":
                    continue
            elif top == YIELDARG:
                if nl or k in _STOP_YIELD:
                    continue
                stack.append(assign)
                if k != "*":
                    continue
            else:
                if k != ";" and k != ",":
                    if nl or k == "}":
                        continue
                    return pos
        elif what is frozenset:
            if k not in top:
                return pos
        else:
            if top[0] == pos and len(good) < _KEEP:
                good[top[1]] = True
            continue
        # The token is consumed.
        pos += 1
        k = kinds[pos]
        if k == NL:
            nl = True
            pos += 1
            k = kinds[pos]
        else:
            nl = False
    return -1


@lru_cache
def _targets(ts: bool) -> re.Pattern:
    """Token streams in which something is assigned to, or counted up, that is no target: a literal or the end of an operation.

    In TypeScript the signs that types use as well are left out, and so are literals behind them.
    """
    literal = "[NSTR" + "".join(KINDS[w] for w in ("true", "false", "null", "this")) + "]"
    signs = re.escape(KINDS["BINOP"] + "+/" + ("" if ts else "-&|!~<>"))
    words = "" if ts else "".join(KINDS[w] for w in ("typeof", "void", "delete", "new"))
    put = f"[={KINDS['ASSIGNOP']}]"
    chain = f"I(?:{NL}?[.{KINDS['?.']}]{NL}?[I{KEYWORDS}P])*"
    times = f"(?<!{KINDS['yield']})\\*" if not ts else "(?!)"
    before = f"[{signs}={KINDS['ASSIGNOP']}{KINDS['return']}{KINDS['=>']}" + ("" if ts else "(,?:\\[") + "]"
    return re.compile(f"(?:(?:[{signs}{words}]|{times}){NL}?{chain}|{before}{NL}?{literal}){NL}?(?P<at>{put})|(?<![.{KINDS['?.']}]){literal}(?P<up>{KINDS['INC']})|{KINDS['INC']}(?P<down>[NSR])")


def bad_target(kinds: str, ts: bool) -> int:
    """The index of the first sign that assigns to what can't be assigned to, or -1."""
    m = _targets(ts).search(kinds)
    return max(m.start(g) for g in ("at", "up", "down")) if m else -1


def first_error(path: str, content: str) -> tuple[int, int, str] | None:
    """(line, column, message) of the first error of a file by the extension of its path, or None."""
    if sys.getrecursionlimit() < _DEEP:
        sys.setrecursionlimit(_DEEP)  # templates and JSX containers nest as deeply as a text says; these calls take no C stack
    is_json, ts, jsx = DIALECTS[path[path.rfind(".") :]]
    g, good = grammar(bool(is_json), bool(ts), bool(jsx))
    try:
        kinds, at = json_kinds(content) if is_json else script_kinds(content, bool(ts), bool(jsx))
        bad = parse(kinds, g, good)
        if bad < 0 and not is_json and (target := bad_target(kinds, bool(ts))) >= 0:
            where, why = at[target], "invalid assignment target"
            return content.count("\n", 0, where) + 1, where - content.rfind("\n", 0, where), why
        if bad < 0:
            return None
        where, why = at[min(bad, len(at) - 1)], "unexpected end" if kinds[bad] == EOF else "unexpected token"
    except LexError as e:
        where, why = e.at, str(e)
    line = content.count("\n", 0, where) + 1
    return line, where - content.rfind("\n", 0, where), why


_OUT = "repo_id string, file_id string, path string, language string, valid boolean, line int, col int, error string"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        errors = [first_error(p, c) for p, c in zip(b["path"], b["content"])]
        out = b[["repo_id", "file_id", "path", "language"]].copy()
        out["valid"] = [e is None for e in errors]
        for i, (name, kind) in enumerate((("line", "Int32"), ("col", "Int32"), ("error", "object"))):
            out[name] = pd.Series([e[i] if e else None for e in errors], dtype=kind, index=b.index)
        yield out


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1)


def judged(files: DataFrame) -> DataFrame:
    """One row for every judged row of files with whether it parses and its first error.

    Judged are rows with a content and a path that ends in one of the dialects' extensions; others, null
    paths and null contents among them, give no row. Repeated rows (all of these columns alike) count
    once. Empty scripts are valid, an empty JSON text isn't. A content of any length is parsed whole.
    """
    rows = files.filter(F.col("content").isNotNull() & extension(F.col("path")).isin(*DIALECTS))
    rows = rows.select("repo_id", F.col("id").alias("file_id"), "path", "language", "content")
    return rows.mapInPandas(_judge, _OUT).dropDuplicates(["file_id", "repo_id", "path", "valid", "line", "col"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are not valid in their language."""
    return judged(spark.read.parquet(f"{sf_dir}/files.parquet")).filter("NOT valid").select("file_id").distinct()


def p4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unrecoverable error of each invalid file."""
    return judged(spark.read.parquet(f"{sf_dir}/files.parquet")).filter("NOT valid").select("repo_id", "file_id", "path", "line", "col", "error")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid and judged files per repository and language (the dialect of the path)."""
    j = judged(spark.read.parquet(f"{sf_dir}/files.parquet")).select("repo_id", "file_id", extension(F.col("path")).alias("ext"), "valid").distinct()
    return j.groupBy("repo_id", "ext").agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), (F.count_if(~F.col("valid")) / F.count("*")).alias("rate"))
