"""Queries of the sources: ignore rules, manifests, dotenv files, tree scans."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from ..runtime import Scratch
from ..sources import repository as R
from ..sources.ignore import Ignore
from .base import files, sql

QUERIES: dict = {}
SQL: dict = {}

PATTERNS = ["dist/", "*.min.js", "src/legacy", "!src/legacy/keep*", "**/snapshot/*.js", "vendor"]


def _ignore_sql() -> str:
    out = "false"
    for r, negated in Ignore(PATTERNS).rules:
        out = f"CASE WHEN regexp_matches(path, '{r}') THEN {str(not negated).lower()} ELSE {out} END"
    return out


def gitignore_filter(spark, sf_dir):
    return files(spark, sf_dir, "path").filter("path IS NOT NULL").select(F.col("id").alias("file_id"), Ignore(PATTERNS).column(F.col("path")).alias("ignored"))


_MANIFEST = {"dependencies": {"react": "^18.0.0", "lodash": "4"}, "devDependencies": {"jest": "^29.0.0", "react": "17"}, "peerDependencies": {"@scope/a-b": "*"}}


def packages_collect(spark, sf_dir):
    m = spark.createDataFrame([("r", json.dumps(_MANIFEST)), ("bad", "{")], "repo_id string, body string")
    i = spark.createDataFrame([("r", "react", "18.2.0")], "repo_id string, name string, version string")
    return R.packages(m, i)


_LINES = ["# c", "A=1", "export B = two words # note", "C='q # q'", 'D="x"', "=no", "noeq", "A=2", "E="]


def dotenv_parse(spark, sf_dir):
    return R.dotenv(spark.createDataFrame(list(enumerate(_LINES)), "ord int, line string"))


def scan_files(spark, sf_dir):
    """A small tree in the shared folder, listed, filtered, classified and hashed. Only local and mounted folders hold trees."""
    root = Scratch(spark, "tree").root.removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise ValueError("trees are read from mounted folders; spark.checkpoint.dir names another kind")
    tree = {"src/a.ts": "export const a = 1\n", "src/b.css": "b {}", "dist/x.js": "1", ".gitignore": "dist/\n*.log\n", "app.log": "", "docs/c.md": "# c", "z.woff2": "", ".hidden/d.js": "1"}
    for p, text in tree.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(text)
    return R.scan(spark, root).select("id", "path", "type", "language", "size_bytes", "hash")


QUERIES |= {"gitignore_filter": gitignore_filter, "packages_collect": packages_collect, "dotenv_parse": dotenv_parse, "scan_files": scan_files}
SQL |= {
    "gitignore_filter": sql(f"SELECT id AS file_id, {_ignore_sql()} AS ignored FROM f WHERE path IS NOT NULL"),
    "packages_collect": "SELECT * FROM (VALUES ('r', 'pkg_react', 'react', '18.2.0', '^18.0.0', 'dependencies', 'node_modules/react'), ('r', 'pkg_lodash', 'lodash', '4', '4', 'dependencies', 'node_modules/lodash'), ('r', 'pkg_jest', 'jest', '^29.0.0', '^29.0.0', 'devDependencies', 'node_modules/jest'), ('r', 'pkg_scope_a_b', '@scope/a-b', '*', '*', 'peerDependencies', 'node_modules/@scope/a-b')) t(repo_id, id, name, version, declared_version, dependency_type, location)",
    "dotenv_parse": "SELECT * FROM (VALUES ('A', '2'), ('B', 'two words'), ('C', 'q # q'), ('D', 'x'), ('E', '')) t(key, value)",
    "scan_files": "SELECT printf('file_%03d', row_number() OVER (ORDER BY path)) AS id, path, type, language, CAST(length(body) AS BIGINT) AS size_bytes, md5(body) AS hash FROM (VALUES ('.gitignore', 'config', 'unknown', 'dist/' || chr(10) || '*.log' || chr(10)), ('docs/c.md', 'docs', 'markdown', '# c'), ('src/a.ts', 'code', 'typescript', 'export const a = 1' || chr(10)), ('src/b.css', 'style', 'css', 'b {}')) t(path, type, language, body)",
}
