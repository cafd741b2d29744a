"""Reading repositories: directory trees, manifests, dotenv files, legacy JSON maps."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalars as S
from ..operators import statements
from ..runtime import ordinals
from .ignore import Ignore, rewrite

SOFT = {"docs": ["docs", "database"], "media": ["media"]}


def enumerate_paths(root: str, hidden: bool = False, out_dir: str | None = None) -> tuple[list[tuple[str, int, float]], int]:
    """(relative path, size, mtime) in byte order, and how many entries were ignored. Links aren't followed; hidden folders are skipped unless asked for, hidden files aren't; out_dir is ignored."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    lines: list[str] = [out_dir] if out_dir else []
    ignore = Ignore(lines)
    found: list[tuple[str, int, float]] = []
    ignored = 0
    todo = [""]
    while todo:
        folder = todo.pop()
        own = os.path.join(root, folder, ".gitignore")
        if os.path.isfile(own):
            with open(own, errors="replace") as f:
                lines += [rewrite(x, folder) for x in f.read().splitlines()]
            ignore = Ignore(lines)
        for e in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: os.fsencode(e.name)):
            path = f"{folder}/{e.name}" if folder else e.name
            if e.name == ".git" or e.is_symlink():
                continue
            if e.is_dir():
                if (e.name.startswith(".") and not hidden) or ignore(path + "/"):
                    ignored += 1
                else:
                    todo.append(path)
            elif ignore(path):
                ignored += 1
            elif os.access(os.path.join(root, path), os.R_OK):
                st = e.stat()
                found.append((path, st.st_size, st.st_mtime))
            else:
                logging.getLogger("srcatlas").warning("can't read %s", path)
    return sorted(found, key=lambda x: os.fsencode(x[0])), ignored


def scan(spark: SparkSession, root: str, repo_id: str = "repo", aggressive: bool = True, docs: bool = False, media: bool = False, hidden: bool = False, out_dir: str | None = None) -> DataFrame:
    """One row per kept file of a tree every executor can read: ids in walk order, category, language, MD5, content, statements.

    The tree is listed on the driver (names and sizes only) and numbered before any content is read; contents are read by
    the tasks and stay where they are. Unreadable files are left out with a warning; one that becomes unreadable later gives no row.
    """
    return scanned(spark, root, enumerate_paths(root, hidden, out_dir)[0], repo_id, aggressive, docs, media)


def scanned(spark: SparkSession, root: str, found: list[tuple[str, int, float]], repo_id: str = "repo", aggressive: bool = True, docs: bool = False, media: bool = False) -> DataFrame:
    listed = spark.createDataFrame([(repo_id, i, *x) for i, x in enumerate(found)], "repo_id string, n long, path string, size_bytes long, mtime double")
    name = S.basename(F.col("path"))
    listed = listed.withColumn("name", name).withColumn("type", S.category(name)).withColumn("language", S.language(name)).filter(~F.col("type").isin(*rules.HARD_SKIP))
    if not aggressive:
        drop = [c for k, cs in SOFT.items() for c in cs if not {"docs": docs, "media": media}[k]]
        listed = listed.filter(~F.col("type").isin(*drop)) if drop else listed
    listed = ordinals(spark, listed, "repo_id", "n").select("repo_id", F.format_string("file_%03d", "ordinal").alias("id"), "name", "path", "type", "language", "size_bytes", F.timestamp_seconds("mtime").alias("last_modified"))

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for p in b["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        data.append(f.read())
                except OSError as e:
                    logging.getLogger("srcatlas").warning("can't read %s: %s", p, e)
                    data.append(None)
            yield b.assign(content=data)

    schema = "repo_id string, id string, name string, path string, type string, language string, size_bytes long, last_modified timestamp, content binary"
    spread = listed.repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism)))
    got = spread.mapInPandas(contents, schema).filter("content IS NOT NULL")
    told = got.withColumn("hash", F.md5("content")).withColumn("content", F.decode("content", "utf-8"))
    rows = statements.extract(told, "repo_id", "name", "path", "type", "language", "size_bytes", "last_modified", "hash", "content")
    return rows.withColumnRenamed("error", "parse_error").withColumn("summarizable", F.col("type") == "code")


def tree_packages(spark: SparkSession, root: str, repo_id: str = "repo") -> DataFrame:
    """The packages the tree's manifest declares, with the versions installed below node_modules; none without a manifest."""

    def body(path: str) -> str | None:
        try:
            with open(os.path.join(root, path), errors="replace") as f:
                return f.read()
        except OSError:
            return None

    manifest = spark.createDataFrame([(repo_id, body("package.json"))], "repo_id string, body string")
    names = [r["name"] for r in packages(manifest, spark.createDataFrame([], "repo_id string, name string, version string")).select("name").collect()]
    there = spark.createDataFrame([(repo_id, n, body(f"node_modules/{n}/package.json")) for n in names], "repo_id string, name string, body string")
    return packages(manifest, there.select("repo_id", "name", F.get_json_object("body", "$.version").alias("version")).filter("version IS NOT NULL"))


# Names of files whose text tells a model about the repository.
CONTEXT = ["agents.md", "AGENTS.md", "Agents.md", "AGENTS.MD", "context.md", "CONTEXT.md"]


def context(root: str, context_tokens: int = 4096) -> str:
    """The context files of a tree, joined and cut to an eighth of the model's window (4 characters a token, 4,000 at most); empty where that is under 400."""
    budget = min(4000, int(context_tokens * 4 * 0.125))
    parts = []
    for name in CONTEXT:
        path = os.path.join(root, name)
        if budget >= 400 and os.path.isfile(path):
            with open(path, errors="replace") as f:
                parts.append(f"### {name}\n{f.read()}")
    text = "\n\n".join(parts)
    return text if len(text) <= budget else text[:budget] + "\n... [truncated]"


# Marks around the note for agents.
NOTE_START, NOTE_END = "<!-- srcatlas:start -->", "<!-- srcatlas:end -->"


def note(root: str, folder: str = ".srcatlas") -> str:
    """Put a note for agents at the head of the tree's context file, AGENTS.md if there is none: "created", "updated", or "kept" where it stands already."""
    name = next((n for n in ["AGENTS.md", *CONTEXT] if os.path.isfile(os.path.join(root, n))), None)
    text = f"{NOTE_START}\nTables of this repository's files, links and descriptions lie in `{folder}`; look there before reading sources one by one.\nAfter changes, `python -m srcatlas analyze` makes them anew.\n{NOTE_END}\n"
    old = ""
    if name:
        with open(os.path.join(root, name), errors="surrogateescape") as f:
            old = f.read()
        if NOTE_START in old and NOTE_END in old:
            return "kept"
    with open(os.path.join(root, name or "AGENTS.md"), "w", errors="surrogateescape") as f:
        f.write(text + ("\n" + old if name else ""))
    return "updated" if name else "created"


def merged(*layers: dict) -> dict:
    """Settings of later layers over earlier ones, objects merged key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(*paths: str, defaults: dict | None = None) -> dict:
    """Settings from JSON files over the defaults; a missing or broken file adds nothing."""
    layers = [defaults or {}]
    for p in paths:
        try:
            with open(p) as f:
                value = json.load(f)
        except (OSError, ValueError):
            continue
        layers += [value] if isinstance(value, dict) else []
    return merged(*layers)


BUCKETS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


def packages(manifests: DataFrame, installed: DataFrame) -> DataFrame:
    """Declared packages of manifests (repo_id, body) with installed versions (repo_id, name, version); the first bucket that names a package wins. Bodies that aren't JSON give no rows."""
    schema = ", ".join(f"{b} map<string,string>" for b in BUCKETS)
    j = manifests.select("repo_id", F.from_json("body", schema).alias("j"))
    each = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(b).alias("dependency_type"), F.col(f"j.{b}").alias("m")) for i, b in enumerate(BUCKETS)])
    rows = j.select("repo_id", F.explode(each).alias("b")).select("repo_id", "b.rank", "b.dependency_type", F.explode("b.m").alias("name", "declared_version"))
    first = Window.partitionBy("repo_id", "name").orderBy("rank")
    rows = rows.withColumn("r", F.row_number().over(first)).filter("r = 1").join(installed.select("repo_id", "name", "version"), ["repo_id", "name"], "left")
    return rows.select("repo_id", S.package_id(F.col("name")).alias("id"), "name", F.coalesce("version", "declared_version").alias("version"), "declared_version", "dependency_type", F.concat(F.lit("node_modules/"), "name").alias("location"))


def dotenv(lines: DataFrame) -> DataFrame:
    """(ord, key, value) of lines (ord, line): the last value of a key counts; quotes come off, and comments behind unquoted values."""
    text = F.trim(F.regexp_replace("line", r"^\s*export\s+", ""))
    kv = lines.select("ord", text.alias("t")).filter("t <> '' AND NOT startswith(t, '#') AND contains(t, '=')")
    raw = F.trim(F.regexp_extract("t", r"^[^=]*=([\s\S]*)$", 1))
    quoted = raw.rlike("^\"[\\s\\S]*\"$") | raw.rlike("^'[\\s\\S]*'$")
    value = F.when(quoted & (F.length(raw) >= 2), F.expr("substring(trim(regexp_extract(t, '^[^=]*=([\\\\s\\\\S]*)$', 1)), 2, length(trim(regexp_extract(t, '^[^=]*=([\\\\s\\\\S]*)$', 1))) - 2)")).otherwise(F.trim(F.regexp_replace(raw, r" #[\s\S]*$", "")))
    kv = kv.select("ord", F.trim(F.regexp_extract("t", r"^([^=]*)=", 1)).alias("key"), value.alias("value")).filter("key <> ''")
    return kv.groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def save(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as Parquet below root, partitioned by repository where it has one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("repo_id") if "repo_id" in df.columns else w).parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A saved table, or the legacy map.json's array of that name; None where there is neither."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (x := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(x)
    if there(f"{root}/{name}"):
        return spark.read.parquet(f"{root}/{name}")
    if there(f"{root}/map.json"):
        whole = spark.read.option("multiLine", True).json(f"{root}/map.json")
        return whole.select(F.explode(name).alias("r")).select("r.*") if name in whole.columns else None
    return None
