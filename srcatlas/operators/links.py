"""Import resolution and the dependency links made from it.

The ranked candidates of an import (the path itself, six extensions, six index files) are put on the side of
the files: a file answers to its path, its path without extension, and its folder if it is an index. One
equi-join on (repository, path) replaces thirteen probes, and the lowest rank wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalars as S


def imports_of(files: DataFrame) -> DataFrame:
    """One row per import: repo_id, from_id, path, imp_ord (from 0), source, kind, line."""
    one = files.select("repo_id", F.col("id").alias("from_id"), "path", F.posexplode("imports").alias("imp_ord", "i"))
    return one.select("repo_id", "from_id", "path", "imp_ord", F.col("i.source").alias("source"), F.col("i.type").alias("kind"), F.col("i.line_imported").alias("line"))


def answers(files: DataFrame, exts: list[str] = rules.CODE_EXTS) -> DataFrame:
    """(repo_id, target, rank, to_id): what each file answers to."""

    def entry(target: Column, rank: int) -> Column:
        return F.struct(target.alias("target"), F.lit(rank).alias("rank"))

    p, keys = F.col("path"), [entry(F.col("path"), 0)]
    for i, e in enumerate(exts):
        keys.append(F.when(p.endswith(e), entry(F.substring(p, F.lit(1), F.length(p) - len(e)), 1 + i)))
    for i, e in enumerate(exts):
        keys.append(F.when(p.endswith("/index" + e), entry(F.substring(p, F.lit(1), F.length(p) - len(e) - 6), 1 + len(exts) + i)))
    return files.filter("path IS NOT NULL").select("repo_id", F.col("id").alias("to_id"), F.inline(F.array_compact(F.array(*keys)))).select("repo_id", "target", "rank", "to_id")


def target_of(path: Column, source: Column) -> Column:
    return S.normalize_path(F.concat(S.dirname(path), F.lit("/"), source))


def folders_of(files: DataFrame) -> DataFrame:
    """(repo_id, target): every folder above a file."""
    parts = F.split("path", "/")
    each = files.filter("path LIKE '%/%'").select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).alias("target"))
    return each.distinct()


def resolve_files(imports: DataFrame, files: DataFrame, exts: list[str] = rules.CODE_EXTS, folders: bool = False) -> DataFrame:
    """Imports of kind file with the file they name; those that name none are dropped. folders: those that name a folder are, too, whatever files lie beside it."""
    asked = imports.filter("kind = 'file'").withColumn("target", target_of(F.col("path"), F.col("source")))
    if folders:
        asked = asked.join(folders_of(files), ["repo_id", "target"], "left_anti")
    hit = asked.join(answers(files, exts), ["repo_id", "target"])
    return hit.groupBy("repo_id", "from_id", "imp_ord", "source", "line").agg(F.min_by("to_id", F.struct("rank", "to_id")).alias("to_id"))


def resolve_packages(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports of kind package with the package they name: the exact name, else the scope and name or the first part."""
    parts = F.split("source", "/")
    base = F.when(F.col("source").startswith("@") & (F.size(parts) >= 2), F.array_join(F.slice(parts, 1, 2), "/")).when(~F.col("source").startswith("@"), parts[0])
    asked = imports.filter("kind = 'package'").withColumn("base", base)
    named = packages.groupBy("name").agg(F.max("id").alias("package_id"))
    exact = named.select(F.col("name").alias("source"), F.col("package_id").alias("exact"))
    rest = named.select(F.col("name").alias("base"), F.col("package_id").alias("by_base"))
    both = asked.join(exact, "source", "left").join(rest, "base", "left").withColumn("package_id", F.coalesce("exact", "by_base"))
    return both.filter("package_id IS NOT NULL").select("repo_id", "from_id", "imp_ord", "source", "line", "package_id")


def direct_links(resolved: DataFrame) -> DataFrame:
    w = rules.WEIGHTS["direct"]
    g = resolved.groupBy("repo_id", "from_id", "to_id").agg(F.count("*").alias("frequency"), F.min_by("line", "imp_ord").alias("line"), F.min("imp_ord").cast("long").alias("first_ord"))
    return g.withColumn("weight", F.col("frequency") * w)


def package_links(resolved: DataFrame) -> DataFrame:
    """The weight counts the package's use over all files."""
    g = resolved.groupBy("from_id", "package_id").agg(F.count("*").alias("frequency"))
    total = g.groupBy("package_id").agg(F.sum("frequency").alias("used"))
    return g.join(total, "package_id").select("from_id", "package_id", "frequency", (F.col("used") * rules.WEIGHTS["package"]).alias("weight"))


def indirect_links(edges: DataFrame) -> DataFrame:
    """Two hops between different files without a direct link; frequency counts the files between. edges (repo_id, from_id, to_id) distinct."""
    a = edges.select("repo_id", "from_id", F.col("to_id").alias("mid"))
    b = edges.select("repo_id", F.col("from_id").alias("mid"), "to_id")
    two = a.join(b, ["repo_id", "mid"]).filter("from_id <> to_id").groupBy("repo_id", "from_id", "to_id").agg(F.count("*").alias("frequency"))
    left = two.join(edges, ["repo_id", "from_id", "to_id"], "left_anti")
    return left.withColumn("weight", F.col("frequency") * rules.WEIGHTS["indirect"])


def route_links(files: DataFrame) -> DataFrame:
    """Implicit links from <folder>.<ext> to each file in that folder, under the route roots."""
    child = files.filter(F.col("path").rlike("^(?:src/)?(?:app|pages)/.*/")).withColumn("parent", S.dirname(F.col("path"))).filter(~F.col("parent").rlike("^(?:src/)?(?:app|pages)$"))
    stem = F.regexp_replace("path", r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", "")
    parent = files.filter(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx|mjs|cjs)$")).select("repo_id", F.col("id").alias("from_id"), stem.alias("parent"))
    kind = F.when(F.regexp_extract("parent", "([^/]*)$", 1).isin("layout", "template"), "layout").otherwise("route")
    pairs = child.select("repo_id", F.col("id").alias("to_id"), "parent").join(parent, ["repo_id", "parent"]).filter("from_id <> to_id")
    return pairs.select("repo_id", "from_id", "to_id", kind.alias("type"), F.lit(1).cast("long").alias("frequency"), F.when(kind == "layout", 90).otherwise(60).cast("long").alias("weight"))


def degrees(ids: DataFrame, links: DataFrame) -> DataFrame:
    """incoming, outgoing: link rows (a multigraph); usage: frequencies that come in. ids (id), links (from_id, to_id, frequency)."""
    ins = links.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("incoming"), F.sum("frequency").alias("usage"))
    outs = links.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("outgoing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(ins, "id", "left").join(outs, "id", "left").select("id", zero("incoming"), zero("outgoing"), zero("usage"))
