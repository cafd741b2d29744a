"""Consolidating pairwise matches into groups: connected components over pairs and lists.

Method: minimum labels travel along edges, pointer jumping collapses the label forest, the graph is
contracted, and every round is cut into a table in the shared folder until no label changes. A label
only ever falls, so a parent is always smaller than its child and the forest has no cycle. Contracting
shrinks the edges geometrically, and one round of jumps collapses a path of any length in log2 steps.

Ids become 8-byte numbers in the order of the ids, so that the smallest number names the smallest id.
A list is a node of its own, numbered above all ids: it joins its members by one edge each, never by
pairs. Hubs: minima are taken with map-side combine; joins on a hub rely on AQE's skew join, and
repeated pairs are removed beforehand. No edge, label or component visits the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch

_LIST_BASE = 1 << 62


def tidy(c: Column) -> Column:
    """Ids compare without letter case and surrounding blanks."""
    return F.lower(F.btrim(c, F.lit(" \t\r\n\f\u000b ")))


def _collapse(scratch: Scratch, parents: DataFrame) -> tuple[DataFrame, str]:
    """Pointer jumping on (v, p) with p < v, two jumps a written round, until every p is a root."""
    now, path = scratch.cut(parents)
    while True:
        up = lambda a, b: now.select(F.col("v").alias(a), F.col("p").alias(b))  # noqa: B023, E731
        two = now.join(up("p", "g"), "p", "left").join(up("g", "gg"), "g", "left")
        nxt, npath = scratch.cut(two.select("v", F.coalesce("gg", "g", "p").alias("p"), F.col("gg").isNotNull().alias("moved")))
        scratch.drop(path)
        moved = not nxt.filter("moved").isEmpty()
        now, path = nxt.drop("moved"), npath
        if not moved:
            return now, path


def components(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, Scratch]:
    """(v, root) for every node that has an edge to another; edges (a, b) long.

    Null ends and self-loops join nothing; repeated edges count once; no edges give no rows.
    """
    scratch = Scratch(spark, "components")
    clean = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, live_path = scratch.cut(clean)
    total, total_path = None, None
    while not live.isEmpty():
        both = live.select(F.col("b").alias("v"), F.col("a").alias("u")).unionAll(live.select(F.col("a").alias("v"), F.col("b").alias("u")))
        lower = both.groupBy("v").agg(F.min("u").alias("p")).filter("p < v")
        forest, forest_path = _collapse(scratch, lower)
        if total is None:
            merged = forest
        else:
            ended = forest.select(F.col("v").alias("p"), F.col("p").alias("g"))
            old = total.join(ended, "p", "left").select("v", F.coalesce("g", "p").alias("p"))
            merged = old.unionAll(forest)
        left = forest.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = forest.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        contracted = moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        nlive, nlive_path = scratch.cut(contracted)
        ntotal, ntotal_path = scratch.cut(merged)
        scratch.drop(live_path, total_path, forest_path)
        live, live_path, total, total_path = nlive, nlive_path, ntotal, ntotal_path
    if total is None:
        total = spark.createDataFrame([], "v long, p long")
    return total.select("v", F.col("p").alias("root")), scratch


def group_ids(spark: SparkSession, ids: DataFrame, pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(file_id, group_id) for every distinct id.

    ids (id), pairs (a, b) and lists (members array) hold raw strings. Ids that differ only in case or
    surrounding blanks name one node and each get their own row. Ends and members outside `ids`, nulls
    and self-pairs join nothing; a list joins all of its known members; an id joined to no other is its
    own group. Null ids give no row; empty tables give every id as its own group.
    """
    scratch = Scratch(spark, "groups")
    named = ids.select("id").filter("id IS NOT NULL").distinct().withColumn("key", tidy(F.col("id")))
    reps = named.groupBy("key").agg(F.min("id").alias("rep"))
    numbered = reps.repartitionByRange("rep").sortWithinPartitions("rep").withColumn("n", F.monotonically_increasing_id())
    nodes, _ = scratch.cut(numbered)
    one = pairs.select(tidy(F.col("a")).alias("a"), tidy(F.col("b")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    one = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    number = lambda end: nodes.select(F.col("key").alias(end), F.col("n").alias("n" + end))
    linked = one.join(number("a"), "a").join(number("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    each = lists.withColumn("l", F.monotonically_increasing_id() + F.lit(_LIST_BASE)).select("l", F.explode("members").alias("m"))
    listed = each.select("l", tidy(F.col("m")).alias("a")).join(number("a"), "a").select(F.col("na").alias("a"), F.col("l").alias("b"))
    roots, _ = components(spark, linked.unionAll(listed))
    top = nodes.select(F.col("n").alias("root"), F.col("rep").alias("group_id"))
    grouped = nodes.join(roots.withColumnRenamed("v", "n"), "n", "left").withColumn("root", F.coalesce("root", "n")).join(top, "root").select("key", "group_id")
    return named.join(grouped, "key").select(F.col("id").alias("file_id"), "group_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file id with the smallest file id of its group."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pairs = read("links").select(F.col("from_file_id").alias("a"), F.col("to_file_id").alias("b"))
    lists = read("networks").filter("type = 'active'").select(F.array_distinct("files").alias("members"))
    return group_ids(spark, read("files").select("id"), pairs, lists)
