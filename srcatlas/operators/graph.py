"""Graph operators: weak and strong components, levels, betweenness, importance.

One way for graphs of every size: rounds of joins and aggregations, cut into tables of the shared folder. Several
hops are laid into one round where a hop reads the table before it once; edges from each node to itself keep what
was there. Nothing is collected, broadcast by hand or finished in one task; hubs are left to AQE's split of
skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch

_HOPS = 3  # hops of one written round


def _loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (a, b) and an edge from each of nodes (v) to itself."""
    return edges.select("a", "b").unionAll(nodes.select(F.col("v").alias("a"), F.col("v").alias("b")))


def weak_components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id of the component. nodes (id), edges (a, b); nulls and self-loops join nothing.

    Each round every node takes its smallest neighbour as parent, looks two parents further, and the edges are
    contracted to the parents, until none is left.
    """
    scratch = Scratch(spark, "weak")
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, path = scratch.cut(pairs)
    label, lpath = scratch.cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first, fpath = scratch.cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).filter("p < v"))
        up = first
        for _ in range(_HOPS - 1):
            jump = first.select(F.col("v").alias("p"), F.col("p").alias("g"))
            up = up.join(jump, "p", "left").select("v", F.coalesce("g", "p").alias("p"))
        up, upath = scratch.cut(up)
        to = lambda c: up.select(F.col("v").alias(c), F.col("p").alias("p" + c))
        nlabel, nlpath = scratch.cut(label.join(to("component"), "component", "left").select("id", F.coalesce("pcomponent", "component").alias("component")))
        small = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).filter("a <> b")
        nlive, npath = scratch.cut(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(path, lpath, upath, fpath)
        live, path, label, lpath = nlive, npath, nlabel, nlpath
    return label


def strong_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, scc, size) of every node on a cycle of two or more nodes, scc its smallest id. edges (a, b); nulls drop out, self-loops don't count.

    Nodes that can't lie on a cycle are trimmed; then colours: the smallest ancestor spreads forward, its component is
    what reaches it backward within its colour, and what is left starts over.
    """
    scratch = Scratch(spark, "strong")
    live, path = scratch.cut(edges.filter("a <> b").select("a", "b").distinct())
    kind = dict(edges.dtypes)["a"]
    parts: list[str] = []
    while True:
        live, path = _trim(scratch, live, path)
        if live.isEmpty():
            break
        nodes = live.select(F.col("a").alias("v")).distinct()
        color, cpath = _spread(scratch, nodes.select("v", F.col("v").alias("c")), live)
        # Backward from each colour's root, within the colour.
        ca, cb = color.select(F.col("v").alias("a"), F.col("c").alias("ca")), color.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        same, spath = scratch.cut(live.join(ca, "a").join(cb, "b").filter("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")))
        part, ppath = _reach(scratch, color.filter("v = c").select("v"), same)
        done, dpath = scratch.cut(color.join(part, "v").select(F.col("v").alias("id"), F.col("c").alias("scc")))
        parts.append(dpath)
        gone = part.withColumnRenamed("v", "a")
        # Ends of different colours lie on no common cycle.
        nlive, npath = scratch.cut(same.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b")))
        scratch.drop(path, cpath, spath, ppath)
        live, path = nlive, npath
    schema = f"id {kind}, scc {kind}"
    if not parts:
        return spark.createDataFrame([], schema + ", size long")
    done = spark.read.schema(schema).parquet(*parts)
    sizes = done.groupBy("scc").agg(F.count("*").alias("size")).filter("size > 1")
    return done.join(sizes, "scc").select("id", "scc", "size")


def _trim(scratch: Scratch, live: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Without edges whose end leads nowhere or whose start is reached by none, over and over."""
    n = live.count()
    while n:
        tails, heads = live.select(F.col("a").alias("b")).distinct(), live.select(F.col("b").alias("a")).distinct()
        nxt, npath = scratch.cut(live.join(tails, "b", "left_semi").join(heads, "a", "left_semi").select("a", "b"))
        scratch.drop(path)
        live, path = nxt, npath
        m = live.count()
        if m == n:
            break
        n = m
    return live, path


def _spread(scratch: Scratch, start: DataFrame, edges: DataFrame) -> tuple[DataFrame, str]:
    """The smallest c that reaches each v of start (v, c) along edges a -> b."""
    loops, lpath = scratch.cut(_loops(edges, start))
    now, path = scratch.cut(start)
    while True:
        at = now.select("v", "c", F.col("c").alias("old"))
        for _ in range(_HOPS):
            came = at.join(loops, at["v"] == loops["a"])
            at = came.groupBy(F.col("b").alias("v")).agg(F.min("c").alias("c"), F.min(F.when(F.col("a") == F.col("b"), F.col("old"))).alias("old"))
        nxt, npath = scratch.cut(at)
        scratch.drop(path)
        moved = not nxt.filter("c < old").isEmpty()
        now, path = nxt.drop("old"), npath
        if not moved:
            scratch.drop(lpath)
            return now, path


def _reach(scratch: Scratch, start: DataFrame, edges: DataFrame) -> tuple[DataFrame, str]:
    """(v): what start (v) reaches along edges a -> b, itself included."""
    now, path = scratch.cut(start.distinct())
    ends = edges.select(F.col("a").alias("v")).unionAll(edges.select(F.col("b").alias("v"))).unionAll(now).distinct()
    loops, lpath = scratch.cut(_loops(edges, ends))
    n = now.count()
    while True:
        at = now
        for _ in range(_HOPS):
            at = at.join(loops, at["v"] == loops["a"]).select(F.col("b").alias("v")).distinct()
        nxt, npath = scratch.cut(at)
        scratch.drop(path)
        now, path, m = nxt, npath, nxt.count()
        if m == n:
            scratch.drop(lpath)
            return now, path
        n = m


def topo_levels(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest chain of dependencies below a node. edges (a, b): a needs b. Nodes on or above a cycle get null.

    Levels rise by relaxation over the acyclic rest, several steps in a round; a chain of n nodes takes n / _HOPS rounds.
    """
    scratch = Scratch(spark, "topo")
    ids, _ = scratch.cut(nodes.select(F.col("id").alias("v")).distinct())
    needs, _ = scratch.cut(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    on = strong_components(spark, needs).select(F.col("id").alias("v")).unionAll(needs.filter("a = b").select(F.col("a").alias("v")))
    bad, _ = _reach(scratch, on, needs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    good = ids.join(bad, "v", "left_anti")
    fine = needs.join(bad.withColumnRenamed("v", "a"), "a", "left_anti")
    steps = fine.select("a", "b", F.lit(1).alias("w")).unionAll(good.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0)))
    # Ends that aren't among the nodes stand at level 0 too.
    steps, _ = scratch.cut(steps.unionAll(fine.select(F.col("b").alias("v")).distinct().join(ids, "v", "left_anti").select(F.col("v"), F.col("v").alias("b"), F.lit(0))))
    now, path = scratch.cut(steps.filter("w = 0").select(F.col("a").alias("v"), F.lit(0).alias("level")))
    while True:
        at = now.select("v", "level", F.col("level").alias("old"))
        for _ in range(_HOPS):
            came = at.join(steps, at["v"] == steps["b"])
            at = came.groupBy(F.col("a").alias("v")).agg(F.max(F.col("level") + F.col("w")).alias("level"), F.max(F.when(F.col("w") == 0, F.col("old"))).alias("old"))
        nxt, npath = scratch.cut(at)
        scratch.drop(path)
        moved = not nxt.filter("level > old").isEmpty()
        now, path = nxt.drop("old"), npath
        if not moved:
            return ids.join(now, "v", "left").select(F.col("v").alias("id"), "level")


def betweenness(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, betweenness): directed, unweighted, not normalized; repeated edges count as paths of their own.

    nodes (id), edges (a, b). Breadth-first levels of all sources at once, then dependencies back from the deepest level. The
    rows are the pairs (source, node it reaches), which is what an exact answer takes; each level is a written table.
    """
    scratch = Scratch(spark, "between")
    kind = dict(nodes.dtypes)["id"]
    ids, _ = scratch.cut(nodes.select("id").distinct())
    known = edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").filter("a <> b")
    e, _ = scratch.cut(known.groupBy("a", "b").agg(F.count("*").cast("double").alias("m")))
    front, path = scratch.cut(e.select(F.col("a").alias("s")).distinct().select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")))
    levels = [path]
    while True:
        seen = spark.read.schema(front.schema).parquet(*levels).select("s", "v")
        far = front.join(e, front["v"] == e["a"]).groupBy("s", F.col("b").alias("v")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        front, path = scratch.cut(far.join(seen, ["s", "v"], "left_anti").select("s", "v", "sigma"))
        if front.isEmpty():
            break
        levels.append(path)
    if len(levels) == 1:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    read = lambda p: spark.read.schema(f"s {kind}, v {kind}, sigma double").parquet(p)
    deeper, done = read(levels[-1]).withColumn("delta", F.lit(0.0)), []
    for p in reversed(levels[1:-1]):
        here = read(p)
        below = deeper.select("s", F.col("v").alias("b"), F.col("sigma").alias("sigma_b"), "delta")
        shares = here.join(e, here["v"] == e["a"]).join(below, ["s", "b"]).groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("sigma_b") * F.col("m") * (1 + F.col("delta"))).alias("delta"))
        deeper, path = scratch.cut(here.join(shares, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        done.append(path)
    if not done:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    total = spark.read.schema(deeper.schema).parquet(*done).groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("bc"))
    return ids.join(total, "id", "left").select("id", F.coalesce("bc", F.lit(0.0)).alias("betweenness"))


def raw_importance(incoming, outgoing, usage, bc):
    return 1.2 * incoming + 0.8 * outgoing + 0.5 * usage + 1.5 * bc


def importance(spark: SparkSession, nodes: DataFrame, links: DataFrame, simultaneous: bool = False) -> DataFrame:
    """(repo_id, id, raw, score): nodes (repo_id, ord, id, raw), links (a, b) rows; targets of other repositories don't count.

    Three passes in the order of ord and in place: each node gains 0.4 * 0.6^pass of the mean over its targets, repeated
    ones counted again; the score is scaled to the repository's largest. A pass in order is a triangular system: what
    comes before a node counts with its new value, the rest with its old one. It is solved by repeated substitution,
    which is exact after as many steps as the longest chain of such targets and shrinks any rest by 0.4 a step, so no
    repository has to fit into one task. Without a repo_id column all nodes are one repository.
    """
    scratch = Scratch(spark, "importance")
    repo = "repo_id" if "repo_id" in nodes.columns else F.lit(None).cast("string").alias("repo_id")
    n, _ = scratch.cut(nodes.select(repo, "ord", "id", F.col("raw").cast("double").alias("raw")))
    end = lambda c: n.select(F.col("repo_id").alias("repo_" + c), F.col("id").alias(c), F.col("ord").alias("ord_" + c))
    counted = links.groupBy("a", "b").agg(F.count("*").alias("m")).join(end("a"), "a").join(end("b"), "b").filter("repo_a <=> repo_b")
    outs = counted.groupBy("a").agg(F.sum("m").alias("total"))
    e, _ = scratch.cut(counted.join(outs, "a").select("a", "b", (F.col("m") / F.col("total")).alias("w"), (F.col("ord_b") < F.col("ord_a")).alias("new")))
    old = e if simultaneous else e.filter("NOT new")
    new = e.filter("new")
    chained = not simultaneous and not new.isEmpty()

    def gain(values: DataFrame, part: DataFrame, c: float) -> DataFrame:
        return values.join(part, values["id"] == part["b"]).groupBy("a").agg((F.sum(F.col("w") * F.col("x")) * c).alias("g")).withColumnRenamed("a", "id")

    now, path = n.select("id", F.col("raw").alias("x")), None
    for i in range(3):
        c = 0.4 * 0.6**i
        base, bpath = scratch.cut(now.join(gain(now, old, c), "id", "left").select("id", (F.col("x") + F.coalesce("g", F.lit(0.0))).alias("x")))
        scratch.drop(path)
        now, path = base, bpath
        while chained:
            at = last = now
            for _ in range(2 * _HOPS):
                last, at = at, base.join(gain(at, new, c), "id", "left").select("id", (F.col("x") + F.coalesce("g", F.lit(0.0))).alias("x"))
            # The last hop tells whether another round is needed.
            nxt, npath = scratch.cut(at.join(last.select("id", F.col("x").alias("was")), "id").select("id", "x", (F.abs(F.col("x") - F.col("was")) > 1e-12 * F.greatest(F.lit(1.0), F.abs("x"))).alias("moved")))
            if path != bpath:
                scratch.drop(path)
            moved = not nxt.filter("moved").isEmpty()
            now, path = nxt.drop("moved"), npath
            if not moved:
                break
        if path != bpath:
            scratch.drop(bpath)
    both = n.select("repo_id", "id").join(now, "id")
    top = both.groupBy(F.col("repo_id").alias("_repo")).agg(F.max("x").alias("top"))
    scored = both.join(top, F.col("repo_id").eqNullSafe(F.col("_repo")), "left").withColumnRenamed("x", "raw")
    return scored.select("repo_id", "id", "raw", F.when(F.col("top") != 0, F.floor(F.col("raw") / F.col("top") * 10 * 10 + 0.5) / 10).otherwise(0.0).alias("score"))
