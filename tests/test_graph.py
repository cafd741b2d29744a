"""Graph operators against golden values and brute force on small graphs."""

import random

import pytest

from srcatlas.operators import graph as G
from srcatlas.operators import links as L

GOLD = [  # nodes in order, edges, raw before, raw after, score
    ("abc", ["ab", "bc", "ca"], [4.0, 4.0, 4.0], [7.96605, 8.23614, 9.05367], [8.8, 9.1, 10.0]),
    ("abcd", ["ab", "bc", "cd"], [0.8, 5.5, 5.5, 1.7], [6.17038, 10.13187, 6.8328, 1.7], [6.1, 10.0, 6.7, 1.7]),
    ("dcba", ["ab", "bc", "cd"], [1.7, 5.5, 5.5, 0.8], [1.7, 6.8328, 10.53704, 7.79888], [1.6, 6.5, 10.0, 7.4]),
]


@pytest.mark.parametrize("nodes,edges,raw,after,score", GOLD)
def test_importance(spark, nodes, edges, raw, after, score):
    n = spark.createDataFrame([(i, v, raw[i]) for i, v in enumerate(nodes)], "ord int, id string, raw double")
    got = {r["id"]: r for r in G.importance(spark, n, spark.createDataFrame([tuple(e) for e in edges], "a string, b string")).collect()}
    assert [round(got[v]["raw"], 5) for v in nodes] == after
    assert [got[v]["score"] for v in nodes] == score


def _propagate(raw, targets, simultaneous=False):
    now = list(raw)
    for i in range(3):
        seen = list(now) if simultaneous else now
        for f, ts in enumerate(targets):
            if ts:
                now[f] = now[f] + 0.4 * 0.6**i * (sum(seen[t] for t in ts) / len(ts))
    return now


@pytest.mark.parametrize("simultaneous", [False, True])
def test_importance_by_brute_force(spark, simultaneous):
    """Two repositories and nodes without one, repeated links, self-links, links between repositories."""
    rnd = random.Random(7)
    repo = lambda v: ["p", "q", None][v % 3]
    order = list(range(60))
    rnd.shuffle(order)
    raw = {v: rnd.random() * 9 for v in range(60)}
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(300)]
    n = spark.createDataFrame([(repo(v), i, v, raw[v]) for i, v in enumerate(order)], "repo_id string, ord int, id long, raw double")
    got = {r["id"]: r for r in G.importance(spark, n, spark.createDataFrame(links, "a long, b long"), simultaneous).collect()}
    for k in ("p", "q", None):
        mine = [v for v in order if repo(v) == k]
        at = {v: i for i, v in enumerate(mine)}
        want = _propagate([raw[v] for v in mine], [[at[b] for a, b in links if a == v and b in at] for v in mine], simultaneous)
        assert [round(got[v]["raw"], 8) for v in mine] == [round(x, 8) for x in want]
        assert max(got[v]["score"] for v in mine) == 10.0


def test_betweenness_by_brute_force(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(14), rnd.randrange(14)) for _ in range(40)]

    def paths(s):
        dist, sigma, todo = {s: 0}, {s: 1}, [s]
        for v in todo:
            for a, b in edges:
                if a == v and b not in dist:
                    dist[b], sigma[b] = dist[v] + 1, 0
                    todo.append(b)
                if a == v and dist[b] == dist[v] + 1:
                    sigma[b] += sigma[v]
        return dist, sigma

    all_ = {s: paths(s) for s in range(14)}
    want = {v: sum(all_[s][1][v] * all_[v][1][t] / all_[s][1][t] for s in range(14) for t in all_[s][0] if len({s, v, t}) == 3 and v in all_[s][0] and t in all_[v][0] and all_[s][0][v] + all_[v][0][t] == all_[s][0][t]) for v in range(14)}
    got = {r["id"]: r["betweenness"] for r in G.betweenness(spark, spark.range(14), spark.createDataFrame([*edges, (None, 1), (99, 1)], "a long, b long")).collect()}
    assert {v: round(x, 9) for v, x in got.items()} == {v: round(float(x), 9) for v, x in want.items()}


def test_betweenness(spark):
    n = spark.createDataFrame([(c,) for c in "abcdx"], "id string")
    e = spark.createDataFrame([tuple(x) for x in ["ab", "bc", "cd", "ax", "xc"]], "a string, b string")
    assert {r["id"]: r["betweenness"] for r in G.betweenness(spark, n, e).collect()} == {"a": 0, "b": 1, "c": 3, "d": 0, "x": 1}


def _reach(edges, n):
    out = [set() for _ in range(n)]
    for s in range(n):
        todo = [s]
        while todo:
            v = todo.pop()
            for a, b in edges:
                if a == v and b not in out[s]:
                    out[s].add(b)
                    todo.append(b)
    return out


def test_components_by_brute_force(spark):
    rnd = random.Random(4)
    n, edges = 30, [(rnd.randrange(30), rnd.randrange(30)) for _ in range(34)]
    e = spark.createDataFrame([*edges, (None, 1), (3, None)], "a long, b long")
    reach = _reach(edges, n)
    want = {}
    for v in range(n):
        same = {w for w in reach[v] if v in reach[w]} | {v}
        if len(same) > 1:
            want[v] = (min(same), len(same))
    assert {r["id"]: (r["scc"], r["size"]) for r in G.strong_components(spark, e).collect()} == want
    both = _reach(edges + [(b, a) for a, b in edges], n)
    nodes = spark.range(n)
    assert {r["id"]: r["component"] for r in G.weak_components(spark, nodes, e).collect()} == {v: min(both[v] | {v}) for v in range(n)}


def test_empty_graph(spark):
    e = spark.createDataFrame([], "a long, b long")
    assert G.strong_components(spark, e).count() == 0
    assert G.weak_components(spark, spark.range(0), e).count() == 0
    assert [r["betweenness"] for r in G.betweenness(spark, spark.range(2), e).collect()] == [0.0, 0.0]
    assert G.importance(spark, spark.createDataFrame([], "ord int, id long, raw double"), e).count() == 0
    assert {r["id"]: r["level"] for r in G.topo_levels(spark, spark.range(2), e).collect()} == {0: 0, 1: 0}


def test_levels(spark):
    n = spark.createDataFrame([(c,) for c in "abcdexy"], "id string")
    e = spark.createDataFrame([tuple(x) for x in ["ab", "ab", "bc", "ac", "xy", "yx", "dx"]], "a string, b string")
    assert {r["id"]: r["level"] for r in G.topo_levels(spark, n, e).collect()} == {"c": 0, "e": 0, "b": 1, "a": 2, "x": None, "y": None, "d": None}


FILES = "repo_id string, id string, path string, imports array<struct<source:string,type:string,line_imported:int>>"


def test_resolution(spark):
    f = spark.createDataFrame(
        [
            ("r", "f1", "src/index.ts", [("./utils/helpers", "file", 1), ("./components/Button", "file", 2), ("./none", "file", 3), ("lodash/fp", "package", 4), ("./utils/helpers", "file", 9), (None, "file", 5)]),
            ("r", "f2", "src/utils/helpers.ts", [("../index", "file", 1), ("@a/b/c", "package", 2)]),
            ("r", "f3", "src/components/Button/index.tsx", None),
            ("q", "f4", "src/utils/helpers.ts", []),
        ],
        FILES,
    )
    got = L.resolve_files(L.imports_of(f), f)
    assert {(r["from_id"], r["imp_ord"], r["to_id"]) for r in got.collect()} == {("f1", 0, "f2"), ("f1", 1, "f3"), ("f1", 4, "f2"), ("f2", 0, "f1")}
    d = {(r["from_id"], r["to_id"]): (r["frequency"], r["line"], r["weight"]) for r in L.direct_links(got).collect()}
    assert d["f1", "f2"] == (2, 1, 200)
    p = spark.createDataFrame([("pkg_lodash", "lodash"), ("pkg_a_b", "@a/b")], "id string, name string")
    assert {(r["from_id"], r["package_id"]) for r in L.resolve_packages(L.imports_of(f), p).collect()} == {("f1", "pkg_lodash"), ("f2", "pkg_a_b")}


def test_indirect(spark):
    e = spark.createDataFrame([("r", *x) for x in ["ab", "bc", "ad", "dc", "ac", "cd", "bd"]], "repo_id string, from_id string, to_id string")
    got = {(r["from_id"], r["to_id"]): r["frequency"] for r in L.indirect_links(e).collect()}
    assert ("a", "c") not in got and got == {k: v for k, v in got.items() if k[0] != k[1]}


def test_routes(spark):
    f = spark.createDataFrame([("r", "1", "app/users.tsx"), ("r", "2", "app/users/page.tsx"), ("r", "3", "app/x.ts"), ("r", "4", "src/pages/layout.js"), ("r", "5", "src/pages/layout/a.js")], "repo_id string, id string, path string")
    assert {(r["from_id"], r["to_id"], r["type"], r["weight"]) for r in L.route_links(f).collect()} == {("1", "2", "route", 60), ("4", "5", "layout", 90)}


def test_folders_shadow_files(spark):
    """As a file system answers: `./utils` is the folder if there is one, though utils.js lies beside it."""
    f = spark.createDataFrame([("r", "1", "src/a.js", [("./utils", "file", 1), ("./util", "file", 2)]), ("r", "2", "src/utils.js", []), ("r", "3", "src/utils/index.js", []), ("r", "4", "src/util.js", []), ("q", "5", None, None)], FILES)
    got = lambda **k: {(r["source"], r["to_id"]) for r in L.resolve_files(L.imports_of(f), f, **k).collect()}
    assert got() == {("./utils", "2"), ("./util", "4")} and got(folders=True) == {("./util", "4")}
