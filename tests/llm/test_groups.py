import random

from srcatlas.llm.groups import components, group_ids


def test_components_by_brute_force(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(500, x) for x in range(501, 560)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rnd.shuffle(edges)
    got = {r["v"]: r["root"] for r in components(spark, spark.createDataFrame([*edges, (None, 3), (7, None)], "a long, b long"))[0].collect()}
    want = {v: find(v) for v in parent}
    assert {v: got.get(v, v) for v in want} == want


def test_group_ids(spark):
    ids = spark.createDataFrame([("f3", 1), ("f1", 2), ("f1", 2), ("F2", 3), ("f4", None), ("f5", 5), (None, 6), ("g", 0)], "id string, component int")
    pairs = spark.createDataFrame([(" f3 ", "F1"), ("f4", "nowhere"), (None, "f5"), ("f5", "f5"), ("f1", "f3")], "a string, b string")
    lists = spark.createDataFrame([(["f2", None, "F1", "f1", "zz"],), ([],), (None,), (["f4"],)], "members array<string>")
    got = {r["file_id"]: r["group_id"] for r in group_ids(spark, ids, pairs, lists).collect()}
    assert got == {"f3": "F2", "f1": "F2", "F2": "F2", "f4": "f4", "f5": "f5", "g": "g"}


def test_empty(spark):
    none = spark.createDataFrame([], "id string")
    pairs, lists = spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "members array<string>")
    assert group_ids(spark, none, pairs, lists).count() == 0
    assert group_ids(spark, spark.createDataFrame([("x",)], "id string"), pairs, lists).collect()[0]["group_id"] == "x"


def test_giant_component_and_hub(spark):
    """A path, a hub and a list that hold most of all nodes end in one group, with few rounds."""
    n = 3000
    ids = spark.range(n + 50).selectExpr("format_string('f%05d', id) AS id")
    f = lambda i: f"f{i:05d}"
    path = [(f(i), f(i + 1)) for i in range(1000, 2000)]
    hub = [(f(999), f(i)) for i in range(2000, 2900)] * 2
    pairs = spark.createDataFrame([*path, *hub], "a string, b string")
    lists = spark.createDataFrame([([f(i) for i in range(1, 1001)],), ([f(2899), f(2950)],)], "members array<string>")
    got = {r["file_id"]: r["group_id"] for r in group_ids(spark, ids, pairs, lists).collect()}
    joined = set(range(1, 2900)) | {2950}
    assert got == {f(i): f(1) if i in joined else f(i) for i in range(n + 50)}
