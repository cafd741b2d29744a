"""Consolidation of small files: exact round trip, torn and odd bodies."""

import datetime
import json

import pyarrow.parquet as pq

from srcatlas.operators.compaction import body_records, consolidate

SCHEMA = "store_path string, body string, written_at timestamp_ntz, n_bytes long, record string"
T = datetime.datetime(2024, 1, 1)


def rec(i, h="AB", **more):
    return {"id": f"f{i}", "hash": h, "functions": [{"id": "x", "name": "n"}]} | more


def test_bodies():
    assert [r["id"] for r in body_records(json.dumps(rec(1), indent=2))] == ["f1"]
    assert [r["id"] for r in body_records(json.dumps({"format_version": "2.0", "file": rec(2)}))] == ["f2"]
    assert {r["id"] for r in body_records(json.dumps([rec(1), rec(2)], indent=1))} == {"f1", "f2"}
    lines = "\n".join(map(json.dumps, [rec(1), rec(2), rec(3)]))
    assert [r["id"] for r in body_records(lines)] == ["f1", "f2", "f3"]
    assert [r["id"] for r in body_records(lines[:-5])] == ["f1", "f2"]
    torn = json.dumps(rec(1))[:20] + "\n" + json.dumps(rec(2))
    assert [r["id"] for r in body_records(torn)] == ["f2"]
    for odd in (None, "", "  \n", "{", "[]", "null", "12", '{"id": 1, "hash": "x"}', json.dumps(rec(1))[:-1]):
        assert body_records(odd) == []


def test_round_trip(spark):
    rows = [(f"p{i}", json.dumps(rec(i % 40, "Ab" if i % 2 else "aB", n=i)), T + datetime.timedelta(i), 1, "clash") for i in range(300)]
    rows += [("hot", json.dumps(rec(7, "zz")), None, None, None)] * 200 + [("n", None, None, None, None), ("e", "", T, 0, "")]
    records, manifest = consolidate(spark, spark.createDataFrame(rows, SCHEMA), target_bytes=1500)
    got = records.collect()
    assert sorted((r["file_id"], r["hash"]) for r in got) == sorted({(f"f{i}", "ab") for i in range(40)} | {("f7", "zz")})
    newest = {r["file_id"]: json.loads(r["record"]).get("n") for r in got if r["hash"] == "ab"}
    assert newest == {f"f{i}": max(x for x in range(300) if x % 40 == i) for i in range(40)}
    check(manifest, 41, got)


def check(manifest, n, got):
    m = sorted(manifest.collect(), key=lambda r: (r["first_id"], r["first_hash"]))
    assert [r["range_no"] for r in m] == list(range(len(m))) and sum(r["n_records"] for r in m) == n == len(got)
    assert sum(r["n_bytes"] for r in m) == sum(len(r["record"].encode()) for r in got)
    assert all((a["last_id"], a["last_hash"]) < (b["first_id"], b["first_hash"]) for a, b in zip(m, m[1:]))
    for r in m:
        keys = [(x["file_id"], x["hash"]) for x in pq.read_table(r["path"].removeprefix("file://")).to_pylist()]
        assert keys == sorted(keys) and keys[0] == (r["first_id"], r["first_hash"]) and keys[-1] == (r["last_id"], r["last_hash"]) and len(keys) == r["n_records"]
    return m


def test_rounds_and_deliveries(spark):
    """More runs than a task merges; a second delivery rewrites only the ranges it touches; an empty one nothing."""
    first = [(f"p{i}", json.dumps(rec(f"{i % 500:04d}", f"{i % 3}", n=i)), T, 1, "") for i in range(3000)]
    df = spark.createDataFrame(first, SCHEMA).repartition(30)
    records, manifest = consolidate(spark, df, target_bytes=6000, fan_in=3)
    m = check(manifest, 1500, records.collect())
    assert len(m) > 3 and all(r["file_bytes"] < 20_000 for r in m)
    late = [("q1", json.dumps(rec("0003", "0", n=-1)), T + datetime.timedelta(1), 1, ""), ("q2", json.dumps(rec("0003x", "9")), None, 1, ""), ("q3", json.dumps(rec("0004", "1", n=-2)), T - datetime.timedelta(1), 1, "")]
    records, again = consolidate(spark, spark.createDataFrame(late, SCHEMA), target_bytes=6000, existing=manifest)
    got = records.collect()
    m2 = check(again, 1501, got)
    kept = {r["path"] for r in m} & {r["path"] for r in m2}
    assert len(kept) == len(m) - 1
    told = {(r["file_id"], r["hash"]): json.loads(r["record"]).get("n") for r in got}
    assert told["f0003", "0"] == -1 and told["f0003x", "9"] is None and told["f0004", "1"] != -2
    _, same = consolidate(spark, spark.createDataFrame([], SCHEMA), existing=again)
    assert {r["path"] for r in same.collect()} == {r["path"] for r in m2}
    many = [(f"r{i}", json.dumps(rec(f"{i:04d}", "new")), T, 1, "") for i in range(0, 700, 7)]
    records, third = consolidate(spark, spark.createDataFrame(many, SCHEMA).repartition(20), target_bytes=6000, existing=again, fan_in=3)
    check(third, 1601, records.collect())


def test_empty(spark):
    records, manifest = consolidate(spark, spark.createDataFrame([], SCHEMA))
    assert records.count() == 0 and manifest.count() == 0
