import os

import numpy as np
import pytest

from srcatlas.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer")
TOPIC = {"a": "kettle water steam tea cup", "b": "engine wheel brake road tyre", "c": "violin bow string note choir"}


def docs(spark, n=240):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        s = "aaabbc"[i % 6]
        text = " ".join(rng.choice(TOPIC[s].split(), 30 + i % 17))
        rows.append((i, text, [s, f" {s.upper()} ", s, s][i % 4] if i % 20 else None))
    rows += [(9001, None, "a"), (9002, "", "b"), (9003, "other words entirely", "unlisted"), (None, "x", "a"), (0, "tea", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS repeats", "2.0 AS rate")


def test_mix(spark):
    t = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(spark, docs(spark), t)
    s = {r["source"]: r for r in shares.collect()}
    for k, want in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(s[k]["actual_share"] - want) < 0.03, s
    assert s["gone"]["actual_share"] == 0 and all(s[k]["most_used"] <= m for k, m in (("a", 2), ("b", 2), ("c", 3)))
    rows = chosen.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and not {9001, 9002, 9003} & {r["doc_id"] for r in rows}


def test_posteriors_tell_domains(spark):
    counted = docs(spark).selectExpr("doc_id", "text", "lower(trim(source)) AS source").filter("text <> '' AND doc_id < 9000 AND length(text) > 9")
    got = {r["doc_id"]: r["m"] for r in mixing._posteriors(spark, counted, ["a", "b", "c"]).collect()}
    assert got and np.mean([int(np.argmax(m)) == "abc".index("aaabbc"[d % 6]) for d, m in got.items()]) >= 0.9
    # Listed sources without documents take no class, and those behind them keep theirs.
    got = {r["doc_id"]: r["m"] for r in mixing._posteriors(spark, counted, ["a", "aa", "b", "bb", "c"]).collect()}
    assert np.mean([int(np.argmax(m)) == "a.b.c".index("aaabbc"[d % 6]) for d, m in got.items()]) >= 0.9 and all(m[1] == m[3] == 0 for m in got.values())


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(spark, docs(spark).limit(0), t)
    assert chosen.count() == 0 and shares.collect()[0]["mixed_tokens"] == 0
    chosen, shares = mixing.mix(spark, docs(spark, 12), t.limit(0))
    assert chosen.count() == 0 and shares.count() == 0


def test_repeated_ids(spark):
    """Of rows with one doc_id the longest text counts; of equally long ones the same one in any order of rows."""
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = [(i, f"tea cup number {i} and {i}", "a" if i % 2 else "b") for i in range(40)] + [(1, "a much longer text about tea and cups and kettles", "b"), (2, "tea cup number 2 and x", "a"), (3, "tea cup number 3 and 3", "a")]
    runs = []
    for order in (rows, rows[::-1]):
        chosen, _ = mixing.mix(spark, spark.createDataFrame(order, "doc_id long, text string, source string"), t)
        runs.append(sorted(tuple(r) for r in chosen.collect()))
    assert runs[0] == runs[1] and len({r[0] for r in runs[0]}) == len(runs[0])
    assert {r[0]: r[1] for r in runs[0]}.get(1, "b") == "b"
