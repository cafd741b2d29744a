import pytest

from srcatlas.llm.handwritten import by_layout, judged, statistics, verdict

HAND = "import a from 'b';\n\nexport function run(x) {\n  if (!x) {\n    return null;\n  }\n  const y = x.map((z) => z + 1);\n  return y;\n}\n" * 2
MIN = "!function(e,t){'use strict';" + "".join(f"function a{i}(n,r){{return n?r.id(n,{i}):null}}" for i in range(40)) + "}(this);"
DATA = "export default [\n" + "".join(f"  [{i}.25, -{i}.5, {i * 997}],\n" for i in range(60)) + "];\n"
GEN = "export class M {\n" + "".join(f"  getA{i}() {{ return this.f[{i}]; }}\n" for i in range(20)) + "}\n"


@pytest.mark.parametrize(
    "path,content,want",
    [
        ("src/a.js", HAND, None),
        ("src/vendor-portal/generatedIds.js", HAND, None),
        ("lib/checkout/dist.js", "// generated ids start at 0, do not edit the list while it loads\n" + HAND, None),
        ("a.js", HAND + "// TODO: this list used to be generated by x, now edited by hand\n", None),
        ("a.js", "const H = '// Code generated by x. DO NOT EDIT.';\n" + HAND, None),
        ("a.ts", "/*\n * Copyright the A team. MIT licensed.\n */\n" + HAND, None),
        ("a.ts", HAND + "//# sourceMappingURL=data:application/json;base64," + "QUJD" * 900, None),
        ("a.js", "const s = '" + "long words in a text " * 60 + "';\n" + HAND, None),
        ("a.js", "// Code generated by x. DO NOT EDIT.\n" + HAND, "generated"),
        ("a.js", HAND + "/* eslint-disable */\n// @generated by y v1\n", "generated"),
        ("a.js", GEN, "generated"),
        ("a.js", MIN, "minified"),
        ("a.js", DATA, "data"),
        ("a.js", 'export default "' + "aB3/" * 500 + '";\n', "data"),
        ("third_party/x/core.js", HAND, "vendored"),
        ("public/js/lib-1.2.3.js", HAND, "vendored"),
        ("a.js", ";/*\n * lib\n * Build 3.0.2, see upstream for source\n */\n" + HAND, "vendored"),
        ("a.js", "/*! lib v1.2.3 | (c) the x contributors | MIT */\n" + HAND, "vendored"),
        (None, None, None),
        ("a.js", "", None),
    ],
)
def test_verdict(path, content, want):
    assert verdict(path, content) == want


def test_copies_and_odd_rows(spark):
    rows = [
        ("1", "r", "third_party/x/core.js", "code", HAND),
        ("2", "q", "src/own.js", "code", "/* other */\n" + HAND.replace("  ", "\t")),
        ("3", "q", "src/b.js", "code", HAND.replace("run", "walk")),
        ("4", None, None, "code", None),
        ("5", "q", "a.css", "style", MIN),
        ("6", "q", "b.js", None, MIN),
        ("3", "q", "src/b.js", "code", HAND.replace("run", "walk")),
        ("7", "q", "c.js", "code", "x = 1;\n" * 300_000),
    ]
    df = spark.createDataFrame(rows, "id string, repo_id string, path string, type string, content string").selectExpr("*", "'clash' AS reason", "1 AS copied")
    got = {r["file_id"]: r["reason"] for r in judged(df).collect()}
    assert {k: got[k] for k in "1234"} == {"1": "vendored", "2": "vendored", "3": None, "4": None} and set(got) == set("12347")
    assert judged(df.limit(0)).count() == 0


def test_code_of_many_repositories(spark):
    """Code that stands in three repositories is a copy without any notice; in two it may be anybody's. Copies of a row count once."""
    other, third = HAND.replace("run", "walk"), HAND.replace("run", "stroll")
    rows = [(str(i), f"r{i % 3}", f"src/{i}.js", "code", HAND) for i in range(9)]
    rows += [(f"b{i}", f"r{i % 2}", f"lib/{i}.js", "code", other) for i in range(8)] + [("n1", None, "a.js", "code", third), ("n2", "r0", "a.js", "code", third), ("n3", "r1", "a.js", "code", third)]
    df = spark.createDataFrame(rows + rows[:2], "id string, repo_id string, path string, type string, content string")
    got = {r["file_id"]: (r["reason"], r["evidence"]) for r in judged(df).collect()}
    assert {k for k, v in got.items() if v == ("vendored", "copies")} == {str(i) for i in range(9)}
    assert all(v == (None, None) for k, v in got.items() if k[0] in "bn")


def test_statistics_find_most_without_notices():
    """Layout alone finds what the notices of generators and minifiers would tell."""
    for path, content in (("a.js", GEN), ("a.js", MIN), ("a.js", DATA), ("a.ts", "// x\n" + GEN)):
        assert by_layout(path, statistics(content))
    for path in ("a.js", "a.ts", "a.tsx", "a.vue", "a.unknown"):
        assert by_layout(path, statistics(HAND)) is None and by_layout(path, statistics("")) is None
