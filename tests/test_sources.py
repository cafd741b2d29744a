"""Trees, ignore files, streams, descriptions."""

import os

from srcatlas.operators.describe import EXPORTED, FUNCTIONS, IMPORTS, file_description
from srcatlas.sources import repository as R
from srcatlas.sources.ignore import Ignore, rewrite
from srcatlas.streaming.incremental import event_windows, watch_files


def test_ignore():
    i = Ignore(["dist/", "*.log", "!keep.log", "a/**/z.js", "x?.ts", "[ab].md", rewrite("private/", "docs")])
    yes = ["dist/a.js", "q/dist/b", "m.log", "k/m.log", "a/z.js", "a/b/c/z.js", "x1.ts", "d/a.md", "docs/private/s", "node_modules/p", ".git/HEAD"]
    no = ["distance/a.js", "keep.log", "b/z.js", "x12.ts", "c.md", "private/s", "m.log2"]
    assert [p for p in yes if not i(p)] == [] and [p for p in no if i(p)] == []
    assert rewrite("/dist") == "dist" and rewrite("# x") == "" and rewrite("!/a", "d") == "!d/a"


def test_scan(spark, tmp_path):
    for p, text in {"a.ts": "1", "b.css": "2", "c.md": "3", "d.png": "4", "e.zip": "5", ".env.example": "6", "docs/.gitignore": "private/", "docs/private/x.md": "7", "broken.js": "function ("}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    os.symlink(tmp_path / "a.ts", tmp_path / "link.ts")
    got = {r["path"]: r["type"] for r in R.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.ts": "code", "b.css": "style", "c.md": "docs", "d.png": "media", ".env.example": "config", "docs/.gitignore": "config", "broken.js": "code"}
    assert "d.png" not in {r["path"] for r in R.scan(spark, str(tmp_path), aggressive=False).collect()}


def test_save_and_load(spark, tmp_path):
    R.save({"t": spark.createDataFrame([("r", 1)], "repo_id string, n int")}, str(tmp_path))
    assert R.load(spark, str(tmp_path), "t").count() == 1 and R.load(spark, str(tmp_path), "u") is None


def test_stream_of_changed_files(spark, tmp_path):
    src, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    run = lambda: watch_files(spark, src, spark.createDataFrame([], "path string, hash string").schema, cache, str(tmp_path / "cp"), lambda d: d).awaitTermination()
    spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1")], "path string, hash string").write.parquet(src)
    run()
    spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string").write.mode("append").parquet(src)
    run()
    assert sorted((r["path"], r["hash"]) for r in spark.read.parquet(cache).collect()) == [("a", "1"), ("b", "1"), ("b", "2")]


def test_windows(spark):
    e = spark.sql("SELECT timestamp_ntz'2024-01-01 01:00:00' AS ts, 'x' AS event_type UNION ALL SELECT timestamp_ntz'2024-01-01 02:00:00', 'x'")
    assert [r["n"] for r in event_windows(e).collect()] == [2]


def test_description(spark):
    f = spark.createDataFrame(
        [
            ("1", "a.test.js", "src/a.test.js", "javascript", [("react", "package", 1)], [("f", "function")], [("i", "f", "function", "f()", 1, 2, "", True, [], None)], "useState()"),
            ("2", "b.js", "lib/b.js", None, None, None, None, None),
            ("3", "c.jsx", "ui/Nav.jsx", "javascriptreact", [("./x", "file", 1)], [("default", "reference"), ("Nav", "function")], [("i", "Nav", "function", "Nav()", 1, 2, "", True, [], None)], "return (<div/>)"),
        ],
        f"id string, name string, path string, language string, imports {IMPORTS}, exported {EXPORTED}, functions {FUNCTIONS}, content string",
    )
    d = {r["file_id"]: r["description"] for r in file_description(f).collect()}
    assert d["1"].startswith("JavaScript test file (a.test.js) covering 1 scenario. Depends on packages `react`. Exports `f`.")
    assert d["2"] == "unknown source file at `lib/b.js`."
    assert d["3"].startswith("Implements the navigation bar in `ui/Nav.jsx` through the `Nav` component. It coordinates local modules such as `./x`.")


def test_chunks(spark):
    from pyspark.sql import functions as F

    from srcatlas.functions import scalars as S

    def parts(texts, cap, slack):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        return [r["p"] for r in df.select(S.chunks(F.col("t"), cap, slack).alias("p")).collect()]

    assert parts(["", "a" * 10, "a" * 25], 10, 3) == [[""], ["a" * 10], ["a" * 10, "a" * 10, "a" * 5]]
    assert parts(["aaaaaaaa\nbbbbbbbbbb\ncc"], 10, 3) == [["aaaaaaaa\n", "bbbbbbbbbb\n", "cc"]]
    long = ["aaaaaaaa\nbbbbbbbbbb\ncc" * 40, "x\n" * 700, "y" * 3001, "é\u2028\r" * 90_000]
    for t, p in zip(long, parts(long, 1000, 100)):
        assert "".join(p) == t and all(len(x) <= 1100 for x in p)


def test_replies(spark):
    from pyspark.sql import functions as F

    from srcatlas.functions import scalars as S

    told = {
        None: ("", []), "  ": ("", []), "plain\u00a0": ("plain", []), 'x {"description": " d ", "tags": ["A", 2]} y': ("d", ["a", "2"]), '{"description": "", "tags": []}': ('{"description": "", "tags": []}', []),
        "Does it.\nTags: ['X', \"y\" , ]\nmore tags: [z]": ("Does it.\n\nmore tags: [z]", ["x", "y"]), '{"description": "d", "tags": "no"}': ('{"description": "d", "tags": "no"}', []), "{broken": ("{broken", []),
        '{"description": "d", "tags": [' + ", ".join(f'"{i}"' for i in range(12)) + "]}": ("d", [str(i) for i in range(10)]),
    }
    df = spark.createDataFrame([(t,) for t in told], "t string")
    for r in df.select("t", S.parse_response(F.col("t")).alias("p")).collect():
        assert (r["p"]["description"], r["p"]["tags"]) == told[r["t"]], r["t"]


def test_formats(spark):
    from pyspark.sql import functions as F

    from srcatlas.functions import scalars as S

    df = spark.createDataFrame([(None, 0, 0), (1023, 1, 2), (1536, 20, 20), (1 << 20, 0, 3)], "n long, a long, b long")
    assert [r["x"] for r in df.select(S.format_bytes(F.col("n")).alias("x")).collect()] == ["—", "1023 B", "1.5 KB", "1.00 MB"]
    assert [r["x"] for r in df.select(S.progress_bar(F.col("a"), F.col("b"), 4).alias("x")).collect()] == [None, "50% ▕██░░▏ (1/2)", "100% ▕████▏ (20/20)", "0% ▕░░░░▏ (0/3)"]


def test_tags(spark):
    from pyspark.sql import functions as F

    from srcatlas.functions import scalars as S

    told = {
        "import Link from 'next/link'": ["routing"], "fetch (x)": ["api-client"], "prefetch(x)": [], "got": ["api-client"], "gotten": [], "from 'x@auth/core'": ["auth"], "'@auth/core'": [], "'@prisma/client'": ["db-client"],
        "document.cookie": ["browser-storage"], "documentXcookie": [], "useEffect(() => {})": ["side-effect-hook"], "useEffect": [], "éfetch(x)": ["api-client"], "react-router-dom": ["routing"], "": [], "x@tanstack/react-router": ["routing"],
    }
    df = spark.createDataFrame([(t, []) for t in told], "t string, s array<string>")
    assert {r["t"]: r["g"] for r in df.select("t", S.behavior_tags(F.col("t"), F.col("s")).alias("g")).collect()} == told


def test_description_reads_whole_contents(spark):
    row = ("1", "a.js", "lib/a.js", "javascript", [], [], [], "// header\n" * 80 + "useState(0)")
    f = spark.createDataFrame([row], f"id string, name string, path string, language string, imports {IMPORTS}, exported {EXPORTED}, functions {FUNCTIONS}, content string")
    assert "manages local component state" in file_description(f).first()["description"]


def test_legacy_map(spark, tmp_path):
    """A map saved as one JSON file is read where there is no table of that name."""
    (tmp_path / "map.json").write_text('{"files": [{"id": "file_001", "path": "a.js"}, {"id": "file_002", "path": "b.js"}], "packages": []}')
    assert [r["path"] for r in R.load(spark, str(tmp_path), "files").orderBy("id").collect()] == ["a.js", "b.js"]
    assert R.load(spark, str(tmp_path), "links") is None


def test_ordinals(spark):
    """Numbers within a key without gaps, also where one key holds most rows; nulls are a key."""
    from srcatlas.runtime import ordinals

    df = spark.range(5000).selectExpr("CASE WHEN id % 10 < 8 THEN 'hot' WHEN id % 10 = 8 THEN 'k' END AS key", "(id * 7919) % 5000 AS v")
    got = ordinals(spark, df, "key", "v").collect()
    for k in ("hot", "k", None):
        mine = sorted((r["v"], r["ordinal"]) for r in got if r["key"] == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert ordinals(spark, df.limit(0), "key", "v").count() == 0


def test_head_bytes_and_waits(spark):
    from pyspark.sql import functions as F

    from srcatlas.functions import scalars as S

    df = spark.createDataFrame([("aé", None, None, None), ("é" * 3, "2", "1m0.5s", None), (None, "x", "3s", "1m"), ("", "1.5", None, "")], "t string, a string, b string, c string")
    got = df.select(S.head_bytes(F.col("t"), 2).alias("h"), S.retry_wait(F.col("a"), F.col("b"), F.col("c")).alias("w")).collect()
    assert [r["h"] for r in got] == ["a\ufffd", "é", None, ""] and [r["w"] for r in got] == [None, 60500.0, 60000.0, 1500.0]


def test_log_noise(spark):
    from pyspark.sql import functions as F

    from srcatlas.functions import scalars as S

    told = {"45% done": True, "at 45%": False, "[==>  ]": True, "\x1b[32m10%\x1b[0m": True, "Scanned 12 files": True, "█": True, "saved": False, None: False}
    df = spark.createDataFrame([(m,) for m in told], "m string")
    assert {r["m"]: r["n"] for r in df.select("m", S.is_log_noise(F.col("m")).alias("n")).collect()} == told


def test_classification_by_hand(spark):
    """Categories and languages as literal values, apart from the tables."""
    from pyspark.sql import functions as F

    from srcatlas.functions import scalars as S

    told = {
        "a.ts": ("code", "typescript"), "b.css": ("style", "css"), "c.md": ("docs", "markdown"), "d.png": ("media", "unknown"), "e.sql": ("database", "sql"), "f.json": ("config", "json"), ".env.example": ("config", "dotenv"), "random.bin": ("other", "unknown"),
        "x.tsx": ("code", "typescriptreact"), "x.jsx": ("code", "javascriptreact"), "x.mjs": ("code", "javascript"), "x.vue": ("code", "vue"), "y.yml": ("config", "yaml"), "y.toml": ("config", "toml"), "s.scss": ("style", "scss"), "h.htm": ("docs", "html"), "i.svg": ("media", "svg"),
        "z.tar": ("archive", "unknown"), "f.woff2": ("font", "unknown"), "p.pdf": ("binary", "unknown"), "w.wasm": ("binary", "unknown"), "d.sqlite": ("database", "unknown"), "Dockerfile": ("config", "unknown"), "README": ("docs", "unknown"), ".gitignore": ("config", "unknown"), "A.TS": ("code", "typescript"), ".env": ("config", "dotenv"), "noext": ("other", "unknown"),
    }
    df = spark.createDataFrame([(n,) for n in told], "n string")
    assert {r["n"]: (r["c"], r["l"]) for r in df.select("n", S.category(F.col("n")).alias("c"), S.language(F.col("n")).alias("l")).collect()} == told
