"""A tree from scan to search, and the commands over the saved map."""

import pytest

from srcatlas.__main__ import main
from srcatlas.engine import Engine, least_delay, with_retries
from srcatlas.sources import repository as R

TREE = {
    "src/main.js": "import { App } from './App';\nimport React from 'react';\nApp();\n",
    "src/App.js": "import { Header } from './Header';\nexport function App(props) { return Header(props) }\n",
    "src/Header.js": "export const Header = (p) => p;\n",
    "src/ring/a.ts": "import { b } from './b';\nexport const a = b;\n",
    "src/ring/b.ts": "import { a } from './a';\nexport const b = a;\n",
    "src/auth.js": "const jwt = require('jsonwebtoken');\nasync function authenticate(req, res, next) { next() }\nmodule.exports = { authenticate };\n",
    "broken.js": "function (",
    "README.md": "# Shop",
    "package.json": '{"dependencies": {"react": "^18.0.0"}, "devDependencies": {"jsonwebtoken": "^9"}}',
    "node_modules/react/package.json": '{"name": "react", "version": "18.2.0"}',
    ".hidden/x.js": "1",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, text in TREE.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    e = Engine.scan(spark, str(tree))
    e.map()
    return e


def test_scan(engine):
    m = engine.metadata().first()
    assert (m["files_analyzed"], m["files_ignored"], m["files_summarizable"]) == (9, 2, 7)
    f = {r["path"]: r for r in engine.files.collect()}
    assert [x["source"] for x in f["src/main.js"]["imports"]] == ["./App", "react"]
    assert f["broken.js"]["functions"] == [] and f["broken.js"]["parse_error"]
    assert [(x["name"], x["type"]) for x in f["src/auth.js"]["exported"]] == [("default", "reference")]
    assert {(r["name"], r["version"]) for r in engine.packages.collect()} == {("react", "18.2.0"), ("jsonwebtoken", "^9")}


def test_map(engine):
    m = engine._map
    path = {r["id"]: r["path"] for r in engine.files.collect()}
    links = {(path[r["from_id"]], path.get(r["to_id"], r["package_id"]), r["type"], r["weight"]) for r in m["links"].collect()}
    assert ("src/main.js", "src/App.js", "direct", 100) in links and ("src/main.js", "src/Header.js", "indirect", 50) in links
    assert ("src/ring/a.ts", "src/ring/b.ts", "circular", 200) in links and ("src/main.js", "pkg_react", "package", 80) in links
    ids = [r["id"] for r in m["links"].collect()]
    assert sorted(ids) == [f"link_{i:04d}" for i in range(1, len(ids) + 1)]
    assert [[path[x] for x in r["files"]] for r in m["cycles"].collect()] == [["src/ring/a.ts", "src/ring/b.ts"]]
    nets = {r["id"]: (r["name"], r["type"], r["node_count"], r["edge_count"]) for r in m["networks"].collect()}
    assert nets == {"network_main": ("Main Codebase", "active", 5, 4), "network_isolated": ("Unused Files", "isolated", 4, 0)}
    s = m["statistics"].first()
    assert (s["total_files"], s["circular_dependency_count"], s["network_density"]) == (9, 1, round(4 / 72, 4))
    f = {r["path"]: r for r in engine.files.collect()}
    assert f["src/App.js"]["importance_score"] >= f["src/main.js"]["importance_score"] > 0 and f["README.md"]["importance_score"] == 0
    assert f["src/Header.js"]["usage_count"] == 1
    assert {r["name"]: r["usage_count"] for r in engine.packages.collect()} == {"react": 1, "jsonwebtoken": 1}


def test_summarize(spark, engine):
    stats, kept = engine.summarize("heuristic")
    assert (stats.first()["files"], stats.first()["files_from_cache"]) == (7, 0) and kept.count() == 7
    assert "middleware" in {r["path"]: r["description"] for r in engine.files.collect()}["src/auth.js"]
    stats, _ = engine.summarize("heuristic", kept)
    assert (stats.first()["files"], stats.first()["files_from_cache"]) == (0, 7)
    reply = lambda f: '{"description": "About ' + f["name"] + '", "tags": ["Auth"]}' if f["name"] != "broken.js" else 1 / 0
    stats, kept = engine.summarize(reply, kept.filter("path <> 'src/auth.js' AND path <> 'broken.js'"), delays=())
    got = {r["path"]: r for r in engine.files.collect()}
    assert (got["src/auth.js"]["description"], got["src/auth.js"]["tags"]) == ("About auth.js", ["auth"])
    assert got["broken.js"]["description"] == "" and got["README.md"]["description"] == "" and kept.count() == 6
    assert engine.summarize("heuristic", kept.withColumn("version", kept["version"] + 1))[0].first()["files_from_cache"] == 0
    assert [r["path"] for r in engine.search_files("auth").collect()] == ["src/auth.js"]


def test_search(engine):
    assert engine.search("auth.js").first()["label"] == "src/auth.js"
    assert engine.search("authenticate").first()["kind"] == "function"
    assert "package" in {r["kind"] for r in engine.search("react").collect()}
    assert engine.search("src", 1).count() == 1 and engine.search("").count() == 0 and engine.search("   ").count() == 0
    assert engine.search_files("", 3).count() == 3


def test_nodes(engine):
    path = {r["id"]: r["path"] for r in engine.files.collect()}
    assert {(r["side"], path[r["id"]], r["distance"]) for r in engine.dependencies("src/App.js", 2).collect()} == {("imports", "src/Header.js", 1), ("imported_by", "src/main.js", 1)}
    assert engine.node("react").first()["kind"] == "package" and engine.node("src/App.js").first()["kind"] == "file"
    func = engine.files.filter("path = 'src/App.js'").first()["functions"][0]["id"]
    assert engine.node(func).first()["label"] == "App" and engine.node("nothing").count() == 0
    assert engine.get_file("src/App.js").count() == 1 and engine.get_map().count() == 9


def test_save_and_commands(spark, engine, tree, tmp_path, capsys):
    engine.save(str(tmp_path / "m"))
    again = Engine.load(spark, str(tmp_path / "m"))
    assert again.files.count() == 9 and again._map["links"].count() == engine._map["links"].count()
    main(["search", str(tmp_path / "m"), "auth.js"])
    assert "src/auth.js" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        Engine.load(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        Engine.scan(spark, str(tmp_path / "none"))


def test_query_and_export(spark, engine, tmp_path):
    assert {r["path"] for r in engine.query("ring", 50).collect()} == {"src/ring/a.ts", "src/ring/b.ts"} and engine.query("").count() == 5
    engine.export_json(str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "files")).count() == 9
    slow, _ = engine.summarize(lambda f: f["path"], delays=(), tokens_per_minute=200_000_000)
    assert slow.first()["files"] == 7 and engine.files.filter("path = 'src/App.js'").first()["description"] == "src/App.js"
    assert least_delay(6000) == 15.0 and least_delay(10**9) == 0.5


def test_empty_tree(spark, tmp_path):
    e = Engine.scan(spark, str(tmp_path))
    m = e.map()
    assert m["links"].count() == 0 and m["networks"].count() == 0 and m["statistics"].first()["total_files"] == 0


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429, retry after 7" if len(calls) == 1 else "odd")
        return "yes"

    assert with_retries(call, (1.0, 2.0), waits.append) == "yes" and waits == [7.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        with_retries(lambda: 1 / 0, (0.0,), lambda s: None)


def test_settings_and_context(tmp_path):
    (tmp_path / "a.json").write_text('{"ai": {"model": "x"}, "n": 1}')
    (tmp_path / "b.json").write_text('{"ai": {"url": "u"}}')
    (tmp_path / "c.json").write_text("{")
    got = R.settings(*(str(tmp_path / n) for n in ("a.json", "b.json", "c.json", "d.json")), defaults={"ai": {"model": "d", "tier": 1}})
    assert got == {"ai": {"model": "x", "tier": 1, "url": "u"}, "n": 1}
    (tmp_path / "AGENTS.md").write_text("y" * 3000)
    assert R.context(str(tmp_path), 4096).endswith("... [truncated]") and R.context(str(tmp_path), 700) == ""


def test_note(tmp_path):
    assert R.note(str(tmp_path)) == "created" and R.note(str(tmp_path)) == "kept"
    other = tmp_path / "other"
    other.mkdir()
    (other / "context.md").write_text("# Mine")
    assert R.note(str(other)) == "updated" and (other / "context.md").read_text().endswith("\n\n# Mine")
