"""python -m srcatlas: scan, map, summarize, search, node, deps, file and stats over a tree or a saved map."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="srcatlas")
    p.add_argument("command", choices=["analyze", "search", "files", "node", "deps", "file", "stats"])
    p.add_argument("folder", help="a tree for analyze, else the folder of a saved map")
    p.add_argument("text", nargs="?", default="", help="query, node, path or, for analyze, where to save the map")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--model", choices=["heuristic", "none"], default="heuristic")
    p.add_argument("--hidden", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("srcatlas").getOrCreate()
    if a.command == "analyze":
        engine = Engine.scan(spark, a.folder, hidden=a.hidden, out_dir=".srcatlas")
        engine.map()
        engine.summarize(a.model)
        engine.save(a.text or f"{a.folder}/.srcatlas")
        engine.metadata().show(truncate=False)
        return
    engine = Engine.load(spark, a.folder)
    out = {
        "search": lambda: engine.search(a.text, a.limit),
        "files": lambda: engine.search_files(a.text, a.limit),
        "node": lambda: engine.node(a.text),
        "deps": lambda: engine.dependencies(a.text, a.depth),
        "file": lambda: engine.get_file(a.text).select("id", "path", "description", "importance_score", "imports", "exported"),
        "stats": lambda: engine._map["statistics"],
    }[a.command]()
    out.show(a.limit, truncate=False)


if __name__ == "__main__":
    main()
