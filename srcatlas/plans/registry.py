"""All core queries and their oracle SQL, collected from the plan modules."""

from __future__ import annotations

from importlib import import_module

from ..operators import compaction

_P5_SQL = """
WITH b AS (SELECT body FROM record_files WHERE body IS NOT NULL),
t AS (SELECT body AS x FROM b WHERE json_valid(body) UNION ALL SELECT unnest(string_split(body, chr(10))) FROM b WHERE NOT json_valid(body)),
v AS (SELECT x::JSON AS j FROM t WHERE json_valid(x)),
e AS (SELECT unnest(CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') ELSE [coalesce(json_extract(j, '$.file'), j)] END) AS r FROM v)
SELECT DISTINCT r->>'$.id' AS file_id, lower(r->>'$.hash') AS hash FROM e WHERE r->>'$.id' IS NOT NULL AND r->>'$.hash' IS NOT NULL
"""
_MODULES: tuple[str, ...] = ("file_queries", "graph_queries", "describe_queries", "source_queries")


def queries() -> dict:
    out = {"p5_found": compaction.p5_found, "p5_manifest": compaction.p5_manifest}
    for m in _MODULES:
        out |= import_module(f".{m}", __package__).QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {"p5_found": _P5_SQL}
    for m in _MODULES:
        out |= import_module(f".{m}", __package__).SQL
    return out
