"""The subpackage's queries and their SQL, added to the driver contract when it can be imported."""

from . import encoding, groups, handwritten, leakage, mixing, pieces, syntax

QUERIES = {
    "p1_found": groups.p1_found,
    "p2_found": pieces.p2_found,
    "p2_pieces": pieces.p2_pieces,
    "p2_quality": pieces.p2_quality,
    "p3_found": handwritten.p3_found,
    "p3_reasons": handwritten.p3_reasons,
    "p4_found": syntax.p4_found,
    "p4_errors": syntax.p4_errors,
    "p4_rates": syntax.p4_rates,
    "p6_found": leakage.p6_found,
    "p6_items": leakage.p6_items,
    "p7_mix": mixing.p7_mix,
    "p7_shares": mixing.p7_shares,
    "p8_found": encoding.p8_found,
    "p8_restored": encoding.p8_restored,
}

SQL = {
    "p1_found": """
WITH RECURSIVE ids AS (SELECT DISTINCT id, lower(trim(id)) AS k FROM files WHERE id IS NOT NULL),
m AS (SELECT n.rn, lower(trim(u.m)) AS k FROM (SELECT row_number() OVER () AS rn, files FROM networks WHERE type = 'active') n, UNNEST(n.files) u(m) WHERE lower(trim(u.m)) IN (SELECT k FROM ids)),
l AS (SELECT lower(trim(from_file_id)) AS a, lower(trim(to_file_id)) AS b FROM links
      UNION SELECT min(k) OVER (PARTITION BY rn), k FROM m),
e AS (SELECT a, b FROM l WHERE a IN (SELECT k FROM ids) AND b IN (SELECT k FROM ids) AND a <> b),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(k, c) USING KEY (k) AS (
  SELECT k, min(id) FROM ids GROUP BY 1
  UNION
  SELECT u.b, min(x.c) FROM cc x JOIN u ON u.a = x.k JOIN recurring.cc y ON y.k = u.b WHERE x.c < y.c GROUP BY u.b)
SELECT ids.id AS file_id, cc.c AS group_id FROM ids JOIN cc USING (k)
""",
    "p2_found": """
WITH lines AS (
  SELECT DISTINCT f.content, u.fn FROM files f, UNNEST(f.functions) u(fn) WHERE length(f.content) > 2000
), spans AS (
  SELECT fn.id AS item_id, content, fn.line_start AS a, fn.line_end AS b,
         string_split(content, chr(10)) AS l
  FROM lines WHERE fn.line_start IS NOT NULL AND fn.line_end IS NOT NULL AND fn.id IS NOT NULL
), sized AS (
  SELECT item_id, length(array_to_string(l[greatest(a, 1):least(b, len(l))], chr(10)))
         + CASE WHEN b < len(l) THEN 1 ELSE 0 END AS n
  FROM spans WHERE b >= a
)
SELECT 'function' AS item_kind, item_id FROM sized WHERE n > 2000
UNION
SELECT 'chunk', id FROM chunks WHERE length(text) > 2000 AND id IS NOT NULL
""",
}
