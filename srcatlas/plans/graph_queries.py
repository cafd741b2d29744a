"""Queries over dependency links: resolution, aggregation, graph analytics, search, node detail, viewer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalars as S
from ..operators import graph as G
from ..operators import links as L
from ..runtime import Scratch, ordinals
from .base import F_SQL, files, read, sql

QUERIES: dict = {}
SQL: dict = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return add


_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"


def _norm(p: str) -> str:
    fold = "CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN CASE WHEN a = '' THEN '..' WHEN a = '..' OR ends_with(a, '/..') THEN a || '/..' WHEN contains(a, '/') THEN regexp_replace(a, '/[^/]*$', '') ELSE '' END WHEN a = '' THEN x ELSE a || '/' || x END"
    return f"coalesce(nullif(list_reduce(list_prepend('', string_split({p}, '/')), lambda a, x: {fold}), ''), '.')"


_VALUES = ", ".join(f"('{c}', {i})" for i, c in enumerate(["", *rules.CODE_EXTS, *["/index" + e for e in rules.CODE_EXTS]]))
_FSVALUES = ", ".join(f"('{c}', {i})" for i, c in enumerate(["", *rules.FS_EXTS, *["/index" + e for e in rules.FS_EXTS]]))
IMP = "imp AS (SELECT repo_id, id AS from_id, path, unnest(range(len(imports))) AS imp_ord, unnest(imports) AS i FROM f)"
TGT = f"tgt AS (SELECT *, i.source AS source, i.line_imported AS line, {_norm(_DIR + chr(32) + '|| ' + chr(39) + '/' + chr(39) + ' || i.source')} AS target FROM imp WHERE i.type = 'file')".replace(_DIR + " ||", f"({_DIR}) ||")
RES = f"res AS (SELECT t.repo_id, t.from_id, t.imp_ord, t.source, t.line, arg_min(g.id, c.rank) AS to_id FROM tgt t, (VALUES {_VALUES}) c(suffix, rank), f g WHERE g.repo_id = t.repo_id AND g.path = t.target || c.suffix GROUP BY ALL)"
DIR = "dir AS (SELECT repo_id, from_id, to_id, count(*) AS frequency, arg_min(line, imp_ord) AS line, min(imp_ord) AS first_ord, CAST(count(*) * 100 AS BIGINT) AS weight FROM res GROUP BY 1, 2, 3)"
CHAIN = (IMP, TGT, RES, DIR)
_BASEPKG = "CASE WHEN starts_with(source, '@') THEN CASE WHEN contains(source, '/') THEN array_to_string(string_split(source, '/')[1:2], '/') END ELSE string_split(source, '/')[1] END"
PKG = f"pkg AS (SELECT repo_id, from_id, imp_ord, source, line, coalesce(e.id, b.id) AS package_id FROM (SELECT *, i.source AS source, i.line_imported AS line, CASE WHEN starts_with(i.source, '@') THEN CASE WHEN contains(i.source, '/') THEN array_to_string(string_split(i.source, '/')[1:2], '/') END ELSE string_split(i.source, '/')[1] END AS base FROM imp WHERE i.type = 'package') t LEFT JOIN (SELECT name, max(id) AS id FROM packages GROUP BY 1) e ON e.name = t.source LEFT JOIN (SELECT name, max(id) AS id FROM packages GROUP BY 1) b ON b.name = t.base WHERE coalesce(e.id, b.id) IS NOT NULL)"
PLINK = "plink AS (SELECT from_id, package_id, frequency, CAST(sum(frequency) OVER (PARTITION BY package_id) * 80 AS BIGINT) AS weight FROM (SELECT from_id, package_id, count(*) AS frequency FROM pkg GROUP BY 1, 2))"


def _imports(spark, sf_dir):
    fs = files(spark, sf_dir, "repo_id", "path", "imports")
    return fs, L.imports_of(fs)


def _direct(spark, sf_dir):
    fs, imps = _imports(spark, sf_dir)
    return L.direct_links(L.resolve_files(imps, fs))


def _packages(spark, sf_dir):
    _, imps = _imports(spark, sf_dir)
    return L.resolve_packages(imps, read(spark, sf_dir, "packages"))


@query(sql(f"SELECT DISTINCT path, {_norm('path || ' + chr(39) + '/../x/./y' + chr(39))} AS normal FROM f WHERE path IS NOT NULL"))
def normalize_path(spark, sf_dir):
    return files(spark, sf_dir, "path").filter("path IS NOT NULL").select("path").distinct().select("path", S.normalize_path(F.concat("path", F.lit("/../x/./y"))).alias("normal"))


@query(sql("SELECT from_id, imp_ord, source, line, to_id FROM res", IMP, TGT, RES))
def resolve_imports(spark, sf_dir):
    fs, imps = _imports(spark, sf_dir)
    return L.resolve_files(imps, fs).select("from_id", F.col("imp_ord").cast("long"), "source", "line", "to_id")


_DIRS = "dirs AS (SELECT DISTINCT repo_id, array_to_string(string_split(path, '/')[1:d], '/') AS target FROM f, UNNEST(range(1, len(string_split(path, '/')))) u(d) WHERE path IS NOT NULL)"


@query(sql("SELECT from_id, imp_ord, to_id FROM res", IMP, TGT, _DIRS, RES.replace(_VALUES, _FSVALUES).replace("FROM tgt t", "FROM (SELECT * FROM tgt WHERE (starts_with(source, './') OR starts_with(source, '../')) AND NOT EXISTS (SELECT 1 FROM dirs WHERE dirs.repo_id = tgt.repo_id AND dirs.target = tgt.target)) t")))
def resolve_imports_fs(spark, sf_dir):
    """As a file system answers: a folder of the very name is found first and is no file."""
    fs, imps = _imports(spark, sf_dir)
    return L.resolve_files(imps.filter(F.col("source").rlike(r"^\.\.?/")), fs, rules.FS_EXTS, folders=True).select("from_id", F.col("imp_ord").cast("long"), "to_id")


@query(sql("SELECT from_id, imp_ord, source, package_id FROM pkg", IMP, PKG))
def resolve_packages(spark, sf_dir):
    return _packages(spark, sf_dir).select("from_id", F.col("imp_ord").cast("long"), "source", "package_id")


@query(sql("SELECT from_id, to_id, frequency, line, weight FROM dir", *CHAIN))
def direct_links(spark, sf_dir):
    return _direct(spark, sf_dir).select("from_id", "to_id", "frequency", "line", "weight")


@query(sql("SELECT * FROM plink", IMP, PKG, PLINK))
def package_links(spark, sf_dir):
    return L.package_links(_packages(spark, sf_dir))


@query(sql("SELECT p.id AS package_id, CAST(coalesce(n, 0) AS BIGINT) AS usage_count FROM packages p LEFT JOIN (SELECT package_id, count(*) AS n FROM pkg GROUP BY 1) u ON u.package_id = p.id", IMP, PKG))
def package_usage(spark, sf_dir):
    used = _packages(spark, sf_dir).groupBy("package_id").agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "packages").select(F.col("id").alias("package_id")).join(used, "package_id", "left").select("package_id", F.coalesce("n", F.lit(0)).alias("usage_count"))


IND = "ind AS (SELECT x.from_id, y.to_id, count(*) AS frequency, CAST(count(*) * 50 AS BIGINT) AS weight FROM dir x JOIN dir y ON x.to_id = y.from_id AND x.repo_id = y.repo_id WHERE x.from_id <> y.to_id AND NOT EXISTS (SELECT 1 FROM dir z WHERE z.from_id = x.from_id AND z.to_id = y.to_id) GROUP BY 1, 2)"


@query(sql("SELECT * FROM ind", *CHAIN, IND))
def indirect_links(spark, sf_dir):
    return L.indirect_links(_direct(spark, sf_dir).select("repo_id", "from_id", "to_id")).select("from_id", "to_id", "frequency", "weight")


ROUTE = f"""rt AS (SELECT p.id AS from_id, c.id AS to_id, CASE WHEN regexp_matches(p.path, '(^|/)(layout|template)\\.[a-z]+$') THEN 'layout' ELSE 'route' END AS type, CAST(1 AS BIGINT) AS frequency,
  CAST(CASE WHEN regexp_matches(p.path, '(^|/)(layout|template)\\.[a-z]+$') THEN 90 ELSE 60 END AS BIGINT) AS weight
FROM (SELECT *, {_DIR} AS parent FROM f WHERE regexp_matches(path, '^(src/)?(app|pages)/.*/')) c, (VALUES {', '.join(f"('{e}')" for e in rules.CODE_EXTS)}) e(ext), f p
WHERE p.repo_id = c.repo_id AND p.path = c.parent || e.ext AND p.id <> c.id AND NOT regexp_matches(c.parent, '^(src/)?(app|pages)$'))"""


@query(sql("SELECT from_id, to_id, type, frequency, weight FROM rt", ROUTE))
def route_links(spark, sf_dir):
    return L.route_links(files(spark, sf_dir, "repo_id", "path")).select("from_id", "to_id", "type", "frequency", "weight")


def _all(spark, sf_dir):
    direct = _direct(spark, sf_dir)
    ind = L.indirect_links(direct.select("repo_id", "from_id", "to_id"))
    rt = L.route_links(files(spark, sf_dir, "repo_id", "path"))
    cols = ["from_id", "to_id", "package_id", "type", "frequency", "weight"]
    none = F.lit(None).cast("string")
    a = direct.withColumn("type", F.lit("direct")).withColumn("package_id", none).select(*cols)
    b = rt.withColumn("package_id", none).select(*cols)
    c = ind.withColumn("type", F.lit("indirect")).withColumn("package_id", none).select(*cols)
    d = L.package_links(_packages(spark, sf_dir)).withColumn("type", F.lit("package")).withColumn("to_id", none).select(*cols)
    return a.unionByName(b).unionByName(c).unionByName(d)


ALL = "alln AS (SELECT from_id, to_id, NULL::VARCHAR AS package_id, 'direct' AS type, frequency, weight FROM dir UNION ALL SELECT from_id, to_id, NULL, type, frequency, weight FROM rt UNION ALL SELECT from_id, to_id, NULL, 'indirect', frequency, weight FROM ind UNION ALL SELECT from_id, NULL, package_id, 'package', frequency, weight FROM plink)"
EVERY = (*CHAIN, PKG, PLINK, IND, ROUTE, ALL)


@query(sql("SELECT * FROM alln", *EVERY))
def all_links(spark, sf_dir):
    return _all(spark, sf_dir)


_PHASE = "CASE type WHEN 'direct' THEN 1 WHEN 'package' THEN 1 WHEN 'route' THEN 2 WHEN 'layout' THEN 2 ELSE 3 END"


@query(sql(f"SELECT from_id, coalesce(to_id, package_id) AS target_id, type, printf('link_%04d', row_number() OVER (PARTITION BY from_id ORDER BY {_PHASE}, type, coalesce(to_id, package_id))) AS link_id FROM alln", *EVERY))
def link_ids(spark, sf_dir):
    """Ordinals per source file: one global counter would order all links in one task."""
    phase = F.when(F.col("type").isin("direct", "package"), 1).when(F.col("type").isin("route", "layout"), 2).otherwise(3)
    df = _all(spark, sf_dir).withColumn("target_id", F.coalesce("to_id", "package_id"))
    order = Window.partitionBy("from_id").orderBy(phase, "type", "target_id")
    return df.select("from_id", "target_id", "type", F.format_string("link_%04d", F.row_number().over(order)).alias("link_id"))


# The trade graph of nations: up to three strongest customers' nations for each supplier's nation.
TRADE = "trade AS (SELECT a, b, frequency FROM (SELECT s.s_nationkey AS a, c.c_nationkey AS b, count(*) AS frequency FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE s.s_nationkey <> c.c_nationkey GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY a ORDER BY frequency DESC, b) <= 3)"


def trade(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    # Order by customer first: both joins then carry two integers per order line.
    g = li.join(s, "l_suppkey").join(o.join(c, "o_custkey"), "l_orderkey").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("frequency"))
    top = Window.partitionBy("a").orderBy(F.desc("frequency"), "b")
    return g.withColumn("r", F.row_number().over(top)).filter("r <= 3").select("a", "b", "frequency")


_DEG = "deg AS (SELECT n_nationkey AS id, CAST(coalesce(i.n, 0) AS BIGINT) AS incoming, CAST(coalesce(o.n, 0) AS BIGINT) AS outgoing, CAST(coalesce(i.u, 0) AS BIGINT) AS usage FROM nation LEFT JOIN (SELECT b, count(*) n, sum(frequency) u FROM trade GROUP BY 1) i ON i.b = n_nationkey LEFT JOIN (SELECT a, count(*) n FROM trade GROUP BY 1) o ON o.a = n_nationkey)"


def _trade(spark, sf_dir):
    """The trade graph, written once for all that reads it."""
    return Scratch(spark, "trade").cut(trade(spark, sf_dir))[0]


def _degrees(spark, sf_dir):
    t = _trade(spark, sf_dir).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "frequency")
    return t, L.degrees(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), t)


@query(f"WITH {TRADE}, {_DEG} SELECT * FROM deg")
def degree_metrics(spark, sf_dir):
    return _degrees(spark, sf_dir)[1]


_BC = """walk(s, t, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT w.s, e.b, w.d + 1 FROM walk w JOIN trade e ON w.t = e.a WHERE w.d < 25),
dist AS (SELECT s, t, min(d) d FROM walk GROUP BY 1, 2),
pth(s, t, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT p.s, e.b, p.d + 1 FROM pth p JOIN trade e ON p.t = e.a JOIN dist x ON x.s = p.s AND x.t = e.b AND x.d = p.d + 1),
sg AS (SELECT s, t, d, count(*) sigma FROM pth GROUP BY 1, 2, 3),
bc AS (SELECT v.t AS id, sum(v.sigma * w.sigma * 1.0 / st.sigma) bc FROM sg v JOIN sg w ON w.s = v.t JOIN sg st ON st.s = v.s AND st.t = w.t AND st.d = v.d + w.d WHERE v.s <> v.t AND w.t <> v.t AND v.s <> w.t GROUP BY 1)"""


def _bc(spark, sf_dir, t):
    return G.betweenness(spark, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), t.select("a", "b"))


@query(f"WITH RECURSIVE {TRADE}, {_BC} SELECT n_nationkey AS id, floor(coalesce(bc, 0) * 10000 + 0.5) / 10000 AS betweenness FROM nation LEFT JOIN bc ON id = n_nationkey")
def betweenness(spark, sf_dir):
    return _bc(spark, sf_dir, trade(spark, sf_dir)).select("id", S.round_half_up(F.col("betweenness"), 4).alias("betweenness"))


def _raw(spark, sf_dir):
    t, d = _degrees(spark, sf_dir)
    raw = G.raw_importance(F.col("incoming"), F.col("outgoing"), F.col("usage"), F.col("betweenness"))
    return t, d.join(_bc(spark, sf_dir, t.toDF("a", "b", "frequency")), "id").select("id", raw.alias("raw"))


@query(f"WITH RECURSIVE {TRADE}, {_DEG}, {_BC} SELECT deg.id, floor((1.2 * incoming + 0.8 * outgoing + 0.5 * usage + 1.5 * coalesce(bc, 0)) * 10000 + 0.5) / 10000 AS raw FROM deg LEFT JOIN bc ON bc.id = deg.id")
def importance_raw(spark, sf_dir):
    return _raw(spark, sf_dir)[1].select("id", S.round_half_up(F.col("raw"), 4).alias("raw"))


_PROP = f"""WITH RECURSIVE {TRADE}, {_DEG}, {_BC},
n AS (SELECT deg.id, row_number() OVER (ORDER BY deg.id) AS ord, CAST(1.2 * incoming + 0.8 * outgoing + 0.5 * usage + 1.5 * coalesce(bc, 0) AS DOUBLE) AS raw, coalesce(tg, []) AS tg FROM deg LEFT JOIN bc ON bc.id = deg.id LEFT JOIN (SELECT a, list(b + 1 ORDER BY b) AS tg FROM trade GROUP BY 1) t ON t.a = deg.id),
st(step, sc) AS (SELECT 0, (SELECT list(raw ORDER BY ord) FROM n) UNION ALL
  SELECT step + 1, list_transform(range(1, len(sc) + 1), lambda i: CASE WHEN i = n.ord AND len(n.tg) > 0 THEN sc[i] + list_avg(list_transform(n.tg, lambda j: sc[j])) * 0.4 * pow(0.6, step // len(sc)) ELSE sc[i] END) FROM st JOIN n ON n.ord = (step % len(sc)) + 1 WHERE step < 3 * len(sc))
SELECT n.id, floor(sc[n.ord] / list_max(sc) * 10 * 10 + 0.5) / 10 AS score FROM n, st WHERE step = 3 * len(sc)"""


@query(_PROP)
def importance_score(spark, sf_dir):
    t, raw = _raw(spark, sf_dir)
    return G.importance(spark, raw.withColumn("ord", F.col("id")), t.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))).select("id", "score")


@query()
def importance_score_jacobi(spark, sf_dir):
    t, raw = _raw(spark, sf_dir)
    return G.importance(spark, raw.withColumn("ord", F.col("id")), t.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), simultaneous=True).select("id", "score")


# The same over the files' own links: direct and route links, each row an edge.
_FL = "fl AS (SELECT from_id AS a, to_id AS b, frequency FROM dir UNION ALL SELECT from_id, to_id, frequency FROM rt)"
_FDEG = "deg AS (SELECT id, repo_id, CAST(coalesce(i.n, 0) AS BIGINT) AS incoming, CAST(coalesce(o.n, 0) AS BIGINT) AS outgoing, CAST(coalesce(i.u, 0) AS BIGINT) AS usage FROM f LEFT JOIN (SELECT b, count(*) n, sum(frequency) u FROM fl GROUP BY 1) i ON i.b = id LEFT JOIN (SELECT a, count(*) n FROM fl GROUP BY 1) o ON o.a = id)"
_FBC = """fe AS (SELECT a, b, count(*) AS m FROM fl WHERE a <> b GROUP BY 1, 2),
walk(s, t, d) AS (SELECT DISTINCT a, a, 0 FROM fe UNION SELECT w.s, e.b, w.d + 1 FROM walk w JOIN fe e ON w.t = e.a WHERE w.d < 40),
dist AS (SELECT s, t, min(d) d FROM walk GROUP BY 1, 2),
sg(s, t, d, sigma) AS (SELECT DISTINCT a, a, 0, CAST(1 AS DOUBLE) FROM fe UNION ALL SELECT p.s, e.b, any_value(p.d) + 1, sum(p.sigma * e.m) FROM sg p JOIN fe e ON p.t = e.a JOIN dist x ON x.s = p.s AND x.t = e.b AND x.d = p.d + 1 GROUP BY p.s, e.b),
bc AS (SELECT v.t AS id, sum(v.sigma * w.sigma / st.sigma) bc FROM sg v JOIN sg w ON w.s = v.t JOIN sg st ON st.s = v.s AND st.t = w.t AND st.d = v.d + w.d WHERE v.s <> v.t AND w.t <> v.t AND v.s <> w.t GROUP BY 1)"""


def _file_links(spark, sf_dir):
    """(a, b, frequency), written once."""
    rt = L.route_links(files(spark, sf_dir, "repo_id", "path"))
    ends = lambda df: df.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "frequency")
    return Scratch(spark, "links").cut(ends(_direct(spark, sf_dir)).unionAll(ends(rt)))[0]


def _file_degrees(spark, sf_dir, fl):
    return L.degrees(files(spark, sf_dir).select("id"), fl.toDF("from_id", "to_id", "frequency"))


@query(sql("SELECT id, incoming, outgoing, usage FROM deg", *CHAIN, ROUTE, _FL, _FDEG))
def file_degrees(spark, sf_dir):
    return _file_degrees(spark, sf_dir, _file_links(spark, sf_dir))


@query(sql("SELECT f.id, floor(coalesce(bc, 0) * 10000 + 0.5) / 10000 AS betweenness FROM f LEFT JOIN bc ON bc.id = f.id", *CHAIN, ROUTE, _FL, _FBC).replace("WITH", "WITH RECURSIVE", 1))
def file_betweenness(spark, sf_dir):
    bc = G.betweenness(spark, files(spark, sf_dir).select("id"), _file_links(spark, sf_dir).select("a", "b"))
    return bc.select("id", S.round_half_up(F.col("betweenness"), 4).alias("betweenness"))


def file_ranks(spark, fs, fl, simultaneous=False):
    """(repo_id, id, raw, score) of files (repo_id, id) by their links (a, b, frequency); files in the order of their ids."""
    bc = G.betweenness(spark, fs.select("id"), fl.select("a", "b"))
    d = L.degrees(fs.select("id"), fl.toDF("from_id", "to_id", "frequency")).join(bc, "id")
    raw = G.raw_importance(F.col("incoming"), F.col("outgoing"), F.col("usage"), F.col("betweenness"))
    nodes = fs.select("repo_id", "id").join(d.select("id", raw.alias("raw")), "id").select("repo_id", F.col("id").alias("ord"), "id", "raw")
    return G.importance(spark, nodes, fl.select("a", "b"), simultaneous)


@query()
def file_importance(spark, sf_dir):
    """Importance of every file within its repository."""
    return file_ranks(spark, files(spark, sf_dir, "repo_id").select("repo_id", "id"), _file_links(spark, sf_dir)).select("id", S.round_half_up(F.col("raw"), 4).alias("raw"), "score")


_FD = "fd AS (SELECT from_id, to_id, 'direct' AS type, weight, line, first_ord FROM dir UNION ALL SELECT from_id, to_id, type, weight, NULL, NULL FROM rt)"
_SREACH = "sreach(s, t) AS (SELECT from_id, to_id FROM fd UNION SELECT r.s, d.to_id FROM sreach r JOIN fd d ON d.from_id = r.t)"
_SCC = f"{ROUTE}, {_FD}, {_SREACH}, scc AS (SELECT x.s AS id, least(x.s, min(x.t)) AS scc, count(*) + CASE WHEN bool_or(x.t = x.s) THEN 0 ELSE 1 END AS size FROM sreach x JOIN sreach y ON y.s = x.t AND y.t = x.s GROUP BY 1 HAVING count(*) FILTER (x.t <> x.s) > 0)"
_CYC = "cyc AS (SELECT id, scc FROM scc UNION SELECT from_id, from_id FROM fd WHERE from_id = to_id AND from_id NOT IN (SELECT id FROM scc))"


@query(
    sql(
        """SELECT f.repo_id, count(*) AS total_files, CAST(coalesce(sum(len(functions)), 0) AS BIGINT) AS total_functions, CAST(coalesce(any_value(e.n), 0) AS BIGINT) AS total_connections,
  CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS circular_count, CASE WHEN count(*) > 1 THEN floor(coalesce(any_value(e.d), 0) * 1.0::DOUBLE / (count(*) * (count(*) - 1)) * 10000 + 0.5) / 10000 ELSE 0 END AS network_density,
  floor(sum(CAST(coalesce(importance_score, 0) AS DECIMAL(18, 6)))::DOUBLE / count(*) * 100 + 0.5) / 100 AS average_importance, arg_min(f.id, (-coalesce(importance_score, 0), f.id)) AS most_important
FROM f LEFT JOIN (SELECT g.repo_id, count(*) AS n, count_if(alln.type <> 'indirect' AND to_id IS NOT NULL) AS d FROM alln JOIN f g ON g.id = from_id GROUP BY 1) e ON e.repo_id IS NOT DISTINCT FROM f.repo_id
LEFT JOIN (SELECT g.repo_id, count(DISTINCT scc) AS n FROM cyc JOIN f g ON g.id = cyc.id GROUP BY 1) c ON c.repo_id IS NOT DISTINCT FROM f.repo_id GROUP BY 1""",
        *EVERY,
        _SCC.replace(ROUTE + ", ", ""),
        _CYC,
    ).replace("WITH", "WITH RECURSIVE", 1)
)
def statistics(spark, sf_dir):
    """Counts, density of direct and route links, average importance and the most important file (of equals the first) of each repository; files without one form a group."""
    fs = files(spark, sf_dir, "repo_id", "functions", "importance_score")
    of = files(spark, sf_dir, "repo_id").select(F.col("id").alias("from_id"), "repo_id")
    inner = (F.col("type") != "indirect") & F.col("to_id").isNotNull()
    links = _all(spark, sf_dir).join(of, "from_id").groupBy(F.col("repo_id").alias("_l")).agg(F.count("*").alias("total_connections"), F.count_if(inner).alias("inner"))
    circular = _cyclic(spark, sf_dir)[1].join(of.withColumnRenamed("from_id", "id"), "id").groupBy(F.col("repo_id").alias("_c")).agg(F.countDistinct("scc").alias("circular_count"))
    score = F.coalesce("importance_score", F.lit(0.0))
    functions = F.greatest(F.coalesce(F.size("functions"), F.lit(0)), F.lit(0))
    g = fs.groupBy("repo_id").agg(F.count("*").alias("total_files"), F.sum(functions).alias("total_functions"), F.sum(score.cast("decimal(18,6)")).alias("points"), F.min_by("id", F.struct((-score).alias("s"), "id")).alias("most_important"))
    g = g.join(links, F.col("repo_id").eqNullSafe(F.col("_l")), "left").join(circular, F.col("repo_id").eqNullSafe(F.col("_c")), "left").fillna(0, ["total_connections", "inner", "circular_count"])
    pairs = F.col("total_files") * (F.col("total_files") - 1)
    density = F.when(F.col("total_files") > 1, S.round_half_up(F.col("inner").cast("double") / pairs, 4)).otherwise(0.0)
    average = S.round_half_up(F.col("points").cast("double") / F.col("total_files"), 2)
    return g.select("repo_id", "total_files", "total_functions", "total_connections", "circular_count", density.alias("network_density"), average.alias("average_importance"), "most_important")


_T = lambda c: f"lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13)))"
LK = f"lk AS (SELECT id, any_value(repo_id) AS repo_id, any_value({_T('from_file_id')}) AS a, any_value({_T('to_file_id')}) AS b, any_value(to_package_id) AS p, any_value(type) AS type, any_value(frequency) AS frequency, any_value(weight) AS weight FROM links GROUP BY id)"


def stored_links(spark, sf_dir):
    """The stored links, each id once, ends tidied. Repeated rows of a link are alike."""
    ends = lambda c: F.lower(F.btrim(c, F.lit(" \t\r\n")))
    df = read(spark, sf_dir, "links").select("id", "repo_id", ends(F.col("from_file_id")).alias("a"), ends(F.col("to_file_id")).alias("b"), F.col("to_package_id").alias("p"), "type", "frequency", "weight")
    return df.dropDuplicates(["id"])


@query(sql("SELECT id, a, b FROM lk WHERE a IN (SELECT id FROM f) AND b IN (SELECT id FROM f)", LK))
def drop_dangling_links(spark, sf_dir):
    ids = files(spark, sf_dir).select("id")
    lk = stored_links(spark, sf_dir).select("id", "a", "b")
    return lk.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("id", "a", "b")


@query(sql("SELECT id, weight FROM lk ORDER BY weight DESC, id LIMIT 100", LK))
def edge_topk(spark, sf_dir):
    return stored_links(spark, sf_dir).orderBy(F.desc_nulls_last("weight"), "id").limit(100).select("id", "weight")


@query(sql("SELECT DISTINCT x AS id FROM (SELECT a AS x, b AS y FROM lk UNION ALL SELECT b, a FROM lk) WHERE y = (SELECT min(a) FROM lk WHERE type = 'direct' AND b IS NOT NULL) AND x IS NOT NULL UNION SELECT min(a) FROM lk WHERE type = 'direct' AND b IS NOT NULL", LK))
def neighborhood(spark, sf_dir):
    lk = stored_links(spark, sf_dir)
    me = lk.filter("type = 'direct' AND b IS NOT NULL").agg(F.min("a").alias("y"))
    both = lk.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(lk.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = both.join(F.broadcast(me), "y").select(F.col("x").alias("id"))
    return near.unionAll(me.select("y")).filter("id IS NOT NULL").distinct()


def _weak(spark, sf_dir):
    d = _direct(spark, sf_dir)
    return d, G.weak_components(spark, files(spark, sf_dir).select("id"), d.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


_WCC = "u AS (SELECT from_id AS a, to_id AS b FROM dir UNION SELECT to_id, from_id FROM dir), reach(s, t) AS (SELECT id, id FROM f UNION SELECT r.s, u.b FROM reach r JOIN u ON u.a = r.t), comp AS (SELECT t AS id, min(s) AS component FROM reach GROUP BY 1)"


@query(sql("SELECT * FROM comp", *CHAIN, _WCC).replace("WITH", "WITH RECURSIVE", 1))
def weak_components(spark, sf_dir):
    return _weak(spark, sf_dir)[1]


@query(sql("SELECT CASE WHEN c.n > 1 OR s.a IS NOT NULL THEN 'network_main' ELSE 'network_isolated' END AS network, count(*) AS node_count, CAST(sum(CASE WHEN c.n > 1 OR s.a IS NOT NULL THEN coalesce(o.n, 0) ELSE 0 END) AS BIGINT) AS edge_count FROM comp JOIN (SELECT component, count(*) n FROM comp GROUP BY 1) c USING (component) LEFT JOIN (SELECT DISTINCT from_id AS a FROM dir WHERE from_id = to_id) s ON s.a = comp.id LEFT JOIN (SELECT from_id, count(*) n FROM dir GROUP BY 1) o ON o.from_id = comp.id GROUP BY 1", *CHAIN, _WCC).replace("WITH", "WITH RECURSIVE", 1))
def networks(spark, sf_dir):
    """All components of two or more files together, and the files without neighbours; a self-link is a neighbour."""
    d, comp = _weak(spark, sf_dir)
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    out = d.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out"), F.max(F.col("from_id") == F.col("to_id")).alias("selfish"))
    each = comp.join(sizes, "component").join(out, "id", "left")
    main = (F.col("n") > 1) | F.coalesce("selfish", F.lit(False))
    return each.groupBy(F.when(main, "network_main").otherwise("network_isolated").alias("network")).agg(F.count("*").alias("node_count"), F.sum(F.when(main, F.coalesce("out", F.lit(0))).otherwise(0)).alias("edge_count"))


_VN = """vl AS (SELECT from_id AS a, to_id AS b FROM dir UNION ALL SELECT from_id, to_id FROM rt UNION ALL SELECT from_id, package_id FROM plink),
vn AS (SELECT id, true AS is_file FROM f UNION ALL SELECT id, false FROM packages), vu AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM vl UNION ALL SELECT b, a FROM vl) WHERE a <> b),
vc(k, c) USING KEY (k) AS (SELECT id, id FROM vn UNION SELECT vu.b, min(x.c) FROM vc x JOIN vu ON vu.a = x.k JOIN recurring.vc y ON y.k = vu.b WHERE x.c < y.c GROUP BY vu.b)"""


@query(sql("SELECT network, CASE WHEN network = 1 THEN 'Main network (' ELSE 'Network ' || network || ' (' END || n_files || ' files)' AS label, n_files, n_packages, n_links FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, c) AS network, count_if(is_file) AS n_files, count_if(NOT is_file) AS n_packages, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links FROM vc JOIN vn ON vn.id = vc.k LEFT JOIN (SELECT c.c AS lc, count(*) AS n FROM vl JOIN vc c ON c.k = vl.a GROUP BY 1) l ON l.lc = vc.c GROUP BY c)", *CHAIN, PKG, PLINK, ROUTE, _VN).replace("WITH", "WITH RECURSIVE", 1))
def viz_networks(spark, sf_dir):
    """Components of files and packages, the largest first, then by their first node."""
    ends = lambda df, b: df.select(F.col("from_id").alias("a"), F.col(b).alias("b"))
    rt = L.route_links(files(spark, sf_dir, "repo_id", "path"))
    links, _ = Scratch(spark, "viewer").cut(ends(_direct(spark, sf_dir), "to_id").unionAll(ends(rt, "to_id")).unionAll(ends(L.package_links(_packages(spark, sf_dir)), "package_id")))
    nodes = files(spark, sf_dir).select("id", F.lit(True).alias("is_file")).unionAll(read(spark, sf_dir, "packages").select("id", F.lit(False)))
    comp = G.weak_components(spark, nodes.select("id"), links)
    n_links = links.join(comp.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.count("*").alias("n_links"))
    sizes = comp.join(nodes, "id").groupBy("component").agg(F.count("*").alias("n"), F.count_if("is_file").alias("n_files"), F.count_if(~F.col("is_file")).alias("n_packages")).join(n_links, "component", "left")
    rows = ordinals(spark, sizes.select(F.lit("all").alias("of"), (-F.col("n")).alias("less"), "*"), "of", "less", "component")
    label = F.concat(F.when(F.col("ordinal") == 1, "Main network (").otherwise(F.concat(F.lit("Network "), F.col("ordinal").cast("string"), F.lit(" ("))), F.col("n_files").cast("string"), F.lit(" files)"))
    return rows.select(F.col("ordinal").alias("network"), label.alias("label"), "n_files", "n_packages", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query(sql("SELECT id AS node_id, 'file' AS kind, name, path, type, coalesce(importance_score, 0) AS importance_score, coalesce(description, '') AS description FROM f UNION ALL SELECT id, 'package', name, NULL, type, 0, coalesce(type, 'dependency') || ' package' || CASE WHEN coalesce(version, '') <> '' THEN ' v' || version ELSE '' END FROM packages"))
def viz_nodes(spark, sf_dir):
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    a = files(spark, sf_dir, "name", "path", "type", "importance_score", "description").select(F.col("id").alias("node_id"), F.lit("file").alias("kind"), "name", "path", "type", F.coalesce("importance_score", zero).alias("importance_score"), F.coalesce("description", F.lit("")).alias("description"))
    about = F.concat(F.coalesce("type", F.lit("dependency")), F.lit(" package"), F.when(F.coalesce("version", F.lit("")) != "", F.concat(F.lit(" v"), "version")).otherwise(""))
    return a.unionAll(read(spark, sf_dir, "packages").select("id", F.lit("package"), "name", none, "type", zero, about))


_FD = "fd AS (SELECT from_id, to_id, 'direct' AS type, weight, line, first_ord FROM dir UNION ALL SELECT from_id, to_id, type, weight, NULL, NULL FROM rt)"
_SREACH = "sreach(s, t) AS (SELECT from_id, to_id FROM fd UNION SELECT r.s, d.to_id FROM sreach r JOIN fd d ON d.from_id = r.t)"
_SCC = f"{ROUTE}, {_FD}, {_SREACH}, scc AS (SELECT x.s AS id, least(x.s, min(x.t)) AS scc, count(*) + CASE WHEN bool_or(x.t = x.s) THEN 0 ELSE 1 END AS size FROM sreach x JOIN sreach y ON y.s = x.t AND y.t = x.s GROUP BY 1 HAVING count(*) FILTER (x.t <> x.s) > 0)"
_CYC = "cyc AS (SELECT id, scc FROM scc UNION SELECT from_id, from_id FROM fd WHERE from_id = to_id AND from_id NOT IN (SELECT id FROM scc))"


@query(
    sql(
        """SELECT f.repo_id, count(*) AS total_files, CAST(coalesce(sum(len(functions)), 0) AS BIGINT) AS total_functions, CAST(coalesce(any_value(e.n), 0) AS BIGINT) AS total_connections,
  CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS circular_count, CASE WHEN count(*) > 1 THEN floor(coalesce(any_value(e.d), 0) * 1.0::DOUBLE / (count(*) * (count(*) - 1)) * 10000 + 0.5) / 10000 ELSE 0 END AS network_density,
  floor(sum(CAST(coalesce(importance_score, 0) AS DECIMAL(18, 6)))::DOUBLE / count(*) * 100 + 0.5) / 100 AS average_importance, arg_min(f.id, (-coalesce(importance_score, 0), f.id)) AS most_important
FROM f LEFT JOIN (SELECT g.repo_id, count(*) AS n, count_if(alln.type <> 'indirect' AND to_id IS NOT NULL) AS d FROM alln JOIN f g ON g.id = from_id GROUP BY 1) e ON e.repo_id IS NOT DISTINCT FROM f.repo_id
LEFT JOIN (SELECT g.repo_id, count(DISTINCT scc) AS n FROM cyc JOIN f g ON g.id = cyc.id GROUP BY 1) c ON c.repo_id IS NOT DISTINCT FROM f.repo_id GROUP BY 1""",
        *EVERY,
        _SCC.replace(ROUTE + ", ", ""),
        _CYC,
    ).replace("WITH", "WITH RECURSIVE", 1)
)
def statistics(spark, sf_dir):
    """Counts, density of direct and route links, average importance and the most important file (of equals the first) of each repository; files without one form a group."""
    fs = files(spark, sf_dir, "repo_id", "functions", "importance_score")
    of = files(spark, sf_dir, "repo_id").select(F.col("id").alias("from_id"), "repo_id")
    inner = (F.col("type") != "indirect") & F.col("to_id").isNotNull()
    links = _all(spark, sf_dir).join(of, "from_id").groupBy(F.col("repo_id").alias("_l")).agg(F.count("*").alias("total_connections"), F.count_if(inner).alias("inner"))
    circular = _cyclic(spark, sf_dir)[1].join(of.withColumnRenamed("from_id", "id"), "id").groupBy(F.col("repo_id").alias("_c")).agg(F.countDistinct("scc").alias("circular_count"))
    score = F.coalesce("importance_score", F.lit(0.0))
    functions = F.greatest(F.coalesce(F.size("functions"), F.lit(0)), F.lit(0))
    g = fs.groupBy("repo_id").agg(F.count("*").alias("total_files"), F.sum(functions).alias("total_functions"), F.sum(score.cast("decimal(18,6)")).alias("points"), F.min_by("id", F.struct((-score).alias("s"), "id")).alias("most_important"))
    g = g.join(links, F.col("repo_id").eqNullSafe(F.col("_l")), "left").join(circular, F.col("repo_id").eqNullSafe(F.col("_c")), "left").fillna(0, ["total_connections", "inner", "circular_count"])
    pairs = F.col("total_files") * (F.col("total_files") - 1)
    density = F.when(F.col("total_files") > 1, S.round_half_up(F.col("inner").cast("double") / pairs, 4)).otherwise(0.0)
    average = S.round_half_up(F.col("points").cast("double") / F.col("total_files"), 2)
    return g.select("repo_id", "total_files", "total_functions", "total_connections", "circular_count", density.alias("network_density"), average.alias("average_importance"), "most_important")


_T = lambda c: f"lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13)))"
LK = f"lk AS (SELECT id, any_value(repo_id) AS repo_id, any_value({_T('from_file_id')}) AS a, any_value({_T('to_file_id')}) AS b, any_value(to_package_id) AS p, any_value(type) AS type, any_value(frequency) AS frequency, any_value(weight) AS weight FROM links GROUP BY id)"


def stored_links(spark, sf_dir):
    """The stored links, each id once, ends tidied. Repeated rows of a link are alike."""
    ends = lambda c: F.lower(F.btrim(c, F.lit(" \t\r\n")))
    df = read(spark, sf_dir, "links").select("id", "repo_id", ends(F.col("from_file_id")).alias("a"), ends(F.col("to_file_id")).alias("b"), F.col("to_package_id").alias("p"), "type", "frequency", "weight")
    return df.dropDuplicates(["id"])


@query(sql("SELECT id, a, b FROM lk WHERE a IN (SELECT id FROM f) AND b IN (SELECT id FROM f)", LK))
def drop_dangling_links(spark, sf_dir):
    ids = files(spark, sf_dir).select("id")
    lk = stored_links(spark, sf_dir).select("id", "a", "b")
    return lk.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("id", "a", "b")


@query(sql("SELECT id, weight FROM lk ORDER BY weight DESC, id LIMIT 100", LK))
def edge_topk(spark, sf_dir):
    return stored_links(spark, sf_dir).orderBy(F.desc_nulls_last("weight"), "id").limit(100).select("id", "weight")


@query(sql("SELECT DISTINCT x AS id FROM (SELECT a AS x, b AS y FROM lk UNION ALL SELECT b, a FROM lk) WHERE y = (SELECT min(a) FROM lk WHERE type = 'direct' AND b IS NOT NULL) AND x IS NOT NULL UNION SELECT min(a) FROM lk WHERE type = 'direct' AND b IS NOT NULL", LK))
def neighborhood(spark, sf_dir):
    lk = stored_links(spark, sf_dir)
    me = lk.filter("type = 'direct' AND b IS NOT NULL").agg(F.min("a").alias("y"))
    both = lk.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(lk.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = both.join(F.broadcast(me), "y").select(F.col("x").alias("id"))
    return near.unionAll(me.select("y")).filter("id IS NOT NULL").distinct()


def _weak(spark, sf_dir):
    d = _direct(spark, sf_dir)
    return d, G.weak_components(spark, files(spark, sf_dir).select("id"), d.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


_WCC = "u AS (SELECT from_id AS a, to_id AS b FROM dir UNION SELECT to_id, from_id FROM dir), reach(s, t) AS (SELECT id, id FROM f UNION SELECT r.s, u.b FROM reach r JOIN u ON u.a = r.t), comp AS (SELECT t AS id, min(s) AS component FROM reach GROUP BY 1)"


@query(sql("SELECT * FROM comp", *CHAIN, _WCC).replace("WITH", "WITH RECURSIVE", 1))
def weak_components(spark, sf_dir):
    return _weak(spark, sf_dir)[1]


@query(sql("SELECT CASE WHEN c.n > 1 OR s.a IS NOT NULL THEN 'network_main' ELSE 'network_isolated' END AS network, count(*) AS node_count, CAST(sum(CASE WHEN c.n > 1 OR s.a IS NOT NULL THEN coalesce(o.n, 0) ELSE 0 END) AS BIGINT) AS edge_count FROM comp JOIN (SELECT component, count(*) n FROM comp GROUP BY 1) c USING (component) LEFT JOIN (SELECT DISTINCT from_id AS a FROM dir WHERE from_id = to_id) s ON s.a = comp.id LEFT JOIN (SELECT from_id, count(*) n FROM dir GROUP BY 1) o ON o.from_id = comp.id GROUP BY 1", *CHAIN, _WCC).replace("WITH", "WITH RECURSIVE", 1))
def networks(spark, sf_dir):
    """All components of two or more files together, and the files without neighbours; a self-link is a neighbour."""
    d, comp = _weak(spark, sf_dir)
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    out = d.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out"), F.max(F.col("from_id") == F.col("to_id")).alias("selfish"))
    each = comp.join(sizes, "component").join(out, "id", "left")
    main = (F.col("n") > 1) | F.coalesce("selfish", F.lit(False))
    return each.groupBy(F.when(main, "network_main").otherwise("network_isolated").alias("network")).agg(F.count("*").alias("node_count"), F.sum(F.when(main, F.coalesce("out", F.lit(0))).otherwise(0)).alias("edge_count"))


@query(sql("SELECT component, count(*) AS n_files, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS n_links FROM comp LEFT JOIN (SELECT from_id, count(*) n FROM dir GROUP BY 1) o ON o.from_id = comp.id GROUP BY 1 HAVING count(*) > 1", *CHAIN, _WCC).replace("WITH", "WITH RECURSIVE", 1))
def viz_networks(spark, sf_dir):
    d, comp = _weak(spark, sf_dir)
    out = d.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out"))
    return comp.join(out, "id", "left").groupBy("component").agg(F.count("*").alias("n_files"), F.sum(F.coalesce("out", F.lit(0))).alias("n_links")).filter("n_files > 1")


def _file_graph(spark, sf_dir):
    """Direct and route links as rows of one table, written once."""
    cols = ["from_id", "to_id", "type", "weight", "line", "first_ord"]
    d = _direct(spark, sf_dir).withColumn("type", F.lit("direct")).select(*cols)
    rt = L.route_links(files(spark, sf_dir, "repo_id", "path")).withColumns({"line": F.lit(None).cast("int"), "first_ord": F.lit(None).cast("long")}).select(*cols)
    return Scratch(spark, "links").cut(d.unionAll(rt))[0]


def _strong(spark, sf_dir):
    d = _file_graph(spark, sf_dir)
    return d, G.strong_components(spark, d.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@query(sql("SELECT id, scc, CAST(size AS BIGINT) AS size FROM scc", *CHAIN, _SCC).replace("WITH", "WITH RECURSIVE", 1))
def scc(spark, sf_dir):
    return _strong(spark, sf_dir)[1]


def _cyclic(spark, sf_dir):
    d, s = _strong(spark, sf_dir)
    own = d.filter("from_id = to_id").select(F.col("from_id").alias("id")).distinct().join(s, "id", "left_anti")
    return d, s.select("id", "scc").unionAll(own.select("id", F.col("id").alias("scc")))


@query(sql("SELECT scc AS cycle, count(*) AS size, 'high' AS risk_level FROM cyc GROUP BY 1", *CHAIN, _SCC, _CYC).replace("WITH", "WITH RECURSIVE", 1))
def cycles(spark, sf_dir):
    return _cyclic(spark, sf_dir)[1].groupBy(F.col("scc").alias("cycle")).agg(F.count("*").alias("size"), F.lit("high").alias("risk_level"))


@query(sql("SELECT from_id, to_id, CASE WHEN x.scc = y.scc THEN 'circular' ELSE type END AS type, CASE WHEN x.scc = y.scc THEN CAST(200 AS BIGINT) ELSE weight END AS weight FROM fd LEFT JOIN cyc x ON x.id = from_id LEFT JOIN cyc y ON y.id = to_id", *CHAIN, _SCC, _CYC).replace("WITH", "WITH RECURSIVE", 1))
def circular_links(spark, sf_dir):
    d, c = _cyclic(spark, sf_dir)
    both = d.join(c.select(F.col("id").alias("from_id"), F.col("scc").alias("x")), "from_id", "left").join(c.select(F.col("id").alias("to_id"), F.col("scc").alias("y")), "to_id", "left")
    inside = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    return both.select("from_id", "to_id", F.when(inside, "circular").otherwise(F.col("type")).alias("type"), F.when(inside, F.lit(200).cast("long")).otherwise(F.col("weight")).alias("weight"))


@query(sql("SELECT x.scc AS cycle, from_id AS file_id, arg_min(line, coalesce(first_ord, 1000000)) AS line FROM fd JOIN cyc x ON x.id = from_id JOIN cyc y ON y.id = to_id AND y.scc = x.scc GROUP BY 1, 2", *CHAIN, _SCC, _CYC).replace("WITH", "WITH RECURSIVE", 1))
def cycle_files_involved(spark, sf_dir):
    d, c = _cyclic(spark, sf_dir)
    x, y = c.select(F.col("id").alias("from_id"), "scc"), c.select(F.col("id").alias("to_id"), "scc")
    return d.join(x, "from_id").join(y, ["to_id", "scc"]).groupBy(F.col("scc").alias("cycle"), F.col("from_id").alias("file_id")).agg(F.min("line").alias("line"))


_TOPO = "treach(s, t) AS (SELECT from_id, to_id FROM dir UNION SELECT r.s, d.to_id FROM treach r JOIN dir d ON d.from_id = r.t), bad AS (SELECT DISTINCT r.s AS id FROM treach r JOIN treach c ON c.s = r.t AND c.t = r.t), lv(id, l) AS (SELECT id, 0 FROM f WHERE id NOT IN (SELECT id FROM bad) UNION SELECT d.from_id, lv.l + 1 FROM lv JOIN dir d ON d.to_id = lv.id WHERE d.from_id NOT IN (SELECT id FROM bad))"


@query(sql("SELECT f.id, max(lv.l) AS level FROM f LEFT JOIN lv ON lv.id = f.id GROUP BY 1", *CHAIN, _TOPO).replace("WITH", "WITH RECURSIVE", 1))
def topo_level(spark, sf_dir):
    """Levels of the files that are on or above no cycle; null for the others."""
    d = _direct(spark, sf_dir)
    return G.topo_levels(spark, files(spark, sf_dir).select("id"), d.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@query(sql("SELECT id AS file_id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN cyclic THEN 0 ELSE l END, id) AS position FROM (SELECT id, repo_id, l, bool_or(l IS NULL) OVER (PARTITION BY repo_id) AS cyclic FROM (SELECT f.id, any_value(f.repo_id) AS repo_id, max(lv.l) AS l FROM f LEFT JOIN lv ON lv.id = f.id GROUP BY 1))", *CHAIN, _TOPO).replace("WITH", "WITH RECURSIVE", 1))
def topo_order(spark, sf_dir):
    """Files of each repository behind those they need; in the order of their ids in a repository that has a cycle."""
    level, _ = Scratch(spark, "order").cut(topo_level(spark, sf_dir).join(files(spark, sf_dir, "repo_id").select("id", "repo_id"), "id"))
    cyclic = level.groupBy(F.col("repo_id").alias("_r")).agg(F.max(F.col("level").isNull()).alias("cyclic"))
    keyed = level.join(cyclic, F.col("repo_id").eqNullSafe(F.col("_r"))).select("id", "repo_id", F.when(F.col("cyclic"), 0).otherwise(F.col("level")).alias("level"))
    return ordinals(spark, keyed, "repo_id", "level", "id").select(F.col("id").alias("file_id"), "repo_id", F.col("ordinal").alias("position"))


_NOEXT = "regexp_replace({}, '\\.\\w+$', '')"
_LIT = f"lit AS (SELECT DISTINCT i.from_id, g.id AS to_id FROM imp i JOIN f g ON g.repo_id = i.repo_id AND {_NOEXT.format('g.path')} = {_NOEXT.format('i.i.source')} WHERE g.id <> i.from_id)"


def _literal(spark, sf_dir):
    fs, imps = _imports(spark, sf_dir)
    bare = lambda c: F.regexp_replace(c, r"\.\w+$", "")
    asked = imps.select("repo_id", "from_id", bare(F.col("source")).alias("k"))
    return asked.join(fs.select("repo_id", F.col("id").alias("to_id"), bare(F.col("path")).alias("k")), ["repo_id", "k"]).filter("from_id <> to_id").select("from_id", "to_id").distinct()


@query(sql("SELECT from_id, to_id FROM lit", IMP, _LIT))
def transitive_imports_literal(spark, sf_dir):
    """Raw import text against stored paths: relative imports match next to nothing, which is the behaviour to keep."""
    return _literal(spark, sf_dir)


@query(sql("SELECT to_id AS file_id, from_id AS imported_by FROM lit", IMP, _LIT))
def transitive_imported_by_literal(spark, sf_dir):
    return _literal(spark, sf_dir).select(F.col("to_id").alias("file_id"), F.col("from_id").alias("imported_by"))


@query(sql("SELECT DISTINCT s AS from_id, t AS to_id FROM (SELECT x.from_id AS s, y.to_id AS t FROM dir x JOIN dir y ON y.from_id = x.to_id UNION SELECT x.from_id, z.to_id FROM dir x JOIN dir y ON y.from_id = x.to_id JOIN dir z ON z.from_id = y.to_id) q WHERE s <> t AND NOT EXISTS (SELECT 1 FROM dir WHERE from_id = q.s AND to_id = q.t)", *CHAIN))
def transitive_imports_resolved(spark, sf_dir):
    """Files reached in two or three steps that aren't imported directly."""
    e = _direct(spark, sf_dir).select("from_id", "to_id").distinct()
    step = lambda d: d.withColumnRenamed("to_id", "mid").join(e.withColumnRenamed("from_id", "mid"), "mid").select("from_id", "to_id").distinct()
    two = step(e)
    return two.unionAll(step(two)).distinct().filter("from_id <> to_id").join(e, ["from_id", "to_id"], "left_anti")


_ONE = "(SELECT arg_max(from_id, (n, from_id)) FROM (SELECT from_id, count(*) n FROM dir GROUP BY 1))"


def _busiest(d):
    return d.groupBy("from_id").agg(F.count("*").alias("n")).agg(F.max_by("from_id", F.struct("n", "from_id")).alias("from_id"))


@query(sql(f"SELECT 'imports' AS side, to_id AS file_id FROM dir WHERE from_id = {_ONE} UNION ALL SELECT 'imported_by', from_id FROM dir WHERE to_id = {_ONE}", *CHAIN))
def get_dependencies(spark, sf_dir):
    d = _direct(spark, sf_dir)
    me = _busiest(d)
    a = d.join(F.broadcast(me), "from_id").select(F.lit("imports").alias("side"), F.col("to_id").alias("file_id"))
    return a.unionAll(d.join(F.broadcast(me.select(F.col("from_id").alias("to_id"))), "to_id").select(F.lit("imported_by"), "from_id"))


@query(sql(f"SELECT 'in' AS side, g.id, g.path, frequency, weight FROM dir JOIN f g ON g.id = from_id WHERE to_id = {_ONE} UNION ALL SELECT 'out', g.id, g.path, frequency, weight FROM dir JOIN f g ON g.id = to_id WHERE from_id = {_ONE} UNION ALL SELECT 'package', p.id, p.name, frequency, weight FROM plink JOIN packages p ON p.id = package_id WHERE from_id = {_ONE}", *CHAIN, PKG, PLINK))
def node_detail_file(spark, sf_dir):
    d, fs = _direct(spark, sf_dir), files(spark, sf_dir, "path")
    me = F.broadcast(_busiest(d).select(F.col("from_id").alias("me")))
    row = lambda df, side, name: df.select(F.lit(side).alias("side"), "id", F.col(name).alias("path"), "frequency", "weight")
    a = d.join(me, d["to_id"] == F.col("me")).withColumnRenamed("from_id", "id").join(fs, "id")
    b = d.join(me, d["from_id"] == F.col("me")).withColumnRenamed("to_id", "id").join(fs, "id")
    p = L.package_links(_packages(spark, sf_dir))
    c = p.join(me, p["from_id"] == F.col("me")).withColumnRenamed("package_id", "id").join(read(spark, sf_dir, "packages").select("id", "name"), "id")
    return row(a, "in", "path").unionAll(row(b, "out", "path")).unionAll(row(c, "package", "name"))


@query(sql("SELECT p.id AS package_id, g.id AS file_id, g.path, frequency FROM plink JOIN packages p ON p.id = package_id JOIN f g ON g.id = from_id", IMP, PKG, PLINK))
def node_detail_package(spark, sf_dir):
    p = L.package_links(_packages(spark, sf_dir))
    return p.join(files(spark, sf_dir, "path").withColumnRenamed("id", "from_id"), "from_id").select("package_id", F.col("from_id").alias("file_id"), "path", "frequency")


@query(sql("SELECT DISTINCT u.x.id AS symbol_id, u.x.name AS name, u.x.type AS kind, f.id AS file_id, f.path FROM f, UNNEST(f.functions) u(x)"))
def node_detail_function(spark, sf_dir):
    return files(spark, sf_dir, "path", "functions").select(F.col("id").alias("file_id"), "path", F.explode("functions").alias("x")).select(F.col("x.id").alias("symbol_id"), F.col("x.name").alias("name"), F.col("x.type").alias("kind"), "file_id", "path").distinct()


_VIZ = "viz AS (SELECT id, a AS source, coalesce(b, p) AS target, type, coalesce(weight, 1) AS weight, coalesce(frequency, 1) AS frequency FROM lk WHERE type <> 'indirect' AND a IS NOT NULL AND coalesce(b, p) IS NOT NULL)"


def _viz(spark, sf_dir):
    return stored_links(spark, sf_dir).filter("type <> 'indirect' AND a IS NOT NULL AND coalesce(b, p) IS NOT NULL").select("id", F.col("a").alias("source"), F.coalesce("b", "p").alias("target"), "type", F.coalesce("weight", F.lit(1)).alias("weight"), F.coalesce("frequency", F.lit(1)).alias("frequency"))


@query(sql("SELECT * FROM viz", LK, _VIZ))
def viz_graph(spark, sf_dir):
    return _viz(spark, sf_dir)


@query(sql("SELECT * FROM viz WHERE source IN (SELECT id FROM f WHERE type = 'code') AND target IN (SELECT id FROM f WHERE type = 'code')", LK, _VIZ))
def viz_filter_main(spark, sf_dir):
    ids = files(spark, sf_dir, "type").filter("type = 'code'").select("id")
    return _viz(spark, sf_dir).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "source", "target", "type", "weight", "frequency")


_NET = "net AS (SELECT DISTINCT lower(trim(u.m)) AS id FROM networks, UNNEST(files) u(m) WHERE networks.id = (SELECT min(id) FROM networks WHERE type = 'active'))"


@query(sql("SELECT * FROM viz WHERE source IN (SELECT id FROM net) AND target IN (SELECT id FROM net)", LK, _VIZ, _NET))
def viz_filter_network(spark, sf_dir):
    nets = read(spark, sf_dir, "networks")
    first = nets.filter("type = 'active'").agg(F.min("id").alias("id"))
    ids = nets.join(F.broadcast(first), "id").select(F.explode("files").alias("m")).select(F.lower(F.trim("m")).alias("id")).distinct()
    return _viz(spark, sf_dir).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "source", "target", "type", "weight", "frequency")


QUERY_TEXT, QUERY_TOKENS = "cart grid", ["cart", "grid"]


def _score_sql(q: str, tokens: list[str], name: str, second: str, desc: str, whole, each) -> str:
    n, s, d = (f"lower(coalesce({c}, ''))" for c in (name, second, desc))
    parts = [f"CASE WHEN {n} = '{q}' THEN {whole[0]} ELSE 0 END", f"CASE WHEN {s} = '{q}' THEN {whole[1]} ELSE 0 END", f"CASE WHEN contains({n}, '{q}') THEN {whole[2]} ELSE 0 END", f"CASE WHEN contains({s}, '{q}') THEN {whole[3]} ELSE 0 END", f"CASE WHEN contains({d}, '{q}') THEN {whole[4]} ELSE 0 END"]
    for t in tokens:
        parts += [f"CASE WHEN contains({n}, '{t}') THEN {each[0]} ELSE 0 END", f"CASE WHEN contains({s}, '{t}') THEN {each[1]} ELSE 0 END", f"((length({d}) - length(replace({d}, '{t}', ''))) // {len(t)}) * {each[2]}"]
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


_FILE = ((1000, 800, 400, 200, 80, 60), (60, 25, 10))
_SYM = ((900, 0, 350, 150, 70), (50, 15, 8))
_PK = ((700, 0, 250, 0, 0), (40, 0, 0))
_SF = f"sf AS (SELECT id AS node_id, 'file' AS kind, {_score_sql(QUERY_TEXT, QUERY_TOKENS, 'name', 'path', 'description', *_FILE)} + coalesce(importance_score, 0) AS score FROM f)"
_SS = f"ss AS (SELECT DISTINCT u.x.id AS node_id, 'function' AS kind, {_score_sql(QUERY_TEXT, QUERY_TOKENS, 'u.x.name', 'u.x.signature', 'u.x.description', *_SYM)} + coalesce(importance_score, 0) * 0.5 AS score FROM f, UNNEST(functions) u(x))"
_SP = f"sp AS (SELECT id AS node_id, 'package' AS kind, {_score_sql(QUERY_TEXT, QUERY_TOKENS, 'name', 'name', 'NULL', (700, 0, 250, 0, 0), (40, 0, 0))} AS score FROM packages)"


def _score_files(spark, sf_dir):
    fs = files(spark, sf_dir, "name", "path", "description", "importance_score")
    s = S.search_score(QUERY_TEXT, QUERY_TOKENS, F.col("name"), F.col("path"), F.col("description"), *_FILE) + F.coalesce("importance_score", F.lit(0.0))
    return fs.select(F.col("id").alias("node_id"), F.lit("file").alias("kind"), s.alias("score"))


def _score_symbols(spark, sf_dir):
    x = files(spark, sf_dir, "functions", "importance_score").select("importance_score", F.explode("functions").alias("x"))
    s = S.search_score(QUERY_TEXT, QUERY_TOKENS, F.col("x.name"), F.col("x.signature"), F.col("x.description"), *_SYM) + F.coalesce("importance_score", F.lit(0.0)) * 0.5
    return x.select(F.col("x.id").alias("node_id"), F.lit("function").alias("kind"), s.alias("score")).distinct()


def _score_packages(spark, sf_dir):
    s = S.search_score(QUERY_TEXT, QUERY_TOKENS, F.col("name"), F.col("name"), F.lit(None).cast("string"), *_PK)
    return read(spark, sf_dir, "packages").select(F.col("id").alias("node_id"), F.lit("package").alias("kind"), s.alias("score"))


@query(sql("SELECT node_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM sf WHERE score > 0", _SF))
def search_score_files(spark, sf_dir):
    return _score_files(spark, sf_dir).filter("score > 0").select("node_id", S.round_half_up(F.col("score"), 6).alias("score"))


@query(sql("SELECT node_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM ss WHERE score > 0", _SS))
def search_score_symbols(spark, sf_dir):
    return _score_symbols(spark, sf_dir).filter("score > 0").select("node_id", S.round_half_up(F.col("score"), 6).alias("score"))


@query(sql("SELECT node_id, score FROM sp WHERE score > 0", _SP).replace(F_SQL + ", ", ""))
def search_score_packages(spark, sf_dir):
    return _score_packages(spark, sf_dir).filter("score > 0").select("node_id", "score")


@query(sql("SELECT kind, node_id, floor(score * 1000000 + 0.5) / 1000000 AS score FROM (SELECT * FROM sf UNION ALL SELECT * FROM ss UNION ALL SELECT * FROM sp) WHERE score > 0 ORDER BY score DESC, kind, node_id LIMIT 10", _SF, _SS, _SP))
def search_topk(spark, sf_dir):
    """The best ten of files, symbols and packages; ties by kind and id."""
    hits = _score_files(spark, sf_dir).unionByName(_score_symbols(spark, sf_dir)).unionByName(_score_packages(spark, sf_dir)).filter("score > 0")
    return hits.orderBy(F.desc("score"), "kind", "node_id").limit(10).select("kind", "node_id", S.round_half_up(F.col("score"), 6).alias("score"))
