"""Queries of the description stage and of extraction: cache, prompts, responses, chunks, statements, viewer attributes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalars as S
from ..operators import links as L
from ..operators import statements
from ..operators.compaction import body_records
from ..operators.describe import file_description
from .base import files, latest, ranked, read, sql, versions
from .file_queries import _KEPT as KEPT
from .graph_queries import IMP, RES, TGT

QUERIES: dict = {}
SQL: dict = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return add


# The description cache: the complete records of the map store with a description, by repository, path and hash.
CACHE = """cb AS (SELECT store_path, body AS x FROM record_files WHERE json_valid(body) UNION ALL SELECT store_path, unnest(string_split(body, chr(10))) FROM record_files WHERE body IS NOT NULL AND NOT json_valid(body)),
ce AS (SELECT store_path, unnest(CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') ELSE [coalesce(json_extract(j, '$.file'), j)] END) AS j FROM (SELECT store_path, x::JSON AS j FROM cb WHERE json_valid(x))),
cache AS (SELECT DISTINCT split_part(store_path, '/', 1) AS repo_id, j->>'$.path' AS path, lower(j->>'$.hash') AS hash, j->>'$.description' AS description
  FROM ce WHERE j->>'$.id' IS NOT NULL AND j->>'$.hash' IS NOT NULL AND j->>'$.path' IS NOT NULL AND coalesce(j->>'$.description', '') <> '')"""


def _described(batches):
    import pandas as pd

    for b in batches:
        rows = [(p.split("/")[0], r["path"], r["hash"].lower(), r["description"]) for p, body in zip(b["store_path"], b["body"]) for r in body_records(body) if isinstance(r.get("path"), str) and isinstance(r.get("description"), str) and r["description"]]
        yield pd.DataFrame(rows, columns=["repo_id", "path", "hash", "description"])


def cache(spark, sf_dir):
    return read(spark, sf_dir, "record_files").filter("body IS NOT NULL").select("store_path", "body").mapInPandas(_described, "repo_id string, path string, hash string, description string").distinct()


def _wanted(spark, sf_dir):
    return files(spark, sf_dir, "repo_id", "path", "hash", "type").filter("type = 'code'").withColumn("hash", F.lower("hash"))


_KEY = ["repo_id", "path", "hash"]
_HIT = "EXISTS (SELECT 1 FROM cache c WHERE c.repo_id = f.repo_id AND c.path = f.path AND c.hash = lower(f.hash))"


@query(sql(f"SELECT id AS file_id FROM f WHERE type = 'code' AND {_HIT}", CACHE))
def cache_hits(spark, sf_dir):
    return _wanted(spark, sf_dir).join(cache(spark, sf_dir).select(*_KEY), _KEY, "left_semi").select(F.col("id").alias("file_id"))


@query(sql(f"SELECT id AS file_id FROM f WHERE type = 'code' AND NOT {_HIT}", CACHE))
def cache_misses(spark, sf_dir):
    return _wanted(spark, sf_dir).join(cache(spark, sf_dir).select(*_KEY), _KEY, "left_anti").select(F.col("id").alias("file_id"))


@query(sql("SELECT id AS file_id FROM f WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.path = f.path AND c.hash = lower(f.hash))", CACHE))
def incremental_changed(spark, sf_dir):
    fs = files(spark, sf_dir, "path", "hash").withColumn("hash", F.lower("hash"))
    return fs.join(cache(spark, sf_dir).select("path", "hash"), ["path", "hash"], "left_anti").select(F.col("id").alias("file_id"))


@query(sql(f"SELECT repo_id, count(*) AS files, count_if({_HIT}) AS files_from_cache, CAST(0 AS BIGINT) AS functions FROM f WHERE type = 'code' AND repo_id IS NOT NULL GROUP BY 1", CACHE))
def summarize_stats(spark, sf_dir):
    hit = cache(spark, sf_dir).select(*_KEY).distinct().withColumn("hit", F.lit(True))
    w = _wanted(spark, sf_dir).filter("repo_id IS NOT NULL").join(hit, _KEY, "left")
    return w.groupBy("repo_id").agg(F.count("*").alias("files"), F.count_if(F.coalesce("hit", F.lit(False))).alias("files_from_cache"), F.lit(0).cast("long").alias("functions"))


@query(sql("SELECT id AS file_id, path, coalesce(c.d, f.description) AS description FROM f LEFT JOIN (SELECT repo_id, path, max(description) AS d FROM cache GROUP BY 1, 2) c USING (repo_id, path)", CACHE))
def load_full_map(spark, sf_dir):
    """The index with the stored record's description where there is one."""
    rec = cache(spark, sf_dir).groupBy("repo_id", "path").agg(F.max("description").alias("d"))
    return files(spark, sf_dir, "repo_id", "path", "description").join(rec, ["repo_id", "path"], "left").select(F.col("id").alias("file_id"), "path", F.coalesce("d", "description").alias("description"))


@query(sql("SELECT id AS file_id, path IN (SELECT path FROM cache) AS summarizable FROM f WHERE type = 'code' AND path IS NOT NULL", CACHE))
def allowlist_filter(spark, sf_dir):
    keep = cache(spark, sf_dir).select("path").distinct().withColumn("summarizable", F.lit(True))
    return files(spark, sf_dir, "path", "type").filter("type = 'code' AND path IS NOT NULL").join(keep, "path", "left").select(F.col("id").alias("file_id"), F.coalesce("summarizable", F.lit(False)).alias("summarizable"))


_COLOR = "CASE coalesce(type, '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.COLORS.items() if k not in ("package", "isolated", "other")) + f" ELSE '{rules.COLORS['code']}' END"
_ISO = "coalesce(incoming_connections, 0) + coalesce(outgoing_connections, 0) = 0"


@query(sql(f"SELECT id AS node_id, CASE WHEN {_ISO} THEN '{rules.COLORS['isolated']}' ELSE {_COLOR} END AS color FROM f UNION ALL SELECT id, '{rules.COLORS['package']}' FROM packages"))
def node_color(spark, sf_dir):
    alone = F.coalesce("incoming_connections", F.lit(0)) + F.coalesce("outgoing_connections", F.lit(0)) == 0
    by_type = {k: v for k, v in rules.COLORS.items() if k not in ("package", "isolated", "other")}
    c = F.when(alone, rules.COLORS["isolated"]).otherwise(F.coalesce(S.lookup(F.coalesce("type", F.lit("")), by_type), F.lit(rules.COLORS["code"])))
    a = files(spark, sf_dir, "type", "incoming_connections", "outgoing_connections").select(F.col("id").alias("node_id"), c.alias("color"))
    return a.unionAll(read(spark, sf_dir, "packages").select("id", F.lit(rules.COLORS["package"])))


_SPH = "greatest(0, 1 - y * y)"


@query(sql("SELECT file_id, floor(cos(pi() * (3 - sqrt(5)) * i) * sqrt(greatest(0, 1 - y * y)) * 100 * 10000 + 0.5) / 10000 AS x, floor(y * 100 * 10000 + 0.5) / 10000 AS y, floor(sin(pi() * (3 - sqrt(5)) * i) * sqrt(greatest(0, 1 - y * y)) * 100 * 10000 + 0.5) / 10000 AS z FROM (SELECT file_id, i, CASE WHEN n > 1 THEN 1 - (i / (n - 1)) * 2 ELSE 0 END AS y FROM (SELECT id AS file_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY id) - 1 AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY repo_id) AS DOUBLE) AS n FROM f WHERE repo_id IS NOT NULL)) WHERE y IS NOT NULL"))
def sphere_layout(spark, sf_dir):
    """Deterministic places on a sphere, per repository."""
    p = ranked(spark, files(spark, sf_dir, "repo_id").filter("repo_id IS NOT NULL"), "repo_id", "id")
    n = p.groupBy("repo_id").agg(F.count("*").cast("double").alias("n"))
    p = p.join(n, "repo_id").withColumn("i", (F.col("ordinal") - 1).cast("double"))
    p = p.withColumn("h", F.when(F.col("n") > 1, 1 - (F.col("i") / (F.col("n") - 1)) * 2).otherwise(0.0))
    r, theta = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("h") * F.col("h"))), F.pi() * (3 - F.sqrt(F.lit(5.0))) * F.col("i")
    place = lambda c: S.round_half_up(c * 100, 4)
    return p.select(F.col("id").alias("file_id"), place(F.cos(theta) * r).alias("x"), place(F.col("h")).alias("y"), place(F.sin(theta) * r).alias("z"))


@query("SELECT doc_id, CASE WHEN budget < 400 THEN NULL WHEN length(text) > budget THEN left(text, budget) || chr(10) || '... [truncated]' ELSE text END AS context FROM (SELECT doc_id, text, least(4000, CAST(floor((800 + (doc_id % 4) * 400) * 4 * 0.125) AS INTEGER)) AS budget FROM documents WHERE text IS NOT NULL)")
def context_budget(spark, sf_dir):
    budget = F.least(F.lit(4000), F.floor((800 + F.pmod("doc_id", F.lit(4)) * 400) * 4 * 0.125).cast("int"))
    cut = F.concat(F.substring("text", F.lit(1), budget), F.lit("\n... [truncated]"))
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.when(budget < 400, None).when(F.length("text") > budget, cut).otherwise(F.col("text")).alias("context"))


# White space of any script, written out: the engines' own classes differ.
_WS = "[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_RAW = "'  Answer: <think>' || text || '</think> ' || text || '  '"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_RAW}, '(?is)<think>.*?</think>', '', 'g'), '(?i)^{_WS}*(?:answer|description|summary){_WS}*:{_WS}*', ''), '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g') AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_response(spark, sf_dir):
    """Model replies made from whole texts."""
    raw = F.concat(F.lit("  Answer: <think>"), "text", F.lit("</think> "), "text", F.lit("  "))
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", S.clean_response(raw).alias("cleaned"))


@query("SELECT event_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(t, '(\\d+)m', 1), '') AS DOUBLE), 0) * 60000 + coalesce(TRY_CAST(nullif(regexp_extract(t, '(\\d+\\.?\\d*)s', 1), '') AS DOUBLE), 0) * 1000 AS DOUBLE) AS ms FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 7) || 'm' || (event_id % 60) || '.5s' WHEN event_id % 3 = 1 THEN (event_id % 90) || '.25s' ELSE 'soon' END AS t FROM events)")
def parse_retry_time(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(F.pmod(e, F.lit(3)) == 0, F.concat(F.pmod(e, F.lit(7)).cast("string"), F.lit("m"), F.pmod(e, F.lit(60)).cast("string"), F.lit(".5s"))).when(F.pmod(e, F.lit(3)) == 1, F.concat(F.pmod(e, F.lit(90)).cast("string"), F.lit(".25s"))).otherwise("soon")
    return read(spark, sf_dir, "events").select("event_id", S.retry_ms(text).alias("ms"))


_REPLY = """CASE WHEN text = '' THEN '' WHEN doc_id % 4 = 0 THEN json_object('description', text, 'tags', ['A' || doc_id, 'b'])::VARCHAR WHEN doc_id % 4 = 1 THEN 'Sure! ' || json_object('tags', ['Q'], 'description', text)::VARCHAR || ' ok.' WHEN doc_id % 4 = 2 THEN text || chr(10) || 'Tags: ["X Y", z' || doc_id || ']' ELSE text END"""


@query(f"""SELECT doc_id, CASE WHEN good THEN regexp_replace(j->>'$.description', '^{_WS}+|{_WS}+$', '', 'g') ELSE regexp_replace(regexp_replace(reply, '(?i)tags?:{_WS}*\\[[^\\]]+\\]', ''), '^{_WS}+|{_WS}+$', '', 'g') END AS description,
  CASE WHEN good THEN array_to_string(list_transform(json_extract_string(j, '$.tags[*]')[1:10], lambda t: lower(t)), ',')
  ELSE array_to_string(list_filter(list_transform(string_split(regexp_extract(reply, '(?i)tags?:{_WS}*\\[([^\\]]+)\\]', 1), ','), lambda t: lower(regexp_replace(regexp_replace(t, '^{_WS}+|{_WS}+$', '', 'g'), '[''"]', '', 'g'))), lambda t: t <> ''), ',') END AS tags
FROM (SELECT *, j IS NOT NULL AND coalesce(json_type(j, '$.tags') = 'ARRAY', false) AND coalesce(json_type(j, '$.description') = 'VARCHAR', false) AND j->>'$.description' <> '' AS good
  FROM (SELECT doc_id, reply, CASE WHEN json_valid(m) THEN m::JSON END AS j FROM (SELECT doc_id, reply, regexp_extract(reply, '(?s)\\{{.*\\}}') AS m FROM (SELECT doc_id, {_REPLY} AS reply FROM documents WHERE text IS NOT NULL))))""")
def parse_response(spark, sf_dir):
    """Replies made from whole texts: bare JSON, JSON within a sentence, a text with a line of tags, a plain text."""
    kind, reply = F.pmod("doc_id", F.lit(4)), F.col("text")
    js = lambda *cols: F.to_json(F.struct(*cols))
    first = js(reply.alias("description"), F.array(F.concat(F.lit("A"), F.col("doc_id").cast("string")), F.lit("b")).alias("tags"))
    second = F.concat(F.lit("Sure! "), js(F.array(F.lit("Q")).alias("tags"), reply.alias("description")), F.lit(" ok."))
    third = F.concat(reply, F.lit('\nTags: ["X Y", z'), F.col("doc_id").cast("string"), F.lit("]"))
    made = F.when(reply == "", "").when(kind == 0, first).when(kind == 1, second).when(kind == 2, third).otherwise(reply)
    p = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", S.parse_response(made).alias("p"))
    return p.select("doc_id", "p.description", F.array_join("p.tags", ",").alias("tags"))


@query("SELECT event_id, CASE WHEN ms > 0 THEN ms END AS ms FROM (SELECT event_id, greatest(CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 AS DOUBLE) * 1000 ELSE 0 END, CASE WHEN event_id % 3 = 0 THEN (event_id % 7) * 60000.0 + (event_id % 60 + 0.5) * 1000 ELSE 0 END, CASE WHEN event_id % 5 = 0 THEN (event_id % 90 + 0.25) * 1000 ELSE 0 END)::DOUBLE AS ms FROM events)")
def retry_wait(spark, sf_dir):
    """The longest wait of three headers, any of which may be missing."""
    e = F.col("event_id")
    rest = lambda n: F.pmod(e, F.lit(n)).cast("string")
    after = F.when(F.pmod(e, F.lit(4)) == 0, rest(50))
    tokens = F.when(F.pmod(e, F.lit(3)) == 0, F.concat(rest(7), F.lit("m"), rest(60), F.lit(".5s")))
    requests = F.when(F.pmod(e, F.lit(5)) == 0, F.concat(rest(90), F.lit(".25s")))
    return read(spark, sf_dir, "events").select("event_id", S.retry_wait(after, tokens, requests).alias("ms"))


@query("SELECT id, part_no, lag(left(text, 80)) OVER (PARTITION BY file_id ORDER BY part_no, id) AS before FROM (SELECT DISTINCT id, file_id, part_no, text FROM chunks)")
def chunk_prev_context(spark, sf_dir):
    order = Window.partitionBy("file_id").orderBy("part_no", "id")
    return read(spark, sf_dir, "chunks").select("id", "file_id", "part_no", "text").distinct().select("id", "part_no", F.lag(F.substring("text", 1, 80)).over(order).alias("before"))


_CUT = "CASE WHEN length(content) - {0} <= 1000 THEN length(content) WHEN strpos(substring(content, {0} + 901, 200), chr(10)) > 0 THEN {0} + 900 + strpos(substring(content, {0} + 901, 200), chr(10)) ELSE {0} + 1000 END"


@query(sql("SELECT file_id, CAST(part_no AS INTEGER) AS part_no, substring(content, a + 1, b - a) AS text FROM ck", f"ck(file_id, content, part_no, a, b) AS (SELECT id, content, 0, 0, {_CUT.format('0')} FROM f WHERE content IS NOT NULL UNION ALL SELECT file_id, content, part_no + 1, b, {_CUT.format('b')} FROM ck WHERE b < length(content))").replace("WITH", "WITH RECURSIVE", 1))
def chunk_content(spark, sf_dir):
    """Contents in parts of about 1,000 characters at line ends. Whole contents are the result, so they travel with their ids."""
    return files(spark, sf_dir, "content").filter("content IS NOT NULL").select(F.col("id").alias("file_id"), F.posexplode(S.chunks(F.col("content"), 1000)).alias("part_no", "text"))


@query(sql("SELECT id AS file_id, array_to_string(list_transform(list_filter(coalesce(imports, []), lambda i: i.type = 'package'), lambda i: i.source), ',') AS packages, array_to_string(list_transform(list_filter(coalesce(imports, []), lambda i: i.type = 'file'), lambda i: i.source), ',') AS locals, array_to_string(list_transform(coalesce(functions, []), lambda x: x.name), ',') AS names, array_to_string(list_transform(coalesce(exported, []), lambda e: e.name), ',') AS exports FROM f"))
def prompt_input(spark, sf_dir):
    src = lambda k: F.array_join(F.transform(F.filter("imports", lambda i: i["type"] == k), lambda i: i["source"]), ",")
    name = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return files(spark, sf_dir, "imports", "functions", "exported").select(F.col("id").alias("file_id"), blank(src("package")).alias("packages"), blank(src("file")).alias("locals"), blank(name("functions")).alias("names"), blank(name("exported")).alias("exports"))


_HEAD = "'File: ' || name || chr(10) || 'Path: ' || path || chr(10) || 'Language: ' || coalesce(language, 'unknown') || chr(10) || 'Size: ' || coalesce(size_bytes, 0) || ' bytes' || chr(10) || 'Exports: ' || CASE WHEN len(coalesce(exported, [])) = 0 THEN 'none' ELSE array_to_string(list_transform(exported, lambda e: e.name), ', ') END || chr(10) || 'Imports: ' || CASE WHEN len(coalesce(imports, [])) = 0 THEN 'none' ELSE array_to_string(list_transform(imports, lambda i: i.source), ', ') END || chr(10) || 'Functions defined: ' || len(coalesce(functions, []))"


def _facts():
    listed = lambda c, field: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, "none").otherwise(F.array_join(F.transform(c, lambda x: x[field]), ", "))
    line = lambda label, v: F.concat(F.lit(label + ": "), v)
    n = F.greatest(F.coalesce(F.size("functions"), F.lit(0)), F.lit(0)).cast("string")
    return F.concat_ws("\n", line("File", F.col("name")), line("Path", F.col("path")), line("Language", F.coalesce("language", F.lit("unknown"))), line("Size", F.concat(F.coalesce("size_bytes", F.lit(0)).cast("string"), F.lit(" bytes"))), line("Exports", listed("exported", "name")), line("Imports", listed("imports", "source")), line("Functions defined", n))


ASK_FILE = "Say in one paragraph of four to six sentences what this code does, what it works with and what it offers to others. Where the beginning above does not show it, say so.\nAnswer as JSON with the keys description and tags (three to five lower-case words)."
ASK_PART = "Note in a few sentences what this part does; the next part follows."
_Q = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_START = f"(SELECT coalesce(nullif(left(content, k) || CASE WHEN strlen(left(content, k)) < 500 AND strlen(content) > strlen(left(content, k)) THEN '\ufffd' ELSE '' END, ''), '(no preview)') FROM (SELECT {KEPT} AS k))"


@query(sql(f"SELECT id AS file_id, {_HEAD} || chr(10) || chr(10) || 'The file begins:' || chr(10) || coalesce({_START}, '(no preview)') || chr(10) || chr(10) || {_Q(ASK_FILE)} AS prompt FROM f WHERE type = 'code'"))
def render_file_prompt(spark, sf_dir):
    """The facts of a file, its first 500 bytes and what is asked."""
    start = F.coalesce(F.nullif(S.head_bytes(F.col("content"), 500), F.lit("")), F.lit("(no preview)"))
    prompt = F.concat(_facts(), F.lit("\n\nThe file begins:\n"), start, F.lit("\n\n" + ASK_FILE))
    return files(spark, sf_dir, "type", prompt=prompt).filter("type = 'code'").select(F.col("id").alias("file_id"), "prompt")


_CUT6 = _CUT.replace("901, 200", "5901, 200").replace("+ 900", "+ 5900").replace("1000", "6000")


@query(sql(f"SELECT file_id, CAST(part_no AS INTEGER) AS part_no, head || chr(10) || chr(10) || 'Part ' || (part_no + 1) || ' of ' || count(*) OVER (PARTITION BY file_id) || ':' || chr(10) || substring(content, a + 1, b - a) || chr(10) || chr(10) || CASE WHEN b >= length(content) THEN {_Q(ASK_FILE)} ELSE {_Q(ASK_PART)} END AS prompt FROM ck", f"ck(file_id, head, content, part_no, a, b) AS (SELECT id, {_HEAD}, content, 0, 0, {_CUT6.format('0')} FROM f WHERE content IS NOT NULL AND type = 'code' UNION ALL SELECT file_id, head, content, part_no + 1, b, {_CUT6.format('b')} FROM ck WHERE b < length(content))").replace("WITH", "WITH RECURSIVE", 1))
def render_part_prompts(spark, sf_dir):
    """One prompt for each part of about 6,000 characters of a code file; the last asks for the description."""
    rows = files(spark, sf_dir, "type", "content", head=_facts()).filter("type = 'code' AND content IS NOT NULL").withColumn("parts", S.chunks(F.col("content"), 6000))
    each = rows.select("id", "head", F.size("parts").alias("n"), F.posexplode("parts").alias("part_no", "text"))
    ask = F.when(F.col("part_no") == F.col("n") - 1, ASK_FILE).otherwise(ASK_PART)
    prompt = F.concat("head", F.lit("\n\nPart "), (F.col("part_no") + 1).cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(":\n"), "text", F.lit("\n\n"), ask)
    return each.select(F.col("id").alias("file_id"), "part_no", prompt.alias("prompt"))


@query(sql("SELECT DISTINCT f.id AS file_id, u.x.id AS symbol_id, 'Name: ' || u.x.name || chr(10) || 'Kind: ' || u.x.type || chr(10) || 'Signature: ' || coalesce(u.x.signature, '') || chr(10) || 'File: ' || f.path AS prompt FROM f, UNNEST(f.functions) u(x)"))
def render_function_prompt(spark, sf_dir):
    x = files(spark, sf_dir, "path", "functions").select(F.col("id").alias("file_id"), "path", F.explode("functions").alias("x"))
    text = F.concat(F.lit("Name: "), "x.name", F.lit("\nKind: "), "x.type", F.lit("\nSignature: "), F.coalesce("x.signature", F.lit("")), F.lit("\nFile: "), "path")
    return x.select("file_id", F.col("x.id").alias("symbol_id"), text.alias("prompt")).distinct()


@query()
def heuristic_file_description(spark, sf_dir):
    """Signals of whole contents; the sentences travel, the contents don't."""
    rows = file_description(versions(spark, sf_dir), "type", "_at", "_tie").withColumnRenamed("file_id", "id")
    return latest(rows).filter("type = 'code'").select(F.col("id").alias("file_id"), "description")


def _extracted(spark, sf_dir):
    """Statements of the latest contents of code files: read below the exchange, so rows of symbols travel, not contents."""
    return latest(statements.extract(versions(spark, sf_dir), "type", "_at", "_tie")).filter("type = 'code'").withColumnRenamed("id", "file_id")


@query()
def extract_imports(spark, sf_dir):
    return _extracted(spark, sf_dir).select("file_id", F.posexplode("imports").alias("ord", "i")).select("file_id", "ord", "i.source", "i.type", F.col("i.line_imported").alias("line"))


@query()
def extract_symbols(spark, sf_dir):
    return _extracted(spark, sf_dir).select("file_id", F.posexplode("functions").alias("ord", "x")).select("file_id", "ord", F.col("x.id").alias("symbol_id"), "x.name", F.col("x.type").alias("kind"), "x.signature", "x.line_start", "x.line_end", "x.exports", F.array_join("x.parameters", ", ").alias("parameters"), "x.return_type")


@query()
def extract_exports(spark, sf_dir):
    return _extracted(spark, sf_dir).select("file_id", F.posexplode("exported").alias("ord", "e")).select("file_id", "ord", "e.name", "e.type", F.col("e.id").alias("symbol_id"))


@query()
def extract_failures(spark, sf_dir):
    """Files whose statements can't be told; they stay in the map with empty lists."""
    return _extracted(spark, sf_dir).filter("error IS NOT NULL").select("file_id", "error")


# An extension: event-time windows over the events table.
@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_daily(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(sql("SELECT i.from_id AS file_id, g.path, c.d AS description FROM (SELECT DISTINCT from_id, to_id FROM res) i JOIN f g ON g.id = i.to_id JOIN (SELECT repo_id, path, max(description) AS d FROM cache GROUP BY 1, 2) c ON c.repo_id = g.repo_id AND c.path = g.path", IMP, TGT, RES, CACHE))
def dependency_descriptions(spark, sf_dir):
    """Descriptions already stored of the files a file imports."""
    fs = files(spark, sf_dir, "repo_id", "path", "imports")
    used = L.resolve_files(L.imports_of(fs), fs).select("from_id", "to_id").distinct()
    rec = cache(spark, sf_dir).groupBy("repo_id", "path").agg(F.max("description").alias("description"))
    told = fs.select(F.col("id").alias("to_id"), "repo_id", "path").join(rec, ["repo_id", "path"])
    return used.join(told, "to_id").select(F.col("from_id").alias("file_id"), "path", "description")
