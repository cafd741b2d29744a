"""Queries over files: classification, projections, filters, symbols, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalars as S
from .base import files, latest, ranked, read, sql, versions

QUERIES: dict = {}
SQL: dict = {}


def query(oracle: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return add


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _by_value(key: str, table: dict[str, str]) -> str:
    return " ".join(f"WHEN {key} IN ({_in(k for k, x in table.items() if x == v)}) THEN '{v}'" for v in dict.fromkeys(table.values()))


_BASE = "regexp_extract(path, '[^/]*$')"
_EXT = f"lower(regexp_extract({_BASE}, '^.+(\\.[^.]*)$', 1))"
_SPECIAL = " ".join(f"WHEN {_BASE} IN ({_in(ns)}) THEN '{c}'" for c, ns in rules.SPECIAL.items())
_CATEGORY = f"CASE {_SPECIAL} WHEN starts_with({_BASE}, '.env.') THEN 'config' " + _by_value(_EXT, rules.EXT_CATEGORY) + " ELSE 'other' END"
_LANGUAGE = f"CASE WHEN {_BASE} = '.env' OR starts_with({_BASE}, '.env.') THEN 'dotenv' " + _by_value(_EXT, rules.EXT_LANGUAGE) + " ELSE 'unknown' END"


def _name():
    return S.basename(F.col("path"))


def _told():
    return F.col("content").isNotNull() & (F.col("type") == "code")


@query(sql(f"SELECT id AS file_id, {_CATEGORY} AS category FROM f"))
def file_category(spark, sf_dir):
    return files(spark, sf_dir, "path").select(F.col("id").alias("file_id"), S.category(_name()).alias("category"))


@query(sql(f"SELECT id AS file_id, {_LANGUAGE} AS language FROM f"))
def file_language(spark, sf_dir):
    return files(spark, sf_dir, "path").select(F.col("id").alias("file_id"), S.language(_name()).alias("language"))


@query(sql("SELECT id AS file_id, md5(content) AS hash FROM f"))
def content_md5(spark, sf_dir):
    return files(spark, sf_dir, md5=F.md5(F.encode("content", "utf-8"))).select(F.col("id").alias("file_id"), F.col("md5").alias("hash"))


@query(sql("SELECT id AS file_id, repo_id, printf('file_%03d', row_number() OVER (PARTITION BY repo_id ORDER BY path, id)) AS scan_id FROM f"))
def file_ids(spark, sf_dir):
    rows = ranked(spark, files(spark, sf_dir, "repo_id", "path"), "repo_id", "path", "id")
    return rows.select(F.col("id").alias("file_id"), "repo_id", F.format_string("file_%03d", "ordinal").alias("scan_id"))


@query(sql("SELECT id AS file_id, path FROM f WHERE type = 'code'"))
def filter_code(spark, sf_dir):
    return files(spark, sf_dir, "path", "type").filter("type = 'code'").select(F.col("id").alias("file_id"), "path")


@query(sql(f"SELECT id AS file_id, path FROM f WHERE {_CATEGORY} NOT IN ({_in(rules.HARD_SKIP)})"))
def hard_skip_filter(spark, sf_dir):
    return files(spark, sf_dir, "path").filter(~S.category(_name()).isin(*rules.HARD_SKIP)).select(F.col("id").alias("file_id"), "path")


@query(sql(f"SELECT id AS file_id, NOT regexp_matches(path, '{'|'.join(f'(?:{p})' for p in rules.SKIP_PATHS)}') AS summarizable, CASE WHEN regexp_matches(path, '{'|'.join(f'(?:{p})' for p in rules.SKIP_PATHS)}') THEN 'filtered_by_heuristic' END AS skip_reason FROM f"))
def heuristic_filter(spark, sf_dir):
    skip = S.any_match(F.col("path"), rules.SKIP_PATHS)
    return files(spark, sf_dir, "path").select(F.col("id").alias("file_id"), (~skip).alias("summarizable"), F.when(skip, "filtered_by_heuristic").alias("skip_reason"))


@query(sql("SELECT id AS file_id, path IS NOT NULL AND (starts_with(path, 'app/') OR starts_with(path, 'pages/') OR starts_with(path, 'src/app/') OR starts_with(path, 'src/pages/')) AS is_route FROM f"))
def is_route_file(spark, sf_dir):
    return files(spark, sf_dir, "path").select(F.col("id").alias("file_id"), F.coalesce(F.col("path").rlike("^(?:src/)?(?:app|pages)/"), F.lit(False)).alias("is_route"))


@query(sql(f"""SELECT id AS file_id,
  regexp_matches({_BASE}, '\\.(test|spec)\\.[tj]sx?$') OR list_contains(string_split(path, '/'), '__tests__') AS is_test,
  coalesce(ends_with(language, 'react'), false) OR len(list_filter(coalesce(imports, []), lambda i: i.source IN ('react', 'preact'))) > 0 AS is_react,
  len(list_filter(coalesce(functions, []), lambda x: regexp_matches(coalesce(x.signature, ''), 'req[,\\s].*res'))) > 0 AS is_middleware,
  list_contains(string_split(path, '/'), 'api') AND list_has_any(string_split(path, '/'), ['pages', 'app', 'routes']) AS is_api_route FROM f"""))
def file_role_flags(spark, sf_dir):
    segs = F.split("path", "/")
    empty = lambda c: F.coalesce(F.col(c), F.array())
    return files(spark, sf_dir, "path", "language", "imports", "functions").select(
        F.col("id").alias("file_id"),
        (_name().rlike(r"\.(test|spec)\.[tj]sx?$") | F.array_contains(segs, "__tests__")).alias("is_test"),
        (F.coalesce(F.col("language").endswith("react"), F.lit(False)) | F.exists(F.coalesce("imports", F.array().cast(IMPORTS)), lambda i: F.coalesce(i["source"].isin("react", "preact"), F.lit(False)))).alias("is_react"),
        F.exists(F.coalesce("functions", F.array().cast(FUNCTIONS)), lambda f: F.coalesce(f["signature"], F.lit("")).rlike(r"req[,\s].*res")).alias("is_middleware"),
        (F.array_contains(segs, "api") & F.arrays_overlap(segs, F.array(*map(F.lit, ["pages", "app", "routes"])))).alias("is_api_route"),
    )


IMPORTS = "array<struct<source:string,type:string,line_imported:int>>"
FUNCTIONS = "array<struct<id:string,name:string,type:string,signature:string,line_start:int,line_end:int,description:string,exports:boolean,parameters:array<string>,return_type:string>>"


@query(sql("SELECT id AS file_id, name, path, type, language, size_bytes, hash, left(description, 200) AS description, importance_score, usage_count FROM f"))
def index_projection(spark, sf_dir):
    cols = ["name", "path", "type", "language", "size_bytes", "hash", "description", "importance_score", "usage_count"]
    return files(spark, sf_dir, *cols).select(F.col("id").alias("file_id"), *[F.substring("description", 1, 200).alias("description") if c == "description" else c for c in cols])


@query(sql("SELECT id AS file_id, path, type, language, importance_score FROM f"))
def lightweight_map(spark, sf_dir):
    return files(spark, sf_dir, "path", "type", "language", "importance_score").withColumnRenamed("id", "file_id")


@query(sql("SELECT id AS file_id, CASE WHEN importance_score >= 8 THEN 'Critical' WHEN importance_score >= 5 THEN 'High' WHEN importance_score >= 2 THEN 'Medium' ELSE 'Low' END AS tier FROM f"))
def importance_tier(spark, sf_dir):
    s = F.col("importance_score")
    return files(spark, sf_dir, "importance_score").select(F.col("id").alias("file_id"), F.when(s >= 8, "Critical").when(s >= 5, "High").when(s >= 2, "Medium").otherwise("Low").alias("tier"))


@query(sql("SELECT id AS node_id, floor((3.5 + 2.2 * pow(coalesce(importance_score, 0) + 1, 1.45)) * 1000000 + 0.5) / 1000000 AS size FROM f UNION ALL SELECT id, floor((7 + 3.5 * ln(1 + coalesce(nullif(usage_count, 0), 1))) * 1000000 + 0.5) / 1000000 FROM packages UNION ALL SELECT DISTINCT u.x.id, 3.0 FROM f, UNNEST(functions) u(x) WHERE u.x.id IS NOT NULL"))
def node_size(spark, sf_dir):
    of_file = 3.5 + 2.2 * F.pow(F.coalesce("importance_score", F.lit(0.0)) + 1, F.lit(1.45))
    of_pkg = 7 + 3.5 * F.log(1 + F.coalesce(F.nullif("usage_count", F.lit(0)), F.lit(1)).cast("double"))
    a = files(spark, sf_dir, "importance_score").select(F.col("id").alias("node_id"), S.round_half_up(of_file, 6).alias("size"))
    c = _symbols(spark, sf_dir).select(F.col("s.id").alias("node_id")).filter("node_id IS NOT NULL").distinct().select("node_id", F.lit(3.0))
    return a.unionAll(read(spark, sf_dir, "packages").select("id", S.round_half_up(of_pkg, 6))).unionAll(c)


@query(sql("SELECT id AS file_id, CASE WHEN size_bytes IS NULL THEN '—' WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN format('{:.1f} KB', floor(size_bytes / 1024 * 10 + 0.5) / 10) ELSE format('{:.2f} MB', floor(size_bytes / 1048576 * 100 + 0.5) / 100) END AS size FROM f"))
def format_bytes(spark, sf_dir):
    return files(spark, sf_dir, "size_bytes").select(F.col("id").alias("file_id"), S.format_bytes(F.col("size_bytes")).alias("size"))


@query(sql("SELECT repo_id, CAST(floor(done / total * 100 + 0.5) AS BIGINT) || '% ▕' || repeat('█', CAST(floor(done * 40 / total + 0.5) AS BIGINT)) || repeat('░', 40 - CAST(floor(done * 40 / total + 0.5) AS BIGINT)) || '▏ (' || done || '/' || total || ')' AS bar FROM (SELECT repo_id, count_if(coalesce(description, '') <> '') AS done, count(*) AS total FROM f WHERE type = 'code' GROUP BY 1)"))
def progress_bar(spark, sf_dir):
    """How many code files of each repository have a description."""
    g = files(spark, sf_dir, "repo_id", "type", "description").filter("type = 'code'").groupBy("repo_id").agg(F.count_if(F.coalesce("description", F.lit("")) != "").alias("done"), F.count("*").alias("total"))
    return g.select("repo_id", S.progress_bar(F.col("done"), F.col("total")).alias("bar"))


_KEPT = "list_max(list_filter(range(0, 501), lambda i: strlen(left(content, i)) <= 500))"


@query(sql(f"SELECT id AS file_id, left(content, k) || CASE WHEN strlen(left(content, k)) < 500 AND strlen(content) > strlen(left(content, k)) THEN '\ufffd' ELSE '' END AS snippet FROM (SELECT id, content, {_KEPT} AS k FROM f WHERE content IS NOT NULL)"))
def snippet(spark, sf_dir):
    """The first 500 bytes; what is left of a character that doesn't fit is a replacement character."""
    return files(spark, sf_dir, snippet=S.head_bytes(F.col("content"), 500)).filter("snippet IS NOT NULL").select(F.col("id").alias("file_id"), "snippet")


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'scan', ''))) // 4 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def token_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", S.occurrences(F.col("text"), "scan").alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_./@-]+', ' ', 'g'), ' '), lambda t: length(t) > 1 AND t NOT IN ({_in(rules.STOP_WORDS)})), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def tokenize(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(S.tokenize(F.col("text")), " ").alias("tokens"))


_FN = "fn AS (SELECT DISTINCT f.id AS file_id, u.x AS s FROM f, UNNEST(f.functions) u(x))"
_SPLIT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'), '\\$', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = _SPLIT.format("s.name")
_VERB = "CASE " + _by_value("lower(string_split(w, ' ')[1])", rules.VERBS) + " END"
_PHRASE = f"CASE WHEN {_VERB} IS NULL THEN NULL WHEN contains(w, ' ') THEN {_VERB} || ' ' || lower(w[strpos(w, ' ') + 1:]) ELSE lower({_VERB}) END"


def _symbols(spark, sf_dir):
    return files(spark, sf_dir, "functions").select(F.col("id").alias("file_id"), F.explode("functions").alias("s")).distinct()


@query(sql(f"SELECT DISTINCT s.name AS name, {_WORDS} AS words FROM fn WHERE s.name IS NOT NULL", _FN))
def split_words(spark, sf_dir):
    return _symbols(spark, sf_dir).select("s.name").filter("name IS NOT NULL").distinct().select("name", S.split_words(F.col("name")).alias("words"))


@query(sql(f"SELECT name, {_PHRASE} AS phrase FROM (SELECT DISTINCT s.name AS name, {_WORDS} AS w FROM fn WHERE s.name IS NOT NULL)", _FN))
def verb_phrase(spark, sf_dir):
    return _symbols(spark, sf_dir).select("s.name").filter("name IS NOT NULL").distinct().select("name", S.verb_phrase(F.col("name")).alias("phrase"))


_P = "coalesce(x.phrase, '')"
_DESC = """CASE kind WHEN 'class' THEN 'Defines the `' || name || '` class.' WHEN 'interface' THEN 'Declares the `' || name || '` interface contract.' WHEN 'type' THEN 'Type alias `' || name || '`.' WHEN 'enum' THEN 'Enum `' || name || '`.' WHEN 'constant' THEN 'Module-level constant `' || name || '`.'
ELSE (CASE WHEN contains(coalesce(signature, ''), 'async') THEN 'Asynchronously ' || lower(left(core, 1)) || core[2:] ELSE core END) || CASE WHEN n > 0 THEN ' from ' || n || ' parameter' || CASE WHEN n > 1 THEN 's' ELSE '' END ELSE '' END || CASE WHEN coalesce(ret, '') <> '' THEN '; returns `' || ret || '`' ELSE '' END || '.' END"""


@query(sql(f"SELECT file_id, symbol_id, {_DESC} AS description FROM (SELECT *, CASE WHEN p IS NOT NULL THEN upper(left(p, 1)) || p[2:] WHEN regexp_matches(name, '^[A-Z]') THEN 'Component or constructor named `' || name || '`' ELSE 'Helper named `' || name || '`' END AS core FROM (SELECT *, {_PHRASE} AS p FROM (SELECT file_id, s.id AS symbol_id, s.name AS name, s.type AS kind, s.signature AS signature, coalesce(len(s.parameters), 0) AS n, s.return_type AS ret, {_WORDS} AS w FROM fn WHERE s.name IS NOT NULL)))", _FN))
def heuristic_function_description(spark, sf_dir):
    n = F.greatest(F.size(F.coalesce("s.parameters", F.array().cast("array<string>"))), F.lit(0))
    return _symbols(spark, sf_dir).filter("s.name IS NOT NULL").select("file_id", F.col("s.id").alias("symbol_id"), S.function_description(F.col("s.name"), F.col("s.type"), F.col("s.signature"), n, F.col("s.return_type")).alias("description"))


@query(sql("SELECT file_id, s.type AS kind, count(*) AS n FROM fn GROUP BY 1, 2", _FN))
def symbol_kind_counts(spark, sf_dir):
    return _symbols(spark, sf_dir).groupBy("file_id", F.col("s.type").alias("kind")).agg(F.count("*").alias("n"))


_Q = "list_transform(exs[1:3], lambda s: '`' || s || '`')"


@query(sql(f"""SELECT file_id, CASE WHEN len(exs) = 0 THEN '' ELSE (CASE WHEN len({_Q}) = 1 THEN {_Q}[1] WHEN len({_Q}) = 2 THEN array_to_string({_Q}, ' and ') ELSE array_to_string({_Q}[1:2], ', ') || ', and ' || {_Q}[3] END) || CASE WHEN len(exs) > 3 THEN ' (+' || (len(exs) - 3) || ' more)' ELSE '' END END AS listed
FROM (SELECT id AS file_id, list_transform(list_filter(exported, lambda e: e.name IS NOT NULL), lambda e: e.name) AS exs FROM f WHERE exported IS NOT NULL)"""))
def join_list(spark, sf_dir):
    names = F.filter(F.transform("exported", lambda e: e["name"]), lambda n: n.isNotNull())
    return files(spark, sf_dir, "exported").filter("exported IS NOT NULL").select(F.col("id").alias("file_id"), S.join_list(names).alias("listed"))


_FNAMES = "array_to_string(list_filter(list_transform(coalesce(functions, []), lambda x: x.name), lambda n: n IS NOT NULL), ' ')"
_HAY = f"lower(concat_ws(' ', path, {_BASE}, {_FNAMES}))"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{r}'" for p, r in rules.UI_ROLES) + " ELSE 'UI module' END"


def _names():
    return F.filter(F.transform(F.coalesce("functions", F.array().cast(FUNCTIONS)), lambda x: x["name"]), lambda n: n.isNotNull())


@query(sql(f"SELECT file_id, {_ROLE} AS role FROM (SELECT id AS file_id, {_HAY} AS h FROM f)"))
def ui_role(spark, sf_dir):
    return files(spark, sf_dir, "path", "functions").select(F.col("id").alias("file_id"), S.ui_role(F.col("path"), _name(), _names()).alias("role"))


_TESTS = {"s": "regexp_matches(sn, '{}')", "r": "(regexp_matches(sn, '{}') OR list_has_any(src, ['react-router-dom', 'react-router']))", "l": "regexp_matches(lower(sn), '{}')", "b": "(regexp_matches(lower(sn), '{0}') OR regexp_matches(h, '{0}'))"}
_SIG = "[" + ", ".join(f"CASE WHEN {_TESTS[k].format(p)} THEN '{s}' END" for k, p, s in rules.SIGNALS) + "]"


@query(sql(f"SELECT file_id, array_to_string(list_filter({_SIG}, lambda z: z IS NOT NULL), '; ') AS signals FROM (SELECT id AS file_id, {_HAY} AS h, content AS sn, list_transform(coalesce(imports, []), lambda i: i.source) AS src FROM f WHERE content IS NOT NULL AND type = 'code')"))
def behavior_signals(spark, sf_dir):
    """Signals of whole contents."""
    src = F.transform(F.coalesce("imports", F.array().cast(IMPORTS)), lambda i: i["source"])
    signals = F.array_join(S.behavior_signals(F.col("path"), _name(), _names(), F.coalesce(src, F.array().cast("array<string>")), F.col("content")), "; ")
    return files(spark, sf_dir, "type", signals=F.when(_told(), signals)).filter("signals IS NOT NULL AND type = 'code'").select(F.col("id").alias("file_id"), "signals")


_ENV = "list_concat(list_concat(list_concat(list_concat({}, {}), {}), {}), {})".format(*["regexp_extract_all(content, '" + p.replace("'", "''") + "', 1)" for p in S.ENV_PATTERNS])


@query(sql(f"SELECT file_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(h, lambda x: string_split(x, ','))), lambda y: y), lambda y: regexp_matches(y, '^[A-Z][A-Z0-9_]*$')))), ',') AS env_vars FROM (SELECT id AS file_id, list_transform({_ENV}, lambda z: CASE WHEN contains(z, ',') THEN regexp_replace(z, '\\s*,\\s*', ',', 'g') ELSE z END) AS h FROM f WHERE content IS NOT NULL AND type = 'code')"))
def env_vars(spark, sf_dir):
    return files(spark, sf_dir, "type", env_vars=F.when(_told(), F.array_join(S.env_vars(F.col("content")), ","))).filter("env_vars IS NOT NULL AND type = 'code'").select(F.col("id").alias("file_id"), "env_vars")


# Written out once more: the oracle's values are its own.
_TAG_SQL = {
    "api-client": r"\bfetch\s*\(|\baxios\b|\bgot\b|\bnode-fetch\b|\bundici\b|\buseQuery\s*\(|\buseMutation\s*\(|\buseSWR\s*\(|\bApolloClient\b|\bgraphql\s*\(",
    "browser-storage": r"\blocalStorage\b|\bsessionStorage\b|\bdocument\.cookie\b|\bcookies\.set\b|\bIndexedDB\b",
    "side-effect-hook": r"\buse(Effect|LayoutEffect|InsertionEffect)\s*\(",
    "db-client": r"\b(mongoose|prisma|pg|mysql2|sequelize|drizzle-orm|kysely|supabase|firebase)\b|[A-Za-z0-9_]@prisma/client\b",
    "auth": r"\b(next-auth|passport|jsonwebtoken|jwt|bcrypt|argon2|crypto|session)\b|[A-Za-z0-9_]@auth/",
    "routing": r"\b(react-router|vue-router|useRouter|useSearchParams|useParams)\b|\busePathname\s*\(|\bLink\s+from\s+[''\"]next/link[''\"]|[A-Za-z0-9_]@tanstack/react-router\b",
}
_TAGS = ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{t}' END" for t, p in _TAG_SQL.items())
_ITAGS = ", ".join(f"CASE WHEN list_has_any(src, [{_in(p)}]) THEN '{t}' END" for t, p in rules.IMPORT_TAGS.items())
_SRC = "list_transform(coalesce(imports, []), lambda i: i.source) AS src"


@query(sql(f"SELECT id AS file_id, CASE WHEN content = '' THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([{_TAGS}, {_ITAGS}], lambda z: z IS NOT NULL))), ',') END AS tags FROM (SELECT *, {_SRC} FROM f WHERE type = 'code' AND content IS NOT NULL)"))
def behavior_tags(spark, sf_dir):
    src = F.coalesce(F.transform("imports", lambda i: i["source"]), F.array().cast("array<string>"))
    return files(spark, sf_dir, "type", tags=F.when(_told(), F.array_join(S.behavior_tags(F.col("content"), src), ","))).filter("type = 'code' AND tags IS NOT NULL").select(F.col("id").alias("file_id"), "tags")


@query(sql(f"SELECT id AS file_id, array_to_string(list_sort(list_filter([{_ITAGS}], lambda z: z IS NOT NULL)), ',') AS tags FROM (SELECT *, {_SRC} FROM f WHERE type = 'code')"))
def import_tags(spark, sf_dir):
    src = F.coalesce(F.transform("imports", lambda i: i["source"]), F.array().cast("array<string>"))
    tags = F.array_compact(F.array(*[F.when(F.arrays_overlap(src, F.array(*map(F.lit, p))), F.lit(t)) for t, p in rules.IMPORT_TAGS.items()]))
    return files(spark, sf_dir, "imports", "type").filter("type = 'code'").select(F.col("id").alias("file_id"), F.array_join(F.sort_array(tags), ",").alias("tags"))


_APP = "regexp_extract('/' || path, '/(?:src/)?app/(?:(?:\\([^)]+\\)/)*)([^/]+(?:/[^/]+)*)/(?:page|route)\\.\\w+$', 1)"
_PAGES = "regexp_extract('/' || path, '/(?:src/)?pages/(.+)\\.\\w+$', 1)"
_MADE = "'/' || regexp_replace(regexp_replace(regexp_replace(g, '/index$', ''), '\\[\\.\\.\\.(.+)\\]', '*', 'g'), '\\[(.+)\\]', ':\\1', 'g')"


@query(sql(f"SELECT id AS file_id, CASE WHEN a <> '' THEN CASE WHEN a NOT IN ('layout', 'loading', 'error', 'not-found', 'template', 'default') THEN '/' || regexp_replace(regexp_replace(a, '/page$', ''), '/route$', '') END WHEN g <> '' AND (starts_with({_MADE}, '/api/') OR g NOT IN ('_app', '_document', '_error', '_middleware', '_404')) THEN {_MADE} END AS route FROM (SELECT id, {_APP} AS a, {_PAGES} AS g FROM f)"))
def nextjs_route(spark, sf_dir):
    """Routes by path; the stored paths have no leading slash, so one is put before them to reach top-level folders."""
    return files(spark, sf_dir, "path").select(F.col("id").alias("file_id"), S.nextjs_route(F.concat(F.lit("/"), "path")).alias("route"))


@query("SELECT id, 'pkg_' || regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS package_id FROM packages")
def package_id(spark, sf_dir):
    return read(spark, sf_dir, "packages").select("id", S.package_id(F.col("name")).alias("package_id"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 280) || chr(10) || '... [truncated ' || (length(text) - 380) || ' chars] ...' || chr(10) || right(text, 100) END AS prompt FROM documents WHERE text IS NOT NULL")
def truncate_head_tail(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", S.truncate_head_tail(F.col("text"), 400).alias("prompt"))


_LANG = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.LANG_DISPLAY.items()) + " ELSE coalesce(nullif(language, ''), 'unknown') END"
_LABEL = "CASE type WHEN 'config' THEN ' configuration file (' WHEN 'docs' THEN ' documentation file (' WHEN 'media' THEN ' media asset (' WHEN 'style' THEN ' stylesheet (' WHEN 'database' THEN ' SQL/database file (' ELSE ' file (' END"
_KB = "CAST(CAST(floor(coalesce(size_bytes, 0) / 102.4 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(coalesce(size_bytes, 0) / 102.4 + 0.5) AS BIGINT) % 10 AS VARCHAR)"


@query(sql(f"SELECT id AS file_id, {_LANG} || {_LABEL} || name || ', ' || {_KB} || ' KB) at `' || path || '`.' AS description FROM f WHERE coalesce(type, '') <> 'code'"))
def heuristic_noncode_description(spark, sf_dir):
    tenths = F.floor(F.coalesce("size_bytes", F.lit(0)) / F.lit(102.4) + 0.5).cast("long")
    kb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    kinds = {"config": " configuration file (", "docs": " documentation file (", "media": " media asset (", "style": " stylesheet (", "database": " SQL/database file ("}
    label = F.coalesce(S.lookup(F.coalesce("type", F.lit("")), kinds), F.lit(" file ("))
    df = files(spark, sf_dir, "name", "path", "type", "language", "size_bytes").filter("coalesce(type, '') <> 'code'")
    return df.select(F.col("id").alias("file_id"), F.concat(S.lang_display(F.col("language")), label, "name", F.lit(", "), kb, F.lit(" KB) at `"), "path", F.lit("`.")).alias("description"))


@query(sql("SELECT hash, ext, count(*) AS n_files, min(id) AS first_id FROM (SELECT id, md5(content) AS hash, " + _EXT + " AS ext FROM f WHERE type = 'code' AND content IS NOT NULL) GROUP BY 1, 2"))
def parse_dedup_by_hash(spark, sf_dir):
    df = files(spark, sf_dir, "path", "type", md5=F.md5(F.encode("content", "utf-8"))).filter("type = 'code' AND md5 IS NOT NULL")
    return df.groupBy(F.col("md5").alias("hash"), S.extension(_name()).alias("ext")).agg(F.count("*").alias("n_files"), F.min("id").alias("first_id"))


@query(sql("SELECT repo_id, count(*) AS files_analyzed, count_if(type = 'code') AS files_summarizable FROM f GROUP BY 1"))
def scan_metadata(spark, sf_dir):
    return files(spark, sf_dir, "repo_id", "type").groupBy("repo_id").agg(F.count("*").alias("files_analyzed"), F.count_if(F.col("type") == "code").alias("files_summarizable"))


@query(sql("SELECT repo_id, depth, dir, count(*) AS n_files FROM (SELECT repo_id, d AS depth, array_to_string(string_split(path, '/')[1:d], '/') AS dir FROM f, UNNEST(range(1, len(string_split(path, '/')))) u(d) WHERE path IS NOT NULL) GROUP BY 1, 2, 3"))
def project_tree(spark, sf_dir):
    segs = F.split("path", "/")
    df = files(spark, sf_dir, "repo_id", "path").filter("path LIKE '%/%'").withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(segs) - 1)))
    return df.groupBy("repo_id", F.col("depth").cast("long").alias("depth"), F.array_join(F.slice(segs, F.lit(1), F.col("depth")), "/").alias("dir")).agg(F.count("*").alias("n_files"))


@query(sql("""SELECT repo_id, array_to_string(string_split(path, '/')[1:d], '/') AS path, repeat('  ', d - 1) || '|- ' || string_split(path, '/')[d] || '/' AS line FROM f, UNNEST(range(1, len(string_split(path, '/')))) u(d) WHERE path IS NOT NULL
UNION SELECT repo_id, path, repeat('  ', len(string_split(path, '/')) - 1) || '|- ' || regexp_extract(path, '[^/]*$') || ' (' || coalesce(size_bytes, 0) || 'b, ' || coalesce(len(functions), 0) || ' fn, ' || coalesce(len(imports), 0) || ' imports)' FROM f WHERE path IS NOT NULL"""))
def project_tree_lines(spark, sf_dir):
    """The tree as text, one row a line; lines of a repository in the order of their paths."""
    segs, n = F.split("path", "/"), lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("string")
    fs = files(spark, sf_dir, "repo_id", "path", "size_bytes", n_functions=n("functions"), n_imports=n("imports")).filter("path IS NOT NULL")
    dirs = fs.filter("path LIKE '%/%'").withColumn("d", F.explode(F.sequence(F.lit(1), F.size(segs) - 1)))
    pad = lambda d: F.concat(F.repeat(F.lit("  "), d), F.lit("|- "))
    a = dirs.select("repo_id", F.array_join(F.slice(segs, F.lit(1), F.col("d")), "/").alias("path"), F.concat(pad(F.col("d") - 1), F.get(segs, F.col("d") - 1), F.lit("/")).alias("line")).distinct()
    about = F.concat(F.lit(" ("), F.coalesce("size_bytes", F.lit(0)).cast("string"), F.lit("b, "), "n_functions", F.lit(" fn, "), "n_imports", F.lit(" imports)"))
    return a.unionAll(fs.select("repo_id", "path", F.concat(pad(F.size(segs) - 1), _name(), about))).distinct()


@query(sql("SELECT id AS file_id, coalesce(regexp_matches(path, '(^|/)(layout|template)\\.[^./]+$'), false) AS is_layout, coalesce(regexp_matches(path, '(^|/)(page|index|route)\\.[^./]+$'), false) AS is_page FROM f"))
def route_roles(spark, sf_dir):
    stem = F.regexp_extract("path", r"(?:^|/)([^/]+)\.[^./]+$", 1)
    one = lambda *names: F.coalesce(stem.isin(*names), F.lit(False))
    return files(spark, sf_dir, "path").select(F.col("id").alias("file_id"), one("layout", "template").alias("is_layout"), one("page", "index", "route").alias("is_page"))


@query(sql("SELECT id AS file_id, path, content FROM f WHERE path = (SELECT min(path) FROM f WHERE type = 'code')"))
def get_file(spark, sf_dir):
    """The files at the first path: their ids are found without contents, then only their contents are read."""
    df = files(spark, sf_dir, "path", "type")
    first = df.filter("type = 'code'").agg(F.min("path").alias("path"))
    ids = df.join(F.broadcast(first), "path").select("id")
    return latest(versions(spark, sf_dir).join(ids, "id", "left_semi")).select(F.col("id").alias("file_id"), "path", "content")


@query(sql("SELECT id AS file_id, path FROM f WHERE contains(lower(path), 'cart') OR contains(lower(coalesce(description, '')), 'cart') ORDER BY path, id LIMIT 10"))
def search_files(spark, sf_dir):
    hit = F.contains(F.lower("path"), F.lit("cart")) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("cart"))
    return files(spark, sf_dir, "path", "description").filter(hit).orderBy("path", "id").limit(10).select(F.col("id").alias("file_id"), "path")
