"""Column builders: paths, classification, names, search scores, text clean-up."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """'.' for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(name: Column) -> Column:
    """Lower-case text from the last dot; empty where the only dot leads."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def category(name: Column) -> Column:
    special = {n: c for c, ns in rules.SPECIAL.items() for n in ns}
    return F.coalesce(lookup(name, special), F.when(name.startswith(".env."), "config"), lookup(extension(name), rules.EXT_CATEGORY), F.lit("other"))


def language(name: Column) -> Column:
    return F.coalesce(F.when((name == ".env") | name.startswith(".env."), "dotenv"), lookup(extension(name), rules.EXT_LANGUAGE), F.lit("unknown"))


def lang_display(c: Column) -> Column:
    return F.coalesce(lookup(F.coalesce(c, F.lit("")), rules.LANG_DISPLAY), F.nullif(c, F.lit("")), F.lit("unknown"))


def round_half_up(x: Column, digits: int = 1) -> Column:
    """floor(x * 10^k + 0.5) / 10^k, which differs from round() on halves that binary can't hold."""
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def head_bytes(text: Column, n: int) -> Column:
    """The first n bytes of UTF-8; a character cut in two becomes one replacement character."""
    head = F.substring(F.encode(text, "utf-8"), 1, n)
    return F.make_valid_utf8(head.cast("string"))


def any_match(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def package_id(name: Column) -> Column:
    return F.concat(F.lit("pkg_"), F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def normalize_path(path: Column) -> Column:
    """Posix normal form as an index key: no '.', no inner '..', no leading './' or single '/'."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    absolute = path.startswith("/")

    def step(acc: Column, x: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        up = F.when(can_pop, popped).when(absolute, acc).otherwise(F.array_append(acc, x))
        return F.when(x == "..", up).otherwise(F.array_append(acc, x))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", F.when(absolute, F.lit("")).otherwise(F.lit("."))).otherwise(joined)


def split_words(name: Column) -> Column:
    for pattern, to in ((r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), (r"[_-]+", " "), (r"\$", " "), (r"\s+", " ")):
        name = F.regexp_replace(name, pattern, to)
    return F.trim(name)


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def verb_phrase(name: Column) -> Column:
    words = F.filter(F.split(split_words(name), " "), lambda w: w != "")
    verb = lookup(F.lower(F.get(words, F.lit(0))), rules.VERBS)
    tail = F.lower(F.array_join(F.slice(words, 2, 1 << 30), " "))
    return F.when(verb.isNotNull() & (tail != ""), F.concat_ws(" ", verb, tail)).when(verb.isNotNull(), F.lower(verb))


def join_list(items: Column, most: int = 3) -> Column:
    """`a`, `b`, and `c` (+n more); empty for none."""
    quoted = F.transform(F.slice(items, 1, most), lambda s: F.concat(F.lit("`"), s, F.lit("`")))
    n, more = F.size(quoted), F.size(items) - F.size(quoted)
    body = F.when(n == 1, quoted[0]).when(n == 2, F.array_join(quoted, " and ")).otherwise(F.concat(F.array_join(F.slice(quoted, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(quoted, n - 1)))
    return F.when(F.size(items) == 0, "").when(more > 0, F.concat(body, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(body)


def tokenize(query: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(query), "[^a-z0-9_./@-]+", " "), " ")
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*rules.STOP_WORDS))


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping, without letter case."""
    low = F.lower(text)
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(token.lower()), F.lit("")))) / len(token)).cast("long")


def _points(*pairs: tuple[Column, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(float(n))).otherwise(0.0) for c, n in pairs])


def search_score(q: str, tokens: list[str], name: Column, second: Column, desc: Column, whole: tuple, each: tuple, tags: Column | None = None) -> Column:
    """whole: points for name = q, second = q, q in name, q in second, q in desc, q in a tag; each: per token in name, in second, per occurrence in desc."""
    name, second = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(second, F.lit("")))
    desc = F.lower(F.coalesce(desc, F.lit("")))
    q = q.lower().strip()
    pairs = [(name == q, whole[0]), (second == q, whole[1]), (F.contains(name, F.lit(q)), whole[2]), (F.contains(second, F.lit(q)), whole[3]), (F.contains(desc, F.lit(q)), whole[4])] if q else []
    if tags is not None and q:
        pairs.append((F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(q))), whole[5]))
    score = _points(*pairs) if pairs else F.lit(0.0)
    for t in tokens:
        score = score + _points((F.contains(name, F.lit(t)), each[0]), (F.contains(second, F.lit(t)), each[1])) + occurrences(desc, t) * F.lit(float(each[2]))
    return score


def tag_pattern(tag: str) -> str:
    """The tag's patterns as one alternation. Their edges are those of ASCII words; Java's \\b would look at all letters."""
    word, out = "[A-Za-z0-9_]", []
    for p in rules.TAG_PATTERNS[tag]:
        start = f"(?<={word})" if p.startswith(r"\b@") else f"(?<!{word})"
        out.append(start + p.removeprefix(r"\b").replace(r"\b", f"(?!{word})"))
    return "|".join(out)


def tag_matches(content: Column, tag: str) -> Column:
    """Whether a pattern of the tag matches; texts without any of the patterns' plain parts skip the regular expression."""
    plain = [max(re.split(r"\\b|\\s[*+]|\\[(.]|\[.*?\]", p), key=len) for p in rules.TAG_PATTERNS[tag]]
    return F.when(reduce(lambda a, b: a | b, [F.contains(content, F.lit(x)) for x in plain]), content.rlike(tag_pattern(tag))).otherwise(False)


def behavior_tags(content: Column, sources: Column) -> Column:
    by_text = [F.when(tag_matches(content, t), F.lit(t)) for t in rules.TAG_PATTERNS]
    by_import = [F.when(F.arrays_overlap(sources, F.array(*map(F.lit, p))), F.lit(t)) for t, p in rules.IMPORT_TAGS.items()]
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.array_compact(F.array(*by_text, *by_import)))))


# Patterns of environment variables.
ENV_PATTERNS = [r"process\.env\.([A-Z][A-Z0-9_]*)", r"import\.meta\.env\.([A-Z][A-Z0-9_]*)", "Deno\\.env\\.get\\(['\"`]([A-Z][A-Z0-9_]+)['\"`]\\)", r"Bun\.env\.([A-Z][A-Z0-9_]*)", r"const\s*\{\s*([A-Z][A-Z0-9_,\s]+)\s*\}\s*=\s*(?:process|import\.meta)\.env"]


def env_vars(content: Column) -> Column:
    hits = F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in ENV_PATTERNS]))
    names = F.flatten(F.transform(hits, lambda h: F.when(F.contains(h, F.lit(",")), F.transform(F.split(h, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).otherwise(F.array(h))))
    return F.sort_array(F.array_distinct(F.filter(names, lambda x: x.rlike("^[A-Z][A-Z0-9_]*$"))))


def ui_role(path: Column, name: Column, functions: Column) -> Column:
    text = F.lower(F.concat_ws(" ", path, name, F.array_join(functions, " ")))
    out = None
    for pattern, role in rules.UI_ROLES:
        out = F.when(text.rlike(pattern), role) if out is None else out.when(text.rlike(pattern), role)
    return out.otherwise("UI module")


def behavior_signals(path: Column, name: Column, functions: Column, sources: Column, snippet: Column) -> Column:
    low, names = F.lower(snippet), F.lower(F.concat_ws(" ", path, name, F.array_join(functions, " ")))
    tests = {"s": lambda p: snippet.rlike(p), "r": lambda p: snippet.rlike(p) | F.arrays_overlap(sources, F.array(F.lit("react-router-dom"), F.lit("react-router"))), "l": lambda p: low.rlike(p), "b": lambda p: low.rlike(p) | names.rlike(p)}
    return F.array_compact(F.array(*[F.when(tests[k](p), F.lit(s)) for k, p, s in rules.SIGNALS]))


def function_description(name: Column, kind: Column, signature: Column, n_params: Column, returns: Column) -> Column:
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    core = F.coalesce(capitalize(verb_phrase(name)), F.when(name.rlike("^[A-Z]"), F.concat(F.lit("Component or constructor named "), tick(name))), F.concat(F.lit("Helper named "), tick(name)))
    is_async = F.contains(F.coalesce(signature, F.lit("")), F.lit("async"))
    body = F.when(is_async, F.concat(F.lit("Asynchronously "), F.lower(F.substring(core, 1, 1)), F.substring(core, 2, 1 << 30))).otherwise(core)
    params = F.when(n_params > 0, F.concat(F.lit(" from "), n_params.cast("string"), F.lit(" parameter"), F.when(n_params > 1, "s").otherwise(""))).otherwise("")
    ret = F.when(F.coalesce(returns, F.lit("")) != "", F.concat(F.lit("; returns "), tick(returns))).otherwise("")
    return (
        F.when(kind == "class", F.concat(F.lit("Defines the "), tick(name), F.lit(" class.")))
        .when(kind == "interface", F.concat(F.lit("Declares the "), tick(name), F.lit(" interface contract.")))
        .when(kind == "type", F.concat(F.lit("Type alias "), tick(name), F.lit(".")))
        .when(kind == "enum", F.concat(F.lit("Enum "), tick(name), F.lit(".")))
        .when(kind == "constant", F.concat(F.lit("Module-level constant "), tick(name), F.lit(".")))
        .otherwise(F.concat(body, params, ret, F.lit(".")))
    )


def nextjs_route(path: Column) -> Column:
    app = F.regexp_extract(path, r"/(?:src/)?app/(?:(?:\([^)]+\)/)*)([^/]+(?:/[^/]+)*)/(?:page|route)\.\w+$", 1)
    pages = F.regexp_extract(path, r"/(?:src/)?pages/(.+)\.\w+$", 1)
    made = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.regexp_replace(pages, "/index$", ""), r"\[\.\.\.(.+)\]", "*"), r"\[(.+)\]", ":$1"))
    return (
        F.when(app != "", F.when(~app.isin("layout", "loading", "error", "not-found", "template", "default"), F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(app, "/page$", ""), "/route$", ""))))
        .when((pages != "") & (made.startswith("/api/") | ~pages.isin("_app", "_document", "_error", "_middleware", "_404")), made)
    )


# White space of any script; Java's own class has that of ASCII only.
WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def clean_response(raw: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, rf"(?i)\A{WS}*(?:answer|description|summary){WS}*:{WS}*", "")
    return F.regexp_replace(strip(bare), WS + "+", " ")


def parse_response(reply: Column) -> Column:
    """struct(description, tags) of a model's reply: of the JSON object in it, if that has a description and a list of tags (ten count); else of the text and its `tags: [...]`."""
    j = F.from_json(F.regexp_extract(reply, r"\{[\s\S]*\}", 0), "description string, tags array<string>")
    found = (F.coalesce(j["description"], F.lit("")) != "") & j["tags"].isNotNull()
    pattern = rf"(?i)tags?:{WS}*\[([^\]]+)\]"
    listed = F.transform(F.split(F.regexp_extract(reply, pattern, 1), ","), lambda t: F.lower(F.regexp_replace(strip(t), "['\"]", "")))
    rest = F.regexp_replace(reply, rf"(?is)\A(.*?)tags?:{WS}*\[[^\]]+\]", "$1")  # the first of them only
    made = F.struct(strip(F.when(found, j["description"]).otherwise(rest)).alias("description"), F.when(found, F.transform(F.slice(j["tags"], 1, 10), F.lower)).otherwise(F.filter(listed, lambda t: t != "")).alias("tags"))
    return F.when(strip(F.coalesce(reply, F.lit(""))) == "", F.struct(F.lit("").alias("description"), F.array().cast("array<string>").alias("tags"))).otherwise(made)


def chunks(text: Column, cap: int, slack: int = 100) -> Column:
    """The text in parts: what is left if it is within the cap; else up to the first line end within `slack` of the cap; else exactly the cap. An empty text is one part."""
    pattern = rf"(?s).{{1,{cap}}}\z|.{{{cap - slack},{cap + slack - 1}}}?\n|.{{{cap}}}"
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def retry_ms(text: Column) -> Column:
    minutes = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)m", 1), F.lit("")).cast("double"), F.lit(0.0))
    seconds = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)s", 1), F.lit("")).cast("double"), F.lit(0.0))
    return minutes * 60000 + seconds * 1000


def retry_wait(after: Column, reset_tokens: Column, reset_requests: Column) -> Column:
    """Milliseconds to wait by the largest of three reply headers; null where none tells."""
    seconds = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(after, F.lit("")), r"^\s*(\d+\.?\d*)", 1), F.lit("")).cast("double"), F.lit(0.0))
    longest = F.greatest(seconds * 1000, F.coalesce(retry_ms(reset_tokens), F.lit(0.0)), F.coalesce(retry_ms(reset_requests), F.lit(0.0)))
    return F.when(longest > 0, longest)


def truncate_head_tail(text: Column, most: int) -> Column:
    head, tail = int(most * 0.7), int(most * 0.25)
    cut = F.concat(F.substring(text, 1, head), F.lit("\n... [truncated "), (F.length(text) - (head + tail)).cast("string"), F.lit(" chars] ...\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def format_bytes(n: Column) -> Column:
    """Fixed format: B, KB with one digit, MB with two, a dash for null."""
    return F.when(n.isNull(), "—").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", n / (1 << 20)), F.lit(" MB")))


def progress_bar(done: Column, total: Column, width: int = 40) -> Column:
    """Fixed format: `50% ▕████░░░░▏ (1/2)`; null where the total is 0."""
    filled = F.floor(done * width / total + 0.5).cast("int")
    parts = [F.floor(done / total * 100 + 0.5).cast("string"), F.lit("% ▕"), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled), F.lit("▏ ("), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(")")]
    return F.when(total > 0, F.concat(*parts))


# Messages that only tell progress.
LOG_NOISE = [r"^\d+%", r"\[=*>*\s*\]", "░", "█", r"Scanned \d+ files", r"Summarizing\s+\d+\s+files"]


def is_log_noise(message: Column) -> Column:
    return F.coalesce(any_match(F.regexp_replace(message, "\u001b\\[[0-9;]*[A-Za-z]", ""), LOG_NOISE), F.lit(False))
