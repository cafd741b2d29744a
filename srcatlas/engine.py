"""The pipeline as one object: scan, map, summarize, search, nodes, dependencies, saving and loading."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules
from .functions import scalars as S
from .operators import graph as G
from .operators import links as L
from .operators.describe import file_description
from .runtime import Scratch, ordinals
from .sources import repository

PACKAGES = "id string, name string, type string, version string, usage_count int"
CACHE = "path string, hash string, description string, tags array<string>, version int"
CACHE_VERSION = 1
BACKOFF = (1.0, 2.0, 4.0, 8.0, 16.0)  # seconds before each new attempt


def least_delay(tokens_per_minute: int) -> float:
    """Seconds between two calls under a limit of tokens a minute. A call is taken for 1,000 tokens, with half as much again and half a second at least."""
    return max(500.0, 60_000 / (tokens_per_minute / 1000) * 1.5) / 1000


def with_retries(call: Callable[[], str], delays: tuple[float, ...] = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> str:
    """What call returns, tried again after each delay; the last failure is raised. A refusal for too many calls waits as long as it says, or longer."""
    for attempt in range(len(delays) + 1):
        try:
            return call()
        except Exception as e:
            if attempt == len(delays):
                raise
            said = re.search(r"(?i)retry after (\d+\.?\d*)", str(e))
            limited = getattr(e, "status", None) == 429 or "429" in str(e)
            wait = float(said[1]) if limited and said else max(delays[attempt], 2.0 * (attempt + 1)) if limited else delays[attempt]
            sleep(wait)
    raise AssertionError


class Engine:
    def __init__(self, spark: SparkSession, files: DataFrame, packages: DataFrame, ignored: int = 0):
        """files: repo_id, id, path, name, type, language, hash, content, imports, functions, exported; packages: id, name."""
        self.spark, self.packages, self.ignored = spark, packages, ignored
        none = {"description": "string", "importance_score": "double", "usage_count": "long", "incoming_connections": "long", "outgoing_connections": "long", "tags": "array<string>"}
        self.files = files.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in files.columns})
        self._scratch = Scratch(spark, "engine")
        self._map: dict[str, DataFrame] = {}

    @classmethod
    def scan(cls, spark: SparkSession, root: str, packages: DataFrame | None = None, repo_id: str = "repo", hidden: bool = False, out_dir: str | None = None, **filters: bool) -> Engine:
        """A tree read whole: files with their statements, declared packages, counters. Raises NotADirectoryError where there is none."""
        found, ignored = repository.enumerate_paths(root, hidden, out_dir)
        engine = cls(spark, repository.scanned(spark, root, found, repo_id, **filters), packages if packages is not None else repository.tree_packages(spark, root, repo_id), ignored)
        engine.files = engine._scratch.cut(engine.files)[0]
        return engine

    def metadata(self) -> DataFrame:
        return self.files.agg(F.count("*").alias("files_analyzed"), F.lit(self.ignored).alias("files_ignored"), F.count_if(F.col("type") == "code").alias("files_summarizable"))

    def direct(self) -> DataFrame:
        return L.direct_links(L.resolve_files(L.imports_of(self.files), self.files))

    def map(self) -> dict[str, DataFrame]:
        """links (direct, circular, route, layout, indirect and package links with their ids), cycles, networks, statistics; scores and counts go to files."""
        cut = lambda df: self._scratch.cut(df)[0]
        d, none = self.direct().withColumn("type", F.lit("direct")), F.lit(None).cast("string")
        cols = ["repo_id", "from_id", "to_id", "type", "frequency", "weight", "line"]
        inner = cut(d.select(*cols).unionByName(L.route_links(self.files).withColumn("line", F.lit(None).cast("int")).select(*cols)))
        ends = inner.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
        strong = G.strong_components(self.spark, ends)
        loops = ends.filter("a = b").select(F.col("a").alias("id")).distinct()
        cyclic = cut(strong.select("id", "scc").unionAll(loops.join(strong, "id", "left_anti").select("id", F.col("id").alias("scc"))))
        x, y = cyclic.select(F.col("id").alias("from_id"), F.col("scc").alias("x")), cyclic.select(F.col("id").alias("to_id"), F.col("scc").alias("y"))
        inside = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
        told = inner.join(x, "from_id", "left").join(y, "to_id", "left")
        relabelled = cut(told.select("repo_id", "from_id", "to_id", F.when(inside, "circular").otherwise(F.col("type")).alias("type"), "frequency", F.when(inside, F.lit(rules.WEIGHTS["circular"]).cast("long")).otherwise(F.col("weight")).alias("weight"), "line", inside.alias("is_circular"), F.when(inside, F.col("x")).alias("cycle")))
        indirect = L.indirect_links(relabelled.select("repo_id", "from_id", "to_id").distinct()).withColumn("type", F.lit("indirect"))
        package = L.package_links(L.resolve_packages(L.imports_of(self.files), self.packages)).withColumn("type", F.lit("package"))
        of = self.files.select(F.col("id").alias("from_id"), "repo_id")
        every = relabelled.withColumn("package_id", none).drop("cycle").unionByName(indirect.withColumn("package_id", none), allowMissingColumns=True).unionByName(package.join(of, "from_id"), allowMissingColumns=True)
        phase = F.when(F.col("type").isin("direct", "circular", "package"), 1).when(F.col("type").isin("route", "layout"), 2).otherwise(3)
        every = every.withColumn("is_circular", F.coalesce("is_circular", F.lit(False))).withColumn("_p", phase).withColumn("_t", F.coalesce("to_id", "package_id"))
        numbered = ordinals(self.spark, every, "repo_id", "_p", "from_id", "type", "_t")
        links = cut(numbered.withColumn("id", F.format_string("link_%04d", "ordinal")).drop("ordinal", "_p", "_t"))

        ranks = self._ranks(inner.select("from_id", "to_id", "frequency"))
        had = [c for c in self.files.columns if c not in ("importance_score", "usage_count", "incoming_connections", "outgoing_connections")]
        self.files = cut(self.files.select(*had).join(ranks, "id"))
        used = links.filter("package_id IS NOT NULL").groupBy(F.col("package_id").alias("id")).agg(F.sum("frequency").alias("usage_count"))
        self.packages = cut(self.packages.drop("usage_count").join(used, "id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0))))
        members = cyclic.groupBy(F.col("scc").alias("cycle")).agg(F.sort_array(F.collect_list("id")).alias("files"), F.lit("high").alias("risk_level"))
        lines = relabelled.filter("cycle IS NOT NULL").groupBy("cycle", F.col("from_id").alias("file_id")).agg(F.min("line").alias("line"))
        self._map = {"links": links, "cycles": members, "cycle_files": lines, "components": G.weak_components(self.spark, self.files.select("id"), ends)}
        self._map["networks"] = self._networks(inner)
        self._map["statistics"] = self._statistics(links, members)
        return self._map

    def _ranks(self, inner: DataFrame) -> DataFrame:
        deg = L.degrees(self.files.select("id"), inner)
        bc = G.betweenness(self.spark, self.files.select("id"), inner.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
        raw = G.raw_importance(F.col("incoming"), F.col("outgoing"), F.col("usage"), F.col("betweenness"))
        deg = deg.join(bc, "id").select("*", raw.alias("raw"))
        nodes = self.files.select("repo_id", "id").join(deg.select("id", "raw"), "id").select("repo_id", F.col("id").alias("ord"), "id", "raw")
        scored = G.importance(self.spark, nodes, inner.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
        return deg.join(scored.select("id", "score"), "id").select("id", F.col("score").alias("importance_score"), F.col("usage").alias("usage_count"), F.col("incoming").alias("incoming_connections"), F.col("outgoing").alias("outgoing_connections"))

    def _networks(self, inner: DataFrame) -> DataFrame:
        """(repo_id, id, name, type, node_count, edge_count): the connected files and the others; members are those of files.network."""
        touched = inner.select(F.col("from_id").alias("id")).unionAll(inner.select("to_id")).distinct().withColumn("on", F.lit(True))
        each = self.files.select("repo_id", "id").join(touched, "id", "left").select("repo_id", "id", F.coalesce("on", F.lit(False)).alias("on"))
        self.files = self.files.drop("network").join(each.select("id", F.when(F.col("on"), "network_main").otherwise("network_isolated").alias("network")), "id")
        edges = inner.groupBy("repo_id").agg(F.count("*").alias("edges")).withColumnRenamed("repo_id", "_r")
        g = each.groupBy("repo_id", "on").agg(F.count("*").alias("node_count")).join(edges, F.col("repo_id").eqNullSafe(F.col("_r")), "left")
        pick = lambda a, b: F.when(F.col("on"), a).otherwise(b)
        return g.select("repo_id", pick("network_main", "network_isolated").alias("id"), pick("Main Codebase", "Unused Files").alias("name"), pick("active", "isolated").alias("type"), "node_count", pick(F.coalesce("edges", F.lit(0)), F.lit(0)).alias("edge_count"))

    def _statistics(self, links: DataFrame, cycles: DataFrame) -> DataFrame:
        n_functions = F.greatest(F.coalesce(F.size("functions"), F.lit(0)), F.lit(0))
        best = F.min_by("id", F.struct((-F.col("importance_score")).alias("s"), "id"))
        one = lambda df: self.spark.createDataFrame(df.collect(), df.schema).withColumn("_", F.lit(1))  # noqa: E731 - a row each
        f = self.files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(n_functions), F.lit(0)).alias("total_functions"), F.avg("importance_score").alias("mean"), best.alias("most_important_file"))
        k = links.agg(F.count("*").alias("total_connections"), F.count_if((F.col("type") != "indirect") & F.col("to_id").isNotNull()).alias("inner"))
        c = cycles.agg(F.count("*").alias("circular_dependency_count"))
        pairs = F.col("total_files") * (F.col("total_files") - 1)
        density = F.when(pairs > 0, S.round_half_up(F.col("inner") / pairs, 4)).otherwise(0.0)
        return one(f).join(one(k), "_").join(one(c), "_").select("total_files", "total_functions", "total_connections", "circular_dependency_count", density.alias("network_density"), S.round_half_up(F.coalesce("mean", F.lit(0.0)), 2).alias("average_file_importance"), "most_important_file")

    def describe(self) -> DataFrame:
        return file_description(self.files.filter("type = 'code'"))

    def summarize(self, provider: str | Callable[[dict], str] = "heuristic", cache: DataFrame | None = None, delays: tuple[float, ...] = BACKOFF, parallelism: int | None = None, tokens_per_minute: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Describe the code files; returns (statistics, cache to keep).

        provider: "none" leaves all descriptions empty, "heuristic" uses rules, a function gets a file's facts (path, name, language,
        hash, content, imports, exports, functions) and returns a reply, tried again when it fails; one that fails for good leaves the
        description empty. Files whose (path, hash) the cache holds with a description are not asked for. Caches of another version are empty.
        Calls run in `parallelism` tasks (1 to 16; as many as there are cores by default). With tokens_per_minute they run in one, with the delay that limit asks for.
        """
        code = (F.col("type") == "code") & F.coalesce("summarizable", F.lit(True)) if "summarizable" in self.files.columns else F.col("type") == "code"
        empty = self.spark.createDataFrame([], CACHE)
        old = (cache if cache is not None else empty).filter(F.coalesce(F.col("version") == CACHE_VERSION, F.lit(False)) & (F.coalesce("description", F.lit("")) != "")) if cache is None or "version" in cache.columns else empty
        old = old.groupBy("path", "hash").agg(F.max(F.struct("description", "tags")).alias("_c"))
        if provider == "none":
            self.files = self.files.withColumn("description", F.coalesce("description", F.lit("")))
            return self.spark.createDataFrame([("none", 0, 0)], "provider string, files long, files_from_cache long"), empty
        skip = S.any_match(F.col("path"), rules.SKIP_PATHS)
        joined = self.files.drop("description", "tags").join(old, ["path", "hash"], "left").withColumn("_ask", code & ~skip & F.col("_c").isNull())
        asked = joined.filter("_ask")
        if callable(provider):
            lanes = 1 if tokens_per_minute else max(1, min(16, parallelism)) if parallelism else self.spark.sparkContext.defaultParallelism
            said = self._asked(asked, provider, delays, lanes, least_delay(tokens_per_minute) if tokens_per_minute else 0.0)
        else:
            said = file_description(asked).select(F.col("file_id").alias("id"), F.struct("description", F.array().cast("array<string>").alias("tags")).alias("_p"))
        told = joined.join(said, "id", "left")
        text = lambda c: F.coalesce(F.when(code, F.coalesce("_p." + c, "_c." + c)), F.lit("") if c == "description" else F.array().cast("array<string>"))
        done, _ = self._scratch.cut(told.withColumns({"description": text("description"), "tags": text("tags"), "_hit": F.col("_c").isNotNull() & code}).drop("_c", "_p"))
        self.files = done.drop("_ask", "_hit")
        stats = done.agg(F.lit(provider if isinstance(provider, str) else getattr(provider, "__name__", "provider")).alias("provider"), F.count_if("_ask").alias("files"), F.count_if("_hit").alias("files_from_cache"))
        return stats, done.filter("description <> '' AND (_ask OR _hit)").select("path", "hash", "description", "tags", F.lit(CACHE_VERSION).alias("version"))

    def _asked(self, files: DataFrame, provider: Callable[[dict], str], delays: tuple[float, ...], lanes: int, pause: float) -> DataFrame:
        names = lambda c, k: F.transform(F.coalesce(c, F.array().cast(dict(files.dtypes)[c])), lambda x: x[k])
        facts = files.select("id", "path", "name", "language", "hash", "content", names("imports", "source").alias("imports"), names("exported", "name").alias("exports"), names("functions", "name").alias("functions"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for row in b.to_dict("records"):
                    time.sleep(pause)
                    try:
                        out.append(with_retries(lambda row=row: provider(row), delays) or "")
                    except Exception:
                        out.append("")
                yield pd.DataFrame({"id": b["id"], "reply": out})

        replies, _ = self._scratch.cut(facts.repartition(lanes).mapInPandas(run, f"id {dict(files.dtypes)['id']}, reply string"))
        return replies.select("id", S.parse_response(F.col("reply")).alias("_p"))

    def search(self, text: str, limit: int | None = 10) -> DataFrame:
        """(kind, id, label, score): the best files, symbols and packages; an empty query gives none. The limit is 1 to 50."""
        none = self.spark.createDataFrame([], "kind string, id string, label string, score double")
        if not text.strip():
            return none
        tokens = [t for t in re.sub("[^a-z0-9_./@-]+", " ", text.lower()).split() if len(t) > 1 and t not in rules.STOP_WORDS]
        weight = F.coalesce("importance_score", F.lit(0.0))
        tags = F.coalesce("tags", F.array().cast("array<string>"))
        f = self.files.select(F.lit("file").alias("kind"), "id", F.col("path").alias("label"), (S.search_score(text, tokens, F.col("name"), F.col("path"), F.col("description"), (1000, 800, 400, 200, 80, 60), (60, 25, 10), tags) + weight).alias("score"), S.search_score(text, tokens, F.col("name"), F.col("path"), F.col("description"), (1000, 800, 400, 200, 80, 60), (60, 25, 10), tags).alias("own"))
        x = self.files.select(weight.alias("w"), F.explode("functions").alias("x"))
        own = S.search_score(text, tokens, F.col("x.name"), F.col("x.signature"), F.col("x.description"), (900, 0, 350, 150, 70), (50, 15, 8))
        s = x.select(F.lit("function").alias("kind"), F.col("x.id").alias("id"), F.col("x.name").alias("label"), (own + F.col("w") * 0.5).alias("score"), own.alias("own"))
        points = S.search_score(text, tokens, F.col("name"), F.lit(None).cast("string"), F.lit(None).cast("string"), (700, 0, 250, 0, 0), (40, 0, 0))
        p = self.packages.select(F.lit("package").alias("kind"), "id", F.col("name").alias("label"), points.alias("score"), points.alias("own"))
        hits = f.unionByName(s).unionByName(p).filter("own > 0").drop("own")
        return hits.orderBy(F.desc("score"), "kind", "id").limit(max(1, min(50, limit or 10)))

    def search_files(self, text: str = "", limit: int | None = 10) -> DataFrame:
        """Files whose path, description or a tag contains the text, in order; an empty text matches all."""
        q = F.lit(text.lower())
        tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), q))
        hit = F.contains(F.lower("path"), q) | F.contains(F.lower(F.coalesce("description", F.lit(""))), q) | tagged
        return self.files.filter(hit).orderBy("repo_id", "id").limit(limit or 10).select("id", "path", "description", "importance_score")

    def query(self, text: str, limit: int | None = 5) -> DataFrame:
        """Whole rows of the files search_files finds, 20 at most; a text counts up to 200 characters."""
        found = self.search_files(text[:200], min(20, limit or 5)).select("id")
        return self.files.join(found, "id", "left_semi")

    def get_file(self, path: str) -> DataFrame:
        return self.files.filter(F.col("path") == path)

    def get_map(self) -> DataFrame:
        return self.files.select("id", "path", F.substring("description", 1, 200).alias("description"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "importance_score")

    def node(self, ref: str) -> DataFrame:
        """(kind, id, label, file_id) of the file (by id or path), symbol or package (by id or name) that ref names."""
        f = self.files.filter((F.col("id") == ref) | (F.col("path") == ref)).select(F.lit("file").alias("kind"), "id", F.col("path").alias("label"), F.col("id").alias("file_id"))
        x = self.files.select("id", F.explode("functions").alias("x")).filter(F.col("x.id") == ref).select(F.lit("function"), "x.id", "x.name", "id")
        p = self.packages.filter((F.col("id") == ref) | (F.col("name") == ref)).select(F.lit("package"), "id", "name", F.lit(None).cast("string"))
        return f.unionAll(x).unionAll(p)

    def dependencies(self, ref: str, depth: int = 1) -> DataFrame:
        """(side, id, distance): files that the file (by id or path) imports and that import it, up to depth (1 to 3) steps."""
        d = self._scratch.cut(self.direct().select("from_id", "to_id").distinct())[0]
        me = self.files.filter((F.col("id") == ref) | (F.col("path") == ref)).select("id")
        out = None
        for side, a, b in (("imports", "from_id", "to_id"), ("imported_by", "to_id", "from_id")):
            edges = d.select(F.col(a).alias("v"), F.col(b).alias("id"))
            seen = me.select("id", F.lit(0).alias("distance"))
            for n in range(1, max(1, min(3, depth)) + 1):
                far = seen.filter(F.col("distance") == n - 1).select(F.col("id").alias("v")).join(edges, "v").select("id", F.lit(n).alias("distance"))
                seen = seen.unionAll(far).groupBy("id").agg(F.min("distance").alias("distance"))
            part = seen.filter("distance > 0").select(F.lit(side).alias("side"), "id", "distance")
            out = part if out is None else out.unionAll(part)
        return out

    def save(self, root: str) -> None:
        """files, packages and what map made, as tables below root, and the narrow index of the files."""
        index = self.files.select("repo_id", "id", "name", "path", "type", "language", "size_bytes", "hash", F.substring("description", 1, 200).alias("description"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "importance_score", "usage_count")
        repository.save({"files": self.files, "files_index": index, "packages": self.packages, **self._map}, root)

    def export_json(self, root: str) -> None:
        """The tables as lines of JSON below root."""
        for name, df in {"files": self.files, "packages": self.packages, **self._map}.items():
            df.write.mode("overwrite").json(f"{root}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Engine:
        files, packages = repository.load(spark, root, "files"), repository.load(spark, root, "packages")
        if files is None:
            raise FileNotFoundError(f"no map in {os.fspath(root)}")
        engine = cls(spark, files, packages if packages is not None else spark.createDataFrame([], PACKAGES))
        engine._map = {n: t for n in ("links", "cycles", "networks", "statistics") if (t := repository.load(spark, root, n)) is not None}
        return engine
