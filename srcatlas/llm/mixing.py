"""Mixing sources to target weights (soft-membership mixing).

1. A classifier (multinomial naive Bayes over hashed words) is fitted on rows whose source is known and
   predicts domain posteriors for those whose source isn't; a known source is a membership of one. Naive Bayes is too sure of
   long texts, so log odds are divided by a power of their length: the one of TEMPERATURES with the best likelihood on held-out rows.
2. Distributed projected-gradient least squares fits a nonnegative rate per document so that the expected token
   totals of the domains meet the targets. Rates are bound by max_repeats; tokens outside of the listed sources are a domain with
   target zero. Documents of like membership and bound share their rate and are added up beforehand; every pass
   sends back one total per domain. Steps are scaled by domain capacity.
3. Rates become whole repeats: the whole part for every document of a source, one more for the documents whose hash
   falls below a threshold, found on token histograms over the hash so that a source's total is met to
   within one document.

The total is the largest that meets all shares of the sources that have documents: the scarcest source,
repeated as often as allowed, sets it. Listed sources without documents can't contribute; their share is spread over
the others in proportion and reported as missing.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch

TOKENIZER = os.environ.get("SRCATLAS_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
TRAIN_ROWS = 200_000  # bound of the sample the classifier is fitted on
FEATURES, ROUNDS, BUCKETS = 1 << 13, 60, 2048
TEMPERATURES = [0.0, 0.25, 0.5, 0.75, 1.0]
OTHER = "(other)"


@lru_cache
def _encoding(path: str):
    import public_tokenizers as P
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for b in batches:
            yield b.assign(n_tokens=[len(enc.encode_ordinary(t)) for t in b.pop("text")])

    return run


def tidy(c: Column) -> Column:
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n"))), F.lit(""))


def _posteriors(spark: SparkSession, texts: DataFrame, sources: list[str]) -> DataFrame:
    """(texts without text, m) of the rows without a source: m is the membership in each of `sources`, the rest outside.

    texts (doc_id, source, text, ...). Fitted on at most TRAIN_ROWS rows with a source, of which a tenth is held out to set the temperature.
    """
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    known = texts.filter("source IS NOT NULL")
    rest = [c for c in texts.columns if c != "text"]
    listed = F.when(F.col("source").isin(*sources), F.col("source")).otherwise(OTHER) if sources else F.lit(OTHER)
    counts = {r["s"]: r["n"] for r in known.groupBy(listed.alias("s")).agg(F.count("*").alias("n")).collect()}  # one row a listed source
    n = sum(counts.values())
    # The model's classes are those that have rows, numbered without gaps.
    classes = sorted(counts)
    label = F.array_position(F.array(*map(F.lit, classes)), listed).cast("double") - 1
    if not n:
        return texts.filter("false").select(*rest, F.lit(None).cast("array<double>").alias("m"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    # A class too small for the sample keeps its rows: each class may have as many as fall to it, or a hundred.
    keep = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(int(min(1.0, max(TRAIN_ROWS / n, 100 / counts[c])) * 1_000_000)))])[listed]
    sample = known.filter(draw < keep).withColumn("label", label).withColumn("held", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0) & listed.isin(*[c for c in classes if counts[c] >= 50]))
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern="[^\\p{L}\\p{N}_]+", toLowercase=True)
    terms = HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES)
    ready = lambda d: terms.transform(words.transform(d))
    model = NaiveBayes(smoothing=0.5).fit(ready(sample.filter("NOT held")))
    scored = lambda d: model.transform(ready(d)).withColumn("raw", vector_to_array("rawPrediction")).withColumn("n", F.greatest(F.lit(1.0), F.size("words").cast("double")))

    def share(power: float) -> Column:
        odds = F.transform("raw", lambda x: F.exp((x - F.array_max("raw")) / F.pow("n", F.lit(power))))
        return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, y: a + y))

    told = scored(sample.filter("held")).select("label", *[share(p).alias(f"t{i}") for i, p in enumerate(TEMPERATURES)])
    fit = told.agg(*[F.sum(F.log(F.greatest(F.lit(1e-12), F.get(f"t{i}", F.col("label").cast("int"))))).alias(f"t{i}") for i in range(len(TEMPERATURES))]).first()
    power = max(range(len(TEMPERATURES)), key=lambda i: fit[i] if fit[i] is not None else -float(TEMPERATURES[i] != 0.5))
    of = lambda s: F.coalesce(F.get("share", F.lit(classes.index(s))), F.lit(0.0)) if s in counts else F.lit(0.0)
    m = F.array(*map(of, sources)) if sources else F.array().cast("array<double>")
    return scored(texts.filter("source IS NULL")).withColumn("share", share(TEMPERATURES[power])).select(*rest, m.alias("m"))


def fit_rates(atoms: DataFrame, goal: np.ndarray, capacity: np.ndarray, rounds: int = ROUNDS) -> list[list[float]]:
    """Projected gradient on rates; returns the steps taken, from which a document's rate follows from its membership.

    atoms (m array<double>, cap double, n_tokens long): documents of like membership, added up. rate(k+1) =
    clip(rate(k) - m . step(k), 0, cap), so no state is written between passes.
    """
    steps: list[list[float]] = []
    scale = np.maximum(capacity, 1.0)
    size = len(goal)
    for _ in range(rounds):
        sent = np.array(steps).reshape(-1, size)  # a few kilobytes

        def totals(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            out = np.zeros(size)
            for b in batches:
                if len(b):
                    m = np.stack(b["m"].to_numpy())
                    r = rates(m, b["cap"].to_numpy(float), sent)
                    out += (m * (r * b["n_tokens"].to_numpy(float))[:, None]).sum(0)
            yield pd.DataFrame({"domain": np.arange(size), "total": out})

        got = atoms.mapInPandas(totals, "domain int, total double").groupBy("domain").agg(F.sum("total").alias("total")).collect()
        now = np.zeros(size)
        for row in got:
            now[row["domain"]] = row["total"]
        off = now - goal
        if np.abs(off).max() <= 1e-4 * max(1.0, goal.sum()):
            break
        steps.append((0.8 * off / scale).tolist())
    return steps


def rates(m: np.ndarray, cap: np.ndarray, steps: np.ndarray) -> np.ndarray:
    r = np.zeros(len(m))
    for s in steps:
        r = np.clip(r - m @ s, 0, cap)
    return r


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their repeats, and the actual shares.

    documents (doc_id, text, source), targets (source, target_share, max_repeats). Sources compare without
    case and surrounding blanks. Null and empty texts have no tokens and aren't chosen; a null source is soft. Repeated
    rows of one doc_id count once (the longest text, then the greatest MD5, then the greatest source); texts aren't exchanged. Null or negative shares count as 0, null max_repeats as 1.
    Empty tables give empty results.
    """
    scratch = Scratch(spark, "mixing")
    goals = targets.select(tidy(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most"))
    goals = goals.filter("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("share"), F.max("most").alias("most")).orderBy("source").collect()  # a fixed table
    sources = [g["source"] for g in goals]
    docs = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", tidy(F.col("source")).alias("source"), "text")
    docs = docs.withColumns({"chars": F.length("text"), "md5": F.md5("text")})
    raw, _ = scratch.cut(docs.mapInPandas(count_tokens(tokenizer), "doc_id long, source string, chars int, md5 string, n_tokens long").filter("n_tokens > 0"))
    version = F.struct("chars", "md5", F.coalesce("source", F.lit("")).alias("source"))
    counted, _ = scratch.cut(raw.groupBy("doc_id").agg(F.max_by(F.struct("source", "md5", "n_tokens"), version).alias("d")).select("doc_id", "d.*"))
    k = len(sources)
    hard = F.array(*[F.when(F.col("source") == s, 1.0).otherwise(0.0) for s in sources], F.when(F.col("source").isin(*sources), 0.0).otherwise(1.0)) if k else F.array(F.lit(1.0))
    # Scored row by row on the texts as they lie; then only rows of the version that counts stay.
    guessed = _posteriors(spark, docs.select("doc_id", "source", "md5", "text"), sources).select("doc_id", "md5", "m")
    soft = counted.filter("source IS NULL").select("doc_id", "md5").join(guessed, ["doc_id", "md5"]).dropDuplicates(["doc_id"])
    rest = lambda m: F.greatest(F.lit(0.0), 1.0 - F.aggregate(m, F.lit(0.0), lambda a, x: a + x))
    softened = soft.select("doc_id", F.concat("m", F.array(rest(F.col("m")))).alias("m"))
    most = [float(g["most"]) for g in goals]
    limits = F.array(*[F.lit(x) for x in most]) if k else F.array().cast("array<double>")
    # Documents of a listed source may be used as often as it; soft ones as often as each source they may belong to.
    cap = F.array_min(F.transform(F.arrays_zip(F.slice("m", 1, max(k, 1)).alias("p"), limits.alias("c")), lambda x: F.when(x["p"] >= 0.05, x["c"])))
    slim = counted.select("doc_id", "source", "n_tokens")
    members = slim.filter("source IS NOT NULL").select("*", hard.alias("m")).unionByName(slim.filter("source IS NULL").join(softened, "doc_id").select("doc_id", "source", "n_tokens", "m"))
    members = members.withColumn("cap", F.coalesce(cap, F.lit(0.0)))
    members, _ = scratch.cut(members)
    atoms, _ = scratch.cut(members.groupBy("m", "cap").agg(F.sum("n_tokens").alias("n_tokens")))
    held = {r["d"]: r["n"] for r in atoms.select(F.posexplode("m").alias("d", "p"), "n_tokens").groupBy("d").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("n")).collect()}
    have = np.array([held.get(i, 0.0) for i in range(k + 1)])
    sure = {r["source"]: r["n"] for r in slim.filter(F.col("source").isin(*sources)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if k else {}
    share = np.array([g["share"] if sure.get(g["source"]) else 0.0 for g in goals])
    share = share / share.sum() if share.sum() else share
    total = min((sure[s] * c / w for s, c, w in zip(sources, most, share) if w > 0), default=0.0)
    goal = np.append(share * total, 0.0)
    steps = np.array(fit_rates(atoms, goal, have)).reshape(-1, k + 1)

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.stack(b["m"].to_numpy()) if len(b) else np.zeros((0, k + 1))
            rate = np.round(rates(m, b["cap"].to_numpy(float), steps), 9)
            yield pd.DataFrame({"doc_id": b["doc_id"], "domain": m.argmax(1).astype(np.int32), "n_tokens": b["n_tokens"], "rate": rate})

    # A rate follows from a row's own membership and bound: no join with the atoms.
    placed = members.select("doc_id", "n_tokens", "m", "cap").mapInPandas(rated, "doc_id long, domain int, n_tokens long, rate double").filter("rate > 0")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(20240607)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    placed, _ = scratch.cut(placed.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate")).withColumn("u", draw))
    # Thresholds on the hash: exact to a bucket, then to a bucket of the bucket.
    want = {r["domain"]: (r["want"], r["n"]) for r in placed.groupBy("domain").agg(F.sum(F.col("part") * F.col("n_tokens")).alias("want"), F.sum("n_tokens").alias("n")).collect()}
    low = dict.fromkeys(want, 0.0)
    width = 1.0
    left = {d: w for d, (w, _) in want.items()}
    for _ in range(3):
        pick = F.create_map(*[F.lit(x) for d, v in low.items() for x in (d, v)]) if low else None
        if pick is None:
            break
        at = F.floor((F.col("u") - pick[F.col("domain")]) / F.lit(width) * BUCKETS)
        inside = placed.withColumn("b", at).filter((F.col("b") >= 0) & (F.col("b") < BUCKETS)).groupBy("domain", "b").agg(F.sum("n_tokens").alias("n")).collect()
        per: dict[int, dict[int, int]] = {}
        for r in inside:
            per.setdefault(r["domain"], {})[r["b"]] = r["n"]
        for d in low:
            b = 0
            while b < BUCKETS - 1 and per.get(d, {}).get(b, 0) <= left[d]:
                left[d] -= per.get(d, {}).get(b, 0)
                b += 1
            low[d] += b * width / BUCKETS
        width /= BUCKETS
    bound = F.create_map(*[F.lit(x) for d, v in low.items() for x in (d, v)])[F.col("domain")] if low else F.lit(0.0)
    repeats = (F.col("whole") + F.when(F.col("u") < bound, 1).otherwise(0)).cast("int")
    name = F.array(*[F.lit(s) for s in [*sources, OTHER]])[F.col("domain")]
    chosen, _ = scratch.cut(placed.select("doc_id", name.alias("source"), "n_tokens", F.round("rate", 6).alias("rate"), repeats.alias("repeats")).filter("repeats > 0"))
    used = {r["source"]: (r["n"], r["most"]) for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n"), F.max("repeats").alias("most")).collect()}
    all_used = sum(n for n, _ in used.values())
    rows = []
    for g, w in zip(goals, share):
        n, most_used = used.get(g["source"], (0, 0))
        rows.append((g["source"], float(g["share"]), float(w), int(g["most"]), int(sure.get(g["source"], 0)), int(n), int(most_used), n / all_used if all_used else 0.0))
    shares = spark.createDataFrame(rows, "source string, target_share double, feasible_share double, max_repeats int, available_tokens long, mixed_tokens long, most_used int, actual_share double")
    return chosen, shares


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mix(spark, *_tables(spark, sf_dir))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mix(spark, *_tables(spark, sf_dir))[1]
