"""Splitting oversized items at natural boundaries (content-defined chunking).

A gear hash rolls over 32 code points; where its low bits are zero there is a landmark. From the start
of a piece, the first landmark between the minimum and the maximum size snaps to the nearest natural
boundary in that window (a blank line beats a line end, which beats a sentence end, at like distance). Landmarks depend on
the text around them only, so an edit moves the cuts of neighbouring pieces and no others. Without a
landmark the last boundary in the window is the cut, without a boundary the landmark, without
either the maximum. All pieces but the first repeat the last `overlap` characters before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST, MASK = 2000, 200, 600, 0xFF


@lru_cache
def _gear() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 63, 4096, dtype=np.uint64)


def landmarks(codes: np.ndarray, mask: int = MASK) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 code points has its masked bits zero."""
    h = _gear()[codes & 4095]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint64(k)
        h = h + shifted
    return np.flatnonzero((h >> np.uint64(24)) & np.uint64(mask) == 0) + 1


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural boundaries: positions and ranks (0 blank line, 1 line end, 2 sentence end)."""
    n = len(codes)
    line = codes == 10
    before = np.zeros(n, bool)
    before[1:] = line[:-1] | ((codes[:-1] == 13) & (np.r_[False, line[:-2]] if n > 1 else False))
    stop = np.isin(codes, (46, 33, 63, 59, 0x3002))
    sentence = np.zeros(n, bool)
    sentence[1:] = stop[:-1] & (codes[1:] == 32)
    rank = np.where(line & before, 0, np.where(line, 1, 2))
    at = np.flatnonzero(line | sentence)
    return at + 1, rank[at]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """[start, end) of the consecutive pieces, each at most `limit` long, the overlap included."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < least < limit - overlap:
        raise ValueError("need 0 <= overlap < least < limit - overlap")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = landmarks(codes)
    at, rank = boundaries(codes)
    most = limit - overlap
    out, start = [], 0
    while n - start > most:
        lo, hi = start + least, start + most
        m = np.searchsorted(marks, lo)
        mark = int(marks[m]) if m < len(marks) and marks[m] <= hi else None
        i, j = np.searchsorted(at, lo), np.searchsorted(at, hi, "right")
        if i < j:
            if mark is None:
                cut = int(at[j - 1])
            else:
                away = np.abs(at[i:j] - mark) + rank[i:j] * 48
                cut = int(at[i + int(np.argmin(away))])
        else:
            cut = mark or hi
            if text[cut - 1 : cut + 1] == "\r\n":
                cut -= 1
        out.append((max(0, start - overlap), cut))
        start = cut
    out.append((max(0, start - overlap), n))
    return out


def _pieces(text: str, kind: str, item: str, rows: list) -> None:
    for k, (a, b) in enumerate(cuts(text)):
        rows.append((kind, item, k, a, b, text[a:b]))


_OUT = "item_kind string, item_id string, part_no int, char_start long, char_end long, text string"
_COLS = ["item_kind", "item_id", "part_no", "char_start", "char_end", "text"]


def function_text(content: str, starts: list[int], first: int, last: int) -> str:
    """Lines first..last of content, counted from 1; starts: where its lines begin."""
    first = max(first, 1)
    if last < first or first > len(starts):
        return ""
    return content[starts[first - 1] : starts[last] if last < len(starts) else len(content)]


def _line_starts(content: str) -> list[int]:
    out, at = [0], content.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = content.find("\n", at + 1)
    if out[-1] == len(content) and len(out) > 1:
        out.pop()
    return out


def _split_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows: list = []
        for content, ids, firsts, lasts in zip(b["content"], b["ids"], b["firsts"], b["lasts"]):
            starts = _line_starts(content)
            for item, first, last in zip(ids, firsts, lasts):
                if item is None or first is None or last is None or first != first or last != last:
                    continue
                text = function_text(content, starts, int(first), int(last))
                if len(text) > LIMIT:
                    _pieces(text, "function", item, rows)
        yield pd.DataFrame(rows, columns=_COLS)


def _split_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows: list = []
        for item, text in zip(b["id"], b["text"]):
            _pieces(text, "chunk", item, rows)
        yield pd.DataFrame(rows, columns=_COLS)


def split_items(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The pieces of every item longer than the limit: chunks.text, and the lines of each function.

    Null ids, texts, contents and line ranges are no items; a range past the end stops there; repeated
    rows give their pieces once; two different texts under one id give the pieces of both. Only texts
    that can hold an oversized item leave the JVM, with the columns needed and no others.
    """
    long_chunks = chunks.filter(F.length("text") > LIMIT).select("id", "text").filter("id IS NOT NULL")
    could = F.filter("functions", lambda f: f["line_end"] >= f["line_start"])
    long_files = files.filter(F.length("content") > LIMIT).select("content", could.alias("f")).filter(F.size("f") > 0)
    long_files = long_files.select("content", F.col("f.id").alias("ids"), F.col("f.line_start").alias("firsts"), F.col("f.line_end").alias("lasts"))
    both = long_chunks.mapInPandas(_split_chunks, _OUT).unionAll(long_files.mapInPandas(_split_functions, _OUT))
    keys = ["item_kind", "item_id", "part_no", "char_start", "char_end"]
    return both.withColumn("h", F.xxhash64("text")).dropDuplicates([*keys, "h"]).drop("h")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/chunks.parquet"), spark.read.parquet(f"{sf_dir}/files.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized item, from its pieces as `p2_pieces` gives them: an item in two pieces or more."""
    pieces = split_items(*_tables(spark, sf_dir))
    return pieces.filter("part_no = 1").select("item_kind", "item_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their texts."""
    return split_items(*_tables(spark, sf_dir))


def quality(pieces: DataFrame) -> DataFrame:
    """What a set of pieces is worth, by item_kind: pieces, the longest and the mean one, the least and greatest overlap of neighbours, breaks
    (neighbours that leave something out or come in another order), and the share of cuts at a line or sentence end. Ids with two texts are left out of the breaks."""
    texts = pieces.filter("part_no = 0").groupBy("item_kind", "item_id").agg((F.count("*") > 1).alias("twice"))
    order = Window.partitionBy("item_kind", "item_id").orderBy("part_no", "char_start", "char_end")
    cut = F.lead("part_no").over(order) > F.col("part_no")
    each = pieces.join(texts, ["item_kind", "item_id"]).select(
        "item_kind", "item_id", "twice", F.length("text").alias("n"), cut.alias("cut"),
        F.when(cut & ~F.col("twice"), F.col("char_end") - F.lead("char_start").over(order)).alias("overlap"),
        (F.length("text") != F.col("char_end") - F.col("char_start")).alias("wrong"),
        F.col("text").rlike(r"(?:\n|[.!?;\u3002] )\z").alias("natural"),
    )
    broken = F.col("wrong") | F.coalesce(F.col("overlap") != OVERLAP, F.lit(False))
    return each.groupBy("item_kind").agg(F.count("*").alias("n_pieces"), F.max("n").alias("longest"), F.avg("n").alias("mean"), F.min("overlap").alias("least_overlap"), F.max("overlap").alias("greatest_overlap"), F.count_if(broken).alias("breaks"), (F.count_if(F.col("cut") & F.col("natural")) / F.greatest(F.lit(1), F.count_if("cut"))).alias("natural_cuts"))


def p2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, overlap, cover and naturalness over all pieces."""
    return quality(p2_pieces(spark, sf_dir))
