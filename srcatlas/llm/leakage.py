"""Evaluation texts leaking into training text.

Two bounds that hold for any number of insertions say where to look: some stretch of the passage has enough of its
words anywhere in the text, and enough words of the passage stand there in order (a bit-parallel longest common
subsequence). What is left, Smith-Waterman aligns with the passage. An inserted remark is a gap
that costs little to extend, an exchanged word a mismatch. A document holds a passage if the alignment covers at
least 20 consecutive passage words of which at most one in eight is exchanged or missing.

The test items are a fixed table and go to every task in blocks of a bounded size; documents never
move, so a passage that leaked into a third of them makes no hot key.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, ONE_IN = 20, 8
# Of a run of any length within the limits, a stretch of one of these lengths is within them, too: halves of a long run can't both be beyond.
STRETCHES = [LEAST, *(n for n in range(LEAST + 1, 2 * LEAST) if n % ONE_IN == 0)]
BLOCK_BYTES = 16 << 20  # of item text that is sent to the tasks at once
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"""</?[A-Za-z][\w:-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*\s*/?>""")
_FIRST = re.compile(r"\s*[^\n]*?(?:[.?!:](?=\s|$)|(?=\n))")
_MATCH, _MISS, _SKIP, _OPEN, _EXTEND = 2.0, -1.5, -1.5, -1.5, -0.08


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def openings(texts: list[str], least: int = 3) -> set[str]:
    """First sentences that several items with different texts share."""
    seen: dict[str, set] = defaultdict(set)
    for t in texts:
        m = _FIRST.match(t)
        if m and m.end() < len(t):
            seen[" ".join(words(m[0]))].add(" ".join(words(t[m.end() :])))
    return {k for k, v in seen.items() if k and len(v) >= least}


def passage(text: str, opens: set[str]) -> list[str]:
    m = _FIRST.match(text)
    if m and " ".join(words(m[0])) in opens:
        return words(text[m.end() :])
    return words(text)


class Index:
    """Passages with the items that share each, and their words as numbers."""

    def __init__(self, items: list[tuple[int, str]], opens: set[str]):
        by: dict[tuple, list[int]] = defaultdict(list)
        for item, text in items:
            w = tuple(passage(text, opens))
            if len(w) >= LEAST:
                by[w].append(item)
        self.items = list(by.values())
        self.ids: dict[str, int] = {}
        self.passages = [np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.int64) for w in by]
        self.has = np.zeros(len(self.ids) + 1, bool)
        # All stretches, as places in the passages put one after another.
        sizes = np.array([len(p) for p in self.passages], np.int64)
        ends = np.cumsum(sizes)
        self.joined = np.concatenate(self.passages) if self.passages else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.sums = np.zeros(len(self.joined) + 1, np.int32)
        # Where a stretch of n words lies within one passage.
        self.inside = {n: self.owner[n - 1 :] == self.owner[: max(0, len(self.owner) - n + 1)] for n in STRETCHES}
        # No alignment is wider: the score of its matches pays for all of its gaps.
        self.widest = int(max(sizes, default=0) * (1 + _MATCH / -_EXTEND))

    def leaked(self, text: str) -> list[tuple[int, int, float]]:
        """(item, covered words, share of them that match) for every item that leaked into text."""
        best: dict[int, tuple[int, float]] = {}
        bare = _TAG.sub(" ", text)
        for t in [text] if bare == text else [text, bare]:
            ids = np.array([self.ids.get(w, 0) for w in words(t)], np.int64)
            for a in range(0, max(1, len(ids) - self.widest), self.widest or 1):
                d = ids[a : a + 2 * self.widest]
                for n in self.possible(d):
                    got = covered(self.passages[n], d)
                    if got and got > best.get(n, (0, 0.0)):
                        best[n] = got
        return [(item, *got) for n, got in best.items() for item in self.items[n]]

    def possible(self, d: np.ndarray) -> list[int]:
        """The passages that d may hold, whatever is inserted into them."""
        known = d[d > 0]
        if not len(self.joined) or len(known) < LEAST - LEAST // ONE_IN:
            return []
        self.has[known] = True
        np.cumsum(self.has[self.joined], out=self.sums[1:])
        self.has[known] = False
        out, row = set(), None
        for n, inside in self.inside.items():
            least = n - n // ONE_IN
            enough = (self.sums[n:] - self.sums[: len(inside)] >= least) & inside
            if not enough.any():
                continue
            row = known.tolist() if row is None else row
            for k in np.flatnonzero(enough).tolist():
                owner = int(self.owner[k])
                if owner not in out and in_order(self.joined[k : k + n].tolist(), row) >= least:
                    out.add(owner)
        return sorted(out)


def in_order(stretch: list[int], row: list[int]) -> int:
    """The length of the longest common subsequence."""
    masks: dict[int, int] = defaultdict(int)
    for k, w in enumerate(stretch):
        masks[w] |= 1 << k
    full = v = (1 << len(stretch)) - 1
    for w in row:
        if w in masks:
            u = v & masks[w]
            v = ((v + u) | (v - u)) & full
    return len(stretch) - v.bit_count()


def align(p: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """Smith-Waterman of passage words with document words: the positions in both that match, in order."""
    n, m = len(p), len(d)
    ramp = np.arange(m + 1) * -_EXTEND
    prev = np.zeros(m + 1)
    moves = np.zeros((n + 1, m + 1), np.int8)
    froms = np.zeros((n + 1, m + 1), np.int32)
    top, where = 0.0, (0, 0)
    for i in range(1, n + 1):
        diag = np.zeros(m + 1)
        diag[1:] = prev[:-1] + np.where(d == p[i - 1], _MATCH, _MISS)
        up = prev + _SKIP
        h = np.maximum(np.maximum(diag, up), 0)
        move = np.where(h <= 0, 0, np.where(diag >= up, 1, 2)).astype(np.int8)
        lifted = h + ramp
        run = np.maximum.accumulate(lifted)
        side = np.full(m + 1, -1e9)
        side[1:] = run[:-1] - ramp[:-1] + _OPEN
        gap = side > h
        if gap.any():
            first = np.maximum.accumulate(np.where(lifted >= run, np.arange(m + 1), 0))
            froms[i, 1:] = first[:-1]
            move[gap] = 3
            h = np.where(gap, side, h)
        moves[i] = move
        prev = h
        j = int(np.argmax(h))
        if h[j] > top:
            top, where = float(h[j]), (i, j)
    out, (i, j) = [], where
    while i > 0 and j > 0 and moves[i, j]:
        if moves[i, j] == 1:
            if p[i - 1] == d[j - 1]:
                out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif moves[i, j] == 2:
            i -= 1
        else:
            j = int(froms[i, j])
    return out[::-1]


def covered(p: np.ndarray, d: np.ndarray) -> tuple[int, float] | None:
    """The longest run of passage words, of which at most one in eight doesn't match, if it is long enough."""
    at = np.flatnonzero(np.isin(d, p))
    if not len(at):
        return None
    d = d[at[0] : at[-1] + 1]  # no alignment begins or ends at a word the passage doesn't have
    while len(pairs := align(p, d)) >= LEAST - LEAST // ONE_IN:
        if best := longest_run([i for i, _ in pairs], len(p)):
            return best
        # A better scored alignment that is edited too much may hide one that isn't.
        d = d.copy()
        d[[j for _, j in pairs]] = 0
    return None


def longest_run(hits: list[int], n: int) -> tuple[int, float] | None:
    best = None
    for a in range(len(hits)):
        for b in range(len(hits) - 1, a, -1):
            size = hits[b] - hits[a] + 1
            lost = size - (b - a + 1)
            # The run may take in exchanged words at its ends, up to what one in eight allows.
            room = n - size
            longest = size + max(0, min(room, size // ONE_IN - lost))
            if best is not None and longest <= best[0]:
                break
            if lost <= longest // ONE_IN and longest >= LEAST:
                best = (longest, (b - a + 1) / longest)
                break
    return best


def leaks(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, match) for every document that holds a passage of an item.

    documents (doc_id, text), items (item_id, text). Null and empty texts hold nothing; items with fewer than
    20 words after their opening can't leak; items that share a passage each count; repeated rows count once. Texts
    are read whole. Items beyond BLOCK_BYTES are sent in blocks of that size, one pass over the documents each.
    """
    rows = [(r["item_id"], r["text"]) for r in items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator()]
    opens = openings([t for _, t in rows])
    blocks, size = [[]], 0
    for r in sorted(rows):
        if size and size + len(r[1]) > BLOCK_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += len(r[1])
    found = None
    docs = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    for block in blocks:
        shared = spark.sparkContext.broadcast((block, opens))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(*shared.value)
            for b in batches:
                out = [(d, *hit) for d, t in zip(b["doc_id"], b["text"]) for hit in index.leaked(t)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "match"])

        part = docs.mapInPandas(run, "doc_id long, item_id long, n_words int, match double")
        found = part if found is None else found.unionAll(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("match").alias("match"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each item that leaked into it."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item turns up in, and its longest run."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))
