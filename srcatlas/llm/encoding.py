"""Garbled text from wrong character encodings: noisy-channel decoding.

A damaged unit (a run without white space) becomes a byte lattice for each charset it may have been read
with: a character, plain or as a numeric character reference, gives its byte, a replacement character a wildcard
over the bytes that get lost. A Viterbi search walks the lattice as UTF-8 or as another single-byte charset, under
corpus word frequencies (a sketch of fixed size) with a character bigram model of the corpus below them; exact word
frequencies choose among the few readings it keeps. References come back as references.
A reading is taken if the model prefers it to what stands there: for UTF-8 the byte pattern itself is strong
evidence; a confusion of two single-byte charsets needs known words in place of unknown ones.

The bigrams and the word frequencies are counts over every text, also those that hold ASCII only; none is sampled.
Distinct texts are read once, and a text counts for at most _COPIES of the documents that repeat it, so that copies
of a garbled text make neither its words known nor its characters likely. Distinct units are judged once each, wherever they occur:
(text, unit) rows are joined with the verdicts on the unit, and word frequencies are joined to the readings;
neither visits the driver. What does is the bigram model, whose alphabet is bounded by the charsets' characters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch

# Charsets text is read with by mistake, and pairs of single-byte charsets (read as, written as).
READ_AS = ["cp1252", "latin_1", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp437", "cp850", "cp852", "cp866", "mac_roman", "iso8859_15"]
PAIRS = [("cp1252", "cp437"), ("cp1252", "cp850"), ("latin_1", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp852"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
         ("cp1250", "cp1252"), ("cp1252", "iso8859_2"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("cp1252", "cp1251"), ("latin_1", "cp1251"), ("cp1252", "koi8_r"), ("latin_1", "koi8_r"),
         ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "koi8_r"), ("koi8_r", "cp866"), ("cp437", "cp866"), ("cp1252", "cp866"), ("cp437", "cp1251"), ("cp850", "cp1251")]
LOST = "�"
# Under these any strictly valid UTF-8 sequence is a step; in the others ordinary Cyrillic words are full of such sequences.
_WESTERN = {"cp1252", "latin_1", "cp1250", "iso8859_2", "cp437", "cp850", "mac_roman", "iso8859_15"}
_GAIN_UTF8, _GAIN_PAIR, _BONUS, _BEAM, _STEPS, _COPIES = 1.0, 2.0, 2.0, 16, 3, 5
_WORD_GAIN, _SLOTS, _SALTS = 0.7, 1 << 18, ("", "+")  # of a word's log frequency; size and rows of the sketch of word frequencies
_AT_ONCE = 1 << 20  # characters of texts counted in one step
_REFERENCE = "&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
_EXTRA = "  «»–—‘’‚“”„†‡•…‰‹›€™→←↑↓≤≥≠≈√±×÷§¶·²³°µ½¼¾¿¡✔✖├└│─┌┐┘┤┬┴┼═║╔╗╚╝"


@lru_cache
def _charset(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and byte to character; bytes a charset leaves open are read as C1 controls."""
    chars = []
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        chars.append(c)
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return back, chars


@lru_cache
def alphabet() -> dict[str, int]:
    """The model's characters; all others are one class, number 0."""
    chars = {c for n in READ_AS for c in _charset(n)[1]} | set(_EXTRA) | {LOST}
    return {c: i + 1 for i, c in enumerate(sorted(chars))}


@lru_cache
def _classes() -> np.ndarray:
    """Code point to class. Astral characters have a class of their own."""
    t = np.zeros(0x10000, np.int32)
    for c, i in alphabet().items():
        t[ord(c)] = i
    return t


def _size() -> int:
    return len(alphabet()) + 2


@lru_cache
def _suspect() -> re.Pattern:
    """UTF-8 sequences as Latin-1 or its Windows extension show them. They count neither for the model nor as parts of words: these are to tell how clean text looks."""
    low = "[" + "".join(re.escape(c) for c in sorted({*map(chr, range(0x80, 0xC0)), *_charset("cp1252")[1][0x80:0xC0]})) + "]"
    return re.compile(f"(?:[\u00c2-\u00df]{low}|[\u00e0-\u00ef]{low}{{2}}|[\u00f0-\u00f4]{low}{{3}})+")


def _bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the pairs of a task's texts, each text between two line feeds; summed here, so a task gives at most one row a pair."""
    size = _size()
    total = np.zeros(size * size, np.int64)

    def add(texts: list[str], weight: int) -> None:
        codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = np.where(codes < 0x10000, _classes()[np.minimum(codes, 0xFFFF)], size - 1).astype(np.int64)
        total[:] += int(weight) * np.bincount(cls[:-1] * size + cls[1:], minlength=size * size)

    for b in batches:
        for weight, part in b.groupby("weight")["text"]:
            texts, length = [], 0
            for t in part:
                texts.append(t if t.isascii() else _suspect().sub("\n", t))
                length += len(t)
                if length > _AT_ONCE:
                    add(texts, weight)
                    texts, length = [], 0
            if texts:
                add(texts, weight)
    pair = np.flatnonzero(total)
    yield pd.DataFrame({"pair": pair, "n": total[pair]})


def bigrams_of(texts: DataFrame) -> DataFrame:
    """(pair, n) over all texts: those without a non-ASCII character tell as well what follows what."""
    return texts.select("weight", "text").mapInPandas(_bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of a character after another."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        size = _size()
        t = np.zeros(size * size, np.float64)
        t[pairs] = counts
        t = t.reshape(size, size)
        share = t.sum(0) / max(1.0, t.sum())
        # Witten-Bell-like: unseen pairs fall back on how common the second character is.
        back = 0.9 * share + 0.1 / (size * 20)
        total, kinds = t.sum(1, keepdims=True), (t > 0).sum(1, keepdims=True) + 1
        self.log = np.log((t + kinds * back[None, :]) / (total + kinds)).astype(np.float32)
        self.unigram = share
        # What stands in clean text often enough to be read into a wildcard or a UTF-8 sequence.
        self.known = {c for c, i in alphabet().items() if t[i].sum() >= 2}
        self.space = alphabet()[" "]

    def of(self, c: str) -> int:
        return alphabet().get(c, 0) if ord(c) < 0x10000 else _size() - 1

    def score(self, text: str) -> float:
        ids = [self.space, *map(self.of, text), self.space]
        return float(sum(self.log[a, b] for a, b in zip(ids, ids[1:])))


def expand(unit: str) -> str:
    """The unit with its numeric character references replaced by their characters; those outside of Unicode stay."""

    def char(m: re.Match) -> str:
        body = m.group()[2:-1]
        code = int(body[1:], 16) if body[0] in "xX" else int(body)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()

    return re.sub(_REFERENCE, char, unit) if "&#" in unit else unit


def contract(reading: str, unit: str) -> str:
    """The reading in the form of the unit it came from: as references, if the unit held its non-ASCII characters so."""
    if "&#" not in unit or not unit.isascii():
        return reading
    form = "&#x{:x};" if re.search("&#[xX]", unit) else "&#{};"
    return "".join(c if ord(c) < 0x80 else form.format(ord(c)) for c in reading)


class Words:
    """Word frequencies in a count-min sketch of two rows of _SLOTS counters, whatever the corpus."""

    def __init__(self, rows: np.ndarray):
        self.gain = (_WORD_GAIN * np.log1p(rows)).astype(np.float32)

    @lru_cache(1 << 16)  # noqa: B019
    def __call__(self, word: str) -> float:
        return min(float(row[zlib.crc32((salt + word).encode("utf-8", "surrogatepass")) % _SLOTS]) for salt, row in zip(_SALTS, self.gain)) if len(word) > 1 else 0.0


class Decoder:
    def __init__(self, model: Model, words: Words):
        self.m, self.words = model, words
        self.by_bytes: dict[bytes, str] = {}
        for c in model.known:
            if ord(c) >= 0x80 and c != LOST and not 0x80 <= ord(c) < 0xA0:
                self.by_bytes[c.encode()] = c
        self.emoji = [chr(x) for x in range(0x1F000, 0x1FB00)]
        for c in self.emoji:
            self.by_bytes[c.encode()] = c
        self.by_length: dict[int, list[tuple[bytes, str]]] = {2: [], 3: [], 4: []}
        for b, c in self.by_bytes.items():
            self.by_length[len(b)].append((b, c))
        # Also what stands only between two wrong decodings: the charsets' other characters and C1 controls.
        self.listed = self.by_bytes | {c.encode(): c for c in [*alphabet(), *map(chr, range(0x80, 0xA0))] if ord(c) >= 0x80 and c != LOST}
        self.lost = sorted((c for c in model.known if ord(c) >= 0xA0 and c.isalpha()), key=lambda c: -model.unigram[model.of(c)])[:160]
        self.lost += [c for c in "’“”—–…«»•€×" if c in model.known]

    @staticmethod
    def strict(raw: bytes) -> tuple[str, float] | None:
        """The character of a valid sequence the corpus doesn't know, and what it counts for: the longer the sequence, the less it is chance."""
        try:
            c = raw.decode()
        except UnicodeDecodeError:
            return None
        return (c, len(raw) - 1.0) if c.isprintable() else None

    def chance(self, reading: str, unit: str) -> bool:
        """Whether the reading's only new character is one the corpus doesn't know, from a short sequence: clean text may show that."""
        new = [c for c in reading if c not in unit]
        return len(new) == 1 and len(b := new[0].encode()) < 4 and b not in self.listed

    def utf8(self, unit: str, charset: str, unknown: bool = False) -> tuple[str, float] | None:
        """The best reading as UTF-8 of what charset showed, and the weight of its multi-byte characters; unknown: also with characters the corpus doesn't know."""
        back, _ = _charset(charset)
        lattice: list[int | None] = []
        for c in unit:
            if c == LOST:
                lattice.append(None)
            elif c in back:
                lattice.append(back[c])
            elif charset == "cp1252" and ord(c) < 0x100:
                lattice.append(ord(c))
            else:
                lattice.append(-1)
        if not any(b is not None and 0xC2 <= b <= 0xF4 for b in lattice):
            return None
        n, m = len(unit), self.m
        # A state is the last character's class and the letters of the word that is not over yet.
        beams: list[dict[tuple[int, str], tuple[float, str, float]]] = [{} for _ in range(n + 1)]
        beams[0] = {(m.space, ""): (0.0, "", 0)}

        def put(at: int, last: tuple[int, str], value: tuple[float, str, float]) -> None:
            old = beams[at].get(last)
            if old is None or value[0] > old[0]:
                beams[at][last] = value

        for i in range(n):
            if not beams[i]:
                continue
            steps: list[tuple[int, str, float]] = []
            b = lattice[i]
            if b is None or b == -1 or b < 0x80:
                steps.append((1, unit[i], 0))
            else:
                steps.append((1, unit[i], 0))
                need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
                if need and i + need <= n:
                    tail = lattice[i + 1 : i + need]
                    if all(x is not None for x in tail):
                        if all(0x80 <= x < 0xC0 for x in tail):
                            raw = bytes([b, *tail])
                            c = (self.listed if charset in _WESTERN else self.by_bytes).get(raw)
                            if c:
                                steps.append((need, c, 3 if need == 4 else 1))
                            elif unknown and (other := self.strict(raw)):
                                steps.append((need, *other))
                    elif all(x is None or 0x80 <= x < 0xC0 for x in tail):
                        for raw, c in self.by_length[need]:
                            if raw[0] == b and all(x is None or x == raw[k + 1] for k, x in enumerate(tail)):
                                steps.append((need, c, 1))
            alive = sorted(beams[i].items(), key=lambda kv: -kv[1][0])[:_BEAM]
            for (last, word), (score, text, seqs) in alive:
                for width, c, multi in steps:
                    k, letter = m.of(c), c.isalpha()
                    over = 0.0 if letter else self.words(word)
                    put(i + width, (k, word + c.lower() if letter else ""), (score + float(m.log[last, k]) + over + _BONUS * multi, text + c, seqs + multi))
        end = [(s + float(m.log[last, m.space]) + self.words(word), t, q) for (last, word), (s, t, q) in beams[n].items() if q]
        if not end:
            return None
        best = max(end)
        return None if self.chance(best[1], unit) else (best[1], best[2])

    def pair(self, unit: str, read: str, written: str) -> str | None:
        back, _ = _charset(read)
        _, chars = _charset(written)
        out, changed = [], False
        for c in unit:
            if ord(c) < 0x80:
                out.append(c)
                continue
            b = back.get(c)
            if b is None:
                return None
            d = chars[b]
            if d not in self.m.known:
                return None
            changed |= d != c
            out.append(d)
        return "".join(out) if changed else None

    def wildcards(self, unit: str) -> list[str]:
        """Readings of a unit whose lost characters stood for one character each, best first."""
        m = self.m
        beam = [(0.0, m.space, "", "")]
        for c in unit:
            options = [(o, m.of(o), o.isalpha()) for o in (self.lost if c == LOST else [c])]
            nxt = [(s + float(m.log[last, k]) + (0.0 if letter else self.words(word)), k, t + o, word + o.lower() if letter else "") for s, last, t, word in beam for o, k, letter in options]
            nxt.sort(key=lambda x: -x[0])
            beam = nxt[:64]
        return [t for _, _, t in sorted(((s + float(m.log[k, m.space]) + self.words(word), k, t) for s, k, t, word in beam), reverse=True)[:24]]

    def readings(self, unit: str) -> list[tuple[str, str, float]]:
        """(kind, reading, gain): utf8, pair (needs known words) and lost (a damaged one, best guess)."""
        m = self.m
        base, out, seen = m.score(unit), [], set()
        now = unit
        for _ in range(_STEPS):
            best = None
            for w, unknown in [*((w, False) for w in READ_AS), *((w, True) for w in READ_AS if w in _WESTERN)]:
                if unknown and best and best[2]:
                    break
                got = self.utf8(now, w, unknown)
                if got and got[0] != now:
                    gain = m.score(got[0]) - m.score(now) + _BONUS * got[1]
                    if gain > _GAIN_UTF8 and (best is None or gain > best[0]):
                        best = (gain, got[0], not unknown)
            if not best:
                break
            now = best[1]
            if now not in seen:
                seen.add(now)
        if now != unit:
            out.append(("utf8", now, m.score(now) - base))
        if LOST in unit:
            for t in self.wildcards(now):
                out.append(("lost", t, m.score(t) - base))
        elif now == unit and sum(map(str.isalpha, unit)) >= 2:
            for read, written in PAIRS:
                t = self.pair(unit, read, written)
                if t and t not in seen:
                    seen.add(t)
                    gain = m.score(t) - base
                    if gain > _GAIN_PAIR:
                        out.append(("pair", t, gain))
        return out


_QUOTED = "`[^`\\n]*`"
_WORD = "\\p{L}+"


def units_of(texts: DataFrame) -> DataFrame:
    """(text_id, weight, unit): distinct runs without white space that hold a non-ASCII character or a numeric reference, outside backticks."""
    bare = F.regexp_replace("text", _QUOTED, " ")
    each = F.array_distinct(F.filter(F.split(bare, "[ \\t\\r\\n\\f\\u000b]+"), lambda u: u.rlike("[^\\x00-\\x7F]|" + _REFERENCE)))
    return texts.select("text_id", "weight", F.explode(each).alias("unit"))


def texts_of(documents: DataFrame) -> DataFrame:
    """(doc_id, text_id, text) of the documents that have a text; repeated texts share a text_id."""
    return documents.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", F.md5("text").alias("text_id"), "text")


def verdicts(spark: SparkSession, documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(text_id, weight, unit) of all suspects, and (unit, restored) of the damaged units; restored is null where it can't be told."""
    texts, _ = scratch.cut(texts_of(documents).groupBy("text_id").agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(_COPIES)).alias("weight")))
    units, _ = scratch.cut(units_of(texts))
    kinds = units.groupBy("unit").agg(F.sum("weight").alias("own"))
    table = bigrams_of(texts).toPandas()
    readable = F.lower(F.regexp_replace("text", _suspect().pattern, "ʘ"))  # a letter no text has: the rest of a garbled word is no word
    words, _ = scratch.cut(texts.select("weight", F.explode(F.array_distinct(F.regexp_extract_all(readable, F.lit(_WORD), F.lit(0)))).alias("word")).groupBy("word").agg(F.sum("weight").alias("df"), F.count("*").alias("texts")))
    slot = [F.struct(F.lit(i).alias("row"), (F.crc32(F.concat(F.lit(salt), "word").cast("binary")) % _SLOTS).cast("int").alias("slot")) for i, salt in enumerate(_SALTS)]
    sketch = words.filter("df >= 2").select("df", F.inline(F.array(*slot))).groupBy("row", "slot").agg(F.sum("df").alias("df")).toPandas()  # at most 2 * _SLOTS rows
    rows = np.zeros((len(_SALTS), _SLOTS), np.float32)
    rows[sketch["row"].to_numpy(np.int64), sketch["slot"].to_numpy(np.int64)] = sketch["df"].to_numpy(np.float32)
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.float64), rows))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, counts, frequencies = shared.value
        decoder = Decoder(Model(pairs, counts), Words(frequencies))
        for b in batches:
            out = [(u, plain, k, r, contract(r, u), g) for u in b["unit"] for plain in (expand(u),) for k, r, g in decoder.readings(plain)]
            yield pd.DataFrame(out, columns=["unit", "plain", "kind", "reading", "shown", "gain"])

    readings, _ = scratch.cut(kinds.select("unit").repartition("unit").mapInPandas(read, "unit string, plain string, kind string, reading string, shown string, gain double"))

    def known(column: str) -> DataFrame:
        """The rarest word of each distinct text, and its longest."""
        each = readings.select(F.col(column).alias("t")).distinct().select("t", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_WORD), F.lit(0)))).alias("word"))
        met = each.join(words, "word", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("df", "texts")})
        return met.groupBy("t").agg(F.min("df").alias("least"), F.max("df").alias("most"), F.max(F.when(F.length("word") >= 3, F.col("df"))).alias("longer"), F.min("texts").alias("texts"))

    # What the unit's own texts say for its words is no evidence that they are words: only the other texts count.
    was = known("plain").select(F.col("t").alias("plain"), F.col("least").alias("was_all"), F.col("texts").alias("was_texts"))
    now = known("reading").select(F.col("t").alias("reading"), "least", "longer", "texts")
    judged = readings.join(was, "plain", "left").join(kinds, "unit").join(now, "reading", "left")
    judged = judged.withColumn("least", F.coalesce("least", F.lit(0))).withColumn("was_least", F.greatest(F.coalesce("was_all", F.lit(0)) - F.col("own"), F.lit(0))).withColumn("was_texts", F.coalesce("was_texts", F.lit(0)))
    taken = judged.filter("kind = 'utf8' OR kind = 'lost' OR (kind = 'pair' AND least >= 3 AND longer IS NOT NULL AND least >= 5 * (was_least + 1) AND texts >= was_texts)")
    rank = F.when(F.col("kind") == "lost", F.log1p("least") * 3 + F.col("gain")).otherwise(F.log1p("least") + F.col("gain"))
    best = taken.groupBy("unit").agg(F.max_by("shown", F.struct(rank.alias("r"), F.col("shown"))).alias("restored"))
    lost = kinds.select("unit").filter(F.col("unit").rlike(LOST + "|&#(?:65533|[xX]0*[fF]{3}[dD]);"))
    told = lost.join(best, "unit", "left").select("unit", F.when(~F.col("restored").rlike(LOST + "|&#(?:65533|[xX]fffd);"), F.col("restored")).alias("restored"))
    return units, best.join(lost, "unit", "left_anti").unionAll(told)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a garbled passage outside of backticks."""
    scratch = Scratch(spark, "encoding")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    units, bad = verdicts(spark, documents, scratch)
    found = units.join(bad, "unit").select("text_id").distinct()
    return texts_of(documents).select("doc_id", "text_id").join(found, "text_id", "left_semi").select("doc_id").distinct()


def restored(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, text, restored_text, n_damaged, n_restored) of the affected documents.

    Null and empty texts are not affected; repeated texts under several ids each get their row. Examples
    between backticks stay as they are. A unit that can't be told stays as it is and doesn't count as restored.
    """
    scratch = Scratch(spark, "encoding")
    units, bad = verdicts(spark, documents, scratch)
    per = units.join(bad, "unit").groupBy("text_id").agg(F.collect_list(F.struct("unit", "restored")).alias("fixes"))
    docs = texts_of(documents).join(per, "text_id")

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quoted, gap = re.compile("(`[^`\n]*`)"), re.compile(r"([ \t\r\n\f\v]+)")
        for b in batches:
            rows = []
            for doc, text, fixes in zip(b["doc_id"], b["text"], b["fixes"]):
                to = {f["unit"]: f["restored"] for f in fixes}
                parts = []
                for part in quoted.split(text):
                    if part[:1] == "`" and part[-1:] == "`" and len(part) > 1:
                        parts.append(part)
                    else:
                        parts.append("".join(to.get(u) or u for u in gap.split(part)))
                rows.append((doc, text, "".join(parts), len(to), sum(v is not None for v in to.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "restored_text", "n_damaged", "n_restored"])

    return docs.mapInPandas(fix, "doc_id long, text string, restored_text string, n_damaged int, n_restored int")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their original text where it can be restored."""
    return restored(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
