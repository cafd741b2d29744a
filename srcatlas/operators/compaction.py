"""Consolidating very many small files into few well-sized ones (sorted-run consolidation).

1. Every task decodes its small files, drops what it has seen twice within a batch, sorts what is left
   and writes it: sorted runs in the shared folder, in small row groups whose statistics tell their keys.
2. A task merges up to FAN_IN runs for one key range: it opens a reader on each run, skips the row groups outside
   of the range, and a heap merges the readers row by row. With more runs than that, rounds of merges
   come first; each round divides the number of runs and the width of the ranges by up to FAN_IN.
3. The merge keeps duplicates side by side, of which the newest stays. A new output file begins when the bytes
   written reach the target.
4. Each output file's key range, rows and bytes are rows of a manifest, which alone says what the result is: files of
   tasks that were tried again are not in it. A later delivery merges only into the files whose range
   it touches; the others stay as they are, and so do their rows in the manifest.

Copies of one hot record shrink to one per batch before anything is written, so no range grows with them. The driver holds
paths of runs and a bounded sample of keys to cut ranges at.
"""

from __future__ import annotations

import heapq
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch

FAN_IN = 64  # runs one task merges
MOST_KEYS = 1_000_000  # sampled to cut ranges at
_BLOCK = 1 << 20  # bytes of a row group
RECORD = "file_id string, hash string, written_at timestamp_ntz, store_path string, record string"
_ARROW = pa.schema([("file_id", pa.string()), ("hash", pa.string()), ("written_at", pa.timestamp("us")), ("store_path", pa.string()), ("record", pa.string())])
MANIFEST = "range_no int, path string, first_id string, first_hash string, last_id string, last_hash string, n_records long, n_bytes long, file_bytes long"
_DECODER = json.JSONDecoder()


def _walk(value) -> Iterator[dict]:
    """Records at any depth of an envelope; a record is an object with a string id and hash."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("id"), str) and isinstance(v.get("hash"), str):
                yield v
            else:
                todo.extend(x for x in v.values() if isinstance(x, (dict, list)))
        elif isinstance(v, list):
            todo.extend(x for x in v if isinstance(x, (dict, list)))


def _complete(text: str) -> Iterator:
    """The complete objects of a body that isn't one JSON text: a line, or an element of a torn list."""
    at = 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
            yield value
            at = end
        except (ValueError, RecursionError):
            line = text.find("\n", at)
            inner = text.find("{", at + 1)
            # A torn line costs that line only; a torn outer object may hold complete records.
            at = inner if inner >= 0 else len(text)
            if line >= 0 and text[line + 1 : line + 2] == "{":
                at = min(at, line + 1)


def body_records(body: str | None) -> list[dict]:
    """The complete records of a body. Null, empty and torn bodies give what stands complete in them."""
    if not body or not body.strip():
        return []
    try:
        values = [_DECODER.decode(body.lstrip("﻿"))]
    except (ValueError, RecursionError):
        values = _complete(body)
    return [r for v in values for r in _walk(v)]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, body, at in zip(b["store_path"], b["body"], b["written_at"]):
            for r in body_records(body):
                rows.append((r["id"], r["hash"].lower(), at, path, json.dumps(r, ensure_ascii=False, sort_keys=True)))
        out = pd.DataFrame(rows, columns=["file_id", "hash", "written_at", "store_path", "record"])
        out = out.sort_values(["written_at", "store_path"], ascending=False, na_position="last", kind="stable")
        yield out.drop_duplicates(["file_id", "hash"])


def _slice(path: str, low: str | None, high: str | None) -> Iterator[tuple]:
    """Rows of a sorted file with low <= file_id < high, in order; one batch is held at a time."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        file = pq.ParquetFile(f)
        at = file.schema_arrow.get_field_index("file_id")
        groups = []
        for i in range(file.num_row_groups):
            stats = file.metadata.row_group(i).column(at).statistics
            known = stats is not None and stats.has_min_max
            if not known or (low is None or stats.max >= low) and (high is None or stats.min < high):
                groups.append(i)
        for batch in file.iter_batches(4096, row_groups=groups, columns=_ARROW.names) if groups else ():
            columns = [c.to_pylist() for c in batch.columns]
            first = 0 if low is None else bisect_left(columns[0], low)
            last = len(columns[0]) if high is None else bisect_left(columns[0], high)
            yield from zip(*(c[first:last] for c in columns))


def _newest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of neighbours with the same key the newest; a null age is the oldest, ties go to the greater path."""
    best = None
    for r in rows:
        if best is None or r[:2] != best[:2]:
            if best is not None:
                yield best
            best = r
        elif ((r[2] is not None, r[2]), r[3] or "") > ((best[2] is not None, best[2]), best[3] or ""):
            best = r
    if best is not None:
        yield best


class _Output:
    """Files of one range: rows are gathered to row groups, and a file is closed once its written bytes reach the target."""

    def __init__(self, folder: str, no: int, target: int):
        self.folder, self.no, self.target, self.done = folder, no, target, []
        self.rows, self.size, self.writer = [], 0, None

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[4]) + 64
        if self.size >= _BLOCK or self.size >= self.target:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        if self.writer is None:
            path = f"{self.folder}/{uuid.uuid4().hex}.parquet"
            system, name = fs.FileSystem.from_uri(path)
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            self.sink = system.open_output_stream(name)
            self.writer = pq.ParquetWriter(self.sink, _ARROW, compression="snappy")
            self.about = [self.no, path, *self.rows[0][:2], None, None, 0, 0, 0]
        self.writer.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), _ARROW.types)], schema=_ARROW), row_group_size=len(self.rows))
        self.about[4:6] = self.rows[-1][:2]
        self.about[6] += len(self.rows)
        self.about[7] += sum(len(r[4].encode()) for r in self.rows)
        self.rows, self.size = [], 0
        if self.sink.tell() >= self.target:
            self.close()

    def close(self) -> None:
        self.flush()
        if self.writer is not None:
            self.writer.close()
            self.about[8] = self.sink.tell()
            self.sink.close()
            self.done.append(tuple(self.about))
            self.writer = None


def _merge(spark: SparkSession, scratch: Scratch, tasks: list[tuple], folder: str, target: int) -> list:
    """tasks (range_no, low, high, paths): what each wrote, as rows of a manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for no, low, high, paths in zip(b["range_no"], b["low"], b["high"], b["paths"]):
                out = _Output(folder, int(no), target)
                for row in _newest(heapq.merge(*(_slice(p, low, high) for p in paths), key=lambda r: r[:2])):
                    out.add(row)
                out.close()
                yield pd.DataFrame(out.done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    asked = spark.createDataFrame(tasks, "range_no int, low string, high string, paths array<string>").repartition(len(tasks))
    return scratch.cut(asked.mapInPandas(run, MANIFEST))[0].orderBy("range_no", "first_id", "first_hash").collect()


def _cuts(keys: list[str], low: str | None, high: str | None, parts: int) -> list[tuple]:
    """The range from low to high in up to `parts` parts with about as many of the sampled keys each."""
    mine = keys[0 if low is None else bisect_left(keys, low) : len(keys) if high is None else bisect_left(keys, high)]
    at = sorted({mine[len(mine) * i // parts] for i in range(1, parts)} - {low}) if mine and parts > 1 else []
    return list(zip([low, *at], [*at, high]))


def consolidate(spark: SparkSession, small: DataFrame, target_bytes: int = 128 << 20, existing: DataFrame | None = None, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(records, manifest) of the small files (store_path, body, written_at), merged into those of an existing manifest if one is given.

    records: file_id, hash, written_at, store_path, record - every distinct (file_id, hash) once, the newest copy;
    sorted by key within an output file. manifest: one row per output file with its path, first and last key, rows, bytes of
    the records and of the file. Null, empty and torn bodies add what stands complete in them; ties in age
    go to the greater path; an empty table gives two empty results.
    """
    scratch = Scratch(spark, "consolidate")
    folder = scratch.root if "://" in scratch.root else "file://" + scratch.root.removeprefix("file:")
    small = small.select("store_path", "body", F.col("written_at").cast("timestamp_ntz").alias("written_at"))
    runs_path = f"{scratch.root}/runs"
    small.mapInPandas(_decode, RECORD).sortWithinPartitions("file_id", "hash").write.option("parquet.block.size", _BLOCK).parquet(runs_path)
    runs = spark.read.schema(RECORD).parquet(runs_path)
    paths = sorted(runs.inputFiles())
    size, n = runs.agg(F.sum(F.length("record")), F.count("*")).first()
    old = sorted(existing.collect(), key=lambda r: (r["first_id"], r["first_hash"])) if existing is not None else []
    if not n:
        paths = []
    parts = max(1, -(-(size or 0) // target_bytes), min(spark.sparkContext.defaultParallelism, (size or 0) // _BLOCK))
    share = min(1.0, 20 * parts / max(1, n), MOST_KEYS / max(1, n))
    keys = sorted(r[0] for r in runs.select("file_id").sample(share, 7).collect()) if parts > 1 or old else []
    # Shelves: (low, high, sorted runs of that range). An existing file is one more run of its range, up to where the next begins.
    shelves = [(None, None, paths)]
    while max(len(s[2]) for s in shelves) > fan_in:
        tasks, spans = [], []
        for low, high, files in shelves:
            for a, b in _cuts(keys, low, high, fan_in):
                spans.append((a, b))
                tasks += [(len(spans) - 1, a, b, files[i : i + fan_in]) for i in range(0, len(files), fan_in)]
        made = _merge(spark, scratch, tasks, f"{folder}/round", 1 << 62)
        shelves = [(a, b, [r["path"] for r in made if r["range_no"] == i]) for i, (a, b) in enumerate(spans)]
    kept, tasks = [], []
    if old:
        # An id may go on in the next file; files that share an id are one range.
        groups: list[list] = []
        for r in old:
            if groups and groups[-1][-1]["last_id"] == r["first_id"]:
                groups[-1].append(r)
            else:
                groups.append([r])
        edges = [None, *(g[0]["first_id"] for g in groups[1:]), None]
        inner = edges[1:-1]

        def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"i": sorted({bisect_right(inner, x) for x in b["file_id"]})})

        touched = {r["i"] for r in runs.select("file_id").mapInPandas(ranges, "i int").distinct().collect()}
        for i, g in enumerate(groups):
            if i not in touched:
                kept += g
                continue
            for low, high, files in shelves:
                a, b = max(filter(None, (low, edges[i])), default=None), min(filter(None, (high, edges[i + 1])), default=None)
                if a is None or b is None or a < b:
                    tasks.append((len(tasks), a, b, [*[r["path"] for r in g], *files]))
    else:
        for low, high, files in shelves:
            if files:
                want = max(1, round(parts / len(shelves)))
                tasks += [(len(tasks) + i, a, b, files) for i, (a, b) in enumerate(_cuts(keys, low, high, want))]
    made = _merge(spark, scratch, tasks, f"{folder}/consolidated", target_bytes) if tasks else []
    rows = sorted([tuple(r) for r in [*made, *kept]], key=lambda r: (r[2], r[3]))
    manifest, _ = scratch.cut(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], MANIFEST).coalesce(1))
    scratch.drop(runs_path, f"{scratch.root}/round")
    records = spark.read.schema(RECORD).parquet(*[r[1] for r in rows]) if rows else spark.createDataFrame([], RECORD)
    return records, manifest


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct complete record of the map store, read from the consolidated files."""
    records, _ = consolidate(spark, spark.read.parquet(f"{sf_dir}/record_files.parquet"))
    return records.select("file_id", "hash")


def p5_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key range, rows and bytes of every consolidated file."""
    _, manifest = consolidate(spark, spark.read.parquet(f"{sf_dir}/record_files.parquet"))
    return manifest.select("range_no", "first_id", "first_hash", "last_id", "last_hash", "n_records", "n_bytes", "file_bytes")
