"""File sources: groups of files, series, binary grids, tab-separated tables, presentation times."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of stored number types and numpy's little-endian types.
GRID_TYPES = {
    "double": "<f8", "single": "<f4", "int8": "<i1", "uint8": "<u1", "int16": "<i2", "uint16": "<u2",
    "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8", "logical": "<u1", "ubit1": "<u1",
}

#: Entries of a batch of a listing; bytes of a task that reads whole files, and of its batches.
LISTED_ROWS, TASK_BYTES, BATCH_BYTES = 10_000, 64 << 20, 8 << 20


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, folder, name, length, modified`` of all files below a folder, without their content; hidden ones are left out.

    Tasks list the folders, level by level, and write what they find to the shared folder, so no list of files passes
    through the driver. One task lists one folder.
    """
    from tessera.operators.graph import written

    tasks = spark.sparkContext.defaultParallelism
    level, found = spark.createDataFrame([(path.rstrip("/"),)], "at string"), []
    while True:
        entries = written(level.repartition(tasks).mapInArrow(_entries, "path string, folder string, name string, length long, modified timestamp, below boolean"))
        found.append(entries.where("NOT below").drop("below"))
        level = entries.where("below").select(F.col("path").alias("at"))
        if level.isEmpty():
            break
    named = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern()
    return reduce(lambda a, b: a.unionByName(b), found).where(F.col("name").rlike(f"^(?:{named})$"))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The visible files and folders of folders."""
    from .stored import opened

    schema = pa.schema([("path", pa.string()), ("folder", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("below", pa.bool_())])
    for batch in batches:
        for root in batch.column("at").to_pylist():
            store, at = opened(root)
            before = "file:" if at.startswith("/") else root[: len(root) - len(at)]
            # As Spark's readers do: names that begin with a point, or with a line that no "=" follows, are hidden.
            seen = [f for f in store.get_file_info(fs.FileSelector(at)) if not (f.base_name.startswith(".") or f.base_name.startswith("_") and "=" not in f.base_name)]
            for i in range(0, len(seen), LISTED_ROWS):
                rows = [
                    {"path": before + f.path, "folder": before + f.path.rpartition("/")[0], "name": f.base_name, "length": f.size, "modified": f.mtime, "below": f.type == fs.FileType.Directory}
                    for f in seen[i : i + LISTED_ROWS]
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, content`` of all files below a folder; hidden ones are left out. A file is read by one task, as one value."""
    files = listing(spark, path, pattern).select("path", "length")
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    return files.repartition(tasks).mapInArrow(_read, "path string, content binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files' bytes, in batches of some ``BATCH_BYTES``."""
    from .stored import opened

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    for batch in batches:
        rows, size = [], 0
        for path in batch.column("path").to_pylist():
            store, at = opened(path)
            with store.open_input_stream(at) as f:
                rows.append({"path": path, "content": f.read()})
            size += len(rows[-1]["content"])
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def glob_regex(pattern: str) -> str:
    """A file pattern as a regular expression: ``#`` and ``*`` stand for any text, ``?`` for one character."""
    return "^" + "".join({"#": ".*", "*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in pattern) + "$"


def first_pattern(name: Column, patterns: list[str]) -> Column:
    """The place of the first pattern that a name matches, by file pattern or else as a regular expression."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(patterns))):
        out = F.when(name.rlike(glob_regex(patterns[i])) | name.rlike(patterns[i].replace("#", ".*").replace("*", ".*").replace("..*", ".*")), i).otherwise(out)
    return out


def file_groups(files: DataFrame, patterns: list[str]) -> DataFrame:
    """``folder, files``: one group for each folder that has a file for every pattern, in the order of patterns and paths."""
    hit = files.withColumn("k", first_pattern(F.col("name"), patterns)).where("k is not null")
    listed = F.array_sort(F.collect_list(F.struct("k", "path")))
    groups = hit.groupBy("folder").agg(listed.alias("l"), F.countDistinct("k").alias("n"))
    return groups.where(F.col("n") == len(patterns)).select("folder", F.transform("l", lambda s: s["path"]).alias("files"))


def folder_epochs(files: DataFrame, base: str, patterns: list[str]) -> DataFrame:
    """File groups whose epoch is named by the first folder below ``base``."""
    rest = F.regexp_extract("path", f"^.*?{re.escape(base.strip('/'))}/([^/]+)/", 1)
    return file_groups(files.withColumn("folder", rest).where("folder <> ''"), patterns).withColumnRenamed("folder", "epoch_id")


def series_epochs(files: DataFrame, series: str, others: list[str]) -> DataFrame:
    """``folder, prefix, first_file, others``: files named by ``series``, whose ``#`` is the prefix; an epoch needs every
    other pattern with its prefix in the folder."""
    head, tail = series.split("#", 1)
    shape = "^" + "".join("\\" + c if not c.isalnum() else c for c in head) + "(.+?)" + glob_regex(tail)[1:]
    prefix = F.regexp_extract("name", shape, 1)
    out = files.withColumn("prefix", prefix).where("prefix <> ''").groupBy("folder", "prefix").agg(F.min("path").alias("first_file"))
    found = []
    for i, p in enumerate(others):
        before, after = (p.split("#", 1) + [""])[:2] if "#" in p else (None, None)
        if before is None:
            hit = files.where(F.col("name").rlike(glob_regex(p))).groupBy("folder").agg(F.min("path").alias(f"o{i}"))
            out = out.join(hit, "folder")
        else:
            ends = F.concat(F.lit(before), F.col("prefix"), F.lit(after))
            hit = files.select("folder", F.col("name").alias("__n"), F.col("path").alias("__p"))
            out = out.join(hit, "folder").where(F.startswith("__n", ends)).groupBy(*out.columns).agg(F.min("__p").alias(f"o{i}"))
        found.append(F.col(f"o{i}"))
    return out.select("folder", "prefix", "first_file", F.array(*found).cast("array<string>").alias("others"))


def reconcile(ingested: DataFrame, on_disk: DataFrame) -> DataFrame:
    """All epochs: those ingested, and those on disk that were not; ``source`` says which."""
    disk = on_disk.join(ingested.select("epoch_id"), "epoch_id", "left_anti")
    return ingested.withColumn("source", F.lit("ingested")).unionByName(disk.withColumn("source", F.lit("disk")), allowMissingColumns=True)


def files_of_name(names: DataFrame, epochs: DataFrame) -> DataFrame:
    """``filename, epoch_id`` where a name is part of one of the epoch's paths."""
    from tessera.operators.tables import containing

    each = epochs.select("epoch_id", F.explode("files").alias("path"))
    return containing(each, names, "path", "filename").select("filename", "epoch_id").distinct()


def read_grid(files: DataFrame, kind: str, shape: list[int]) -> DataFrame:
    """``path, dim, data`` of binary grid files (``path, content``); a size that does not fit ``shape`` is an error."""
    if kind not in GRID_TYPES:
        raise ValueError(f"unknown type: {kind}")
    dtype, size = np.dtype(GRID_TYPES[kind]), int(np.prod(shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for path, raw in zip(b["path"], b["content"]):
                if len(raw) != size * dtype.itemsize:
                    raise ValueError(f"{path}: {len(raw)} bytes, not {size} values of {kind}")
                data.append(np.frombuffer(raw, dtype).astype(float))
            yield pd.DataFrame({"path": b["path"], "dim": [list(shape)] * len(b), "data": data})

    return files.select("path", "content").mapInPandas(run, "path string, dim array<int>, data array<double>")


def grid_bytes(values: list, kind: str) -> bytes:
    """The bytes of a grid file."""
    return np.asarray(values).astype(GRID_TYPES[kind]).tobytes()


# Fixed values of the presentation-time format: the first line, and the bytes of the header.
HEADER_LINE, HEADER_BYTES = b"presentation_time structure\n", 512


def presentation_bytes(records: list[dict]) -> bytes:
    """A presentation-time file: the header line and the number of records in 512 bytes, then for each its clock and a line
    end, four times (open, onset, offset, close), the number of its events, and their times and then their codes."""
    out = [(HEADER_LINE + struct.pack("<Q", len(records))).ljust(HEADER_BYTES, b"\0")]
    for r in records:
        events = np.asarray(r["events"], dtype="<f8").reshape(-1, 2)
        out += [r["clock"].encode() + b"\n", struct.pack("<4dI", *r["times"], len(events)), events.T.tobytes()]
    return b"".join(out)


def presentation_records(raw: bytes, first: int = 1, last: int | None = None) -> list[tuple]:
    """``number, clock, times, events`` of the records ``first`` to ``last`` of a file."""
    if not raw.startswith(HEADER_LINE):
        raise ValueError("not a presentation-time file")
    (n,), at, rows = struct.unpack_from("<Q", raw, len(HEADER_LINE)), HEADER_BYTES, []
    for number in range(1, min(n, last or n) + 1):
        end = raw.index(b"\n", at)
        *times, events = struct.unpack_from("<4dI", raw, end + 1)
        if number >= first:
            flat = np.frombuffer(raw, "<f8", 2 * events, end + 37).reshape(2, events).T
            rows.append((number, raw[at:end].decode(), times, flat.tolist()))
        at = end + 37 + 16 * events
    return rows


def presentation_files(rows: DataFrame) -> DataFrame:
    """``path, content`` of rows ``path, records``, an array of structs ``clock, times, events``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = [presentation_bytes([{"clock": r["clock"], "times": r["times"], "events": [list(e) for e in r["events"]]} for r in each]) for each in b["records"]]
            yield pd.DataFrame({"path": b["path"], "content": content})

    return rows.select("path", "records").mapInPandas(run, "path string, content binary")


def read_presentation(files: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """``path, number, clock, times, events`` of the records ``first`` to ``last``, counted from 1; the end is clamped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *r) for path, raw in zip(b["path"], b["content"]) for r in presentation_records(raw, first, last)]
            yield pd.DataFrame(rows, columns=["path", "number", "clock", "times", "events"])

    return files.select("path", "content").mapInPandas(run, "path string, number int, clock string, times array<double>, events array<array<double>>")


def read_tab_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated table with a header: channel lists, probe maps, session tables and stimulus parameters."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, inferSchema=schema is None)


#: Columns of a probe map.
PROBE_MAP = "name string, reference long, type string, devicestring string, subjectstring string"


def read_probe_map(spark: SparkSession, path: str) -> DataFrame:
    """The probes of an epoch: name, reference, type, device string and subject."""
    return read_tab_table(spark, path, PROBE_MAP)


def write_tab_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def session_table(rows: DataFrame, order: str) -> DataFrame:
    """``session_id, path``: of several rows with one id the last counts."""
    last = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc(order)))
    return rows.withColumn("__n", last).where("__n = 1").select("session_id", "path")


def ingest_plan(documents: DataFrame) -> DataFrame:
    """``id, name, uid, location, action``: what the locations' flags ask for: copy, and delete the original."""
    kind = "array<struct<name:string,locations:array<struct<uid:string,location:string,ingest:boolean,delete_original:boolean>>>>"
    info = documents.select("id", F.explode(F.try_variant_get("body", "$.files.file_info", kind)).alias("i"))
    each = info.select("id", "i.name", F.explode("i.locations").alias("l"))
    actions = F.array_compact(F.array(F.when(F.col("l.ingest"), "copy"), F.when(F.col("l.delete_original"), "delete")))
    return each.select("id", "name", "l.uid", "l.location", F.explode(actions).alias("action"))
