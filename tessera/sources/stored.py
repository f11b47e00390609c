"""Files through Spark's data source interface: whole files, n-dimensional grids and sampled recordings.

Tasks write files under hidden names and rename each one when it is complete, so no file is ever seen half written. What a
job wrote is listed in ``_manifest``, one hidden part a task; the commit makes the parts visible, an abort removes the files
they list. A task that ends after the abort may leave files; no reader sees them, and :func:`sweep` deletes them. Readers go by the manifest, so they see a job's files all together or not at all, and a rerun replaces them.
Readers make one partition for each byte range of a large file and one for many small files, and skip files by their manifest
entries.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import prod
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)

from .files import GRID_TYPES

MANIFEST = "_manifest"
#: Bytes of a file that one partition reads, and values of an Arrow batch.
SPLIT_BYTES, BATCH_VALUES = 64 << 20, 1 << 17
#: What a file counts for beside its bytes where many small ones make a partition, and the values of a batch of small files.
OPEN_BYTES, SMALL_BATCH = 64 << 10, 1 << 14
COPY_BYTES = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def below(root: str, path: str) -> str:
    """``path`` below ``root``; one that leads elsewhere is an error."""
    parts = PurePosixPath(path).parts
    if not parts or path.startswith("/") or ".." in parts or parts[0] == MANIFEST:
        raise ValueError(f"not a path below the folder: {path!r}")
    return f"{root.rstrip('/')}/{path}"


def hidden(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex}"


def copy_file(source: str, target: str) -> int:
    """Copy a file under a hidden name and rename it; the number of its bytes."""
    there, at = opened(source)
    here, to = opened(target)
    here.create_dir(to.rpartition("/")[0], recursive=True)
    temp, size = hidden(to), 0
    try:
        with there.open_input_stream(at) as a, here.open_output_stream(temp) as b:
            while block := a.read(COPY_BYTES):
                b.write(block)
                size += len(block)
        here.move(temp, to)
    except BaseException:
        drop_file(here, temp)
        raise
    return size


def drop_file(store: fs.FileSystem, path: str) -> bool:
    """Delete a file; whether it was there."""
    if store.get_file_info(path).type != fs.FileType.File:
        return False
    store.delete_file(path)
    return True


@dataclass
class Written(WriterCommitMessage):
    """A task's hidden part of the manifest."""

    part: str | None


class _Job:
    """What the writers share: complete files only, a manifest part a task, commit and abort."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def note(self, entries: list[dict]) -> Written:
        if not entries:
            return Written(None)
        store, root = opened(self.root)
        task = TaskContext.get()
        store.create_dir(f"{root}/{MANIFEST}", recursive=True)
        part = f"{root}/{MANIFEST}/.{self.job}-{task.partitionId()}-{task.taskAttemptId()}"
        with store.open_output_stream(part) as out:
            out.write("".join(json.dumps(e) + "\n" for e in entries).encode())
        return Written(part)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.root)
        store.create_dir(f"{root}/{MANIFEST}", recursive=True)
        parts = [m.part for m in messages if m is not None and m.part]
        if self.overwrite:
            before = _parts(store, root)
            mine = {e["path"] for p in parts for e in _lines(store, p)} if before else set()
            for old in before:
                for e in _lines(store, old):
                    if e["path"] not in mine:
                        drop_file(store, f"{root}/{e['path']}")
                store.delete_file(old)
        for p in parts:
            folder, _, name = p.rpartition("/")
            store.move(p, f"{folder}/{name[1:]}.jsonl")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.root)
        for m in messages:
            if m is not None and m.part and store.get_file_info(m.part).type == fs.FileType.File:
                for e in _lines(store, m.part):
                    if not e.get("replaced"):
                        drop_file(store, f"{root}/{e['path']}")
                store.delete_file(m.part)


def _parts(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".jsonl"))


def _lines(store: fs.FileSystem, path: str) -> list[dict]:
    with store.open_input_stream(path) as f:
        return [json.loads(x) for x in f.read().splitlines()]


def _placed(store: fs.FileSystem, path: str) -> Iterator[tuple[int, int, dict]]:
    """The entries of a manifest part with the bytes that each one's line takes."""
    at = 0
    with store.open_input_stream(path) as f:
        for line in f.read().splitlines(keepends=True):
            yield at, at + len(line), json.loads(line)
            at += len(line)


def sweep(root: str) -> int:
    """Delete what a failed job's tasks left that ended after its abort: hidden files, and files of hidden manifest parts that no
    other part lists. Not to be called while a job writes to the folder. Returns the number of files deleted."""
    store, at = opened(root)
    known, gone = set(manifest(root)), 0
    for f in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File and f.base_name.startswith("."):
            if f.path.rpartition("/")[0].endswith(f"/{MANIFEST}"):
                gone += sum(drop_file(store, f"{at}/{e['path']}") for e in _lines(store, f.path) if e["path"] not in known)
            gone += drop_file(store, f.path)
    return gone


def manifest(root: str) -> dict[str, dict]:
    """The entries of a folder by path; of several jobs that wrote a path, any one's entry."""
    store, at = opened(root)
    return {e["path"]: e for p in _parts(store, at) for e in _lines(store, p)}


class _FilesWriter(_Job, DataSourceWriter):
    def write(self, iterator: Iterator) -> Written:
        store, root = opened(self.root)
        entries, temp = [], None
        try:
            for row in iterator:
                row = row.asDict(recursive=True)
                path, content, source = row.pop("path"), row.pop("content", None), row.pop("source", None)
                target = below(root, path)
                replaced = store.get_file_info(target).type == fs.FileType.File
                if content is None and source is not None:
                    size = copy_file(source, target if "://" not in self.root else f"{self.root.rstrip('/')}/{path}")
                else:
                    content = bytes(content or b"")
                    store.create_dir(target.rpartition("/")[0], recursive=True)
                    temp = hidden(target)
                    with store.open_output_stream(temp) as out:
                        out.write(content)
                    store.move(temp, target)
                    size = len(content)
                entries.append({"path": path, "size": size, "replaced": replaced, **row})
        except BaseException:
            # What this attempt completed goes too: the job fails, or another attempt writes it again.
            for e in entries:
                if not e["replaced"]:
                    drop_file(store, f"{root}/{e['path']}")
            if temp:
                drop_file(store, temp)
            raise
        return self.note(entries)


class WholeFiles(DataSource):
    """Sink ``whole_files``: rows ``path, content`` (or ``source``, a file to copy), paths relative to the folder.

    Further columns go into the manifest. No reader: :func:`stored_files` reads the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"], overwrite)


@dataclass
class ByteRange(InputPartition):
    """Values ``first`` to ``last`` of a file."""

    entry: dict
    first: int
    last: int


@dataclass
class Lines(InputPartition):
    """Bytes ``first`` to ``last`` of a part of the manifest: small files that one task reads whole."""

    part: str
    first: int
    last: int


def _kind(entry: dict) -> np.dtype:
    if entry.get("data_type") not in GRID_TYPES:
        raise ValueError(f"{entry['path']}: unknown type {entry.get('data_type')!r}")
    return np.dtype(GRID_TYPES[entry["data_type"]])


def _read_values(root: str, part: ByteRange) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of values with the place of their first one."""
    store, at = opened(root)
    dtype = _kind(part.entry)
    with store.open_input_file(f"{at}/{part.entry['path']}") as f:
        for i in range(part.first, part.last, BATCH_VALUES):
            n = min(BATCH_VALUES, part.last - i)
            yield i, np.frombuffer(f.read_at(n * dtype.itemsize, i * dtype.itemsize), dtype).astype(np.float64)


class _Ranges(DataSourceReader):
    """Partitions are byte ranges of large files, and lines of the manifest that list small ones, which tasks look up there; so the
    driver holds eight bytes a file, and few partitions. Filters on columns that the manifest knows skip files and are checked
    by Spark again."""

    def __init__(self, options: dict):
        self.root, self.split, self.tasks = options["path"], int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("tasks", 1))
        self.wanted: dict[str, set] = {}
        self.least, self.most = 0, None
        self.named = "path"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo) and name in (self.named, "channel"):
                self.wanted[name] = self.wanted.get(name, {f.value}) & {f.value}
            elif isinstance(f, In) and name in (self.named, "channel"):
                self.wanted[name] = self.wanted.get(name, set(f.value)) & set(f.value)
            elif name == "sample_idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    most = int(f.value) - isinstance(f, LessThan)
                    self.most = most if self.most is None else min(self.most, most)
            yield f

    def asked(self, entry: dict) -> bool:
        return self.named not in self.wanted or entry[self.named] in self.wanted[self.named]

    def partitions(self) -> list[InputPartition]:
        store, at = opened(self.root)
        parts, hashes, total = _parts(store, at), array("q"), 0
        for part in parts:
            for _, _, e in _placed(store, part):
                hashes.append(hash(e["path"]))
                if self.asked(e):
                    total += OPEN_BYTES + sum(last - first for first, last in self.ranges(e)) * _kind(e).itemsize
        most = min(self.split, max(OPEN_BYTES, total // self.tasks))
        known = np.sort(np.frombuffer(hashes, np.int64))
        twice = set(known[1:][known[1:] == known[:-1]].tolist())
        # Of entries with one path, that of the last counts.
        last_of = {e["path"]: (part, first) for part in parts for first, _, e in _placed(store, part) if hash(e["path"]) in twice} if twice else {}
        out: list[InputPartition] = []
        for part in parts:
            group, cost = None, 0
            for first, last, e in _placed(store, part):
                ranges = self.ranges(e) if self.asked(e) else []
                if last_of.get(e["path"], (part, first)) != (part, first):
                    group = None
                elif len(ranges) > 1:
                    group = None
                    out += [ByteRange(e, a, b) for a, b in ranges]
                elif ranges:
                    mine = OPEN_BYTES + (ranges[0][1] - ranges[0][0]) * _kind(e).itemsize
                    if group is None or cost + mine > most:
                        group, cost = Lines(part, first, last), 0
                        out.append(group)
                    group.last, cost = last, cost + mine
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, ByteRange):
            yield from self.values(partition)
            return
        store, _ = opened(self.root)
        with store.open_input_file(partition.part) as f:
            lines = f.read_at(partition.last - partition.first, partition.first).splitlines()
        held, n = [], 0
        for e in filter(self.asked, map(json.loads, lines)):
            for first, last in self.ranges(e):
                for batch in self.values(ByteRange(e, first, last)):
                    held.append(batch)
                    n += batch.num_rows
                    if n >= SMALL_BATCH:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _GridReader(_Ranges):
    def ranges(self, e: dict) -> list[tuple[int, int]]:
        n, each = prod(e["data_dim"]), max(1, self.split // _kind(e).itemsize)
        if n * _kind(e).itemsize != e["size"]:
            raise ValueError(f"{e['path']}: {e['size']} bytes, not {n} values of {e['data_type']}")
        return [(i, min(i + each, n)) for i in range(0, n, each)]

    def values(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        for at, values in _read_values(self.root, partition):
            columns = [pa.array([partition.entry["path"]] * len(values)), pa.array(np.arange(at, at + len(values))), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "position", "value"])


class Grids(DataSource):
    """Source ``grid``: the values of grid files that ``whole_files`` wrote with ``data_type`` and ``data_dim``, by position."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return "path string, position long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _GridReader(self.options)


class _RecordingReader(_Ranges):
    def __init__(self, options: dict):
        super().__init__(options)
        self.named = "epoch_id"

    def ranges(self, e: dict) -> list[tuple[int, int]]:
        wide = len(e["channels"])
        first, last = max(self.least, e["first"]), e["first"] + e["n"] - 1
        last = last if self.most is None else min(last, self.most)
        each = max(1, self.split // (wide * _kind(e).itemsize))
        return [((i - e["first"]) * wide, (min(i + each - 1, last) - e["first"] + 1) * wide) for i in range(first, last + 1, each)]

    def values(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        e = partition.entry
        wide = len(e["channels"])
        names = np.array(e["channels"], dtype=object)
        keep = np.isin(names, list(self.wanted["channel"])) if "channel" in self.wanted else np.ones(wide, bool)
        for at, values in _read_values(self.root, partition):
            place = np.arange(at, at + len(values))
            mine = keep[place % wide]
            place, values = place[mine], values[mine]
            columns = [
                pa.array([e["epoch_id"]] * len(values), pa.string()), pa.array(names[place % wide], pa.string()),
                pa.array(e["first"] + place // wide), pa.array(values / e["multiplier"] if e["multiplier"] != 1 else values),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["epoch_id", "channel", "sample_idx", "value"])


class _RecordingWriter(_Job, DataSourceArrowWriter):
    """Rows come ordered by epoch, segment, sample and channel; values go straight into the segment's file."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.kind, self.multiplier = options.get("kind", "double"), float(options.get("multiplier", 1.0))
        self.dtype = np.dtype(GRID_TYPES[self.kind])

    def stored(self, values: np.ndarray) -> bytes:
        """Scaled and cast: towards zero and within the type's range if it holds whole numbers."""
        values = values * self.multiplier
        if self.dtype.kind != "f":
            info = np.iinfo(self.dtype)
            values = np.clip(np.trunc(values), info.min, info.max)
        return values.astype(self.dtype).tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.root)
        entries, current, out = [], None, None

        def close() -> None:
            nonlocal out
            if out is None:
                return
            out.close()
            out = None
            e = current
            wide = len(e["channels"])
            if e["seen"] % wide:
                raise ValueError(f"epoch {e['epoch_id']}: sample {e['first'] + e['seen'] // wide} lacks a channel")
            temp = e.pop("temp")
            e["n"], e["size"] = e.pop("seen") // wide, e["bytes"]
            del e["bytes"], e["segment"]
            e["replaced"] = store.get_file_info(f"{root}/{e['path']}").type == fs.FileType.File
            store.move(temp, f"{root}/{e['path']}")
            entries.append(e)

        def segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            epoch, number = batch.column("epoch_id"), batch.column("segment")
            e = epoch.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((np.diff(number.to_numpy()) != 0) | (np.diff(e) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                if b > a:
                    yield batch.slice(a, b - a)

        try:
            for batch in iterator:
                for part in segments(batch):
                    epoch, segment = part.column("epoch_id")[0].as_py(), part.column("segment")[0].as_py()
                    if current is None or out is None or (epoch, segment) != (current["epoch_id"], current["segment"]):
                        close()
                        path = f"{epoch}/{segment}.dat"
                        folder = below(root, path).rpartition("/")[0]
                        store.create_dir(folder, recursive=True)
                        temp = hidden(below(root, path))
                        channels = part.column("channels")[0].as_py()
                        current = {"path": path, "epoch_id": epoch, "segment": segment, "channels": channels, "first": part.column("sample_idx")[0].as_py()}
                        current |= {"data_type": self.kind, "multiplier": self.multiplier, "seen": 0, "bytes": 0, "temp": temp}
                        out = store.open_output_stream(temp)
                    wide = len(current["channels"])
                    place = np.arange(current["seen"], current["seen"] + part.num_rows)
                    want = np.array(current["channels"], dtype=object)[place % wide]
                    right = (part.column("sample_idx").to_numpy() == current["first"] + place // wide) & (np.array(part.column("channel").to_pylist(), dtype=object) == want)
                    if not right.all():
                        raise ValueError(f"epoch {epoch}: sample {current['first'] + place[~right][0] // wide} is missing, lacks a channel, or comes twice")
                    raw = self.stored(part.column("value").to_numpy(zero_copy_only=False))
                    out.write(raw)
                    current["seen"] += part.num_rows
                    current["bytes"] += len(raw)
            close()
        except BaseException:
            if out is not None:
                out.close()
            if current is not None and "temp" in current:
                drop_file(store, current["temp"])
            for e in entries:
                if not e["replaced"]:
                    drop_file(store, f"{root}/{e['path']}")
            raise
        return self.note(entries)


class Recordings(DataSource):
    """Source and sink ``recording``: samples of epochs, a file for each segment, interleaved by channel."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return "epoch_id string, channel string, sample_idx long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _RecordingReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RecordingWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``whole_files``, ``grid`` and ``recording`` known, and let filters reach readers in this session."""
    for source in (WholeFiles, Grids, Recordings):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_files(files: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write rows ``path, content`` (or ``path, source``) as files of the folder; see :class:`WholeFiles`."""
    register(files.sparkSession)
    files.write.format("whole_files").mode(mode).save(folder)


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size`` of the files of the folder, from its manifest."""
    return spark.read.schema("path string, size long").json(f"{folder}/{MANIFEST}/*.jsonl").distinct()


def write_grids(grids: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write rows ``path, data, data_type, data_dim`` as binary grids; an array that its shape does not fit is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for row in batch.to_pylist():
                if len(row["data"]) != prod(row["data_dim"]):
                    raise ValueError(f"{row['path']}: {len(row['data'])} values, not {row['data_dim']}")
                content.append(np.array(row["data"]).astype(_kind(row)).tobytes())
            columns = [batch.column("path"), pa.array(content, pa.binary()), batch.column("data_type"), batch.column("data_dim")]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "content", "data_type", "data_dim"])

    rows = grids.select("path", F.col("data").cast("array<double>"), "data_type", F.col("data_dim").cast("array<long>"))
    write_files(rows.mapInArrow(run, "path string, content binary, data_type string, data_dim array<long>"), folder, mode)


def read_grids(spark: SparkSession, folder: str) -> DataFrame:
    """``path, position, value`` of the grids of a folder, each of its own type and shape, in row-major order."""
    register(spark)
    return spark.read.format("grid").option("tasks", spark.sparkContext.defaultParallelism).load(folder)


#: Samples of a segment, the file of a recording.
SEGMENT = 1 << 16


def write_recording(samples: DataFrame, folder: str, kind: str = "double", multiplier: float = 1.0, segment: int = SEGMENT, mode: str = "overwrite") -> None:
    """Write ``epoch_id, channel, sample_idx, value`` as binary files of ``segment`` samples, interleaved by channel.

    Values are multiplied and cast to ``kind``: whole-number types cut towards zero and clamp. A file's channels are the
    epoch's, in order; a sample that lacks one, a gap, or a sample that comes twice is an error, and the job leaves no file.
    """
    if kind not in GRID_TYPES:
        raise ValueError(f"unknown type: {kind}")
    register(samples.sparkSession)
    names = samples.groupBy("epoch_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    rows = samples.select(F.col("epoch_id").cast("string").alias("epoch_id"), "channel", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("value").cast("double").alias("value"))
    named = rows.join(names.withColumn("epoch_id", F.col("epoch_id").cast("string")), "epoch_id").withColumn("segment", F.floor(F.col("sample_idx") / segment))
    ordered = named.repartition("epoch_id", "segment").sortWithinPartitions("epoch_id", "segment", "sample_idx", "channel")
    ordered.write.format("recording").option("kind", kind).option("multiplier", multiplier).mode(mode).save(folder)


def read_recording(spark: SparkSession, folder: str) -> DataFrame:
    """``epoch_id, channel, sample_idx, value``; filters on epoch, channel and sample skip files and byte ranges."""
    register(spark)
    return spark.read.format("recording").option("tasks", spark.sparkContext.defaultParallelism).load(folder)


def recording_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``epoch_id, samples, channels, multiplier, data_type`` of each epoch of a recording."""
    kind = "path string, epoch_id string, n long, channels array<string>, multiplier double, data_type string"
    rows = spark.read.schema(kind).json(f"{folder}/{MANIFEST}/*.jsonl").distinct()
    return rows.groupBy("epoch_id").agg(
        F.sum("n").alias("samples"), F.max(F.size("channels")).alias("channels"), F.max("multiplier").alias("multiplier"), F.max("data_type").alias("data_type")
    )


# --- Attachments: plans of copies and deletions, carried out by the executors ---

DONE = "id string, uid string, action string, path string, done boolean, error string"


def expel_plan(documents: DataFrame, folder: str) -> DataFrame:
    """``id, uid, action, path``: the ingested files to delete when the documents go."""
    kind = "array<struct<locations:array<struct<uid:string,ingest:boolean>>>>"
    info = documents.select("id", F.explode(F.try_variant_get("body", "$.files.file_info", kind)).alias("i"))
    each = info.select("id", F.explode("i.locations").alias("l")).where("l.ingest AND coalesce(l.uid, '') <> ''")
    return each.select("id", F.col("l.uid").alias("uid"), F.lit("delete").alias("action"), F.concat(F.lit(f"{folder.rstrip('/')}/"), "l.uid").alias("path"))


def carry_out(plan: DataFrame, folder: str) -> DataFrame:
    """Copy or delete files as a plan (``id, uid, action, path``) says; ``done`` and ``error`` say what came of each row.

    ``copy`` brings ``path`` to ``folder/uid``, and leaves a target of the same size as it is; ``delete`` removes ``path``,
    and finds one that is gone done. So a plan can be run again, wholly or in part. Every action is the result's
    evaluation: write it once.
    """

    def act(uid: str, action: str, path: str) -> None:
        store, at = opened(path)
        if action == "delete":
            drop_file(store, at)
            return
        target = f"{folder.rstrip('/')}/{uid}"
        there, to = opened(target)
        source, now = store.get_file_info(at), there.get_file_info(to)
        if source.type != fs.FileType.File:
            raise FileNotFoundError(path)
        if now.type != fs.FileType.File or now.size != source.size:
            copy_file(path, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                try:
                    act(r["uid"], r["action"], r["path"])
                    r |= {"done": True, "error": None}
                except OSError as e:
                    r |= {"done": False, "error": str(e)}
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(n, pa.bool_() if n == "done" else pa.string()) for n in ("id", "uid", "action", "path", "done", "error")])
    return plan.select("id", "uid", "action", "path").mapInArrow(run, DONE)


def ingest(plan: DataFrame, folder: str, report) -> DataFrame:
    """Carry out a plan's copies, and its deletions only where all copies were made; otherwise take the new copies back.

    ``report`` writes a DataFrame and reads it back, so that each action runs once. A failed ingest leaves the sources
    as they were and none of its copies in ``folder``; copies that were there before stay.
    """
    there = plan.where("action = 'copy'")
    before = report(carried_before(there, folder))
    copies = report(carry_out(there, folder))
    if copies.where("NOT done").isEmpty():
        return copies.unionByName(report(carry_out(plan.where("action = 'delete'"), folder)))
    new = copies.where("done").join(before.where("there").select("uid"), "uid", "left_anti")
    target = F.concat(F.lit(f"{folder.rstrip('/')}/"), "uid")
    report(carry_out(new.select("id", "uid", F.lit("delete").alias("action"), target.alias("path")), folder))
    return copies.withColumn("done", F.lit(False)).withColumn("error", F.coalesce("error", F.lit("rolled back")))


def carried_before(copies: DataFrame, folder: str) -> DataFrame:
    """``uid, there``: whether the target of each copy exists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened(folder)
        for batch in batches:
            uids = batch.column("uid").to_pylist()
            there = [i.type == fs.FileType.File for i in store.get_file_info([f"{at.rstrip('/')}/{u}" for u in uids])]
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.string()), pa.array(there, pa.bool_())], names=["uid", "there"])

    return copies.select("uid").mapInArrow(run, "uid string, there boolean")


def document_files(documents: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Rows for :func:`write_files`: ``<id>/document.json`` of each document, and its attachments (``id, name, source``) beside it."""
    from tessera.operators.store import to_json

    texts = to_json(documents).select(F.concat("id", F.lit("/document.json")).alias("path"), F.col("json").cast("binary").alias("content"), F.lit(None).cast("string").alias("source"))
    if attachments is None:
        return texts
    files = attachments.join(documents.select("id"), "id", "left_semi")
    return texts.unionByName(files.select(F.concat("id", F.lit("/"), "name").alias("path"), F.lit(None).cast("binary").alias("content"), "source"))
