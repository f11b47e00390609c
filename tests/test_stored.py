"""Files that tasks write and read: complete or absent, skipped by filters, copied and taken back."""

import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.graph import written
from tessera.sources import files, stored


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def data_files(root):
    return [f for f in tree(root) if not f.startswith("_manifest")]


@pytest.fixture
def samples(spark):
    rows = [(e, c, i, float(i * 10 + k)) for e in ("a", "b c") for i in range(20) for k, c in enumerate(("ai1", "ai10", "ai2"))]
    return spark.createDataFrame(rows, "epoch_id string, channel string, sample_idx long, value double")


def test_recording_round_trip_and_bytes(spark, samples, tmp_path):
    stored.write_recording(samples, str(tmp_path), "int16", 2.0, segment=8)
    assert data_files(tmp_path) == [f"{e}/{k}.dat" for e in ("a", "b c") for k in (0, 1, 2)]
    want = np.array([[2 * (i * 10 + k) for k in range(3)] for i in range(8, 16)], "<i2").tobytes()
    assert (tmp_path / "a" / "1.dat").read_bytes() == want
    back = stored.read_recording(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, samples.collect()))
    stored.write_recording(samples.where("epoch_id = 'a'"), str(tmp_path), segment=8)  # takes the folder's place
    assert data_files(tmp_path) == ["a/0.dat", "a/1.dat", "a/2.dat"] and stored.read_recording(spark, str(tmp_path)).count() == 60
    stored.write_recording(samples.where("epoch_id <> 'a'"), str(tmp_path), segment=8, mode="append")
    assert stored.read_recording(spark, str(tmp_path)).count() == 120


def test_filters_open_only_the_files_they_need(spark, samples, tmp_path):
    stored.write_recording(samples, str(tmp_path), segment=8)
    (tmp_path / "b c" / "0.dat").unlink()
    (tmp_path / "a" / "2.dat").unlink()
    some = stored.read_recording(spark, str(tmp_path)).where("epoch_id = 'a' AND sample_idx < 16 AND channel IN ('ai2', 'ai1')")
    assert some.count() == 32 and some.rdd.getNumPartitions() == 2
    with pytest.raises(Exception):
        stored.read_recording(spark, str(tmp_path)).count()


def test_reader_splits_files_by_bytes(spark, samples, tmp_path):
    stored.write_recording(samples, str(tmp_path))
    stored.register(spark)
    one = spark.read.format("recording").option("split_bytes", 7 * 24).load(str(tmp_path))
    assert one.rdd.getNumPartitions() == 6 and sorted(map(tuple, one.collect())) == sorted(map(tuple, samples.collect()))


@pytest.mark.parametrize("spoil", ["NOT (channel = 'ai2' AND sample_idx = 9)", "NOT (epoch_id = 'b c' AND sample_idx = 3)", "NOT (channel = 'ai2' AND sample_idx = 19)", "twice"])
def test_a_failed_job_leaves_no_file(spark, samples, tmp_path, spoil):
    bad = samples.unionByName(samples.where("sample_idx = 4")) if spoil == "twice" else samples.where(spoil)
    with pytest.raises(Exception, match="lacks a channel|missing"):
        stored.write_recording(bad, str(tmp_path), segment=8)
    assert tree(tmp_path) == []


def test_whole_files_are_complete_or_absent(spark, tmp_path):
    (tmp_path / "src").write_bytes(b"x" * 100)
    rows = [("d/one.bin", b"1", None), ("two", None, str(tmp_path / "src")), ("empty", None, None)]
    make = lambda r: spark.createDataFrame(r, "path string, content binary, source string")
    out = tmp_path / "out"
    stored.write_files(make(rows), str(out))
    assert data_files(out) == ["d/one.bin", "empty", "two"] and (out / "two").read_bytes() == b"x" * 100
    assert {(r.path, r.size) for r in stored.stored_files(spark, str(out)).collect()} == {("d/one.bin", 1), ("two", 100), ("empty", 0)}
    for bad in ("../up", "/abs", "_manifest/x", ""):
        with pytest.raises(Exception, match="not a path below"):
            stored.write_files(make([(bad, b"1", None)]), str(out))
    before = tree(out)
    with pytest.raises(Exception):
        stored.write_files(make([("new", b"1", None), ("three", None, str(tmp_path / "gone"))]).coalesce(1), str(out), "append")
    assert tree(out) == before


def test_what_a_late_task_left_is_swept(spark, tmp_path):
    make = lambda r: spark.createDataFrame(r, "path string, content binary")
    stored.write_files(make([("a", b"1"), ("d/b", b"2")]), str(tmp_path))
    for name, content in ((".c.123", b"half"), ("late", b"3"), ("a", b"1"), ("_manifest/.job-0-1", b'{"path": "late", "size": 1}\n{"path": "a", "size": 1}\n')):
        (tmp_path / name).write_bytes(content)
    assert {r.path for r in stored.stored_files(spark, str(tmp_path)).collect()} == {"a", "d/b"}
    assert stored.sweep(str(tmp_path)) == 3 and data_files(tmp_path) == ["a", "d/b"] and stored.sweep(str(tmp_path)) == 0
    assert stored.sweep(str(tmp_path / "none")) == 0
    stored.write_files(make([]), str(tmp_path))
    assert tree(tmp_path) == []


def test_grids_of_many_shapes(spark, tmp_path):
    rows = [("g/a", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "int16", [2, 3]), ("g/b", [0.5], "double", [1, 1, 1]), ("g/c", [], "single", [0, 4]), ("g/d", [1.0, 0.0], "logical", [2])]
    grids = spark.createDataFrame(rows, "path string, data array<double>, data_type string, data_dim array<int>")
    stored.write_grids(grids, str(tmp_path))
    assert (tmp_path / "g/a").read_bytes() == struct.pack("<6h", 1, 2, 3, 4, 5, 6)
    got = stored.read_grids(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(p, i, v) for p, data, _, _ in rows for i, v in enumerate(data)]
    assert got.where("path = 'g/b'").rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="values, not"):
        stored.write_grids(spark.createDataFrame([("g/a", [1.0], "int16", [2])], grids.schema), str(tmp_path))
    (tmp_path / "g/a").write_bytes(b"123")
    stored.write_files(spark.createDataFrame([("x", b"123", "int16", [2])], "path string, content binary, data_type string, data_dim array<int>"), str(tmp_path / "odd"))
    with pytest.raises(Exception, match="bytes, not"):
        stored.read_grids(spark, str(tmp_path / "odd")).count()


def test_presentation_bytes():
    raw = files.presentation_bytes([{"clock": "utc", "times": [1, 2, 3, 4], "events": [(0.5, 7.0), (0.75, 8.0)]}, {"clock": "no_time", "times": [0] * 4, "events": []}])
    assert raw[:36] == b"presentation_time structure\n" + struct.pack("<Q", 2) and raw[36:512] == b"\0" * 476
    assert raw[512:] == b"utc\n" + struct.pack("<4dI4d", 1, 2, 3, 4, 2, 0.5, 0.75, 7, 8) + b"no_time\n" + struct.pack("<4dI", 0, 0, 0, 0, 0)
    assert [r[:2] for r in files.presentation_records(raw, 2, 9)] == [(2, "no_time")]
    assert files.presentation_records(raw)[0][3] == [[0.5, 7.0], [0.75, 8.0]]
    with pytest.raises(ValueError):
        files.presentation_records(b"other")


def plan(spark, rows):
    return spark.createDataFrame(rows, "id string, uid string, action string, path string")


def test_ingest_is_safe_to_rerun_and_taken_back_when_it_fails(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    source.mkdir(), target.mkdir()
    for n in "abc":
        (source / n).write_bytes(n.encode() * 50)
    (target / "uold").write_bytes(b"c" * 50)
    rows = [("d1", "ua", "copy", str(source / "a")), ("d1", "ua", "delete", str(source / "a")), ("d2", "ub", "copy", str(source / "b")), ("d3", "uold", "copy", str(source / "c"))]
    bad = [*rows, ("d4", "ux", "copy", str(source / "gone"))]
    out = stored.ingest(plan(spark, bad), str(target), written).collect()
    assert not any(r.done for r in out) and tree(target) == ["uold"] and tree(source) == ["a", "b", "c"]
    assert all(r.done for r in stored.ingest(plan(spark, rows), str(target), written).collect())
    assert tree(target) == ["ua", "ub", "uold"] and tree(source) == ["b", "c"]
    again = [r for r in rows if r[1] != "ua"]
    assert all(r.done for r in stored.ingest(plan(spark, again), str(target), written).collect()) and tree(target) == ["ua", "ub", "uold"]
    gone = plan(spark, [("d1", "ua", "delete", str(target / "ua")), ("d1", "ua", "delete", str(target / "ua"))])
    assert [r.done for r in written(stored.carry_out(gone, str(target))).collect()] == [True, True] and tree(target) == ["ub", "uold"]


def test_folder_names_are_not_patterns(spark, tmp_path):
    for name in ("base.v1/e1/x.rhd", "basexv1/e2/x.rhd"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(b"1")
    found = files.listing(spark, str(tmp_path))
    assert [r.epoch_id for r in files.folder_epochs(found, "base.v1", ["#.rhd"]).collect()] == ["e1"]
    disk = spark.createDataFrame([("e1", "f"), ("e3", "g")], "epoch_id string, folder string")
    both = files.reconcile(spark.createDataFrame([("e1",)], "epoch_id string"), disk).collect()
    assert {(r.epoch_id, r.source) for r in both} == {("e1", "ingested"), ("e3", "disk")}


def test_tab_tables(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "n-trode", "d:ai1", "s"), ("tab\tin", 2, "x", None, "")], files.PROBE_MAP)
    files.write_tab_table(rows, str(tmp_path / "m"))
    back = {r.name: (r.reference, r.devicestring) for r in files.read_probe_map(spark, str(tmp_path / "m")).collect()}
    assert back == {"p": (1, "d:ai1"), "tab\tin": (2, None)}
    last = files.session_table(spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "session_id string, path string, line int"), "line")
    assert {tuple(r) for r in last.collect()} == {("a", "y"), ("b", "z")}


def test_copies_have_the_same_bytes(tmp_path):
    (tmp_path / "a").write_bytes(os.urandom(3 << 20))
    assert stored.copy_file(f"file:{tmp_path}/a", f"file://{tmp_path}/deep/b") == 3 << 20
    assert hashlib.md5((tmp_path / "a").read_bytes()).digest() == hashlib.md5((tmp_path / "deep/b").read_bytes()).digest()
    assert tree(tmp_path) == ["a", "deep/b"]


def test_folders_are_listed_and_read_by_tasks(spark, tmp_path):
    for name in ("a/b c/1.rhd", "a/2.rhd", "a/n.txt", ".h/3.rhd", "_manifest/4.rhd", "a/.5.rhd", "_k=1/6.rhd"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty").mkdir()
    found, read = files.listing(spark, str(tmp_path)), files.contents(spark, f"file:{tmp_path}/", "*.{rhd,bin}")
    assert not any("binaryFile" in d._jdf.queryExecution().toString() for d in (found, read))
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length", F.col("modificationTime").alias("modified"))
    assert sorted(map(tuple, found.select("path", "length", F.date_trunc("second", "modified")).collect())) == sorted(map(tuple, want.withColumn("modified", F.date_trunc("second", "modified")).collect()))
    assert {(r.folder, r.name) for r in found.collect()} == {(f"file:{tmp_path}/{d}", n) for d, n in (("a/b c", "1.rhd"), ("a", "2.rhd"), ("a", "n.txt"), ("_k=1", "6.rhd"))}
    assert sorted((r.path, bytes(r.content)) for r in read.collect()) == sorted((f"file:{tmp_path}/{n}", n.encode()) for n in ("a/b c/1.rhd", "a/2.rhd", "_k=1/6.rhd"))
    assert files.listing(spark, str(tmp_path / "empty")).count() == 0


def test_small_files_share_partitions(spark, tmp_path, monkeypatch):
    rows = spark.range(2000).selectExpr("concat('e', id % 500) epoch_id", "'ai1' channel", "id div 500 sample_idx", "id / 2D value")
    stored.write_recording(rows, str(tmp_path), segment=2)
    assert len(data_files(tmp_path)) == 1000
    back = stored.read_recording(spark, str(tmp_path))
    assert back.rdd.getNumPartitions() <= 16 and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    some = back.where("epoch_id IN ('e7', 'e311') AND sample_idx >= 2")
    assert some.rdd.getNumPartitions() == 2 and {tuple(r) for r in some.collect()} == {(f"e{e}", "ai1", k, (e + 500 * k) / 2) for e in (7, 311) for k in (2, 3)}
    again = rows.where("epoch_id = 'e7'").withColumn("value", F.col("value") + 1)
    stored.write_recording(again, str(tmp_path), segment=2, mode="append")  # its files come twice in the manifest
    want = rows.where("epoch_id <> 'e7'").unionByName(again)
    assert sorted(map(tuple, back.sparkSession.read.format("recording").load(str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))
