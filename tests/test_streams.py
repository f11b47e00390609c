"""Streams in several micro-batches, with rows that come late."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def batches(spark, tmp_path):
    """A stream that takes one file a micro-batch, in the order written."""

    def make(parts, schema="channel string, t timestamp, value double"):
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
            (file,) = (tmp_path / f"b{i}").glob("part-*")
            target = tmp_path / "in" / f"{i:03d}.parquet"
            target.parent.mkdir(exist_ok=True)
            file.rename(target)
            import os

            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def crossings(rows, threshold=0.5):
    out, last = [], {}
    for c, t, v in sorted(rows, key=lambda r: (r[1], r[2])):
        high = v >= threshold
        if c in last and last[c] != high:
            out.append((c, t, 1 if high else -1))
        last[c] = high
    return sorted(out)


def test_late_rows_are_taken_in_order(batches):
    parts = [
        [("a", at(0), 0.0), ("a", at(10), 1.0), ("b", at(5), 1.0)],
        [("a", at(6), 1.0), ("a", at(8), 0.0), ("b", at(20), 0.0), ("a", at(20), 0.0)],  # two rows of a come late
        [("a", at(30), 1.0), ("b", at(15), 0.0)],
        [("z", at(600), 0.0)],  # nothing of a and b any more: their timers take what waits
        [("z", at(601), 0.0)],
    ]
    got = events.run_available(events.ordered_edges(batches(parts), late="30 minutes"), "append")
    assert sorted(map(tuple, got.collect())) == crossings([r for p in parts for r in p])


def test_rows_behind_the_watermark_are_left_out(batches):
    parts = [[("a", at(0), 0.0), ("a", at(100), 0.0)], [("a", at(101), 0.0)], [("a", at(50), 1.0), ("a", at(300), 1.0)], [("a", at(500), 1.0)], [("a", at(501), 1.0)]]
    got = events.run_available(events.ordered_edges(batches(parts), late="10 minutes"), "append")
    assert [tuple(r) for r in got.collect()] == [("a", at(300), 1)]


def test_rows_at_the_last_watermark_are_taken(batches):
    parts = [[("a", at(0), 0.0), ("z", at(31), 0.0)], [("a", at(10), 1.0), ("z", at(40), 0.0)]]
    got = events.run_available(events.ordered_edges(batches(parts), late="30 minutes"), "append")
    assert [tuple(r) for r in got.collect()] == [("a", at(10), 1)]


@pytest.mark.parametrize("buckets", [1, 3])
@pytest.mark.parametrize("find", [events.ordered_edges, events.streaming_edges])
def test_channels_share_states(batches, find, buckets):
    """Rows of equal times go by their numbers; channels, null too, are told apart within a state."""
    channels = ["a", "b", "c", None, "d"]
    rows = [(channels[i % 5], at(i // 10), (i * 7 % 11) / 10, i) for i in range(600)]
    parts = [rows[:50], rows[50:300], rows[300:], [("z", at(5000), 0.0, 1000)], [("z", at(5001), 0.0, 1001)]]
    want, last = [], {}
    for c, t, v, _ in rows:
        if c in last and last[c] != (v >= 0.5):
            want.append((c, t, 1 if v >= 0.5 else -1))
        last[c] = v >= 0.5
    stream = batches(parts, "channel string, t timestamp, value double, n long")
    got = events.run_available(find(stream, order="n", buckets=buckets), "append")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_calls_do_not_grow_with_channels(spark, batches):
    rows = [(f"c{i % 3000}", at(i // 3000), float(i // 3000 % 2)) for i in range(9000)]
    stream = batches([rows, [("z", at(5000), 0.0)]])
    query = events.ordered_edges(stream, buckets=8).writeStream.format("memory").queryName("calls").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8 and spark.table("calls").count() == 6000


def test_sessions_with_a_late_row_that_joins_two(batches):
    parts = [[("a", at(0), 1.0), ("a", at(40), 1.0), ("b", at(3), 1.0)], [("a", at(20), 1.0), ("b", at(50), 1.0)], [("z", at(1000), 1.0)], [("z", at(1001), 1.0)]]
    got = events.run_available(events.sessions(batches(parts), "channel", gap="25 minutes", late="2 hours"), "append").where("channel <> 'z'")
    assert sorted(map(tuple, got.collect())) == [("a", at(0), at(65), 3), ("b", at(3), at(28), 1), ("b", at(50), at(75), 1)]


def test_counts_with_late_rows(batches):
    parts = [[("a", at(0), 1.0)], [("a", at(3000), 1.0)], [("a", at(3001), 1.0)], [("a", at(2990), 1.0), ("a", at(1), 1.0)], [("a", at(9000), 1.0)], [("a", at(9001), 1.0)]]
    got = events.run_available(events.windowed_counts(batches(parts), size="1 hour", late="1 hour"), "append")
    counts = {r.start: r.n for r in got.select("start", F.col("n")).collect()}
    assert counts[at(0)] == 1 and counts[at(2940)] == 1 and counts[at(3000)] == 2
