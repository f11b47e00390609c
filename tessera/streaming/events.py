"""Structured Streaming: windowed counts with late data, and edges across micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.graph import shared_folder

EDGES = "channel string, t timestamp, event int"
HELD = "names array<string>, last binary, counts binary, held binary"
BUCKETS = 4096


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result, as the last micro-batch wrote it to the shared folder.

    In ``append`` mode every micro-batch adds its rows.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/tessera-stream/{uuid.uuid4().hex}"
    how = "overwrite" if mode == "complete" else "append"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state")
    query = writer.foreachBatch(lambda df, _: df.write.mode(how).parquet(f"{at}/rows")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def windowed_counts(stream: DataFrame, t: str = "t", size: str = "1 day", late: str = "1 hour", by: list[str] = []) -> DataFrame:
    """Events by window (and columns); rows later than ``late`` behind the newest are left out."""
    grouped = stream.withWatermark(t, late).groupBy(F.window(t, size).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, key: str, t: str = "t", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a key: events with less than ``gap`` between them."""
    grouped = stream.withWatermark(t, late).groupBy(F.session_window(t, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _told_apart(names: list, parts: list[pd.DataFrame]) -> tuple[np.ndarray, list]:
    """The channel of each row as a place in ``names``, to which new ones are added."""
    codes, found = pd.factorize(np.concatenate([np.array(names, object), *(p["channel"].to_numpy(object) for p in parts)]), use_na_sentinel=False)
    return codes[len(names) :], [None if pd.isna(n) else n for n in found]


def _crossed(of: np.ndarray, high: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which rows, sorted by channel and time, differ from the one before; ``last`` is each channel's newest (-1: none)."""
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    before = np.roll(high, 1)
    before[first] = np.where(last[of[first]] < 0, high[first], last[of[first]] > 0)
    end = np.roll(first, -1)
    last[of[end]] = high[end]
    return high != before


def _edges(names: list, of: np.ndarray, at: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"channel": np.array(names, object)[of], "t": pd.to_datetime(at, unit="us", utc=True), "event": np.where(high, 1, -1)})


def _bucketed(stream: DataFrame, order: str | None, buckets: int, *more: str) -> DataFrame:
    # A call for each channel costs more than its rows, so channels share calls and states.
    tie = [F.coalesce(F.col(order).cast("long"), F.lit(-(2**63))).alias("tie")] if order else []
    return stream.select(F.pmod(F.xxhash64("channel"), F.lit(buckets)).cast("int").alias("bucket"), "channel", *more, F.unix_micros("t").alias("at"), *tie, F.col("value").cast("double").alias("value"))


def streaming_edges(stream: DataFrame, threshold: float = 0.5, order: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``channel, t, event`` of threshold crossings (1 up, -1 down); ``stream`` has ``channel, t, value``.

    The last value of each channel is kept as state, so that a crossing between two micro-batches is found. Rows of a
    channel must not arrive after later ones in another micro-batch. Rows of equal times go by the integers of ``order``, if
    given, then by value. Channels share ``buckets`` states; their number is fixed once a stream has a checkpoint.
    """
    keys = ["tie", "at"] if order else ["at"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = list(parts)
        names, last = state.get if state.exists else ([], b"")
        of, names = _told_apart(names, new)
        last = np.concatenate([np.frombuffer(last, np.int8), np.full(len(names) - len(last), -1, np.int8)])
        at, value = (np.concatenate([p[c].to_numpy() for p in new]) for c in ("at", "value"))
        by = np.lexsort((value, *(np.concatenate([p[c].to_numpy() for p in new]) for c in keys), of))
        high = value[by] >= threshold
        changed = _crossed(of[by], high, last)
        state.update((names, last.tobytes()))
        if changed.any():
            yield _edges(names, of[by][changed], at[by][changed], high[changed])

    return _bucketed(stream, order, buckets).groupBy("bucket").applyInPandasWithState(run, EDGES, "names array<string>, last binary", "append", GroupStateTimeout.NoTimeout)


def ordered_edges(stream: DataFrame, threshold: float = 0.5, late: str = "1 hour", order: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``channel, t, event`` of threshold crossings, whatever the order in which a channel's rows arrive.

    Rows wait in the state until the watermark, ``late`` behind the newest row, has passed them; then they are taken in order
    of time (of equal times, by the integers of ``order``, if given, then by value) after the last value taken. A row that
    comes later than that is left out. A state wakes up by its timer, so rows are taken even if none of their channel arrives
    any more. Channels share ``buckets`` states; their number is fixed once a stream has a checkpoint.
    """
    # What waits is a matrix of integers: time, order if given, and the value's bits; sorted by channel, with rows counted by channel.
    fields = ["at", "tie", "value"] if order else ["at", "value"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [] if state.hasTimedOut else list(parts)
        names, last, counts, held = state.get if state.exists else ([], b"", b"", b"")
        counts = np.frombuffer(counts, np.int32)
        came, names = _told_apart(names, new)
        last = np.concatenate([np.frombuffer(last, np.int8), np.full(len(names) - len(last), -1, np.int8)])
        of = np.concatenate([np.repeat(np.arange(len(counts)), counts), came])
        rows = np.concatenate([np.frombuffer(held, np.int64).reshape(-1, len(fields)), *(np.column_stack([p[c].to_numpy().view(np.int64) for c in fields]) for p in new)])
        by = np.lexsort((rows[:, -1].copy().view(float), *rows[:, -2::-1].T, of))
        of, rows = of[by], rows[by]
        done = rows[:, 0] <= state.getCurrentWatermarkMs() * 1000
        high = rows[done, -1].copy().view(float) >= threshold
        changed = _crossed(of[done], high, last)
        waits = rows[~done]
        state.update((names, last.tobytes(), np.bincount(of[~done], minlength=len(names)).astype(np.int32).tobytes(), waits.tobytes()))
        if len(waits):
            # A timer goes off when the watermark is past it, and its time has to be ahead of the watermark.
            state.setTimeoutTimestamp(max(int(waits[:, 0].min()) // 1000 - 1, state.getCurrentWatermarkMs() + 1))
        if changed.any():
            yield _edges(names, of[done][changed], rows[done, 0][changed], high[changed])

    rows = stream.where("t is not null").withWatermark("t", late)
    return _bucketed(rows, order, buckets, "t").groupBy("bucket").applyInPandasWithState(run, EDGES, HELD, "append", GroupStateTimeout.EventTimeTimeout)
