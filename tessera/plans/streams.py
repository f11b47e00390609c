"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import events

from .inputs import PAIRS, SAMPLES, query, seconds


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT CAST(epoch_us(date_trunc('day', ts)) // 1000000 AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    stream = _stream(spark, sf_dir).select(F.timestamp_micros((seconds("ts") * 1e6).cast("long")).alias("t"), "event_type")
    counts = events.run_available(events.windowed_counts(stream, by=["event_type"]))
    return counts.select(F.unix_seconds("start").alias("day"), "event_type", "n")


@query(f"WITH {PAIRS} SELECT CAST(epoch_id AS VARCHAR) AS channel, CAST(epoch_us(to_timestamp(t)) // 1000 AS BIGINT) AS t, (CASE WHEN value >= 50 THEN 1 ELSE -1 END)::INTEGER AS event FROM pairs WHERE (prev >= 50) <> (value >= 50)")
def stream_edges(spark, sf_dir):
    stream = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("channel"), F.timestamp_micros((seconds("ts") * 1e6).cast("long")).alias("t"), "value", "event_id")
    found = events.run_available(events.streaming_edges(stream, 50.0, order="event_id"), "append")
    return found.select("channel", F.unix_millis("t").alias("t"), "event")


@query(f"""WITH {SAMPLES}, told AS (SELECT * FROM samples WHERE t <= (SELECT max(epoch_us(ts)) // 1000 - 86400000 FROM events) / 1000.0),
p AS (SELECT *, lag(value) OVER (PARTITION BY epoch_id ORDER BY sample_idx) AS prev FROM told)
SELECT CAST(epoch_id AS VARCHAR) AS channel, CAST(epoch_us(to_timestamp(t)) // 1000 AS BIGINT) AS t, (CASE WHEN value >= 50 THEN 1 ELSE -1 END)::INTEGER AS event FROM p WHERE (prev >= 50) <> (value >= 50)""")
def stream_edges_in_order(spark, sf_dir):
    stream = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("channel"), F.timestamp_micros((seconds("ts") * 1e6).cast("long")).alias("t"), "value", "event_id")
    found = events.run_available(events.ordered_edges(stream, 50.0, late="1 day", order="event_id"), "append")
    return found.select("channel", F.unix_millis("t").alias("t"), "event")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT user_id, k, min(epoch_us(ts)) AS a, max(epoch_us(ts)) + 7200000000 AS b, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, a // 1000 AS start, b // 1000 AS stop, n FROM w WHERE b <= (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events) * 1000""")
def stream_sessions(spark, sf_dir):
    stream = _stream(spark, sf_dir).select("user_id", F.timestamp_micros((seconds("ts") * 1e6).cast("long")).alias("t"))
    found = events.run_available(events.sessions(stream, "user_id", gap="2 hours"), "append")
    return found.select("user_id", F.unix_millis("start").alias("start"), F.unix_millis("end").alias("stop"), "n")
