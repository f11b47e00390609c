"""Queries over sampled channels, events and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import clocks, signals

from .inputs import BITS, PAIRS, SAMPLES, digital, query, samples, seconds, table

_C = ["epoch_id", "channel"]


@query(f"WITH {SAMPLES} SELECT epoch_id, sample_idx, round(5 + sample_idx / 250.0, 6) AS at FROM samples")
def samples_to_times(spark, sf_dir):
    return samples(spark, sf_dir).select("epoch_id", "sample_idx", F.round(signals.sample_time(F.col("sample_idx"), F.lit(250.0), F.lit(5.0)), 6).alias("at"))


@query("SELECT event_id, CAST(round_even((value - 5) * 30, 0) AS BIGINT) AS sample FROM events")
def times_to_samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", signals.time_sample(F.col("value"), F.lit(30.0), F.lit(5.0)).alias("sample"))


@query("SELECT event_id, round((value - 2.5) * 0.195, 6) AS scaled FROM events")
def scale_offset(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(signals.scaled(F.col("value"), F.lit(2.5), F.lit(0.195)), 6).alias("scaled"))


@query(f"WITH {SAMPLES} SELECT epoch_id, sample_idx, value FROM samples WHERE sample_idx BETWEEN 10 AND 25")
def segment_read(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("segment", (F.floor(F.col("sample_idx") / 16) + 1).cast("int"))
    return signals.read_samples(s, 10, 25, ["ai1"], 16).select("epoch_id", "sample_idx", "value")


@query(f"WITH {SAMPLES} SELECT epoch_id, sample_idx, max(value) AS ai1 FROM samples GROUP BY ALL")
def wide_read(spark, sf_dir):
    return signals.wide_samples(samples(spark, sf_dir), ["ai1"])


@query("SELECT event_id FROM events WHERE epoch_us(ts) / 1e6 BETWEEN 1704500000 AND 1706000000")
def event_range(spark, sf_dir):
    return signals.in_range(table(spark, sf_dir, "events").withColumn("t", seconds("ts")), 1704500000, 1706000000).select("event_id")


@query(f"WITH {BITS} SELECT epoch_id, channel, sample_idx, 1::INTEGER AS event FROM pairs WHERE prev = 0 AND value = 1")
def edges_digital(spark, sf_dir):
    return signals.digital_edges(digital(spark, sf_dir))


@query(f"WITH {BITS} SELECT epoch_id, channel, before AS sample_idx, 1::INTEGER AS event FROM pairs WHERE prev = 1 AND value = 0")
def edges_digital_before(spark, sf_dir):
    return signals.digital_edges(digital(spark, sf_dir), rising=False, at="before")


@query(f"WITH {BITS} SELECT epoch_id, channel, sample_idx, (CASE WHEN value = 1 THEN 1 ELSE -1 END)::INTEGER AS event FROM pairs WHERE prev <> value")
def pulses_digital(spark, sf_dir):
    return signals.digital_pulses(digital(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT epoch_id, channel, sample_idx, (CASE WHEN prev < 50 AND value >= 50 THEN 1 ELSE -1 END)::INTEGER AS event FROM pairs WHERE prev < 50 AND value >= 50 OR prev >= 50 AND value < 50")
def threshold_up_down(spark, sf_dir):
    return signals.crossings(samples(spark, sf_dir), 50.0, "both")


@query(f"WITH {PAIRS} SELECT epoch_id, channel, sample_idx, (CASE WHEN prev < 80 AND value >= 80 THEN -1 ELSE 1 END)::INTEGER AS event FROM pairs WHERE prev < 80 AND value >= 80 OR prev >= 80 AND value < 80")
def pulses_analog(spark, sf_dir):
    return signals.analog_pulses(samples(spark, sf_dir), 80.0, positive=False)


_ON = "o AS (SELECT user_id, epoch_us(ts) / 1e6 AS t_on, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS place FROM events WHERE event_type = 'signup')"
_OFF = "f AS (SELECT user_id, epoch_us(ts) / 1e6 AS t_off, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS place FROM events WHERE event_type = 'error')"


@query(f"WITH {_ON}, {_OFF} SELECT user_id, place::INTEGER AS place, t_on, t_off FROM o FULL JOIN f USING (user_id, place)")
def marker_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", seconds("ts").alias("t"))
    return signals.pair_by_place(e.where("event_type = 'signup'"), e.where("event_type = 'error'"), ["user_id"])


_ST = "s AS (SELECT user_id, value AS stimulus, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS place FROM events WHERE event_type = 'purchase')"


@query(f"WITH {_ON}, {_OFF}, {_ST} SELECT user_id, place::INTEGER AS place, t_on, t_off, stimulus FROM o FULL JOIN f USING (user_id, place) FULL JOIN s USING (user_id, place)")
def marker_decode(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("signup", "error"), 1).when(F.col("event_type") == "purchase", 2)
    value = F.when(F.col("event_type") == "signup", F.lit(1.0)).when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.col("value"))
    e = table(spark, sf_dir, "events").select("user_id", seconds("ts").alias("t"), kind.alias("marker"), value.alias("value")).where("marker is not null")
    return signals.decode_markers(e, ["user_id"]).select("user_id", "place", "t_on", "t_off", "stimulus")


@query(f"WITH {SAMPLES} SELECT epoch_id, sample_idx, round(t - lag(t) OVER (PARTITION BY epoch_id ORDER BY sample_idx), 4) AS interval FROM samples")
def ipi_diff(spark, sf_dir):
    out = signals.intervals(samples(spark, sf_dir), _C, ["sample_idx"], counted=True)
    return out.select("epoch_id", "sample_idx", F.round("interval", 4).alias("interval"))


@query(f"WITH {SAMPLES} SELECT epoch_id, sample_idx, value FROM samples WHERE sample_idx % 4 = 0")
def decimate(spark, sf_dir):
    return signals.decimate(samples(spark, sf_dir), 4).select("epoch_id", "sample_idx", "value")


@query("SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'analog_in' WHEN 'view' THEN 'marker' ELSE event_type END AS full_name FROM events")
def channel_types(spark, sf_dir):
    short = F.when(F.col("event_type") == "click", "AI").when(F.col("event_type") == "view", "mk").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_type", signals.standard_type(short).alias("full_name")).distinct()


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS grp, min(l_linenumber) AS f FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1)::INTEGER AS in_group, (SELECT count(*) FROM c d WHERE d.l_orderkey = l.l_orderkey AND (d.f, d.grp) < (c.f, c.grp))::INTEGER AS group_place FROM lineitem l JOIN c USING (l_orderkey) WHERE c.grp = l.l_returnflag""")
def channel_group_decoding(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("grp"))
    return signals.channel_groups(li, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "in_group", "group_place")


@query(f"""WITH {SAMPLES}, n AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY epoch_id ORDER BY sample_idx), value) AS nxt FROM samples)
SELECT epoch_id, (sample_idx * 4 + j)::BIGINT AS sample_idx, round(value + (nxt - value) * j / 4, 5) AS value FROM n, range(4) r(j)""")
def aux_interpolate(spark, sf_dir):
    return signals.interpolate_to(samples(spark, sf_dir), 4, _C).select("epoch_id", "sample_idx", F.round("value", 5).alias("value"))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type FROM events), m AS (SELECT user_id, ts, max(event_id) AS mark FROM e WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, (SELECT max_by(m.mark, m.ts) FROM m WHERE m.user_id = e.user_id AND m.ts <= e.ts) AS mark FROM e""")
def event_asof_marker(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("t"), "event_type")
    marks = e.where("event_type = 'signup'").groupBy("user_id", "t").agg(F.max("event_id").alias("mark"))
    return signals.as_of(e.select("event_id", "user_id", "t"), marks, ["user_id"]).select("event_id", "mark")


@query("SELECT a.event_id, w.event_id AS window_id FROM events a JOIN events w ON w.event_type = 'purchase' AND a.user_id = w.user_id AND a.ts >= w.ts AND epoch_us(a.ts) < epoch_us(w.ts) + 86400000000")
def event_in_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("t"), "event_type")
    w = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("window_id"), F.col("t").alias("t_on"), (F.col("t") + 86400).alias("t_off"))
    return signals.in_windows(e.select("event_id", "user_id", "t"), w, ["user_id"]).select("event_id", "window_id")


_LONG = "CASE w.event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 31536000 ELSE 0.0 END"


@query(f"SELECT a.event_id, w.event_id AS window_id FROM events a JOIN events w ON w.event_type = 'signup' AND a.user_id = w.user_id AND a.ts >= w.ts AND epoch_us(a.ts) < epoch_us(w.ts) + {_LONG} * 1000000")
def event_in_mixed_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("t"), "event_type")
    length = F.element_at(F.array(F.lit(60.0), F.lit(3600.0), F.lit(31536000.0), F.lit(0.0)), (F.col("event_id") % 4 + 1).cast("int"))
    w = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("window_id"), F.col("t").alias("t_on"), (F.col("t") + length).alias("t_off"))
    return signals.in_windows(e.select("event_id", "user_id", "t"), w, ["user_id"]).select("event_id", "window_id")


@query()
def downsample_cheby(spark, sf_dir):
    s = samples(spark, sf_dir).select("epoch_id", "channel", (F.col("sample_idx") / 1000).alias("t"), "value")
    return signals.downsample(s, 100.0, _C)


@query("SELECT event_id, round((0.5 * value + 2) * value - 1, 6) AS mapped FROM events")
def poly_map(spark, sf_dir):
    m = F.array(F.lit(0.5), F.lit(2.0), F.lit(-1.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(clocks.apply_mapping(m, F.col("value")), 6).alias("mapped"))


@query("SELECT n_nationkey, [(n_nationkey + 1.0) * 2, 2 * CAST(n_regionkey AS DOUBLE) + 5]::DOUBLE[] AS mapping FROM nation")
def map_compose(spark, sf_dir):
    first = clocks.linear(F.col("n_nationkey") + 1, F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", clocks.compose(first, F.array(F.lit(2.0), F.lit(5.0))).alias("mapping"))


@query("SELECT n_nationkey, round(1 / (n_nationkey + 1.0), 8) AS scale, round(-n_regionkey / (n_nationkey + 1.0), 8) + 0.0 AS shift FROM nation")
def map_inverse(spark, sf_dir):
    m = clocks.invert(clocks.linear(F.col("n_nationkey") + 1, F.col("n_regionkey")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(F.get(m, 0), 8).alias("scale"), (F.round(F.get(m, 1), 8) + 0.0).alias("shift"))


_CLOCK = "CASE n_nationkey % 3 WHEN 0 THEN 'utc' WHEN 1 THEN 'approx_utc' ELSE 'dev_local_time' END"
_NODES = f"n AS (SELECT n_nationkey AS id, n_regionkey AS owner, {_CLOCK} AS clock FROM nation)"


def _nodes(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    clock = F.when(k == 0, "utc").when(k == 1, "approx_utc").otherwise("dev_local_time")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node_id"), F.col("n_regionkey").alias("objectname"), clock.alias("clock"))


@query(f"WITH {_NODES} SELECT a.id AS src, b.id AS dst, 100.0::DOUBLE AS cost FROM n a JOIN n b ON a.owner <> b.owner AND a.clock = 'utc' AND b.clock IN ('utc', 'approx_utc')")
def clock_edges(spark, sf_dir):
    return clocks.clock_edges(_nodes(spark, sf_dir), []).select("src", "dst", "cost")


@query("WITH n AS (SELECT c_custkey AS id, c_nationkey AS session, c_mktsegment AS owner, CASE c_custkey % 3 WHEN 0 THEN 'utc' WHEN 1 THEN 'approx_utc' ELSE 'dev_local_time' END AS clock FROM customer) SELECT a.id AS src, b.id AS dst FROM n a JOIN n b USING (session) WHERE a.owner <> b.owner AND a.clock = 'utc' AND b.clock IN ('utc', 'approx_utc')")
def clock_edges_in_session(spark, sf_dir):
    k = F.col("c_custkey") % 3
    clock = F.when(k == 0, "utc").when(k == 1, "approx_utc").otherwise("dev_local_time").alias("clock")
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("session"), F.col("c_mktsegment").alias("objectname"), clock)
    return clocks.clock_edges(nodes, ["session"]).select("src", "dst")


@query("WITH f AS (SELECT DISTINCT c_nationkey AS id, c_mktsegment AS path FROM customer UNION SELECT DISTINCT s_nationkey, CAST(s_suppkey AS VARCHAR) FROM supplier) SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE AS cost FROM f a JOIN f b USING (path) WHERE a.id <> b.id GROUP BY a.id, b.id HAVING count(*) >= 2")
def sync_filematch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node_id"), F.col("c_mktsegment").alias("path"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node_id"), F.col("s_suppkey").cast("string").alias("path"))
    return clocks.shared_file_edges(c.unionByName(s).withColumn("objectname", F.col("node_id"))).select("src", "dst", "cost")


@query("""WITH a AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events)
SELECT user_id, count(*) AS n, round(regr_slope(2 * x + 7, x), 6) AS scale FROM a GROUP BY user_id HAVING count(*) >= 2""")
def sync_triggers_fit(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("user_id", seconds("ts").alias("t"))
    fit = clocks.trigger_fit(a, a.withColumn("t", 2 * F.col("t") + 7), ["user_id"])
    return fit.select("user_id", "n", F.round(F.get("mapping", 0), 6).alias("scale"))


@query()
def sync_random_pulses(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("user_id", (seconds("ts") - 1704067200).alias("t"))
    return clocks.pulse_fit(a, a.withColumn("t", F.col("t") * 1.5 + 3), ["user_id"])


_STEPS = "e(src, dst, cost, a, b) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1.0 + n_nationkey, 2.0, 1.0 FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 1.0, 1.0, CAST(s_suppkey AS DOUBLE) FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey + 1), 50.0, 1.0, 100.0 FROM region WHERE r_regionkey < 4)"


@query(f"""WITH RECURSIVE {_STEPS}, p AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0.0::DOUBLE AS cost, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM region
UNION ALL SELECT p.root, e.dst, p.cost + e.cost, e.a * p.a, e.a * p.b + e.b FROM p JOIN e ON e.src = p.id)
SELECT root, id, round(min(cost), 4) AS cost, round(min_by(a * (10 - 3) + b, cost), 4) AS converted FROM p GROUP BY root, id""")
def time_convert_path(spark, sf_dir):
    n, s, r = (table(spark, sf_dir, x) for x in ("nation", "supplier", "region"))
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = n.select(key("r", F.col("n_regionkey")).alias("src"), key("n", F.col("n_nationkey")).alias("dst"), (F.col("n_nationkey") + 1.0).alias("cost"), F.array(F.lit(2.0), F.lit(1.0)).alias("mapping"))
    e = e.unionByName(s.select(key("n", F.col("s_nationkey")).alias("src"), key("s", F.col("s_suppkey")).alias("dst"), F.lit(1.0).alias("cost"), clocks.linear(F.lit(1.0), F.col("s_suppkey")).alias("mapping")))
    e = e.unionByName(r.where("r_regionkey < 4").select(key("r", F.col("r_regionkey")).alias("src"), key("r", F.col("r_regionkey") + 1).alias("dst"), F.lit(50.0).alias("cost"), F.array(F.lit(1.0), F.lit(100.0)).alias("mapping")))
    paths = clocks.cheapest_paths(e, r.select(key("r", F.col("r_regionkey")).alias("id")))
    times = paths.select("root", "id", F.lit(10.0).alias("t"), F.lit(3.0).alias("reference"))
    return clocks.convert_times(times, paths).select("root", "id", F.round("cost", 4).alias("cost"), F.round("converted", 4).alias("converted"))
