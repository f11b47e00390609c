"""Queries over epochs, probes and elements: customers record, orders are their epochs, line items name the probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import epochs as ep
from tessera.operators import calc, doctables, signals, store
from tessera.operators.query import Query

from .inputs import entity_documents, prefixed, query, samples, table

_CLOCKS = "array<struct<clock:string,t0:double,t1:double>>"


def _epochs(spark, sf_dir):
    """``daq, epoch_id, clocks, probe_map``: an order's device is its customer's in capitals, but for clerks ending in 3."""
    li = table(spark, sf_dir, "lineitem")
    name = F.col("c_name")
    device = F.when(F.col("o_orderkey") % 3 == 0, F.lit("other")).otherwise(F.upper(name))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(
        F.col("o_orderkey").alias("l_orderkey"), name.alias("daq"), prefixed("o", "o_orderkey").alias("epoch_id"), device.alias("__d"),
        F.array(F.struct(F.lit("utc").alias("clock"), F.lit(0.0).alias("t0"), F.col("o_totalprice").alias("t1"))).alias("clocks"),
    )
    each = li.join(o, "l_orderkey").select(
        "daq", "epoch_id", "clocks", prefixed("p", "l_partkey").alias("name"), F.col("l_linenumber").cast("int").alias("reference"), F.col("l_returnflag").alias("type"),
        F.concat("__d", F.lit(":ai"), F.col("l_linenumber").cast("string"), F.lit("-"), (F.col("l_linenumber") + 1).cast("string"), F.lit(";di2")).alias("device"),
    )
    return each.groupBy("daq", "epoch_id", "clocks").agg(F.array_sort(F.collect_list(F.struct("name", "reference", "type", "device"))).alias("probe_map"))


_PM = """pm AS (SELECT c_name AS daq, 'o' || o_orderkey AS epoch_id, o_totalprice AS t1, 'p' || l_partkey AS name, l_linenumber::INTEGER AS reference, l_returnflag AS type,
  o_orderkey % 3 <> 0 AS mine FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {_PM} SELECT name, reference, type, daq, epoch_id, row_number() OVER (PARTITION BY name, reference, type ORDER BY epoch_id)::INTEGER AS epoch_number FROM (SELECT DISTINCT name, reference, type, daq, epoch_id FROM pm WHERE mine)")
def probe_epochs(spark, sf_dir):
    return ep.probe_epochs(_epochs(spark, sf_dir)).select("name", "reference", "type", "daq", "epoch_id", "epoch_number")


@query("SELECT c_name AS daq, 'o' || o_orderkey AS epoch_id, row_number() OVER (PARTITION BY c_name ORDER BY 'o' || o_orderkey)::INTEGER AS epoch_number, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE o_totalprice END::DOUBLE AS t1 FROM orders JOIN customer ON o_custkey = c_custkey")
def daq_epochs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    clocks = lambda t1: F.array(F.struct(F.lit("utc").alias("clock"), F.lit(0.0).alias("t0"), t1.alias("t1")))
    disk = o.select(F.col("c_name").alias("daq"), prefixed("o", "o_orderkey").alias("epoch_id"), clocks(F.col("o_totalprice")).alias("clocks"))
    stored = o.where("o_orderstatus = 'F'").select(F.col("c_name").alias("daq"), prefixed("o", "o_orderkey").alias("epoch_id"), clocks(F.lit(1.0)).alias("clocks"))
    return ep.daq_epochs(disk, stored).select("daq", "epoch_id", "epoch_number", ep.clock_range(F.col("clocks"), "utc")["t1"].alias("t1"))


@query(f"WITH {_PM} SELECT name, reference, type, bool_or(stored) AS stored FROM (SELECT name, reference, type, false AS stored FROM pm UNION ALL SELECT 'p' || p_partkey, 1, 'A', true FROM part) WHERE reference = 1 AND type = 'A' GROUP BY ALL")
def probes(spark, sf_dir):
    stored = table(spark, sf_dir, "part").select(prefixed("p", "p_partkey").alias("name"), F.lit(1).alias("reference"), F.lit("A").alias("type"))
    return ep.probes_of(_epochs(spark, sf_dir), stored, reference=1, type="A", name=None)


@query(f"WITH {_PM} SELECT DISTINCT epoch_id FROM pm WHERE reference = 2 AND type = 'R'")
def probe_map_match(spark, sf_dir):
    e = _epochs(spark, sf_dir)
    return e.where(F.exists("probe_map", lambda p: ep.entry_matches(p, reference=2, kind="R"))).select("epoch_id")


@query("SELECT 'p' || p_partkey AS id FROM part WHERE p_brand = 'Brand#12' AND p_size = 10")
def elements_by_field(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    docs = store.make_documents(p, prefixed("p", "p_partkey"), "element", ["base"], name=F.col("p_name"))
    return ep.elements_of(docs, p_brand="Brand#12", p_size=10).select("id")


@query("SELECT 's' || s_suppkey AS id FROM supplier WHERE regexp_matches(s_name, '00[1-5]$')")
def daq_by_pattern(spark, sf_dir):
    s = store.make_documents(table(spark, sf_dir, "supplier"), prefixed("s", "s_suppkey"), "daqsystem", ["base"], name=F.col("s_name"))
    return ep.named_like(s, "daqsystem", "00[1-5]$").select("id")


@query("SELECT 'daq' AS kind, 'n' || n_nationkey AS id, n_name AS name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation) UNION ALL SELECT 'probe', 'r' || r_regionkey, r_name FROM region WHERE r_name = (SELECT min(n_name) FROM nation)")
def object_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(prefixed("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(prefixed("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"))
    least = n.agg(F.min("name")).first()[0]
    return ep.objects_named({"daq": n, "probe": r}, least)


_ORDERED = "n AS (SELECT o_custkey, 'o' || o_orderkey AS epoch_id, row_number() OVER (PARTITION BY o_custkey ORDER BY 'o' || o_orderkey)::INTEGER AS epoch_number, o_totalprice FROM orders)"


def _ordered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", prefixed("o", "o_orderkey").alias("epoch_id"), "o_totalprice", "o_orderdate")
    return ep.numbered_epochs(o, ["o_custkey"])


@query(f"WITH {_ORDERED} SELECT o_custkey, epoch_id FROM n WHERE epoch_number BETWEEN 2 AND 4")
def epoch_range(spark, sf_dir):
    return ep.epoch_range(_ordered(spark, sf_dir), ["o_custkey"], 2, 4).select("o_custkey", "epoch_id")


@query(f"WITH {_ORDERED} SELECT o_custkey, epoch_id FROM n WHERE epoch_number = 3")
def epoch_by_number(spark, sf_dir):
    return ep.matched_epochs(_ordered(spark, sf_dir), number=3).select("o_custkey", "epoch_id")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS has_local, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS t1, CASE WHEN o_orderstatus = 'F' THEN [[0.0, 1.0], [5.0, o_totalprice]] ELSE [[0.0, 1.0]] END::DOUBLE[][] AS bounds FROM orders")
def epoch_clocks(spark, sf_dir):
    one = F.array(F.struct(F.lit("utc").alias("clock"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1")))
    two = F.concat(one, F.array(F.struct(F.lit("dev_local_time").alias("clock"), F.lit(5.0).alias("t0"), F.col("o_totalprice").alias("t1"))))
    o = table(spark, sf_dir, "orders").withColumn("clocks", F.when(F.col("o_orderstatus") == "F", two).otherwise(one))
    c = F.col("clocks")
    return o.select("o_orderkey", ep.has_clock(c, "dev_local_time").alias("has_local"), ep.clock_range(c, "dev_local_time")["t1"].alias("t1"), ep.clock_bounds(c).alias("bounds"))


@query(f"WITH {_PM} SELECT epoch_id, count(*) AS n, max(t1) AS t1 FROM pm GROUP BY epoch_id")
def epoch_round_trip(spark, sf_dir):
    back = ep.epoch_of_record(ep.epoch_record(_epochs(spark, sf_dir)))
    return back.select("epoch_id", F.size("probe_map").cast("long").alias("n"), F.get("clocks", 0)["t1"].alias("t1"))


@query(f"WITH {_PM} SELECT epoch_id, name, reference, CASE WHEN mine THEN upper(daq) ELSE 'other' END AS device_name, t AS channel_type, c::INTEGER AS channel FROM pm, LATERAL (SELECT 'ai' AS t, unnest([reference, reference + 1]) AS c UNION ALL SELECT 'di', 2)")
def channel_devices(spark, sf_dir):
    out = ep.channel_devices(ep.probe_entries(_epochs(spark, sf_dir)))
    return out.select("epoch_id", "name", "reference", "device_name", "channel_type", "channel")


@query(f"WITH {_PM}, c AS (SELECT DISTINCT daq, unnest([reference, reference + 1]) AS c FROM pm) SELECT daq, list(c::INTEGER ORDER BY c) AS channels FROM c GROUP BY daq")
def channel_inventory(spark, sf_dir):
    inventory = ep.channel_inventory(ep.channel_devices(ep.probe_entries(_epochs(spark, sf_dir))), ["daq"])
    return ep.channels_of_type(inventory, "ai").select("daq", "channels")


@query("SELECT o_orderkey AS pos, 'O' || o_orderkey AS epoch_id, coalesce((SELECT list(DISTINCT 'p' || l_partkey ORDER BY 'p' || l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'), []) AS elements FROM orders")
def elements_of_epochs(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), prefixed("O", "o_orderkey").alias("epoch_id"))
    have = table(spark, sf_dir, "lineitem").select(prefixed("o", "l_orderkey").alias("epoch_id"), prefixed("p", "l_partkey").alias("element_id"), F.col("l_returnflag").alias("type"))
    return ep.elements_of_epochs(asked, have, kind="R")


@query("SELECT 'c' || c_custkey AS element_id, e AS epoch_id, row_number() OVER (PARTITION BY c_custkey ORDER BY e)::INTEGER AS epoch_number FROM (SELECT c_custkey, 'n' || s_suppkey AS e FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal < 0 UNION ALL SELECT o_custkey, 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0)")
def element_epochs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(prefixed("c", "c_custkey").alias("element_id"), prefixed("x", "c_nationkey").alias("parent_id"), (F.col("c_acctbal") < 0).alias("direct"))
    parents = table(spark, sf_dir, "supplier").select(prefixed("x", "s_nationkey").alias("element_id"), prefixed("n", "s_suppkey").alias("epoch_id"))
    own = table(spark, sf_dir, "orders").select(prefixed("c", "o_custkey").alias("element_id"), prefixed("o", "o_orderkey").alias("epoch_id"))
    return ep.element_epochs(c, parents, own)


_S = "s AS (SELECT user_id AS epoch_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, value FROM events)"


@query(f"WITH {_S}, r(request, a, b) AS (VALUES (1, 30, 75), (2, 100, 1000000000)) SELECT request, epoch_id, sample_idx, round(2 + sample_idx / 10.0, 6) AS t, value FROM s, r WHERE sample_idx BETWEEN a AND b")
def read_by_time(spark, sf_dir):
    s = samples(spark, sf_dir)
    req = s.select("epoch_id", "channel").distinct().withColumns({"rate": F.lit(10.0), "start": F.lit(2.0)})
    req = req.withColumns({"request": F.lit(1), "t0": F.lit(5.0), "t1": F.lit(9.5)}).unionByName(req.withColumns({"request": F.lit(2), "t0": F.lit(12.0), "t1": F.lit(float("inf"))}))
    return ep.read_by_time(s, req).withColumn("t", F.round("t", 6)).select("request", "epoch_id", "sample_idx", "t", "value")


@query(f"WITH {_S} SELECT epoch_id, sample_idx, round(CASE WHEN epoch_id % 2 = 0 THEN 1 + sample_idx / 4.0 ELSE sample_idx * 0.5 END, 6) AS t, CASE WHEN epoch_id % 2 = 0 THEN value * 2 ELSE value END AS value FROM s WHERE epoch_id % 2 = 1 OR sample_idx < 1000000")
def element_series(spark, sf_dir):
    s = samples(spark, sf_dir).select("epoch_id", F.lit("raw").alias("channel"), "sample_idx", (F.col("sample_idx") * 0.5).alias("t"), "value")
    vector = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda x: x["value"] * 2)
    stored = s.where("epoch_id % 2 = 0").groupBy("epoch_id").agg(vector.alias("values")).select(F.lit("e").alias("element_id"), "epoch_id", F.lit(1.0).alias("start"), F.lit(4.0).alias("rate"), "values")
    element = spark.createDataFrame([("e", "raw")], "element_id string, parent_id string")
    return ep.element_series(element, stored, s).select("epoch_id", "sample_idx", F.round("t", 6).alias("t"), "value")


@query(f"WITH {_S}, d AS (SELECT *, sample_idx // 50 AS ep, sample_idx % 50 AS i FROM s), k AS (SELECT epoch_id, ep, count(*) AS n FROM d GROUP BY ALL), o AS (SELECT epoch_id, ep, coalesce(sum(n) OVER w, 0) AS before FROM k WINDOW w AS (PARTITION BY epoch_id ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT epoch_id AS owner, (i + before)::BIGINT AS sample_idx, round(i / 10.0 + before / 10.0, 6) AS t, value FROM d JOIN o USING (epoch_id, ep)")
def one_epoch(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.col("epoch_id").alias("owner"), F.floor(F.col("sample_idx") / 50).alias("epoch_id"), (F.col("sample_idx") % 50).alias("sample_idx"), "value")
    e = s.groupBy("owner", "epoch_id").agg(F.count("*").alias("n_samples")).withColumn("duration", F.col("n_samples") / 10.0).withColumn("epoch_number", F.col("epoch_id"))
    return ep.one_epoch(s.withColumn("t", F.col("sample_idx") / 10.0), e, ["owner"]).withColumn("t", F.round("t", 6))


@query("SELECT 'unit' AS name, 3::INTEGER AS reference, 'spikes' AS type, count(DISTINCT user_id) AS n_epochs, count(*)::BIGINT AS n_spikes FROM events WHERE event_type = 'click'")
def spikes_element(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(prefixed("u", "user_id").alias("epoch_id"), "event_type")
    return ep.spikes_element(e.where("event_type = 'click'"), e.select("epoch_id"), "unit", 3)


@query("SELECT 'c' || o_custkey AS daq, 'o' || o_orderkey AS epoch_id, md5('c' || o_custkey || '/o' || o_orderkey) AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey <> 1")
def ingest_missing_epochs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(prefixed("c", "o_custkey").alias("daq"), prefixed("o", "o_orderkey").alias("epoch_id"), "o_orderstatus", F.lit(None).cast(_CLOCKS).alias("clocks"))
    return ep.delete_epoch(ep.ingest_epochs(o, o.where("o_orderstatus = 'F'")), "o1").select("daq", "epoch_id", "id")


@query("SELECT 'c' || o_custkey AS daq, count(*) AS n_epochs, count(*) FILTER (o_orderstatus = 'F') AS n_ingested, count(*) = count(*) FILTER (o_orderstatus = 'F') AS complete FROM orders GROUP BY o_custkey")
def ingest_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(prefixed("c", "o_custkey").alias("daq"), prefixed("o", "o_orderkey").alias("epoch_id"), "o_orderstatus")
    return ep.ingest_status(o, o.where("o_orderstatus = 'F'"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS t1 FROM orders")
def ingested_clock(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", prefixed("c", "o_custkey").alias("daq"), prefixed("o", "o_orderkey").alias("epoch_id"), "o_orderstatus", F.array(F.struct(F.lit("utc").alias("clock"), F.lit(0.0).alias("t0"), F.col("o_totalprice").alias("t1"))).alias("clocks"))
    found = ep.ingested_entry(o.where("o_orderstatus = 'F'").drop("o_orderkey"), o.select("o_orderkey", "daq", "epoch_id"))
    return found.select("o_orderkey", ep.clock_range(F.col("clocks"), "utc")["t1"].alias("t1"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events w WHERE w.user_id = e.user_id AND w.event_type = 'purchase') OR EXISTS (SELECT 1 FROM events w WHERE w.user_id = e.user_id AND w.event_type = 'purchase' AND e.ts >= w.ts AND epoch_us(e.ts) < epoch_us(w.ts) + 86400000000)")
def valid_intervals(spark, sf_dir):
    from .inputs import seconds

    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("t"), "event_type")
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("t_on"), (F.col("t") + 86400).alias("t_off"))
    return ep.valid_events(e.select("event_id", "user_id", "t"), spans, ["user_id"]).select("event_id")


@query(f"WITH {_ORDERED} SELECT epoch_id, path, path LIKE 'epochid://%' AS ingested FROM (SELECT epoch_id, unnest(['/data/' || epoch_id || '.bin', 'epochid://' || epoch_id]) AS path FROM n WHERE epoch_number = 2)")
def epoch_files(spark, sf_dir):
    files = F.array(F.concat(F.lit("/data/"), "epoch_id", F.lit(".bin")), F.concat(F.lit("epochid://"), "epoch_id"))
    return ep.epoch_files(_ordered(spark, sf_dir).withColumn("files", files), number=2)


@query("SELECT grp AS \"group\", CASE WHEN grp % 2 = 0 THEN 'side' || grp ELSE 'nav_' || md5('a' || grp || chr(10) || 'b' || grp) END AS epoch_id, row_number() OVER (ORDER BY CASE WHEN grp % 2 = 0 THEN 'side' || grp ELSE 'nav_' || md5('a' || grp || chr(10) || 'b' || grp) END)::INTEGER AS epoch_number FROM (SELECT s_suppkey AS grp FROM supplier)")
def navigator_epochs(spark, sf_dir):
    g = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("group"))
    groups = g.withColumn("files", F.array(prefixed("b", "group"), prefixed("a", "group")))
    side = g.where("group % 2 = 0").withColumn("text", F.concat(F.lit(" side"), F.col("group").cast("string"), F.lit(" ")))
    return ep.navigator_epochs(groups, side, "nav").select("group", "epoch_id", "epoch_number")


@query("WITH t(short, full_name, kind, bits) AS (VALUES ('ai', 'analog_in', 'float64', 64), ('AO', 'analog_out', 'float64', 64), ('di', 'digital_in', 'uint8', 8), ('do', 'digital_out', 'uint8', 8), ('ax', 'auxiliary_in', 'float64', 64), ('aux', 'auxiliary_in', 'float64', 64), ('t', 'time', 'float64', 64), ('e', 'event', 'float64', 64), ('mk', 'marker', 'float64', 64), ('tx', 'text', 'float64', 64), ('odd', 'odd', NULL, NULL)) SELECT r_regionkey, short, full_name, kind, bits::INTEGER AS bits FROM region, t")
def channel_storage(spark, sf_dir):
    each = table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*[F.lit(x) for x in ("ai", "AO", "di", "do", "ax", "aux", "t", "e", "mk", "tx", "odd")])).alias("short"))
    kept = each.withColumn("full_name", signals.standard_type(F.col("short"))).withColumn("s", signals.storage_type(F.col("full_name")))
    return kept.select("r_regionkey", "short", "full_name", "s.kind", "s.bits")


_INVENTORY = """w AS (SELECT user_id, event_id, value, user_id % 3 + 1 AS number, (CASE WHEN user_id % 4 = 0 THEN 0.0 ELSE (user_id % 4) * 12.5 END)::DOUBLE AS rate FROM events)"""


def _inventory(spark, sf_dir):
    u = F.col("user_id")
    e = table(spark, sf_dir, "events")
    each = e.select("user_id").distinct().withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(3))))
    rate = F.when(u % 4 == 0, 0.0).otherwise((u % 4) * 12.5)
    known = each.select(u.alias("epoch_id"), F.lit("analog_in").alias("type"), "number", rate.alias("rate"), F.lit(1.5).alias("offset"), (F.col("number") * 0.5).alias("scale"))
    wanted = e.select(u.alias("epoch_id"), "event_id", F.lit("ai").alias("type"), (u % 3 + 1).cast("int").alias("number"), "value")
    return known, wanted


@query(f"WITH {_INVENTORY} SELECT event_id, rate, 1.5::DOUBLE AS offset, number * 0.5::DOUBLE AS scale FROM w")
def channel_rates(spark, sf_dir):
    known, wanted = _inventory(spark, sf_dir)
    return signals.channel_facts(wanted, known).select("event_id", "rate", "offset", "scale")


@query(f"WITH {_INVENTORY} SELECT event_id, CASE WHEN rate > 0 THEN round_even(value * rate, 0) ELSE 'nan'::DOUBLE END AS sample FROM w")
def probe_times_to_samples(spark, sf_dir):
    known, wanted = _inventory(spark, sf_dir)
    return signals.probe_samples(wanted.withColumnRenamed("value", "t"), known).select("event_id", "sample")


@query(f"WITH {_INVENTORY} SELECT event_id, CASE WHEN rate > 0 THEN round(event_id / rate, 6) ELSE 'nan'::DOUBLE END AS t FROM w")
def probe_samples_to_times(spark, sf_dir):
    known, wanted = _inventory(spark, sf_dir)
    return signals.probe_times(wanted.withColumn("sample", F.col("event_id")), known).select("event_id", F.round("t", 6).alias("t"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'class.one' WHEN 1 THEN 'class.two' END AS classname FROM nation")
def probe_classes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    kind = F.concat(F.lit("type"), (F.col("n_nationkey") % 3).cast("string"))
    types = n.where("n_nationkey < 2").select(F.concat(F.lit("type"), "n_nationkey").alias("type"), F.when(F.col("n_nationkey") == 0, "class.one").otherwise("class.two").alias("classname"))
    return ep.probe_classes(n.select(F.col("n_nationkey").alias("id"), kind.alias("type")), types).select("id", "classname")


@query("SELECT 'x' AS app_id, 'r' || r_regionkey AS region, 'n' || n_nationkey AS nation FROM region, nation WHERE n_name LIKE '%A%' AND n_nationkey < 10")
def calculator_inputs(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "region", "nation")
    nations = Query().isa("nation") & Query("base.name").contains("A")
    return calc.input_sets(docs, {"app_id": "x"}, {"region": Query().isa("region"), "nation": nations}, {"nation": Query("nation.n_nationkey") < 10})


@query("SELECT 'n' || n_nationkey AS id, 'new' AS name, n_regionkey::VARCHAR AS region, lower(n_name) AS deep, n_name AS kept FROM nation")
def set_paths(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "nation")
    get = lambda path: F.try_variant_get("body", path, "string")
    lower, region = F.lower(get("$.nation.n_name")), get("$.nation.n_regionkey")
    out = doctables.set_paths(docs, {"base.name": F.lit("new"), "other.region": region, "nation.more.name": lower})
    return out.select("id", "name", get("$.other.region").alias("region"), get("$.nation.more.name").alias("deep"), get("$.nation.n_name").alias("kept"))
