"""Queries over tables: row filters, joins, aggregates, calculators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import calc, summaries, tables
from tessera.operators.epochs import matches_given

from .inputs import query, table


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#12' AND p_size >= 10")
def rows_match_ignorecase(spark, sf_dir):
    p = tables.match_rows(table(spark, sf_dir, "part"), ["p_brand"], ["BRAND#12"], text="ignoreCase")
    return tables.match_rows(p, ["p_size"], [10], number="ge").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'S(TEEL|MALL)')")
def rows_match_pattern(spark, sf_dir):
    return tables.match_rows(table(spark, sf_dir, "part"), ["p_type"], ["S(TEEL|MALL)"], text="contains").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL AND c_mktsegment <> 'BUILDING'")
def rows_valid(spark, sf_dir):
    c = tables.valid_rows(table(spark, sf_dir, "customer"), ["c_acctbal", "not_there"])
    return tables.valid_rows(c, ["c_mktsegment"], "BUILDING").select("c_custkey")


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND value BETWEEN 10 AND 90")
def findepochnode_wildcard(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(matches_given({"event_type": "purchase", "user_id": None}))
    return e.where(F.col("value").between(10, 90)).select("event_id")


@query("SELECT c_custkey, c_nationkey, n_name, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_natural_fold(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return tables.natural_join([c, n, r]).select("c_custkey", "c_nationkey", "n_name", "n_regionkey", "r_name")


@query("SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS n_name FROM nation GROUP BY n_regionkey")
def join_collapse(spark, sf_dir):
    return tables.collapse(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), ["n_regionkey"])


@query("WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS o_orderpriority FROM f GROUP BY o_custkey")
def collapse_first_seen(spark, sf_dir):
    return tables.collapse(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderkey")


@query("SELECT coalesce(a.k, b.k)::INTEGER AS k, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k")
def join_outer_fold(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return tables.outer_join([c, s])


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def vstack_dissimilar(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return tables.move_left(tables.stack([c, s]), ["balance", "none"])


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def cartesian_inputs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return tables.combinations([table(spark, sf_dir, "region").select("r_regionkey"), n])


@query("SELECT l_returnflag, l_linestatus, l_shipmonth, round(avg(l_quantity) + 1e-7, 4) AS mean, count(*) AS n FROM (SELECT *, month(l_shipdate)::INTEGER AS l_shipmonth FROM lineitem) GROUP BY ALL")
def grouped_mean3(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate"))
    return tables.grouped_mean(li, ["l_returnflag", "l_linestatus", "l_shipmonth"], "l_quantity").withColumn("mean", F.round(F.col("mean") + 1e-7, 4))


@query("""WITH m AS (SELECT l_suppkey, l_linestatus, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS A, avg(l_extendedprice) FILTER (l_returnflag = 'N') AS N, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_linestatus, round(100 * (A - N) / N, 4) AS cued, round(100 * (N - R) / R, 4) AS not_cued FROM m""")
def fear_percentages(spark, sf_dir):
    m = tables.pivot_mean(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linestatus"], "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    pct = lambda a, b: F.round(tables.percent_change(F.col(a), F.col(b)), 4)
    return m.select("l_suppkey", "l_linestatus", pct("A", "N").alias("cued"), pct("N", "R").alias("not_cued"))


_NET = "l_extendedprice - l_discount"


# Prices end in whole hundredths, so means lie on rounding borders; the small summand keeps both engines off them.
@query(f"SELECT l_partkey, l_returnflag, count(*) AS n, round(avg({_NET}) + 1e-7, 4) AS mean, round(stddev_samp({_NET}) + 1e-7, 4) AS stddev, round(stddev_samp({_NET}) / sqrt(count(*)) + 1e-7, 4) AS stderr FROM lineitem GROUP BY ALL")
def tuning_curve_stats(spark, sf_dir):
    out = calc.tuning_curve(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_discount", ["l_partkey"])
    return out.select("l_partkey", "l_returnflag", "n", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("mean", "stddev", "stderr")])


@query("WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice - l_discount) AS v FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, round(v + 1e-7, 4) AS best_value FROM m QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, l_returnflag) = 1")
def best_stimulus(spark, sf_dir):
    out = calc.best_stimulus(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_discount", keys=["l_suppkey"])
    return out.withColumn("best_value", F.round(F.col("best_value") + 1e-7, 4))


@query("SELECT p_brand, min(p_partkey) AS first_seen FROM part GROUP BY p_brand")
def property_values(spark, sf_dir):
    return calc.property_values(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'compute' WHEN o_orderpriority <> '1-URGENT' THEN 'keep' ELSE 'replace' END AS todo FROM orders")
def calc_run_policy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("parameters"))
    old = o.where("o_orderstatus = 'F'").withColumn("parameters", F.when(F.col("parameters") == "1-URGENT", "other").otherwise(F.col("parameters")))
    return calc.run_policy(o, old, ["o_orderkey"], "REPLACE_IF_DIFFERENT").select("o_orderkey", "todo")


@query("SELECT p_partkey, round(2 * p_size ** 2 + 3 * exp(-(p_size / 10.0)) - p_retailprice / 7, 4) AS y FROM part")
def fit_curve(spark, sf_dir):
    names = {"a": F.lit(2.0), "b": F.lit(3.0), "x": F.col("p_size").cast("double"), "c": F.col("p_retailprice")}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(calc.curve("y = a*x^2 + b*exp(-(x/10)) - c/7", names), 4).alias("y"))


@query("SELECT p_partkey, round(CASE WHEN p_size > 25 THEN p_retailprice * 2 + 1 WHEN p_size > 0 THEN 1.0 / p_size END, 6) AS tf FROM part")
def stimulus_frequency(spark, sf_dir):
    params = F.create_map(F.when(F.col("p_size") > 25, "tf").otherwise("none"), F.col("p_retailprice").cast("string"), F.lit("period"), F.col("p_size").cast("string"))
    rules = [{"name": "tf", "multiplier": 2.0, "adder": 1.0}, {"name": "period", "is_period": True}]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(calc.temporal_frequency(params, rules), 6).alias("tf"))


@query("SELECT presentation::BIGINT AS presentation, presentation % 3 + 1 AS stimulus, presentation * 15.0::DOUBLE AS t_on, presentation * 15.0::DOUBLE + 10 AS t_off FROM range(15) r(presentation)")
def mock_stimulus_train(spark, sf_dir):
    return calc.stimulus_train(spark, 3, 5)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def page_slice(spark, sf_dir):
    return tables.page(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 3, 50).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_per_key(spark, sf_dir):
    return tables.top_rows(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE ends_with(lower(c_name), '7')")
def viewer_filter(spark, sf_dir):
    return tables.text_filter(table(spark, sf_dir, "customer"), "c_name", "7", "ends").select("c_custkey")


@query("SELECT needle, c_name FROM customer JOIN (VALUES ('#000000012'), ('R#00000004')) t(needle) ON contains(lower(c_name), lower(needle))")
def viewer_search_ids(spark, sf_dir):
    needles = spark.createDataFrame([("#000000012",), ("R#00000004",)], "needle string")
    return tables.search_ids(table(spark, sf_dir, "customer"), needles, "c_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return summaries.cube_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_partkey", "parts")


_CLEAN = "list_filter(string_split(regexp_replace(regexp_replace({c}, '[:-]', '_', 'g'), '[^A-Za-z0-9_]', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(j, '^[A-Za-z]') THEN j WHEN j = '' THEN '' ELSE 'var_' || j END AS name FROM (SELECT p_partkey, array_to_string(list_transform({_CLEAN.format(c='p_name')}, lambda w: upper(w[1]) || w[2:]), '') AS j FROM part)")
def name_to_variable(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.variable_name(F.col("p_name")).alias("name"))


@query("SELECT s_suppkey, regexp_extract(n, '^([^0-9]+)', 1) AS prefix, CAST(regexp_extract(n, '([0-9]+)$', 1) AS INTEGER) AS number FROM (SELECT s_suppkey, 'ch' || s_suppkey AS n FROM supplier)")
def channel_split(spark, sf_dir):
    n = F.concat(F.lit("ch"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.channel_prefix(n).alias("prefix"), scalars.channel_number(n).alias("number"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_quantity > 10), i AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM d),
s AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM i GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS runs FROM s GROUP BY l_orderkey""")
def channel_compact(spark, sf_dir):
    return scalars.compact_runs(table(spark, sf_dir, "lineitem").where("l_quantity > 10"), ["l_orderkey"], "l_linenumber")


@query("SELECT s_suppkey, n::INTEGER AS number, 'ai' AS type FROM supplier, LATERAL (SELECT unnest(range(s_nationkey, s_nationkey + 4)) AS n) UNION ALL SELECT s_suppkey, 9::INTEGER, 'di' FROM supplier UNION ALL SELECT s_suppkey, 2::INTEGER, 'aep_t2.5' FROM supplier")
def device_parse(spark, sf_dir):
    k = F.col("s_nationkey")
    text = F.concat(F.lit("dev:ai"), k.cast("string"), F.lit("-"), (k + 3).cast("string"), F.lit(","), (k + 1).cast("string"), F.lit(";di9;aep2_t2.5"))
    each = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(scalars.device_channels(text)).alias("c"))
    return each.select("s_suppkey", "c.number", "c.type")


@query("SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def id_valid(spark, sf_dir):
    good = F.concat(F.lpad(F.hex("event_id"), 16, "0"), F.lit("_"), F.lpad(F.hex("user_id"), 16, "a"))
    text = F.when(F.col("event_id") % 3 == 0, F.substring(good, 2, 40)).otherwise(good)
    return table(spark, sf_dir, "events").select("event_id", scalars.is_id(text).alias("ok"))


@query("SELECT o_orderkey, o_orderstatus <> 'F' AS ok FROM orders")
def is_iso8601(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.is_iso8601(text).alias("ok"))


@query("SELECT c_custkey, 'c_acctbal' AS path, 'negative' AS error FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_name', 'ends in 3' FROM customer WHERE c_name LIKE '%3'")
def validate_rules(spark, sf_dir):
    rules = [("c_acctbal", F.col("c_acctbal") >= 0, "negative"), ("c_name", ~F.col("c_name").endswith("3"), "ends in 3")]
    return scalars.check_rules(table(spark, sf_dir, "customer"), "c_custkey", rules)


@query("SELECT c_custkey, r_name AS term_name FROM customer LEFT JOIN region ON c_nationkey = r_regionkey")
def ontology_lookup(spark, sf_dir):
    terms = table(spark, sf_dir, "region").select(F.lit("REG").alias("prefix"), F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    rows = table(spark, sf_dir, "customer").withColumn("term", F.concat(F.lit("reg:"), F.col("c_nationkey").cast("string")))
    return scalars.lookup_terms(rows, "term", terms).select("c_custkey", "term_name")


@query("SELECT c_custkey, '{\"a\":NaN,\"b\":\"' || c_mktsegment || '\"}' AS text FROM customer")
def json_rehydrate(spark, sf_dir):
    text = F.concat(F.lit('{"a":"__NaN__","b":"'), F.col("c_mktsegment"), F.lit('"}'))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.rehydrate(text).alias("text"))


@query("SELECT p_partkey, hex(p_name[1:16]) AS first_row, ceil(strlen(p_name) / 16.0)::INTEGER AS n_rows FROM part")
def hex_dump(spark, sf_dir):
    rows = scalars.hex_rows(F.col("p_name").cast("binary"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(rows, 0)["hex"].alias("first_row"), F.size(rows).alias("n_rows"))
