"""Queries over tables made of documents, searches within bodies, subjects, sessions, datasets and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import calc, clocks, diffs, doctables, graph, store, summaries, tables
from tessera.operators.query import Query, search

from .inputs import entity_documents, event_documents, prefixed, query, seconds, table


@query("SELECT 'c' || c_custkey AS id, c_name, round(c_acctbal * 2, 2) AS doubled, 'x' AS note FROM customer")
def set_properties(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer")
    bal = F.try_variant_get("body", "$.customer.c_acctbal", "double")
    docs = doctables.set_properties(docs, "customer", {"c_acctbal": F.round(bal * 2, 2)})
    docs = doctables.set_properties(docs, "extra", {"note": F.lit("x")})
    read = lambda p, t: F.try_variant_get("body", p, t)
    return docs.select("id", read("$.customer.c_name", "string").alias("c_name"), F.round(read("$.customer.c_acctbal", "double"), 2).alias("doubled"), read("$.extra.note", "string").alias("note"))


@query("SELECT 'n' || n_nationkey AS id, n_name AS nation_n_name, CAST(n_nationkey AS VARCHAR) AS nation_n_nationkey, CAST(n_regionkey AS VARCHAR) AS nation_n_regionkey, NULL AS region_r_name, NULL AS region_r_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, NULL, NULL, r_name, CAST(r_regionkey AS VARCHAR) FROM region")
def documents_table(spark, sf_dir):
    return doctables.documents_table(entity_documents(spark, sf_dir, "nation", "region"))


def _ontology(spark, sf_dir):
    """Parts as rows of ontology tables; the variables that a row has depend on its size."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    two = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), size)
    one = F.create_map(F.lit("type"), F.col("p_type"))
    none = F.create_map().cast("map<string,string>")
    names = F.when(F.col("p_size") % 3 == 0, "size,brand").when(F.col("p_size") % 3 == 1, "brand,size").otherwise("type")
    data = F.when(F.col("p_size") > 45, none).when(F.col("p_size") % 3 == 2, one).otherwise(two)
    return store.make_documents(
        p, F.lpad(F.col("p_partkey").cast("string"), 9, "0"), "ontologyTableRow", ["base"], store.edge_list(store.edge("subject_id", F.col("p_brand"))), session=F.col("p_type"),
        section={"variableNames": names, "data": F.call_function("to_variant_object", data)},
    )


_ONT = "o AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_type AS session_id, p_brand, p_size, p_type, p_size % 3 = 2 AS one FROM part WHERE p_size <= 45), g AS (SELECT one, row_number() OVER (ORDER BY min(id))::INTEGER AS grp FROM o GROUP BY one)"


@query(f"WITH {_ONT} SELECT grp, id, session_id, p_brand AS dependency, CASE WHEN one THEN NULL ELSE p_brand END AS brand, CASE WHEN one THEN p_type END AS type FROM o JOIN g USING (one)")
def ontology_tables(spark, sf_dir):
    rows = doctables.ontology_tables(_ontology(spark, sf_dir))
    named = rows.select("grp", "id", "session_id", "dependency")
    return named.join(doctables.stacked_ontology_table(rows, ["brand", "type"]), ["grp", "id"])


@query(f"WITH {_ONT} SELECT id, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM o JOIN g USING (one) WHERE grp = (SELECT grp FROM g WHERE NOT one)")
def ontology_table(spark, sf_dir):
    rows = doctables.ontology_tables(_ontology(spark, sf_dir))
    grp = rows.where(F.array_contains("variables", "brand")).agg(F.min("grp")).first()[0]
    return doctables.ontology_table(rows, grp or 0, ["brand", "size"])


@query("SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS depends_on, c_name, c_mktsegment FROM customer")
def openminds_table(spark, sf_dir):
    return doctables.typed_table(entity_documents(spark, sf_dir, "customer", "nation"), "customer", ["c_name", "c_mktsegment"])


@query("SELECT 'p' || p_partkey AS id, p_brand AS subject_id, p_name AS name FROM part")
def treatment_table(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    docs = store.make_documents(p, prefixed("p", "p_partkey"), "treatment", ["base"], store.edge_list(store.edge("other", F.lit("z")), store.edge("subject_id", F.col("p_brand"))), section={"name": F.col("p_name"), "mixtureText": F.col("p_type")})
    return doctables.treatment_table(docs, ["name", "mixtureText"])


@query("SELECT 'e' || event_id AS id, json_extract_string(props, '$.k') AS k FROM events WHERE json_exists(props, '$.k')")
def path_rows(spark, sf_dir):
    t = doctables.path_table(event_documents(spark, sf_dir))
    return t.where("path = 'event.props.k'").select("id", F.col("text").alias("k"))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE contains(lower(c_mktsegment), 'build')")
def content_search(spark, sf_dir):
    return doctables.content_search(entity_documents(spark, sf_dir, "customer", "nation"), "C_MKTSEGMENT", "Build")


@query("SELECT 's' || s_suppkey AS id FROM supplier")
def field_name_search(spark, sf_dir):
    return doctables.field_name_search(entity_documents(spark, sf_dir, "customer", "supplier", "nation"), "S_AcctBal")


def _with_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    where = lambda n: F.struct(prefixed(f"u{n}", "o_orderkey").alias("uid"), prefixed("/data/", "o_orderkey").alias("location"), (F.col("o_orderkey") % 2 == 0).alias("ingest"), (F.col("o_orderkey") % 3 == 0).alias("delete_original"))
    body = F.struct(F.struct(F.array(F.struct(F.lit("a.bin").alias("name"), F.array(where(1), where(2)).alias("locations"))).alias("file_info")).alias("files"))
    docs = store.make_documents(o, prefixed("o", "o_orderkey"), "orders", ["record"], session=F.col("o_orderpriority"))
    return docs.drop("body").join(o.select(prefixed("o", "o_orderkey").alias("id"), F.call_function("to_variant_object", body).alias("body")), "id").select(*docs.columns)


@query("SELECT 'o' || o_orderkey AS id, 'u' || n || o_orderkey AS uid FROM orders, range(1, 3) r(n)")
def file_uids(spark, sf_dir):
    return doctables.file_rows(_with_files(spark, sf_dir)).select("id", "uid")


@query("SELECT 'o5' AS id")
def find_by_uid(spark, sf_dir):
    return doctables.find_uid(_with_files(spark, sf_dir), "u25").select("id")


@query("SELECT DISTINCT 'u' || n || o_orderkey AS uid FROM orders, range(1, 3) r(n)")
def location_uids(spark, sf_dir):
    return summaries.location_uids(_with_files(spark, sf_dir))


@query("SELECT 'o' || o_orderkey AS id, 'u' || n || o_orderkey AS uid, a AS action FROM orders, range(1, 3) r(n), (VALUES ('copy'), ('delete')) t(a) WHERE a = 'copy' AND o_orderkey % 2 = 0 OR a = 'delete' AND o_orderkey % 3 = 0")
def ingest_plan(spark, sf_dir):
    from tessera.sources import files

    return files.ingest_plan(_with_files(spark, sf_dir)).select("id", "uid", "action")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['a', 'b1', 'b2'] ELSE ['b1', 'b2'] END AS names, 2::INTEGER AS places, o_orderkey % 2 = 0 AS has_a, true AS has_b FROM orders")
def file_bookkeeping(spark, sf_dir):
    none = F.array().cast("array<struct<name:string,locations:array<struct<uid:string,location:string,ingest:boolean,delete_original:boolean>>>>")
    add = lambda f, name: doctables.add_file(f, F.lit(name), F.lit("/x"), F.lit("u"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", add(none, "a").alias("f"))
    for name in ("a", "b#", "b#"):
        o = o.withColumn("f", add(F.col("f"), name))
    o = o.withColumn("places", F.size(F.get("f", 0)["locations"]))
    o = o.withColumn("f", F.when(F.col("o_orderkey") % 2 == 1, doctables.remove_file(F.col("f"), F.lit("a"))).otherwise(F.col("f")))
    return o.select("o_orderkey", F.transform("f", lambda x: x["name"]).alias("names"), "places", doctables.has_file(F.col("f"), F.lit("a")).alias("has_a"), doctables.has_file(F.col("f"), F.lit("b#")).alias("has_b"))


@query("SELECT 'e' || event_id AS id FROM events WHERE user_id = 5 AND event_type = 'click'")
def documents_of_element_epoch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    docs = store.make_documents(e, prefixed("e", "event_id"), "response", ["base"], store.edge_list(store.edge("element_id", prefixed("u", "user_id"))))
    docs = doctables.set_properties(docs.join(e.select(prefixed("e", "event_id").alias("id"), "event_type"), "id"), "epochid", {"epochid": F.col("event_type")})
    return doctables.of_element_epoch(docs, "u5", "click", "response").select("id")


@query("SELECT 'n' || n_nationkey AS id FROM nation")
def ingested_documents(spark, sf_dir):
    n = store.make_documents(table(spark, sf_dir, "nation"), prefixed("n", "n_nationkey"), "epochfiles_ingested", ["base"])
    return doctables.ingested_documents(n.unionByName(entity_documents(spark, sf_dir, "customer"))).select("id")


@query("SELECT 'c' || c_custkey AS root, 'r' || n_regionkey AS probe, 's' || s_suppkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey % 5 = n_regionkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 's' || s_suppkey FROM nation JOIN supplier ON s_nationkey % 5 = n_regionkey UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 's' || s_suppkey FROM region JOIN supplier ON s_nationkey % 5 = r_regionkey")
def probe_location(spark, sf_dir):
    none = F.lit(None).cast("string").alias("underlying")
    e = table(spark, sf_dir, "customer").select(prefixed("c", "c_custkey").alias("id"), prefixed("n", "c_nationkey").alias("underlying"))
    e = e.unionByName(table(spark, sf_dir, "nation").select(prefixed("n", "n_nationkey").alias("id"), prefixed("r", "n_regionkey").alias("underlying"))).unionByName(table(spark, sf_dir, "region").select(prefixed("r", "r_regionkey").alias("id"), none))
    at = table(spark, sf_dir, "supplier").select(prefixed("s", "s_suppkey").alias("id"), F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string")).alias("probe"))
    return doctables.probe_locations(e, at)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'c' || o_custkey END AS subject_id FROM orders")
def subject_match(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 3 == 0, prefixed("c", "o_custkey")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("sub"), F.col("o_custkey").cast("string"), F.lit("@lab"))).otherwise("nobody@lab")
    o = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("subject"))
    s = table(spark, sf_dir, "customer").select(prefixed("c", "c_custkey").alias("id"), F.concat(F.lit("sub"), F.col("c_custkey").cast("string"), F.lit("@lab")).alias("local_identifier"))
    return doctables.match_subjects(o, s).select("o_orderkey", "subject_id")


@query("SELECT p_partkey AS id, 'mix' || b.n_nationkey AS mixture FROM part JOIN nation b ON p_size = b.n_nationkey")
def mixture_match(spark, sf_dir):
    part = lambda n, v: F.struct(F.lit("o").alias("ontologyName"), F.lit(n).alias("name"), v.cast("string").alias("value"), F.lit(None).cast("string").alias("ontologyUnit"), F.lit("mM").alias("unitName"))
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(part("NaCl", F.col("p_size")), part("KCl", F.lit(1))).alias("components"))
    d = table(spark, sf_dir, "nation").select(prefixed("mix", "n_nationkey").alias("name"), F.array(part("KCl", F.lit(1)), part("NaCl", F.col("n_nationkey"))).alias("components"))
    return doctables.match_mixtures(a, d)


@query("SELECT md5('c' || c_custkey || '/' || k) AS id, k AS class_name, CASE k WHEN 'species' THEN c_mktsegment WHEN 'strain' THEN c_name ELSE 'f' END AS name, 'c' || c_custkey AS subject_id FROM customer, (VALUES ('species'), ('strain'), ('sex')) t(k) WHERE k <> 'sex' OR c_acctbal < 0")
def subject_documents(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(prefixed("c", "c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("species"), F.col("c_name").alias("strain"), F.when(F.col("c_acctbal") < 0, "f").alias("sex"))
    return doctables.subject_documents(s).select("id", "class_name", "name", graph.dependency_value("subject_id").alias("subject_id"))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_name = 'Customer#000000007'")
def self_query(spark, sf_dir):
    return search(entity_documents(spark, sf_dir, "customer", "nation"), doctables.self_query("customer", base__name="Customer#000000007")).select("id")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 500 AND c_mktsegment = 'BUILDING'")
def query_methods(spark, sf_dir):
    bal = Query("customer.c_acctbal")
    q = bal.greater_than_or_equal(0) & bal.less_than_or_equal(500) & ~(bal.less_than(0) | bal.greater_than(500)) & Query("customer.c_mktsegment").equals("BUILDING")
    return search(entity_documents(spark, sf_dir, "customer"), q).select("id")


@query("SELECT 'c' || c_custkey AS id FROM customer")
def query_all_none(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer")
    back = Query.of_search((Query.all() | Query.none()).to_search())
    return search(docs, back & Query.from_search("base.name", "~exact_string", "nobody")).select("id")


_SUM = "SELECT c_mktsegment AS session_id, count(*) AS n_documents FROM customer GROUP BY 1"


_MIXED = "d AS (SELECT o_orderpriority AS session_id, 'o' || o_orderkey AS name, CASE o_orderkey % 4 WHEN 0 THEN 'probe' WHEN 1 THEN 'daqsystem' ELSE 'orders' END AS kind FROM orders)"


def _mixed(spark, sf_dir):
    """Sessions with recorders, probes and other documents, which have a file each."""
    k = F.substring("id", 2, 20).cast("long") % 4
    kind = F.when(k == 0, "probe").when(k == 1, "daqsystem").otherwise("orders")
    return _with_files(spark, sf_dir).withColumn("class_name", kind).withColumn("name", F.col("id"))


@query(f"""WITH {_MIXED} SELECT session_id, count(*) AS n_documents, list(DISTINCT kind ORDER BY kind) AS classes, list(name ORDER BY name) FILTER (kind = 'daqsystem') AS daqs,
list(name ORDER BY name) FILTER (kind = 'probe') AS probes, count(*) AS files FROM d GROUP BY session_id""")
def session_summary(spark, sf_dir):
    return summaries.session_summary(_mixed(spark, sf_dir))


@query(f"WITH {_MIXED} SELECT count(DISTINCT session_id) AS n_sessions, count(*)::BIGINT AS n_documents, list(DISTINCT kind ORDER BY kind) AS classes FROM d")
def dataset_summary(spark, sf_dir):
    return summaries.dataset_summary(summaries.session_summary(_mixed(spark, sf_dir)))


@query("SELECT c_mktsegment AS session_id, 'probes' AS field, 'different' AS status FROM customer WHERE c_acctbal < 0 GROUP BY 1 UNION ALL SELECT c_mktsegment, 'n_documents', 'different' FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def summary_compare(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer").withColumn("class_name", F.lit("probe"))
    less = store.remove(docs, Query("customer.c_acctbal") < 0)
    a, b = summaries.session_summary(docs), summaries.session_summary(less)
    return summaries.compare_summaries(a, b, ["n_documents", "classes", "daqs", "probes", "files"], ["files"])


@query("SELECT c_mktsegment AS session_id, 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'only_left' ELSE 'different' END AS status FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def dataset_diff(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer").withColumn("bal", F.try_variant_get("body", "$.customer.c_acctbal", "double"))
    right = docs.where("bal >= 0").withColumn("name", F.when(F.col("bal") > 9000, "other").otherwise(F.col("name"))).drop("bal")
    return diffs.dataset_diff(docs.drop("bal"), right)


@query("SELECT c_mktsegment AS session_id, c_mktsegment = 'BUILDING' AS is_linked FROM (SELECT DISTINCT c_mktsegment FROM customer UNION SELECT 'BUILDING' UNION SELECT 'GHOST')")
def session_entries(spark, sf_dir):
    entries = spark.createDataFrame([("BUILDING", True), ("GHOST", False)], "session_id string, is_linked boolean")
    return store.session_entries(entries, entity_documents(spark, sf_dir, "customer"))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING'")
def foreign_documents(spark, sf_dir):
    return store.foreign_documents(entity_documents(spark, sf_dir, "customer", "nation"), "BUILDING").select("id")


@query("SELECT c_mktsegment AS session_id, count(*) AS n FROM customer GROUP BY 1")
def session_counts(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer")
    return store.id_counts(store.routed(docs.select("session_id"), docs))


@query("SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey >= 10")
def store_add_named(spark, sf_dir):
    n = entity_documents(spark, sf_dir, "nation")
    key = F.substring("id", 2, 9).cast("int")
    return store.add_named(n.where(key < 10), n.where(key >= 10)).select("id", "name")


@query("WITH i AS (SELECT user_id, event_id, event_type, ts, CAST(floor(value) AS BIGINT) AS b FROM events), c AS (SELECT *, sum(b) OVER (PARTITION BY user_id) + 100 - 500 AS short, coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i) SELECT user_id, event_id FROM c WHERE short > 0 AND before < short")
def cache_evictions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("key"), F.col("event_type").alias("priority"), seconds("ts").alias("t"), F.floor("value").alias("bytes"))
    return store.evictions(e, 100, 500, keys=["user_id"]).select("user_id", F.col("key").alias("event_id"))


@query("SELECT 'c' || c_custkey AS id, 'customer.c_acctbal' AS path, 'range' AS error FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'c' || c_custkey, 'customer.c_phone', 'missing' FROM customer UNION ALL SELECT 'c' || c_custkey, 'nation_id', 'dangling' FROM customer WHERE c_nationkey >= 20 UNION ALL SELECT 'c' || c_custkey, 'customer.c_name', 'type' FROM customer")
def validate_documents(spark, sf_dir):
    rows = [("entity", "customer.c_acctbal", "double", 0.0, None, True), ("customer", "customer.c_phone", "string", None, None, True), ("customer", "nation_id", "dependency", None, None, True), ("customer", "customer.c_name", "integer", None, None, False), ("customer", "customer.c_fax", "string", None, None, False)]
    rules = spark.createDataFrame(rows, "class_name string, path string, type string, low double, high double, required boolean")
    known = entity_documents(spark, sf_dir, "nation").where(F.substring("id", 2, 9).cast("int") < 20)
    return doctables.validate_documents(entity_documents(spark, sf_dir, "customer"), rules, known.select("id"))


_LINES = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag, l_linestatus) AS k FROM lineitem),
r AS (SELECT 'l' || l_orderkey || '_' || l_linenumber AS id, CASE l_returnflag WHEN 'R' THEN 'mean' WHEN 'A' THEN 'F1' ELSE 'F2' END AS response_type, l_partkey FROM l WHERE k = 1)"""


def _responses(spark, sf_dir):
    """A response of each order line; where a line comes twice, of its first row in a stated order."""
    kind = F.when(F.col("l_returnflag") == "R", "mean").when(F.col("l_returnflag") == "A", "F1").otherwise("F2")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    li = tables.top_rows(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_returnflag", "l_linestatus"]).withColumn("response_type", kind)
    return store.make_documents(li, prefixed("l", "l_orderkey", "l_linenumber"), "stimulus_response_scalar", ["base"], store.edge_list(store.edge("element_id", prefixed("p", "l_partkey"))), section={"response_type": F.col("response_type"), "log": F.col("l_linestatus")})


@query(f"WITH {_LINES} SELECT id, response_type FROM r WHERE response_type IN ('mean', 'F1')")
def default_parameters(spark, sf_dir):
    found = search(_responses(spark, sf_dir), calc.default_parameters_query())
    return found.select("id", F.try_variant_get("body", "$.stimulus_response_scalar.response_type", "string").alias("response_type"))


@query("SELECT 'n' || n_nationkey AS depends_on_id, md5('simple/n' || n_nationkey) AS id, 5.0::DOUBLE AS answer FROM nation")
def simple_calculator(spark, sf_dir):
    return calc.simple_answer(entity_documents(spark, sf_dir, "nation"), 5.0)


@query("SELECT 't' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS log FROM part")
def tuning_curve_log(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r = store.make_documents(p, prefixed("r", "p_partkey"), "stimulus_response_scalar", ["base"], section={"log": F.col("p_brand")})
    edge = store.edge("stimulus_response_scalar_id", F.when(F.col("p_partkey") % 2 == 0, prefixed("r", "p_partkey")))
    t = store.make_documents(p, prefixed("t", "p_partkey"), "stimulus_tuningcurve", ["base"], store.edge_list(edge))
    return calc.tuning_curve_log(r, t)


@query(f"WITH {_LINES} SELECT id FROM r WHERE l_partkey = 7")
def tuning_curves_of(spark, sf_dir):
    return calc.tuning_curves_of(_responses(spark, sf_dir), "p7").select("id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 'same' WHEN o_orderstatus = 'F' THEN 'new' ELSE 'new' END AS origin FROM orders")
def app_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("parameters"), F.lit("new").alias("origin"))
    old = o.where("o_orderstatus = 'F'").withColumn("parameters", F.when(F.col("parameters") == "1-URGENT", "other").otherwise(F.col("parameters"))).withColumn("origin", F.lit("same"))
    return calc.app_documents(old, o, ["o_orderkey"], "REPLACE_IF_DIFFERENT").select("o_orderkey", "origin")


@query("SELECT p_partkey, 'y' AS \"column\", p_size <= 25 AS ok FROM part")
def compare_results(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(0.0).alias("y"), (F.col("p_size") / 100).alias("d"))
    return calc.compare_results(p, p.select("p_partkey", F.col("d").alias("y")), "p_partkey", {"y": 0.25})


@query("SELECT n_nationkey AS node_id FROM nation WHERE n_nationkey % 3 <> 2 AND n_regionkey <> 1")
def eligible_nodes(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node_id"), F.when(k == 0, "utc").when(k == 1, "approx_utc").otherwise("dev_local_time").alias("clock"), prefixed("k", "n_regionkey").alias("kind"))
    return clocks.eligible_nodes(n, ("utc", "approx_utc"), ("no_time",), (), ("k1",)).select("node_id")


@query("WITH u AS (SELECT r_regionkey::INTEGER + 1 AS place, 'a' AS kind, r_name AS parameters FROM region UNION ALL SELECT 5 + row_number() OVER (ORDER BY min(n_nationkey))::INTEGER, 'a', n_name FROM nation WHERE n_name NOT IN (SELECT r_name FROM region) GROUP BY n_name) SELECT (CASE WHEN place > 2 THEN place - 1 ELSE place END)::INTEGER AS place, kind, parameters FROM u WHERE place <> 2")
def sync_rules(spark, sf_dir):
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("place"), F.lit("a").alias("kind"), F.col("r_name").alias("parameters"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.lit("a").alias("kind"), F.col("n_name").alias("parameters"))
    return clocks.remove_rule(clocks.add_rules(r, n.unionByName(r)), 2)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'utc' ELSE 'dev_local_time' END AS clock, CASE WHEN event_id % 2 = 1 THEN 'e1' END AS epoch, value AS time FROM events")
def time_references(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    ref = clocks.time_reference(F.lit("x"), F.when(even, "utc").otherwise("dev_local_time"), F.when(~even, "e1"), F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", ref.alias("r")).select("event_id", "r.clock", "r.epoch", "r.time")


@query("SELECT vec_id, [len(embedding)]::INTEGER[] AS dim, len(embedding)::INTEGER - 1 AS last FROM embeddings")
def grid_shape(spark, sf_dir):
    shape = scalars.shape_of(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", shape.alias("s"))
    return e.select("vec_id", "s.dim", F.element_at("s.coordinates", -1).alias("last"))


@query("SELECT c_custkey, 'a.b.' || lower(c_mktsegment) AS dotted, 'a_b_' || lower(c_mktsegment) AS underscored, length(c_mktsegment) = 8 AS fits FROM customer")
def class_names(spark, sf_dir):
    name = F.concat(F.lit("a_b."), F.lower("c_mktsegment"))
    c = scalars.require_types(table(spark, sf_dir, "customer"), {"c_acctbal": "numeric", "c_name": "string"})
    return c.select("c_custkey", scalars.dotted_class(name).alias("dotted"), scalars.underscored_class(name).alias("underscored"), scalars.fully_matches(F.col("c_mktsegment"), "[A-Z]{8}").alias("fits"))


@query("SELECT n_regionkey, md5(string_agg(line, chr(10) ORDER BY line)) AS hash FROM (SELECT n_regionkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation) GROUP BY n_regionkey")
def table_hash(spark, sf_dir):
    return summaries.table_hash(table(spark, sf_dir, "nation"), ["n_regionkey"])


@query("SELECT o_orderkey, m, CASE m WHEN 'none' THEN true WHEN 'difference' THEN b - a <= 100 WHEN 'abs_difference' THEN abs(b - a) <= 100 WHEN 'percent_difference' THEN 100 * (b - a) / a <= 5 WHEN 'abs_percent_difference' THEN abs(100 * (b - a) / a) <= 5 WHEN 'character_exact' THEN a = b ELSE a >= 0.05 END AS ok FROM (SELECT o_orderkey, o_totalprice AS a, round(o_totalprice) AS b FROM orders), (VALUES ('none'), ('difference'), ('abs_difference'), ('percent_difference'), ('abs_percent_difference'), ('character_exact'), ('p_value_consistent')) t(m)")
def compare_methods(spark, sf_dir):
    a, b = F.col("o_totalprice"), F.round("o_totalprice")
    limits = {"difference": 100.0, "abs_difference": 100.0, "percent_difference": 5.0, "abs_percent_difference": 5.0, "p_value_consistent": 0.05}
    each = F.array(*[F.struct(F.lit(m).alias("m"), diffs.agrees(a, b, m, limits.get(m, 0.0)).alias("ok")) for m in diffs.METHODS])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(each).alias("s")).select("o_orderkey", "s.m", "s.ok")


@query("SELECT p_partkey, i::INTEGER AS row, hex(substr(p_name, 16 * i + 1, 16)) AS hex FROM part, LATERAL (SELECT unnest(range(0, CAST(ceil(strlen(p_name) / 16.0) AS BIGINT))) AS i)")
def hex_all_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(scalars.hex_rows(F.col("p_name").cast("binary"))).alias("row", "r"))
    return p.select("p_partkey", "row", F.col("r.hex").alias("hex"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN p_retailprice END AS f0, CASE WHEN p_size <= 20 THEN p_retailprice END AS f1 FROM part")
def f0_f1(spark, sf_dir):
    r = calc.f0_f1(F.array(F.lit(1.0), F.col("p_retailprice"), F.lit(2.0)), F.when(F.col("p_size") > 20, "Mean").otherwise("f1"))
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.f0", "r.f1")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey = 12")
def store_read_one(spark, sf_dir):
    return store.read_one(entity_documents(spark, sf_dir, "customer", "nation"), "c12", "entity").select("id")


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'changed' ELSE c_name END AS name FROM customer")
def store_update(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer")
    new = search(docs, Query("customer.c_acctbal") < 0).withColumn("name", F.lit("changed"))
    return store.update(docs, new.unionByName(new.withColumn("id", F.concat(F.lit("x"), "id")))).select("id", "name")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def store_copy_session(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer")
    return store.copy_session(docs, store.remove(docs, Query("customer.c_acctbal") < 0), "BUILDING").select("id")


@query("SELECT 'c' || c_custkey AS id, ['entity', 'base', 'record'] AS superclasses, 'o' || c_custkey AS nation_id FROM customer")
def document_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    right = store.make_documents(c, prefixed("c", "c_custkey"), "x", ["record", "base"], store.edge_list(store.edge("nation_id", prefixed("o", "c_custkey"))))
    out = store.document_merge(entity_documents(spark, sf_dir, "customer"), right)
    return out.select("id", "superclasses", graph.dependency_value("nation_id").alias("nation_id"))


@query("SELECT 'c' || c_custkey AS id, 'S' AS session_id FROM customer")
def store_stamp_session(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer").withColumn("session_id", F.lit(""))
    return store.stamp_session(store.add(docs.where("false"), docs), "S").select("id", "session_id")


@query("SELECT l_partkey, l_orderkey, l_linenumber, c, t0, t1 FROM (SELECT l_partkey, l_orderkey, l_linenumber, unnest(['utc', 'dev_local_time']) AS c, unnest([0.0, 1.0])::DOUBLE AS t0, unnest([l_quantity, l_quantity + 1]) AS t1 FROM lineitem)")
def epoch_nodes(spark, sf_dir):
    clock = lambda n, a, b: F.struct(F.lit(n).alias("clock"), F.lit(a).alias("t0"), b.alias("t1"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.array(clock("utc", 0.0, F.col("l_quantity")), clock("dev_local_time", 1.0, F.col("l_quantity") + 1)).alias("clocks"))
    return clocks.epoch_nodes(li).withColumnRenamed("clock", "c")


@query("SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 2.0::DOUBLE AS scale, CAST(s_suppkey AS DOUBLE) AS shift FROM supplier UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 0.5::DOUBLE, -s_suppkey / 2.0 + 0.0 FROM supplier")
def sync_file_edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(prefixed("s", "s_suppkey").alias("src"), prefixed("n", "s_nationkey").alias("dst"), F.lit(2.0).alias("scale"), F.col("s_suppkey").alias("shift"))
    e = clocks.sync_file_edges(s)
    return e.select("src", "dst", F.get("mapping", 0).alias("scale"), (F.get("mapping", 1) + 0.0).alias("shift"))


@query("SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 9.0 ELSE 1.0 END::DOUBLE AS scale FROM supplier")
def stored_mapping_first(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", prefixed("s", "s_suppkey").alias("src"), prefixed("n", "s_nationkey").alias("dst"), clocks.identity().alias("mapping"))
    kept = s.where("s_suppkey % 2 = 0").withColumn("mapping", F.array(F.lit(9.0), F.lit(0.0)))
    return clocks.stored_first(s.drop("s_suppkey"), kept).select("src", "dst", F.get("mapping", 0).alias("scale"))
