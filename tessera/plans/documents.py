"""Queries over documents: predicates, the store, the graph, summaries and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import diffs, graph, store, summaries, tables
from tessera.operators.query import Query, search

from .inputs import EDGES, IDS, entity_documents, event_documents, prefixed, query, table

_E = "SELECT 'e' || event_id AS id FROM events WHERE "
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def _ids(spark, sf_dir, q: Query):
    return search(event_documents(spark, sf_dir), q).select("id")


@query(_E + "event_type = 'purchase'")
def q_eq_string(spark, sf_dir):
    return _ids(spark, sf_dir, Query("base.name") == "purchase")


@query(_E + "event_type <> 'purchase'")
def q_ne(spark, sf_dir):
    return _ids(spark, sf_dir, Query("base.name") != "purchase")


@query(_E + f"{_K} = 50")
def q_eq_number(spark, sf_dir):
    return _ids(spark, sf_dir, Query("event.props.k") == 50)


@query(_E + f"{_K} > 20 AND {_K} <= 60 AND value >= 10 AND value < 90")
def q_cmp_range(spark, sf_dir):
    k, v = Query("event.props.k"), Query("event.value")
    return _ids(spark, sf_dir, (k > 20) & (k <= 60) & (v >= 10) & (v < 90))


@query(_E + f"event_type = 'click' AND {_K} < 10 OR event_type = 'error' AND {_K} > 90")
def q_and_or(spark, sf_dir):
    k, n = Query("event.props.k"), Query("base.name")
    return _ids(spark, sf_dir, ((n == "click") & (k < 10)) | ((n == "error") & (k > 90)))


@query(_E + f"NOT event_type = 'click' AND NOT coalesce({_K} < 50, false)")
def q_not_terms(spark, sf_dir):
    return _ids(spark, sf_dir, ~((Query("base.name") == "click") & (Query("event.props.k") < 50)))


@query(_E + f"NOT (event_type = 'click' AND coalesce({_K} < 50, false))")
def q_not_demorgan(spark, sf_dir):
    return _ids(spark, sf_dir, ((Query("base.name") == "click") & (Query("event.props.k") < 50)).negate_all())


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE contains(c_name, '77')")
def q_contains(spark, sf_dir):
    return search(entity_documents(spark, sf_dir, "customer"), Query("customer.c_name").contains("77")).select("id")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE regexp_matches(c_mktsegment, '^(AUTO|MACH)')")
def q_regexp(spark, sf_dir):
    return search(entity_documents(spark, sf_dir, "customer"), Query("customer.c_mktsegment").match("^(AUTO|MACH)")).select("id")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE lower(c_mktsegment) = 'building'")
def q_anycase(spark, sf_dir):
    return search(entity_documents(spark, sf_dir, "customer"), Query("customer.c_mktsegment").equals_any_case("Building")).select("id")


@query("SELECT 'e' || event_id AS id FROM events WHERE json_exists(props, '$.k')")
def q_hasfield(spark, sf_dir):
    return _ids(spark, sf_dir, Query("event.props.k").has_field())


@query("SELECT vec_id FROM embeddings WHERE list_contains(list_transform(embedding, lambda x: round(x * 1000)), 100)")
def q_hasmember(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.rint(x * 1000).cast("int")).alias("bins"))
    docs = store.make_documents(e, prefixed("v", "vec_id"), "vector", ["base"])
    return search(docs, Query("vector.bins").has_member("100")).select(F.substring("id", 2, 20).cast("long").alias("vec_id"))


@query("SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier")
def q_isa(spark, sf_dir):
    return search(entity_documents(spark, sf_dir), Query().isa("entity")).select("id")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 3")
def q_depends_on(spark, sf_dir):
    return search(entity_documents(spark, sf_dir), Query().depends_on("*", "n3")).select("id")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def q_session_scope(spark, sf_dir):
    return search(entity_documents(spark, sf_dir, "customer", "supplier"), Query().depends_on("nation_id", "n3"), "BUILDING").select("id")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal < 0")
def store_bulk_add_skip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    docs = entity_documents(spark, sf_dir, "customer")
    known = c.where("c_acctbal >= 0").select(prefixed("c", "c_custkey").alias("id"))
    return store.bulk_add(docs.join(known, "id", "left_semi"), docs.unionByName(docs)).select("id")


@query("SELECT sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS added, (2 * count(*) - sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END))::BIGINT AS skipped FROM customer")
def store_bulk_counts(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer")
    known = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(prefixed("c", "c_custkey").alias("id"))
    return store.bulk_counts(known, docs.unionByName(docs))


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'changed' ELSE c_name END AS name FROM customer")
def store_upsert(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer")
    new = search(docs, Query("customer.c_acctbal") < 0).withColumn("name", F.lit("changed"))
    return store.upsert(docs, new).select("id", "name")


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
def store_delete_where(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer")
    listed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(prefixed("c", "c_custkey").alias("id"))
    return store.remove(docs, Query("customer.c_acctbal") < 0, listed).select("id")


@query(f"WITH {IDS} SELECT id FROM ids WHERE id NOT IN (SELECT 'n7' UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7)")
def store_delete_dependents(spark, sf_dir):
    docs = entity_documents(spark, sf_dir)
    return store.remove_with_dependents(docs, docs.where("id = 'n7'").select("id")).select("id")


@query("SELECT class_name, count(*) AS n FROM (SELECT 'customer' AS class_name FROM customer UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'supplier' FROM supplier) GROUP BY class_name")
def store_federated(spark, sf_dir):
    c, s = entity_documents(spark, sf_dir, "customer"), entity_documents(spark, sf_dir, "supplier")
    return summaries.type_histogram(store.federated_search([c, s, s], Query().isa("entity")))


@query("SELECT o_orderkey AS pos, 'c' || o_custkey AS id, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_positional(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), prefixed("c", "o_custkey").alias("id"))
    return store.docs_from_ids(entity_documents(spark, sf_dir, "customer"), ids).select("pos", "id", "name")


@query(f"WITH RECURSIVE {EDGES}, up AS (SELECT src AS root, dst AS id, 1 AS depth FROM edges WHERE src LIKE 'o%' UNION SELECT up.root, edges.dst, up.depth + 1 FROM up JOIN edges ON edges.src = up.id) SELECT root, id, min(depth)::INTEGER AS depth FROM up GROUP BY root, id")
def ancestors(spark, sf_dir):
    docs = entity_documents(spark, sf_dir)
    return graph.ancestors(graph.edges_of(docs), docs.where("class_name = 'orders'").select("id"))


@query(f"WITH RECURSIVE {EDGES}, down AS (SELECT dst AS root, src AS id, 1 AS depth FROM edges WHERE dst LIKE 'r%' UNION SELECT down.root, edges.src, down.depth + 1 FROM down JOIN edges ON edges.dst = down.id) SELECT root, id, min(depth)::INTEGER AS depth FROM down GROUP BY root, id")
def descendants(spark, sf_dir):
    docs = entity_documents(spark, sf_dir)
    return graph.descendants(graph.edges_of(docs), docs.where("class_name = 'region'").select("id"))


@query("SELECT 'o' || o_orderkey AS id, 'customer_id' AS name, 'c' || o_custkey AS parent FROM orders")
def parents_of(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "orders")
    return graph.parents(graph.edges_of(docs), docs.select("id"))


@query("SELECT 'n' || c_nationkey AS id, 'nation_id' AS name, 'c' || c_custkey AS child FROM customer UNION ALL SELECT 'n' || s_nationkey, 'nation_id', 's' || s_suppkey FROM supplier")
def children_of(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "nation", "customer", "supplier")
    return graph.children(graph.edges_of(docs), docs.where("class_name = 'nation'").select("id"))


@query("SELECT 'o' || o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def dangling_edges(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "region", "nation", "customer", "orders")
    return graph.dangling(store.remove(docs, (Query("customer.c_acctbal") < 0) & Query().isa("customer")), "customer_id")


@query(f"WITH {IDS}, {EDGES}, inside AS (SELECT * FROM edges WHERE src NOT LIKE 'o%') SELECT id, coalesce(p, []) AS parents, coalesce(len(p), 0)::BIGINT AS n_parents, coalesce(n, 0)::BIGINT AS n_children FROM (SELECT * FROM ids WHERE class_name <> 'orders') LEFT JOIN (SELECT src AS id, list(dst ORDER BY dst) AS p FROM inside GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS n FROM inside GROUP BY dst) USING (id)")
def adjacency(spark, sf_dir):
    return graph.adjacency(entity_documents(spark, sf_dir, "region", "nation", "customer", "supplier"))


@query("SELECT 'r' || n_regionkey AS id, 'predecessor' AS side FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 'c' || c_custkey, 'successor' FROM customer WHERE c_nationkey = 5")
def neighbours(spark, sf_dir):
    return graph.neighbourhood(graph.edges_of(entity_documents(spark, sf_dir, "nation", "customer")), "n5")


@query("WITH c(class_name, superclass) AS (VALUES ('customer', 'entity'), ('supplier', 'entity'), ('entity', 'base'), ('orders', 'record'), ('record', 'base')) SELECT class_name, superclass AS ancestor, 1 AS depth FROM c UNION ALL SELECT c.class_name, d.superclass, 2 FROM c JOIN c d ON c.superclass = d.class_name")
def class_hierarchy(spark, sf_dir):
    rows = [("customer", "entity"), ("supplier", "entity"), ("entity", "base"), ("orders", "record"), ("record", "base")]
    return graph.class_closure(spark.createDataFrame(rows, "class_name string, superclass string"))


@query("SELECT l_orderkey AS src, l_linenumber AS number, 'p' || l_partkey AS dst FROM lineitem l WHERE l_linenumber <= (SELECT count(DISTINCT m.l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber <= l.l_linenumber) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1")
def numbered_dependencies(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    edges = li.select(F.col("l_orderkey").alias("src"), F.concat(F.lit("part_"), F.col("l_linenumber")).alias("name"), prefixed("p", "l_partkey").alias("dst"))
    return graph.numbered_dependencies(edges, "part")


@query("SELECT event_type AS class_name, count(*) AS n FROM events GROUP BY event_type")
def type_histogram(spark, sf_dir):
    return summaries.type_histogram(event_documents(spark, sf_dir))


@query("SELECT DISTINCT event_type AS class_name FROM events")
def all_types(spark, sf_dir):
    return summaries.all_types(event_documents(spark, sf_dir))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def newest_doc(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("stamp", F.col("o_orderdate").cast("string"))
    return summaries.newest(o, ["o_custkey"], "stamp", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def summary_star(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnsRenamed({"n_nationkey": "c_nationkey"})
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = summaries.star_join(table(spark, sf_dir, "customer"), [(n, "c_nationkey"), (r, "n_regionkey")])
    return out.select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS epoch_number FROM orders")
def summary_epoch_number(spark, sf_dir):
    return summaries.epoch_numbers(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "epoch_number")


@query("SELECT user_id, " + ", ".join(f"coalesce(CAST(max(event_id) FILTER (event_type = '{t}') AS VARCHAR), '') AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def summary_pivot(spark, sf_dir):
    return summaries.pivot_attributes(table(spark, sf_dir, "events"), "user_id", ["click", "error", "purchase", "signup", "view"], "event_type", "event_id")


@query("SELECT o_orderkey AS id, keep FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS keep FROM orders) WHERE o_orderkey <> keep")
def duplicates_keep_min(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return summaries.duplicates(o, F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority"), "o_orderkey")


@query("SELECT p_brand AS name, min_by(p_type, p_partkey) AS variable, min_by(CAST(p_size AS VARCHAR), p_partkey) AS term FROM part GROUP BY p_brand")
def first_value_per_name(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("names"), F.col("p_type").alias("variables"), F.col("p_size").cast("string").alias("terms"))
    return summaries.variable_names(p, "p_partkey")


@query("SELECT n_regionkey, count(DISTINCT n_nationkey) AS n FROM nation GROUP BY n_regionkey")
def table_hash_groups(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    hashed = summaries.table_hash(n, ["n_regionkey"])
    return hashed.join(n.groupBy("n_regionkey").agg(F.countDistinct("n_nationkey").alias("n")), "n_regionkey").where(F.length("hash") == 32).select("n_regionkey", "n")


_CHANGED = "c_acctbal BETWEEN 0 AND 1000"


@query(f"SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'only_left' WHEN c_acctbal > 9000 THEN 'only_right' ELSE 'different' END AS status FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 OR {_CHANGED}")
def session_diff(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer").withColumn("bal", F.try_variant_get("body", "$.customer.c_acctbal", "double"))
    left = docs.where("bal <= 9000").drop("bal")
    right = docs.where("bal >= 0").withColumn("name", F.when(F.col("bal").between(0, 1000), "other").otherwise(F.col("name"))).drop("bal")
    return diffs.session_diff(left, right)


@query(f"SELECT count(*) FILTER (c_acctbal >= 0 AND c_acctbal <= 9000) AS common, count(*) FILTER (c_acctbal < 0) AS only_left, count(*) FILTER (c_acctbal > 9000) AS only_right, count(*) FILTER ({_CHANGED}) AS different, false AS equal FROM customer")
def session_diff_counts(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer").withColumn("bal", F.try_variant_get("body", "$.customer.c_acctbal", "double"))
    left = docs.where("bal <= 9000").drop("bal")
    right = docs.where("bal >= 0").withColumn("name", F.when(F.col("bal").between(0, 1000), "other").otherwise(F.col("name"))).drop("bal")
    return diffs.session_diff_counts(left, right)


@query("SELECT c_custkey, 'c_name' AS path, c_name AS a, upper(c_name) || '!' AS b FROM customer WHERE c_acctbal < 0")
def document_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    other = c.withColumn("c_name", F.when(F.col("c_acctbal") < 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")))
    return diffs.field_diff(c, other, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * 1000) <= 500 AS near, CASE WHEN l_quantity = 0 THEN l_discount = 0 ELSE 100 * (l_discount - l_quantity) / l_quantity <= -99.8 END AS within, true AS none FROM lineitem")
def doc_compare_tolerance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    near = diffs.agrees(F.col("l_quantity") * 1000, F.col("l_extendedprice"), "abs_difference", 500)
    within = diffs.agrees(F.col("l_quantity"), F.col("l_discount"), "percent_difference", -99.8)
    return li.select("l_orderkey", "l_linenumber", near.alias("near"), within.alias("within"), diffs.agrees(F.col("l_tax"), F.col("l_tax"), "none").alias("none"))


_SETS = """l AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 15), r AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey >= 5 AND c_nationkey <> 20),
pl AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 3 OR c_nationkey = 22), pr AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (1, 10, 20))"""


@query(f"""WITH {_SETS}, u AS (SELECT id FROM l UNION SELECT id FROM r UNION SELECT id FROM pl UNION SELECT id FROM pr),
f AS (SELECT id, id IN (SELECT id FROM l) AS a, id IN (SELECT id FROM r) AS b, id IN (SELECT id FROM pl) AS c, id IN (SELECT id FROM pr) AS d FROM u)
SELECT id, CASE WHEN a AND NOT c AND b AND NOT d THEN 'conflict' WHEN a AND NOT c AND NOT b THEN 'upload' WHEN b AND NOT d AND NOT a THEN 'download'
WHEN c AND NOT a AND b THEN 'delete_remote' WHEN d AND NOT b AND a THEN 'delete_local' ELSE 'none' END AS action FROM f""")
def two_way_sync(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    pick = lambda cond: c.where(cond).select("id")
    return diffs.two_way_sync(pick("c_nationkey < 15"), pick("c_nationkey >= 5 AND c_nationkey <> 20"), pick("c_nationkey < 3 OR c_nationkey = 22"), pick("c_nationkey IN (1, 10, 20)"))


@query(f"WITH {_SETS} SELECT id FROM l EXCEPT SELECT id FROM r")
def missing_ids_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return diffs.missing_from(c.where("c_nationkey < 15"), c.where("c_nationkey >= 5 AND c_nationkey <> 20"))


@query(f"WITH {_SETS} SELECT id, CASE WHEN b IS NULL THEN 'local_only' WHEN a IS NULL THEN 'remote_only' ELSE 'common' END AS side FROM (SELECT id, 1 AS a FROM l) FULL JOIN (SELECT id, 1 AS b FROM r) USING (id)")
def sync_validate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return diffs.validate_sync(c.where("c_nationkey < 15"), c.where("c_nationkey >= 5 AND c_nationkey <> 20"))


@query("SELECT 'c' || c_custkey AS id, c_name AS name, 'n' || c_nationkey AS nation FROM customer WHERE c_acctbal < 0")
def store_json_round_trip(spark, sf_dir):
    docs = store.from_json(store.to_json(entity_documents(spark, sf_dir, "customer")), "json")
    found = search(docs, (Query("customer.c_acctbal") < 0) & Query().isa("entity"))
    return found.select("id", "name", graph.dependency_value("nation_id").alias("nation"))


@query("SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS depends_on_nation_id, '' AS depends_on_other FROM customer")
def document_dependencies(spark, sf_dir):
    return tables.dependency_columns(entity_documents(spark, sf_dir, "customer"), ["nation_id", "other"])


@query("SELECT 'c' || c_custkey AS id, c_acctbal, CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM (SELECT * REPLACE (round(c_acctbal, 2) AS c_acctbal) FROM customer)")
def document_table(spark, sf_dir):
    out = tables.document_table(entity_documents(spark, sf_dir, "customer"), "customer")
    out = out.withColumnsRenamed({c: c.removeprefix("customer_") for c in out.columns})
    return out.withColumn("c_acctbal", F.round(F.col("c_acctbal").cast("double"), 2))


@query("SELECT CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN max(c_mktsegment) ELSE '' END AS session_id FROM customer")
def dataset_session_id(spark, sf_dir):
    return store.session_id_of(entity_documents(spark, sf_dir, "customer"))


def dependency_summary(spark, sf_dir):
    """The flagship: documents by class, with how many depend on them and how many edges they have."""
    docs = entity_documents(spark, sf_dir)
    linked = graph.adjacency(docs).join(docs.select("id", "class_name"), "id")
    return linked.groupBy("class_name").agg(F.count("*").alias("n"), F.sum("n_parents").alias("n_parents"), F.sum("n_children").alias("n_children"))


query(f"WITH {IDS}, {EDGES} SELECT class_name, count(*) AS n, sum(coalesce(p, 0))::BIGINT AS n_parents, sum(coalesce(c, 0))::BIGINT AS n_children FROM ids LEFT JOIN (SELECT src AS id, count(*) AS p FROM edges GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS c FROM edges GROUP BY dst) USING (id) GROUP BY class_name")(dependency_summary)
