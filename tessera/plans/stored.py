"""Queries over files that each query writes from the given tables to the shared folder and reads back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import diffs, schemas, store, summaries
from tessera.operators.graph import shared_folder, written
from tessera.operators.query import Query, search
from tessera.sources import files, stored

from .inputs import SAMPLES, entity_documents, event_documents, prefixed, query, samples, table


def _folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/tessera-files/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def _searched(spark, sf_dir, q: Query) -> DataFrame:
    """The ids that a query selects in a saved store that is indexed by the query's own paths."""
    folder = f"{_folder(spark)}/store"
    store.save_indexed(event_documents(spark, sf_dir), folder, store.hot_paths([q]), cluster=("event.value", "double"))
    return search(store.load_indexed(spark, folder), q).select("id")


@query(f"SELECT 'e' || event_id AS id FROM events WHERE {_K} > 20 AND {_K} <= 60 AND value >= 10 AND value < 90")
def q_index_range(spark, sf_dir):
    k, v = Query("event.props.k"), Query("event.value")
    return _searched(spark, sf_dir, (k > 20) & (k <= 60) & (v >= 10) & (v < 90))


@query(f"SELECT 'e' || event_id AS id FROM events WHERE (CAST({_K} AS INTEGER) = 7 OR contains(json_extract_string(props, '$.k'), '4') OR value < 5) AND NOT coalesce({_K} < 5, false)")
def q_index_text(spark, sf_dir):
    k, v = Query("event.props.k"), Query("event.value")
    return _searched(spark, sf_dir, ((k == 7) | (k.contains("4") | (v < 5))) & ~(k < 5))


_SCHEMAS = {
    "supplier": {
        "classname": "supplier", "superclasses": ["entity", "ghost"],
        "depends_on": [{"name": "nation_id", "mustbenotempty": 1}, {"name": "region_id", "mustbenotempty": 1}, {"name": "other_id", "mustbenotempty": 0}],
        "supplier": [
            {"name": "s_suppkey", "type": "integer", "parameters": [0, 50, 1]}, {"name": "s_name", "type": "string", "parameters": ""},
            {"name": "s_acctbal", "type": "integer", "parameters": [-1000000, 1000000, 1]}, {"name": "s_note", "type": "string", "parameters": ""},
        ],
    },
    "entity": {"classname": "entity", "superclasses": ["base"], "depends_on": [], "entity": [{"name": "label", "type": "string"}]},
    "base": {"classname": "base", "superclasses": [], "depends_on": [], "base": [{"name": "id", "type": "did_uid", "parameters": 3}, {"name": "datestamp", "type": "timestamp"}]},
}


@query("""WITH s AS (SELECT 's' || s_suppkey AS id, * FROM supplier)
SELECT id, 'this' AS part, 'supplier.s_suppkey' AS path, 'range' AS error FROM s WHERE s_suppkey > 50
UNION ALL SELECT id, 'this', 'supplier.s_acctbal', 'type' FROM s WHERE s_acctbal <> floor(s_acctbal)
UNION ALL SELECT id, 'this', 'supplier.s_note', 'missing property' FROM s
UNION ALL SELECT id, 'entity', 'entity', 'missing section' FROM s
UNION ALL SELECT id, 'ghost', 'ghost', 'no schema' FROM s
UNION ALL SELECT id, 'base', 'base.id', 'length' FROM s WHERE length(id) <> 3
UNION ALL SELECT id, 'depends_on', 'region_id', 'missing' FROM s
UNION ALL SELECT id, 'depends_on', 'nation_id', 'dangling' FROM s WHERE s_nationkey >= 12""")
def schema_validation(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").limit(1).select(F.explode(F.array(*[F.struct(F.lit(f"{k}_schema.json").alias("path"), F.lit(json.dumps(v)).cast("binary").alias("content")) for k, v in _SCHEMAS.items()])).alias("f")).select("f.*")
    folder = _folder(spark)
    stored.write_files(names, folder)
    rules = schemas.compile_rules(schemas.read_schemas(spark, folder))
    known = table(spark, sf_dir, "nation").where("n_nationkey < 12").select(prefixed("n", "n_nationkey").alias("id"))
    docs = entity_documents(spark, sf_dir, "supplier").withColumn("datestamp", F.lit(""))
    return schemas.validate_by_class(docs, rules, known)


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < -900 THEN 'only_left' WHEN c_acctbal > 9900 THEN 'only_right' ELSE 'different' END AS status FROM customer WHERE c_acctbal < -900 OR c_acctbal > 9900 OR c_acctbal BETWEEN 0 AND 100")
def session_diff_stored(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "customer").withColumn("bal", F.try_variant_get("body", "$.customer.c_acctbal", "double"))
    left, right = f"{_folder(spark)}/s", f"{_folder(spark)}/s"
    diffs.save_hashed(docs.where("bal <= 9900").drop("bal"), left)
    changed = F.when(F.col("bal").between(0, 100), "other").otherwise(F.col("name"))
    diffs.save_hashed(docs.where("bal >= -900").withColumn("name", changed).withColumn("session_id", F.lit("copy")).drop("bal"), right)
    return diffs.stored_session_diff(spark, left, right)


@query("""SELECT n_regionkey, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS hi, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS lo
FROM (SELECT n_regionkey, md5('{"n_name":"' || n_name || '"}') AS h FROM nation) GROUP BY n_regionkey""")
def group_digests(spark, sf_dir):
    found = summaries.group_digests(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), ["n_regionkey"])
    return found.select("n_regionkey", "n", F.col("hi").cast("string").alias("hi"), F.col("lo").cast("string").alias("lo"))


def _two_channels(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir).select("epoch_id", "channel", "sample_idx", "value")
    return s.unionByName(s.withColumn("channel", F.lit("ai2")).withColumn("value", F.col("value") * -2))


_TWO = f"{SAMPLES}, two AS (SELECT epoch_id, channel, sample_idx, value FROM samples UNION ALL SELECT epoch_id, 'ai2', sample_idx, value * -2 FROM samples)"


@query(f"WITH {_TWO} SELECT epoch_id::VARCHAR AS epoch_id, channel, sample_idx, value FROM two")
def source_recording(spark, sf_dir):
    folder = _folder(spark)
    stored.write_recording(_two_channels(spark, sf_dir), folder, segment=64)
    return stored.read_recording(spark, folder)


@query(f"WITH {_TWO} SELECT epoch_id::VARCHAR AS epoch_id, channel, sample_idx, value FROM two WHERE epoch_id IN (7, 11) AND channel = 'ai2' AND sample_idx BETWEEN 5 AND 90")
def source_recording_range(spark, sf_dir):
    folder = _folder(spark)
    stored.write_recording(_two_channels(spark, sf_dir), folder, segment=16)
    return stored.read_recording(spark, folder).where("epoch_id IN ('7', '11') AND channel = 'ai2' AND sample_idx BETWEEN 5 AND 90")


def _exported(spark, sf_dir, segment: int) -> DataFrame:
    folder = _folder(spark)
    stored.write_recording(_two_channels(spark, sf_dir), folder, "int16", 10.0, segment)
    raw = files.contents(spark, folder, "*.dat")
    return raw.select(F.regexp_extract("path", r"/(\d+)/\d+\.dat$", 1).cast("long").alias("epoch_id"), F.regexp_extract("path", r"/(\d+)\.dat$", 1).cast("long").alias("chunk"), "content")


@query(f"WITH {SAMPLES} SELECT epoch_id::BIGINT AS epoch_id, (sample_idx // 64)::BIGINT AS chunk, count(*)::INTEGER * 4 AS bytes FROM samples GROUP BY ALL")
def export_binary_chunks(spark, sf_dir):
    return _exported(spark, sf_dir, 64).select("epoch_id", "chunk", F.octet_length("content").alias("bytes"))


@query(f"""WITH {_TWO}, v AS (SELECT *, trunc(value * 10.0)::INTEGER AS x FROM two)
SELECT epoch_id::BIGINT AS epoch_id, (sample_idx // 4096)::BIGINT AS chunk,
  string_agg(printf('%02x%02x', (x & 255)::INTEGER, ((x >> 8) & 255)::INTEGER), '' ORDER BY sample_idx, channel) AS bytes FROM v GROUP BY ALL""")
def export_binary_bytes(spark, sf_dir):
    return _exported(spark, sf_dir, 4096).select("epoch_id", "chunk", F.lower(F.hex("content")).alias("bytes"))


@query(f"WITH {SAMPLES} SELECT epoch_id::VARCHAR AS epoch_id, count(*) AS samples, 2::INTEGER AS channels, 10.0::DOUBLE AS multiplier, 'int16' AS data_type FROM samples GROUP BY epoch_id")
def export_binary_metadata(spark, sf_dir):
    folder = _folder(spark)
    stored.write_recording(_two_channels(spark, sf_dir), folder, "int16", 10.0, 64)
    return stored.recording_metadata(spark, folder)


_CELLS = """m AS (SELECT c_nationkey AS k, c_custkey::DOUBLE AS a, c_custkey % 100 - 50.0::DOUBLE AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer)"""


@query(f"""WITH {_CELLS} SELECT 'grid/n' || k || '.bin' AS path, 2 * r AS position, a AS value FROM m UNION ALL SELECT 'grid/n' || k || '.bin', 2 * r + 1, b FROM m""")
def grid_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    rows = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("l"))
    data = F.flatten(F.transform("l", lambda x: F.array(x.cast("double"), (x % 100 - 50).cast("double"))))
    kind = F.element_at(F.array(F.lit("double"), F.lit("int32"), F.lit("single")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    grids = rows.select(F.concat(F.lit("grid/n"), "c_nationkey", F.lit(".bin")).alias("path"), data.alias("data"), kind.alias("data_type"), F.array(F.size("l"), F.lit(2)).alias("data_dim"))
    folder = _folder(spark)
    stored.write_grids(grids, folder)
    return stored.read_grids(spark, folder)


_RECORDS = f"{SAMPLES}, r AS (SELECT epoch_id, sample_idx // 4 AS k, sample_idx, t, value FROM samples)"


@query(f"""WITH {_RECORDS} SELECT epoch_id::BIGINT AS epoch_id, k::INTEGER + 1 AS number, CASE k % 2 WHEN 0 THEN 'utc' ELSE 'dev_local_time' END AS clock,
  min(t) OVER w AS onset, max(t) OVER w AS stop, t, value FROM r WHERE k BETWEEN 1 AND 2 WINDOW w AS (PARTITION BY epoch_id, k)""")
def presentation_round_trip(spark, sf_dir):
    r = samples(spark, sf_dir).withColumn("k", F.floor(F.col("sample_idx") / 4))
    event = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "t", "value"))), lambda e: F.array(e["t"], e["value"]))
    clock = F.when(F.col("k") % 2 == 0, "utc").otherwise("dev_local_time").alias("clock")
    each = r.groupBy("epoch_id", "k").agg(F.min("t").alias("a"), F.max("t").alias("b"), event.alias("events"))
    record = F.struct("k", clock, F.array(F.col("a"), F.col("a"), F.col("b"), F.col("b")).alias("times"), "events")
    whole = each.groupBy("epoch_id").agg(F.array_sort(F.collect_list(record)).alias("records"))
    folder = _folder(spark)
    stored.write_files(files.presentation_files(whole.select(F.concat(F.lit("p/"), "epoch_id", F.lit(".bin")).alias("path"), "records")), folder)
    got = files.read_presentation(files.contents(spark, folder, "*.bin"), 2, 3)
    flat = got.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("epoch_id"), "number", "clock", F.col("times")[1].alias("onset"), F.col("times")[2].alias("stop"), F.explode("events").alias("e"))
    return flat.select("epoch_id", "number", "clock", "onset", "stop", F.col("e")[0].alias("t"), F.col("e")[1].alias("value"))


@query("SELECT 's' || s_suppkey AS id, 'supplier' AS class_name, ['entity', 'base'] AS superclasses, s_name AS name, 'n' || s_nationkey AS nation_id, s_acctbal AS balance FROM supplier")
def json_folder_load(spark, sf_dir):
    docs = entity_documents(spark, sf_dir, "supplier")
    folder = _folder(spark)
    stored.write_files(store.to_json(docs).select(F.concat("id", F.lit(".json")).alias("path"), F.col("json").cast("binary").alias("content")), folder)
    back = store.read_json_folder(spark, folder)
    balance = F.try_variant_get("body", "$.supplier.s_acctbal", "double").alias("balance")
    return back.select("id", "class_name", "superclasses", "name", F.col("depends_on")[0]["value"].alias("nation_id"), balance)


@query("""SELECT 's' || s_suppkey || '/document.json' AS path, 's' || s_suppkey AS id, NULL AS digest FROM supplier
UNION ALL SELECT 's' || s_suppkey || '/name.txt', NULL, md5(s_name) FROM supplier WHERE s_suppkey % 2 = 0""")
def export_document_files(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    source, target = _folder(spark), _folder(spark)
    stored.write_files(s.where("s_suppkey % 2 = 0").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("path"), F.col("s_name").cast("binary").alias("content")), source)
    notes = s.where("s_suppkey % 2 = 0").select(prefixed("s", "s_suppkey").alias("id"), F.lit("name.txt").alias("name"), F.concat(F.lit(f"{source}/"), "s_suppkey", F.lit(".txt")).alias("source"))
    stored.write_files(stored.document_files(entity_documents(spark, sf_dir, "supplier"), notes), target)
    found = files.contents(spark, target, "*.{json,txt}")
    path = F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path")
    text = F.col("path").endswith(".txt")
    return found.select(path, F.when(~text, F.get_json_object(F.col("content").cast("string"), "$.base.id")).alias("id"), F.when(text, F.md5("content")).alias("digest"))


def _tree(spark, sf_dir) -> tuple[str, DataFrame]:
    """Folders of nations with a folder a supplier: a recording each, and an epoch file for every second one."""
    s = table(spark, sf_dir, "supplier")
    at = F.concat(F.lit("base.v1/n"), "s_nationkey", F.lit("/"))
    content = F.col("s_name").cast("binary").alias("content")
    one = s.select(F.concat(at, F.lit("rec_"), "s_suppkey", F.lit(".rhd")).alias("path"), content)
    two = s.where("s_suppkey % 2 = 0").select(F.concat(at, F.lit("rec_"), "s_suppkey", F.lit(".epoch")).alias("path"), content)
    folder = _folder(spark)
    stored.write_files(one.unionByName(two), folder)
    return folder, files.listing(spark, f"{folder}/base.v1")


@query("""WITH f AS (SELECT s_nationkey AS k, count(*) AS n, count_if(s_suppkey % 2 = 0) AS e FROM supplier GROUP BY ALL) SELECT 'n' || k AS folder, (n + e)::INTEGER AS files FROM f WHERE e > 0""")
def file_group_epochs(spark, sf_dir):
    groups = files.file_groups(_tree(spark, sf_dir)[1], ["#.rhd", "#.epoch"])
    return groups.select(F.regexp_extract("folder", "([^/]+)$", 1).alias("folder"), F.size("files").alias("files"))


@query("""WITH f AS (SELECT s_nationkey AS k, count(*) AS n, count_if(s_suppkey % 2 = 0) AS e FROM supplier GROUP BY ALL)
SELECT 'n' || k AS epoch_id, (n + e)::INTEGER AS files FROM f WHERE e > 0""")
def folder_epochs(spark, sf_dir):
    groups = files.folder_epochs(_tree(spark, sf_dir)[1], "base.v1", ["#.rhd", "#.epoch"])
    return groups.select("epoch_id", F.size("files").alias("files"))


@query("SELECT 'n' || s_nationkey AS folder, 'rec_' || s_suppkey AS prefix, 'rec_' || s_suppkey || '.rhd' AS first_file, 'rec_' || s_suppkey || '.epoch' AS other FROM supplier WHERE s_suppkey % 2 = 0")
def series_epochs(spark, sf_dir):
    last = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    found = files.series_epochs(_tree(spark, sf_dir)[1], "#.rhd", ["#.epoch"])
    return found.select(last("folder").alias("folder"), "prefix", last("first_file").alias("first_file"), last(F.col("others")[0]).alias("other"))


@query("""WITH f AS (SELECT s_nationkey AS k, count_if(s_suppkey % 2 = 0) AS e FROM supplier GROUP BY ALL)
SELECT coalesce('n' || n_nationkey, 'n' || k) AS epoch_id, CASE WHEN n_nationkey IS NULL THEN 'disk' ELSE 'ingested' END AS source
FROM (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) FULL JOIN (SELECT k FROM f WHERE e > 0) ON n_nationkey = k""")
def reconciled_epochs(spark, sf_dir):
    disk = files.folder_epochs(_tree(spark, sf_dir)[1], "base.v1", ["#.rhd", "#.epoch"])
    known = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(prefixed("n", "n_nationkey").alias("epoch_id"))
    return files.reconcile(known, disk).select("epoch_id", "source")


@query("SELECT 'rec_' || s_suppkey || '.rhd' AS name, md5(s_name) AS digest, octet_length(s_name::BLOB)::BIGINT AS length FROM supplier")
def file_digests(spark, sf_dir):
    folder, _ = _tree(spark, sf_dir)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rhd").load(f"{folder}/base.v1")
    facts = scalars.file_facts(raw).where("modified IS NOT NULL")
    return facts.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("md5").alias("digest"), "length")


@query("""WITH needles AS (SELECT DISTINCT 'rec_' || (s_suppkey // 10) AS filename FROM supplier)
SELECT DISTINCT filename, 'n' || s_nationkey AS epoch_id FROM supplier JOIN needles ON contains('rec_' || s_suppkey || '.rhd', filename)""")
def filename_epochs(spark, sf_dir):
    epochs = files.file_groups(_tree(spark, sf_dir)[1], ["#.rhd"])
    epochs = epochs.select(F.regexp_extract("folder", "([^/]+)$", 1).alias("epoch_id"), "files")
    needles = table(spark, sf_dir, "supplier").select(F.concat(F.lit("rec_"), F.floor(F.col("s_suppkey") / 10).cast("string")).alias("filename")).distinct()
    return files.files_of_name(needles, epochs)


@query("SELECT 'ai' || (n_nationkey + 1) AS name, n_name AS label, n_regionkey AS bank, round(n_nationkey / 8.0, 3) AS gain FROM nation")
def channel_list_file(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.lit("ai"), (F.col("n_nationkey") + 1).cast("string")).alias("name"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("bank"), F.round(F.col("n_nationkey") / 8, 3).alias("gain"))
    folder = f"{_folder(spark)}/channels"
    files.write_tab_table(rows, folder)
    kind = dict(n.dtypes)["n_regionkey"]
    return files.read_tab_table(spark, folder, f"name string, label string, bank {kind}, gain double")


@query("SELECT 'probe' || s_nationkey AS name, 1::BIGINT AS reference, 'n-trode' AS type, 'dev' || s_nationkey || ':ai' || min(s_suppkey) || '-' || max(s_suppkey) AS devicestring, 'r' || s_nationkey AS subjectstring FROM supplier GROUP BY s_nationkey")
def probe_map_file(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b"))
    text = lambda *c: F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(c)])
    rows = s.select(text("probe", "s_nationkey").alias("name"), F.lit(1).cast("long").alias("reference"), F.lit("n-trode").alias("type"), text("dev", "s_nationkey", ":ai", "a", "-", "b").alias("devicestring"), text("r", "s_nationkey").alias("subjectstring"))
    folder = f"{_folder(spark)}/probemap"
    files.write_tab_table(rows, folder)
    return files.read_probe_map(spark, folder)


@query("SELECT c_mktsegment AS session_id, max_by('/data/c' || c_custkey, c_custkey) AS path FROM customer GROUP BY ALL")
def session_table_file(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("session_id"), F.concat(F.lit("/data/c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").alias("line"))
    folder = f"{_folder(spark)}/sessions"
    files.write_tab_table(c, folder)
    return files.session_table(files.read_tab_table(spark, folder, "session_id string, path string, line long"), "line")


def _attached(spark, sf_dir) -> tuple[DataFrame, str, str]:
    """Documents of suppliers with one file each, which asks to be copied and, for every third, deleted; its folder and the target."""
    s = table(spark, sf_dir, "supplier")
    source, target = _folder(spark), _folder(spark)
    stored.write_files(s.select(F.concat("s_suppkey", F.lit(".bin")).alias("path"), F.col("s_name").cast("binary").alias("content")), source)
    place = F.struct(
        F.concat(F.lit("u"), "s_suppkey").alias("uid"), F.concat(F.lit(f"{source}/"), "s_suppkey", F.lit(".bin")).alias("location"),
        F.lit(True).alias("ingest"), (F.col("s_suppkey") % 3 == 0).alias("delete_original"),
    )
    body = F.struct(F.struct(F.array(F.struct(F.lit("a.bin").alias("name"), F.array(place).alias("locations"))).alias("file_info")).alias("files"))
    return s.select(prefixed("s", "s_suppkey").alias("id"), F.call_function("to_variant_object", body).alias("body")), source, target


@query("""SELECT 's' || s_suppkey AS id, 'copied' AS place, md5(s_name) AS digest FROM supplier
UNION ALL SELECT 's' || s_suppkey, 'source', md5(s_name) FROM supplier WHERE s_suppkey % 3 <> 0""")
def ingest_files(spark, sf_dir):
    docs, source, target = _attached(spark, sf_dir)
    plan = files.ingest_plan(docs).withColumnRenamed("location", "path")
    stored.ingest(plan, target, written)
    at = lambda folder, place, shape: files.contents(spark, folder).select(F.concat(F.lit("s"), F.regexp_extract("path", shape, 1)).alias("id"), F.lit(place).alias("place"), F.md5("content").alias("digest"))
    return at(target, "copied", r"/u(\d+)$").unionByName(at(source, "source", r"/(\d+)\.bin$"))


@query("SELECT 's' || s_suppkey AS id, 'u' || s_suppkey AS uid, 'delete' AS action, true AS done, s_suppkey % 2 = 0 AS still_there FROM supplier")
def expel_files(spark, sf_dir):
    docs, _, target = _attached(spark, sf_dir)
    stored.ingest(files.ingest_plan(docs).withColumnRenamed("location", "path"), target, written)
    gone = docs.where("substring(id, 2) % 2 = 1")
    written(stored.carry_out(stored.expel_plan(gone, target), target))
    # Run again for all: what is gone is done.
    left = files.contents(spark, target).select(F.regexp_extract("path", "([^/]+)$", 1).alias("uid"), F.lit(True).alias("there"))
    left = written(left)
    done = written(stored.carry_out(stored.expel_plan(docs, target), target))
    return done.join(left, "uid", "left").select("id", "uid", "action", "done", F.coalesce("there", F.lit(False)).alias("still_there"))
