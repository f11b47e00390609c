"""Tables as the operators take them: documents made of rows, samples and events made of the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import store

REGISTRY: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with the SQL that gives the same rows."""

    def keep(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefixed(prefix: str, *columns: str) -> Column:
    return F.concat_ws("_", F.concat(F.lit(prefix), F.col(columns[0]).cast("string")), *[F.col(c).cast("string") for c in columns[1:]])


def seconds(t: str) -> Column:
    """A timestamp column as seconds, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP'1970-01-01 00:00:00', CAST({t} AS TIMESTAMP)) / 1e6D")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a document of its type's class, with its JSON properties in the body."""
    e = table(spark, sf_dir, "events")
    return store.make_documents(
        e, prefixed("e", "event_id"), "event", ["event", "base"], store.edge_list(store.edge("user_id", prefixed("u", "user_id"))),
        name=F.col("event_type"), section={"value": F.col("value"), "props": F.try_parse_json("props")},
    ).withColumn("class_name", F.col("name"))


def entity_documents(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Rows of the star schema as documents whose edges are the foreign keys."""
    # Rows are small and their bodies slow to make, and a small file makes few tasks: rows are dealt over the shuffle's tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = lambda n: table(spark, sf_dir, n) if n in ("region", "nation") else table(spark, sf_dir, n).repartition(tasks)
    e = store.edge
    make = {
        "region": lambda: store.make_documents(t("region"), prefixed("r", "r_regionkey"), "region", ["entity", "base"], name=F.col("r_name")),
        "nation": lambda: store.make_documents(t("nation"), prefixed("n", "n_nationkey"), "nation", ["entity", "base"], store.edge_list(e("region_id", prefixed("r", "n_regionkey"))), name=F.col("n_name")),
        "customer": lambda: store.make_documents(
            t("customer"), prefixed("c", "c_custkey"), "customer", ["entity", "base"], store.edge_list(e("nation_id", prefixed("n", "c_nationkey"))), name=F.col("c_name"), session=F.col("c_mktsegment")
        ),
        "supplier": lambda: store.make_documents(t("supplier"), prefixed("s", "s_suppkey"), "supplier", ["entity", "base"], store.edge_list(e("nation_id", prefixed("n", "s_nationkey"))), name=F.col("s_name")),
        "orders": lambda: store.make_documents(
            t("orders"), prefixed("o", "o_orderkey"), "orders", ["record", "base"], store.edge_list(e("customer_id", prefixed("c", "o_custkey"))),
            datestamp=F.date_format("o_orderdate", "yyyy-MM-dd"), section={"o_orderstatus": F.col("o_orderstatus"), "o_totalprice": F.col("o_totalprice")},
        ),
    }
    out = [make[n]() for n in (names or make)]
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``epoch_id, channel, sample_idx, value, t``: a user's events in time order as one sampled channel."""
    from tessera.operators.tables import numbered

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("epoch_id"), F.lit("ai1").alias("channel"), "event_id", seconds("ts").alias("t"), "value")
    rows = numbered(e, ["epoch_id", "channel"], ["t", "event_id"], "n")
    return rows.select("epoch_id", "channel", (F.col("n") - 1).cast("long").alias("sample_idx"), "value", "t")


def digital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("value", (F.col("value") >= 100).cast("int"))


SAMPLES = """samples AS (
  SELECT user_id AS epoch_id, 'ai1' AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
         value, epoch_us(ts) / 1e6 AS t FROM events)"""
PAIRS = f"""{SAMPLES}, pairs AS (
  SELECT *, lag(value) OVER w AS prev, lag(sample_idx) OVER w AS before FROM samples WINDOW w AS (PARTITION BY epoch_id ORDER BY sample_idx))"""
BITS = f"""{SAMPLES}, bits AS (SELECT epoch_id, channel, sample_idx, CAST(value >= 100 AS INTEGER) AS value FROM samples), pairs AS (
  SELECT *, lag(value) OVER w AS prev, lag(sample_idx) OVER w AS before FROM bits WINDOW w AS (PARTITION BY epoch_id ORDER BY sample_idx))"""
EDGES = """edges AS (
  SELECT 'n' || n_nationkey AS src, 'region_id' AS name, 'r' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'nation_id', 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'nation_id', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'customer_id', 'c' || o_custkey FROM orders)"""
IDS = """ids AS (
  SELECT 'r' || r_regionkey AS id, 'region' AS class_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'orders' FROM orders)"""
