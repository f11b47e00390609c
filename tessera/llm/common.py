"""Shared plumbing of the text operators: work tables, input columns and partition counts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes and rows of an Arrow batch that goes to or comes from a Python worker, so that long texts make small batches.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in the session, where its own bounds are wider."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        now = int(re.sub(r"[bB]$", "", now)) if now and re.fullmatch(r"-?[0-9]+[bB]?", now) else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def work_dir(spark: SparkSession) -> str:
    """The shared folder for work tables: ``spark.checkpoint.dir``, or in local mode a fresh one where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessera-work-")
        spark.conf.set("spark.checkpoint.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    bound_batches(spark)
    return shared.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder that exists deleted when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stage_table(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost no rerun.

    The table goes when the driver's JVM ends; :func:`drop_table` removes it sooner.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`stage_table` once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty), so that no other column's name can clash."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def parts_for(spark: SparkSession, amount: int, per_part: int) -> int:
    """Partitions so that each holds about ``per_part`` of ``amount``; at least the session's parallelism."""
    return max(spark.sparkContext.defaultParallelism, -(-int(amount) // per_part))


#: A key with more than one in so many of all rows is joined by broadcast; there are fewer such keys than this.
HOT_SHARE = 128


def join_keyed(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``table`` (one row a key) without a task that takes all rows of a frequent key.

    ``n`` is the column of ``table`` with the key's number of rows, of ``total`` altogether. Keys with more than
    ``total / HOT_SHARE`` rows, fewer than ``HOT_SHARE`` of them, are broadcast; all others meet by a shuffle.
    """
    hot = F.broadcast(table.where(F.col(n) * HOT_SHARE > F.lit(int(total))))
    others = table.where(F.col(n) * HOT_SHARE <= F.lit(int(total)))
    rest = rows.join(hot.select(key), key, "left_anti").join(others, key)
    columns = [*rows.columns, *[c for c in table.columns if c != key]]
    return rows.join(hot, key).select(*columns).unionByName(rest.select(*columns))
