"""Differences of documents, sessions and id sets, and synchronisation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .summaries import row_digests

METHODS = ("none", "difference", "abs_difference", "percent_difference", "abs_percent_difference", "character_exact", "p_value_consistent")


def same(a: Column, b: Column) -> Column:
    """Equal, where null equals null and NaN equals NaN."""
    return a.eqNullSafe(b)


def comparable(documents: DataFrame, ignore: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """``id, content``: a canonical text of each document, without the ignored columns; edges lose their order."""
    columns = [c for c in documents.columns if c not in ignore]
    parts = [F.array_sort(c).alias(c) if c == "depends_on" else F.col(c) for c in columns]
    return documents.select("id", F.to_json(F.struct(*parts)).alias("content"))


def session_diff(left: DataFrame, right: DataFrame, ignore: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """``id, status`` of every document that is only in ``left``, only in ``right``, or differs; equal ones are left out."""
    a = comparable(left, ignore).withColumnRenamed("content", "a")
    b = comparable(right, ignore).withColumnRenamed("content", "b")
    status = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").when(F.col("a") != F.col("b"), "different")
    return a.join(b, "id", "full").select("id", status.alias("status")).where("status is not null")


def session_diff_counts(left: DataFrame, right: DataFrame, ignore: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One row: how many documents are common, on one side only, and different, and whether the sessions are equal."""
    d = session_diff(left, right, ignore)
    counts = d.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("only_left", "only_right", "different")])
    common = left.select("id").join(right.select("id"), "id", "left_semi").agg(F.count("*").alias("common"))
    return common.crossJoin(counts).withColumn("equal", F.expr("only_left + only_right + different = 0"))


def field_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, path, a, b``: a row for each field that differs between rows with one key."""
    both = left.select(key, *[F.col(c).alias(f"__a_{c}") for c in fields]).join(right.select(key, *[F.col(c).alias(f"__b_{c}") for c in fields]), key)
    each = [F.struct(F.lit(c).alias("path"), F.col(f"__a_{c}").cast("string").alias("a"), F.col(f"__b_{c}").cast("string").alias("b"), (~same(F.col(f"__a_{c}"), F.col(f"__b_{c}"))).alias("changed")) for c in fields]
    return both.select(key, F.explode(F.filter(F.array(*each), lambda s: s["changed"])).alias("s")).select(key, "s.path", "s.a", "s.b")


def agrees(a: Column, b: Column, method: str, tolerance: float = 0.0) -> Column:
    """Whether two values agree by a method; two missing values agree, and a base of 0 agrees only with 0."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method == "none":
        return F.lit(True)
    if method == "character_exact":
        return same(a.cast("string"), b.cast("string"))
    if method == "p_value_consistent":
        return F.coalesce(a >= tolerance, F.lit(False))
    gap = b - a
    if "percent" in method:
        gap = F.when(a == 0, F.when(b == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(100 * gap, a))
    gap = F.abs(gap) if method.startswith("abs") else gap
    none = lambda c: c.isNull() | F.isnan(c)
    return F.when(none(a) & none(b), True).when(none(a) | none(b), False).otherwise(gap <= tolerance)


def two_way_sync(local: DataFrame, remote: DataFrame, last_local: DataFrame, last_remote: DataFrame) -> DataFrame:
    """``id, action`` from the ids now and at the last sync, on both sides.

    An id that one side has gained goes to the other; one that a side has lost is deleted on the other; one that both
    have gained is a conflict.
    """
    flag = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    out = flag(local, "l").join(flag(remote, "r"), "id", "full").join(flag(last_local, "pl"), "id", "full").join(flag(last_remote, "pr"), "id", "full")
    on = lambda c: F.coalesce(c, F.lit(False))
    l, r, pl, pr = (on(F.col(c)) for c in ("l", "r", "pl", "pr"))
    action = (
        F.when(l & ~pl & r & ~pr, "conflict").when(l & ~pl & ~r, "upload").when(r & ~pr & ~l, "download")
        .when(pl & ~l & r, "delete_remote").when(pr & ~r & l, "delete_local").otherwise("none")
    )
    return out.select("id", action.alias("action"))


def missing_from(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Keys of ``a`` that ``b`` lacks, each once."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def validate_sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``id, side``: local only, remote only, or common."""
    a, b = local.select("id", F.lit(1).alias("l")).distinct(), remote.select("id", F.lit(1).alias("r")).distinct()
    side = F.when(F.col("r").isNull(), "local_only").when(F.col("l").isNull(), "remote_only").otherwise("common")
    return a.join(b, "id", "full").select("id", side.alias("side"))


def compare_lists(a: Column, b: Column) -> Column:
    """What only one of two lists holds, in any order."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"))


def dataset_diff(left: DataFrame, right: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``session_id, id, status``: the differences of two datasets session by session; documents are told apart by both ids."""
    pair = lambda df: df.withColumn("id", F.to_json(F.struct("session_id", "id")))
    out = session_diff(pair(left), pair(right), ignore)
    ids = F.from_json("id", "session_id string, id string")
    return out.select(ids["session_id"].alias("session_id"), ids["id"].alias("id"), "status")


# --- Stored sessions with a tree of hashes, so that only what differs is read ---

#: Hex digits of an id's MD5 that name its folder, and its leaf in the tree.
FOLDER_DIGITS, LEAF_DIGITS = 2, 4


def save_hashed(documents: DataFrame, path: str, ignore: tuple[str, ...] = ("session_id",)) -> None:
    """Write documents by ranges of their ids' hashes, and the digests of each range's content.

    ``_hashes`` has a row a leaf: its folder, and digests that do not depend on the order of documents. A parent's digest
    is the sum of its children's.
    """
    rows = documents.withColumn("__leaf", F.substring(F.md5("id"), 1, LEAF_DIGITS)).withColumn("__folder", F.substring("__leaf", 1, FOLDER_DIGITS))
    rows.repartition("__folder").sortWithinPartitions("__folder", "__leaf").write.mode("overwrite").partitionBy("__folder").parquet(path)
    stored = documents.sparkSession.read.parquet(path).withColumn("__folder", F.col("__folder").cast("string"))
    content = comparable(stored.drop("__folder"), ignore + ("__leaf",))
    leaf = F.substring(F.md5("id"), 1, LEAF_DIGITS)
    digests = content.groupBy(leaf.alias("leaf")).agg(*row_digests(F.concat_ws("\n", "id", "content")))
    digests.withColumn("folder", F.substring("leaf", 1, FOLDER_DIGITS)).coalesce(1).write.mode("overwrite").parquet(f"{path}/_hashes")
    stored.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")


def unequal_ranges(spark: SparkSession, left: str, right: str) -> tuple[list[str], DataFrame]:
    """The folders in which two stored sessions differ (none if their roots agree), and the leaves that do, from the hashes alone."""
    a, b = (spark.read.parquet(f"{p}/_hashes") for p in (left, right))

    def differing(level: str, *within: Column) -> DataFrame:
        up = lambda h, s: h.where(F.lit(True) if not within else within[0]).groupBy(level).agg(*[F.sum(c).alias(f"{c}_{s}") for c in ("n", "hi", "lo")])
        met = up(a, "a").join(up(b, "b"), level, "full")
        equal = [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in ("n", "hi", "lo")]
        return met.where(~(equal[0] & equal[1] & equal[2])).select(level)

    folders = sorted(r[0] for r in differing("folder").collect())  # at most 16 ** FOLDER_DIGITS
    return folders, differing("leaf", F.col("folder").isin(folders))


def stored_session_diff(spark: SparkSession, left: str, right: str, ignore: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """:func:`session_diff` of two sessions that :func:`save_hashed` wrote; folders and leaves that agree are not read or joined."""
    folders, leaves = unequal_ranges(spark, left, right)

    def some(path: str) -> DataFrame:
        # With the schema given, no other file is opened for it, and a folder's name is text even if it looks like a number.
        rows = spark.read.schema(spark.read.parquet(f"{path}/_schema").schema).parquet(path)
        mine = rows.where(F.col("__folder").isin(folders))
        return mine.join(leaves.withColumnRenamed("leaf", "__leaf"), "__leaf", "left_semi").drop("__leaf", "__folder")

    return session_diff(some(left), some(right), ignore)
