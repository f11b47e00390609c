"""Summaries of a document store: counts by class, newest documents, star joins and numbered epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def type_histogram(documents: DataFrame) -> DataFrame:
    """``class_name, n`` of each class; documents without one count as ``unknown``."""
    return documents.groupBy(F.coalesce("class_name", F.lit("unknown")).alias("class_name")).agg(F.count("*").alias("n"))


def all_types(documents: DataFrame) -> DataFrame:
    return documents.select("class_name").where("class_name is not null").distinct()


def newest(documents: DataFrame, keys: list[str], stamp: str = "datestamp", order: str = "id") -> DataFrame:
    """The document with the latest time stamp of each key; one that cannot be read counts as earliest, ties take the first."""
    when = F.try_to_timestamp(F.col(stamp).cast("string"))
    ranked = documents.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(when), F.col(order))))
    return ranked.where("__n = 1").drop("__n")


def last_of_each(dim: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, so that a join to it does not multiply rows."""
    return dim.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def first_of_each(dim: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return dim.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def star_join(facts: DataFrame, dims: list[tuple[DataFrame, str]], fill: str = "") -> DataFrame:
    """Left joins of facts to dimensions by key; text that is missing becomes ``fill``."""
    out = facts
    added = []
    for dim, key in dims:
        added += [f.name for f in dim.schema.fields if f.name != key and f.dataType.typeName() == "string"]
        out = out.join(dim, key, "left")
    return out.select(*[F.coalesce(c, F.lit(fill)).alias(c) if c in added else F.col(c) for c in out.columns])


def epoch_numbers(epochs: DataFrame, probe: str, order: list[str]) -> DataFrame:
    """Epochs numbered from 1 within their probe."""
    return epochs.withColumn("epoch_number", F.row_number().over(W.partitionBy(probe).orderBy(*order)))


def variable_names(rows: DataFrame, order: str) -> DataFrame:
    """``name, variable, term``: three comma lists split in step; the first row of each name counts."""
    parts = [F.split(c, ",") for c in ("names", "variables", "terms")]
    each = rows.select(order, F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("name", "variable", "term"))])).alias("pos", "z"))
    flat = each.select(order, "pos", *[F.trim(F.col(f"z.{n}")).alias(n) for n in ("name", "variable", "term")])
    return flat.groupBy("name").agg(*[F.min_by(c, F.struct(order, "pos")).alias(c) for c in ("variable", "term")])


def pivot_attributes(rows: DataFrame, key: str, names: list[str], name: str, value: str) -> DataFrame:
    """One row for each key, one column a name: the largest value, empty where there is none."""
    wide = rows.groupBy(key).pivot(name, names).agg(F.max(value))
    return wide.select(key, *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) for n in names])


def duplicates(documents: DataFrame, key: Column, order: str = "id") -> DataFrame:
    """``id, keep``: documents that share a key, and the smallest id among them; empty keys are left out."""
    keyed = documents.select(F.col(order).alias("id"), key.alias("__key")).where("__key is not null and __key <> ''")
    keep = F.min("id").over(W.partitionBy("__key"))
    return keyed.withColumn("keep", keep).where("id <> keep").select("id", "keep")


def cube_counts(rows: DataFrame, by: list[str], of: str, distinct: str = "distinct") -> DataFrame:
    """``by, n, distinct``: rows and distinct values of ``of`` (nulls aside) for every grouping set of CUBE (``by``).

    A value counts once a set, so values that occur in the same cells count together: rows are first reduced to cells of a
    value, values to their lists of cells, and only these lists, of which there are few, are dealt over the grouping sets.
    """
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n")).cube(*by).agg(F.grouping_id().alias("__set"), F.sum("__n").alias("__n"))
    cells = rows.where(F.col(of).isNotNull()).select(F.col(of).alias("__of"), *by).distinct()
    lists = cells.groupBy("__of").agg(F.sort_array(F.collect_list(F.struct(*by))).alias("__cells")).groupBy("__cells").agg(F.count("*").alias("__values"))
    sets = [["__cells", *(c for i, c in enumerate(by) if s >> i & 1)] for s in range(2 ** len(by))]
    # The list's bit of the grouping id is 0 in every set, so the ids are those of the cube.
    each = lists.select("*", F.inline("__cells")).groupingSets(sets, "__cells", *by).agg(F.grouping_id().alias("__set"), F.first("__values").alias("__values"))
    both = counts.withColumn("__values", F.lit(0)).unionByName(each.drop("__cells").withColumn("__n", F.lit(0)))
    return both.groupBy("__set", *by).agg(F.sum("__n").alias("n"), F.sum("__values").alias(distinct)).drop("__set")


def table_hash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """MD5 of each group's rows in canonical order, to tell whether what was built from them is still valid."""
    line = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in keys]))
    return rows.groupBy(*keys).agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("hash"))


def row_digests(line: Column) -> list[Column]:
    """Aggregates ``n, hi, lo``: the number of rows, and two sums of 60 bits of each row's MD5. They do not depend on the order of
    rows, and sums of parts add up, so no group is ever held as a list."""
    part = lambda at: F.sum(F.conv(F.substring(F.md5(line), at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return [F.count("*").alias("n"), part(1).alias("hi"), part(16).alias("lo")]


def group_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, hi, lo`` of each group's rows in any order: equal groups, and as good as only they, have equal digests."""
    return rows.groupBy(*keys).agg(*row_digests(F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in keys]))))


def location_uids(documents: DataFrame) -> DataFrame:
    """Distinct uids of all file locations."""
    info = F.explode(F.try_variant_get("body", "$.files.file_info", "array<struct<name:string,locations:array<struct<uid:string>>>>"))
    return documents.select(info.alias("i")).select(F.explode("i.locations").alias("l")).select(F.col("l.uid").alias("uid")).where("uid <> ''").distinct()


def session_summary(documents: DataFrame) -> DataFrame:
    """``session_id, n_documents, classes, daqs, probes, files`` of each session: sorted names of its recorders and
    probes, its classes, and its number of files."""
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("class_name") == kind, F.col("name"))))
    files = F.coalesce(F.size(F.try_variant_get("body", "$.files.file_info", "array<variant>")), F.lit(0))
    return documents.groupBy("session_id").agg(
        F.count("*").alias("n_documents"), F.array_sort(F.collect_set("class_name")).alias("classes"), names("daqsystem").alias("daqs"),
        names("probe").alias("probes"), F.sum(F.greatest(files, F.lit(0))).alias("files"),
    )


def dataset_summary(sessions: DataFrame) -> DataFrame:
    """One row: how many sessions and documents a dataset has, and all its classes."""
    return sessions.agg(F.count("*").alias("n_sessions"), F.sum("n_documents").alias("n_documents"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))


def compare_summaries(left: DataFrame, right: DataFrame, fields: list[str], exclude: list[str] = [], key: str = "session_id") -> DataFrame:
    """``key, field, status``: a row for each field that differs; lists are compared in any order, a list of one as its
    value. A summary that one side lacks is ``only_left`` or ``only_right``, with a null field."""

    def plain(df: DataFrame, side: str) -> DataFrame:
        def text(c: str) -> Column:
            v = F.col(c)
            if df.schema[c].dataType.typeName() == "array":
                listed = F.array_sort(v.cast("array<string>"))
                return F.when(F.size(v) == 1, F.get(listed, 0)).otherwise(F.to_json(listed))
            return v.cast("string")

        return df.select(key, F.lit(True).alias(f"__{side}"), *[text(c).alias(f"__{side}_{c}") for c in fields if c not in exclude])

    both = plain(left, "l").join(plain(right, "r"), key, "full")
    each = [F.struct(F.lit(c).alias("field"), F.when(~F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")), "different").alias("status")) for c in fields if c not in exclude]
    lone = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right")
    one = F.array(F.struct(F.lit(None).cast("string").alias("field"), lone.alias("status")))
    found = F.when(lone.isNotNull(), one).otherwise(F.filter(F.array(*each), lambda s: s["status"].isNotNull()))
    return both.select(key, F.explode(found).alias("s")).select(key, "s.field", "s.status")
