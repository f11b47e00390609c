"""The document store: building, reading, adding, replacing and deleting documents as DataFrame operations.

A document is a row ``id, session_id, name, datestamp, class_name, superclasses, depends_on, body``. Writers return the
new content of the store, or only the rows to append; saving is a Parquet write partitioned by class.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import descendants, edges_of
from .query import Query, index_column, path_value, search
from .segments import sums_before

ENVELOPE = ("id", "session_id", "name", "datestamp", "class_name", "superclasses", "depends_on")
EDGES = "array<struct<name:string,value:string>>"


def edge(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))


def edge_list(*edges: Column) -> Column:
    """An array of the edges that have a value."""
    return F.filter(F.array(*edges), lambda d: d["value"].isNotNull()) if edges else F.array().cast(EDGES)


def make_documents(
    rows: DataFrame, ident: Column, class_name: str, superclasses: list[str], edges: Column | None = None,
    name: Column | None = None, session: Column | None = None, datestamp: Column | None = None, section: dict[str, Column] | None = None,
) -> DataFrame:
    """A document for each row; ``section`` holds the fields of the class's own section of the body."""
    fields = section or {c: F.col(f"`{c}`") for c in rows.columns}
    body = F.struct(F.struct(*[v.alias(k) for k, v in fields.items()]).alias(class_name))
    return rows.select(
        ident.cast("string").alias("id"),
        (session if session is not None else F.lit("")).cast("string").alias("session_id"),
        (name if name is not None else ident).cast("string").alias("name"),
        (datestamp if datestamp is not None else F.lit(None)).cast("string").alias("datestamp"),
        F.lit(class_name).alias("class_name"),
        F.array(*[F.lit(s) for s in superclasses]).cast("array<string>").alias("superclasses"),
        (edges if edges is not None else edge_list()).cast(EDGES).alias("depends_on"),
        F.call_function("to_variant_object", body).alias("body"),
    )


def from_json(rows: DataFrame, text: str = "value") -> DataFrame:
    """Documents of JSON texts. A lone object where a list is due (edges, superclasses) becomes a list of one."""
    v = F.try_parse_json(F.col(text))
    get = lambda path, kind: F.try_variant_get(F.col("__v"), path, kind)
    one = lambda path, kind: F.coalesce(get(path, f"array<{kind}>"), F.array_compact(F.array(get(path, kind))))
    supers = F.transform(one("$.document_class.superclasses", "struct<definition:string>"), lambda s: F.regexp_extract(s["definition"], r"([^/]+?)(?:\.json)?$", 1))
    return rows.withColumn("__v", v).where("__v is not null").select(
        get("$.base.id", "string").alias("id"),
        F.coalesce(get("$.base.session_id", "string"), F.lit("")).alias("session_id"),
        get("$.base.name", "string").alias("name"),
        get("$.base.datestamp", "string").alias("datestamp"),
        get("$.document_class.class_name", "string").alias("class_name"),
        supers.alias("superclasses"),
        one("$.depends_on", "struct<name:string,value:string>").alias("depends_on"),
        F.col("__v").alias("body"),
    )


def read_json_folder(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of JSON files, one document a file."""
    return from_json(spark.read.text(path, wholetext=True, pathGlobFilter="*.json"))


def save(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Write documents, one folder a class, so that predicates on the class prune folders."""
    documents.withColumn("class", F.coalesce("class_name", F.lit("unknown"))).write.mode(mode).partitionBy("class").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("class")


def hot_paths(queries: list[Query], least: int = 1) -> list[tuple[str, str]]:
    """The body paths, with the kinds, that at least so many of the queries compare."""
    seen = Counter(p for q in queries for p in q.paths())
    return sorted(p for p, n in seen.items() if n >= least)


def with_index(documents: DataFrame, paths: list[tuple[str, str]]) -> DataFrame:
    """The documents with a typed column for each body path and kind; the schema is the catalogue that searches consult."""
    return documents.withColumns({index_column(p, k): path_value(p, k) for p, k in paths})


def save_indexed(documents: DataFrame, path: str, paths: list[tuple[str, str]], mode: str = "append", cluster: tuple[str, str] | None = None) -> None:
    """Write documents with typed columns for hot body paths, so that comparisons on these reach the scan.

    ``cluster`` is the path by whose values files and their row groups are laid out, so that its statistics skip them.
    A store keeps the paths it was begun with: they stand in its catalogue, and appending under other ones is an error.
    """
    spark, paths = documents.sparkSession, sorted(set(paths))
    known = indexed_paths(spark, path) if mode == "append" else None
    if known is not None and known != paths:
        raise ValueError(f"the store is indexed by {known}")
    rows = with_index(documents, paths)
    if cluster is not None:
        by = f"`{index_column(*cluster)}`"
        rows = rows.repartitionByRange("class_name", by).sortWithinPartitions("class_name", by)
    save(rows, path, mode)
    if known is None:
        spark.createDataFrame([tuple(x) for x in paths], "path string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_index")


def indexed_paths(spark: SparkSession, path: str) -> list[tuple[str, str]] | None:
    """The catalogue of a store: its indexed paths and kinds, or nothing if it has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_index")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return sorted(tuple(r) for r in spark.read.schema("path string, kind string").parquet(f"{path}/_index").collect())


def load_indexed(spark: SparkSession, path: str) -> DataFrame:
    """An indexed store with its index columns, for :func:`tessera.operators.query.search`."""
    if indexed_paths(spark, path) is None:
        raise ValueError(f"{path} has no index")
    return spark.read.parquet(path).drop("class")


def read_one(documents: DataFrame, ident: str, isa: str | None = None) -> DataFrame:
    """The document with this id, if there is one and it is of the class."""
    out = documents.where(F.col("id") == ident)
    return (out.where(Query().isa(isa).column()) if isa else out).limit(1)


def add(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append; an id that the store holds, or that comes twice, is an error when the plan runs."""
    twice = W.partitionBy("id")
    known = store.select("id").distinct().withColumn("__known", F.lit(True))
    marked = new.withColumn("__n", F.count("*").over(twice)).join(known, "id", "left")
    bad = F.col("__known").isNotNull() | (F.col("__n") > 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("document exists: "), F.col("id")))).otherwise(F.col("id"))
    return marked.withColumn("id", checked).select(*new.columns)


def first_of_each(new: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each id: the first by ``order``, or by its content, so that a rerun keeps the same."""
    by = F.col(order) if order is not None else F.to_json(F.struct(*[c for c in new.columns if c != "id"]))
    return new.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy(by))).where("__n = 1").drop("__n")


def bulk_add(store: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Rows to append: one for each id that the store does not hold."""
    return first_of_each(new, order).join(store.select("id"), "id", "left_anti").select(*new.columns)


def bulk_counts(store: DataFrame, new: DataFrame) -> DataFrame:
    """``added, skipped`` of :func:`bulk_add`."""
    ids = new.groupBy("id").agg(F.count("*").alias("n")).join(store.select(F.col("id"), F.lit(1).alias("known")).distinct(), "id", "left")
    added = F.count_if(F.col("known").isNull())
    return ids.agg(added.alias("added"), (F.coalesce(F.sum("n"), F.lit(0)) - added).alias("skipped"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with ``new`` in place of the documents that have its ids."""
    return store.join(new.select("id"), "id", "left_anti").select(*store.columns).unionByName(new)


def update(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with those of ``new`` that it already holds."""
    return upsert(store, new.join(store.select("id"), "id", "left_semi").select(*new.columns))


def remove(store: DataFrame, query: Query | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The store without what the query selects and without the listed ids."""
    out = store if query is None else store.where(~F.coalesce(query.column(), F.lit(False)))
    return out if ids is None else out.join(ids.select("id"), "id", "left_anti").select(*store.columns)


def remove_with_dependents(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the listed documents and all that depend on them, at any distance; cycles do no harm."""
    gone = descendants(edges_of(store), ids).select("id").unionByName(ids.select("id"))
    return store.join(gone.distinct(), "id", "left_anti").select(*store.columns)


def stamp_session(new: DataFrame, session_id: str) -> DataFrame:
    """New documents of a session: an empty session id is filled in, another one is an error when the plan runs."""
    mine = F.coalesce("session_id", F.lit(""))
    stamped = F.when(mine.isin("", session_id), F.lit(session_id)).otherwise(F.raise_error(F.concat(F.lit("another session: "), mine)))
    return new.withColumn("session_id", stamped)


def federated_search(stores: list[DataFrame], query: Query | None = None) -> DataFrame:
    """What the query selects in each store, one after the other; nothing is dropped."""
    out = search(stores[0], query)
    for other in stores[1:]:
        out = out.unionByName(search(other, query), allowMissingColumns=True)
    return out


def copy_session(store: DataFrame, dataset: DataFrame, session_id: str) -> DataFrame:
    """The documents of a session that the dataset lacks."""
    return bulk_add(dataset, store.where(F.col("session_id") == session_id))


def to_json(documents: DataFrame) -> DataFrame:
    """``id, json``: each document as one JSON text, which :func:`from_json` reads back."""
    base = F.struct("id", "session_id", "name", "datestamp")
    kind = F.struct("class_name", F.transform("superclasses", lambda s: F.struct(s.alias("definition"))).alias("superclasses"))
    head = F.to_json(F.struct(base.alias("base"), kind.alias("document_class"), F.col("depends_on")))
    sections = F.to_json("body")
    whole = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(","), sections.substr(F.lit(2), F.length(sections)))
    return documents.select("id", whole.alias("json"))


def docs_from_ids(documents: DataFrame, ids: DataFrame, pos: str = "pos") -> DataFrame:
    """One row for each listed id, in the list's order; documents that are missing are null."""
    return ids.select(pos, "id").join(documents, "id", "left").orderBy(pos)


def session_id_of(documents: DataFrame) -> DataFrame:
    """The only session id that is not empty, or an empty text."""
    named = F.when(F.col("session_id") != "", F.col("session_id"))
    return documents.agg(F.when(F.countDistinct(named) == 1, F.max(named)).otherwise(F.lit("")).alias("session_id"))


def document_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each document of ``left`` joined to the one of ``right`` with its id: superclasses are added, and an edge of
    ``right`` takes the place of one with its name."""
    r = right.select("id", F.col("superclasses").alias("__s"), F.col("depends_on").alias("__d"))
    theirs = F.coalesce("__d", F.array().cast(EDGES))
    kept = F.filter("depends_on", lambda d: ~F.exists(theirs, lambda o: o["name"] == d["name"]))
    return (
        left.join(r, "id", "left")
        .withColumn("superclasses", F.array_union("superclasses", F.coalesce("__s", F.array().cast("array<string>"))))
        .withColumn("depends_on", F.concat(kept, theirs))
        .select(*left.columns)
    )


def id_list(documents: DataFrame, session_id: str | None = None) -> DataFrame:
    """Ids of all documents, or of a session's."""
    out = documents if session_id is None else documents.where(F.col("session_id") == session_id)
    return out.select("id")


def id_counts(documents: DataFrame) -> DataFrame:
    """``session_id, n``: documents of each session."""
    return documents.groupBy("session_id").agg(F.count("*").alias("n"))


def add_named(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append, as :func:`add`; a name that the store holds is an error as well."""
    names = store.select(F.col("name").alias("__name")).distinct()
    marked = add(store, new).join(names, F.col("name") == F.col("__name"), "left")
    bad = F.raise_error(F.concat(F.lit("name exists: "), F.col("name")))
    return marked.withColumn("name", F.when(F.col("__name").isNotNull(), bad).otherwise(F.col("name"))).select(*new.columns)


def clear(store: DataFrame, sure: str) -> DataFrame:
    """An empty store, if ``sure`` is ``yes``; every session's documents go."""
    return store.where("false") if sure == "yes" else store


def foreign_documents(documents: DataFrame, session_id: str) -> DataFrame:
    """Documents that belong to another session; those without one belong to any."""
    return documents.where(~F.coalesce("session_id", F.lit("")).isin("", session_id))


def routed(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """New documents of a dataset; a session that it lacks is an error when the plan runs."""
    known = sessions.select("session_id", F.lit(True).alias("__known")).distinct()
    bad = F.raise_error(F.concat(F.lit("no such session: "), F.col("session_id")))
    met = new.join(known, "session_id", "left")
    return met.withColumn("session_id", F.when(F.col("__known").isNull(), bad).otherwise(F.col("session_id"))).select(*new.columns)


def session_entries(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """A dataset's session entries (``session_id, is_linked``) repaired: one for each session that is listed or has
    documents; one that is not listed is not linked."""
    seen = documents.where("session_id <> ''").select("session_id", F.lit(None).cast("boolean").alias("is_linked"))
    both = entries.select("session_id", "is_linked").unionByName(seen)
    return both.groupBy("session_id").agg(F.coalesce(F.max("is_linked"), F.lit(False)).alias("is_linked"))


def evictions(items: DataFrame, needed: int, capacity: int, order: str = "fifo", keys: list[str] = []) -> DataFrame:
    """The cached items that leave so that ``needed`` bytes fit: lowest priority first, of equal ones the oldest (``fifo``)
    or the newest (``lifo``); ``error`` raises when the plan runs if any has to leave. ``items``: ``key, priority, t, bytes``."""
    if order not in ("fifo", "lifo", "error"):
        raise ValueError(f"unknown order: {order}")
    t = F.desc("t") if order == "lifo" else F.asc("t")
    if keys:
        held = F.sum("bytes").over(W.partitionBy(*keys))
        before = F.coalesce(F.sum("bytes").over(W.partitionBy(*keys).orderBy("priority", t, "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        marked = items.withColumn("__short", held + needed - capacity).withColumn("__before", before)
    else:  # one cache: what it holds is one number, and its order is laid out in ranges
        held = items.agg(F.sum("bytes")).first()[0] or 0
        marked = sums_before(items, [F.col("priority").asc(), t, F.col("key").asc()], F.col("bytes"), "__before").withColumn("__short", F.lit(held + needed - capacity))
    out = marked.where((F.col("__short") > 0) & (F.col("__before") < F.col("__short"))).drop("__short", "__before")
    return out.withColumn("key", F.raise_error(F.lit("the cache is full")).cast(items.schema["key"].dataType)) if order == "error" else out
