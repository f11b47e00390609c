"""Tables made of documents: one row a document, grouped ontology tables, subject metadata, treatments, and path tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .query import TYPED, Query, search
from .tables import section_keys, spread_join

PATHS = "id string, path string, key string, text string"


def set_properties(documents: DataFrame, section: str, values: dict[str, Column]) -> DataFrame:
    """``documents`` with fields of a section of the body set; other fields and sections stay, and a section that is
    missing is made."""
    held = F.try_variant_get("body", "$", "map<string,variant>")
    mine = F.coalesce(F.try_variant_get("body", f"$.{section}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    new = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("variant") for v in values.values()]))
    kept = F.map_filter(mine, lambda k, _: ~k.isin(*values))
    rest = F.map_filter(F.coalesce(held, F.create_map().cast("map<string,variant>")), lambda k, _: k != section)
    whole = F.map_concat(rest, F.create_map(F.lit(section), F.call_function("to_variant_object", F.map_concat(kept, new))))
    return documents.withColumn("body", F.call_function("to_variant_object", whole))


def set_paths(documents: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``documents`` with many dotted paths set at once, in any sections and at any depth, in the order given.

    Identity paths (``base.id``, ``base.name`` and so on) are set in their columns. An object that is missing on the way, or a
    value that is none, becomes an object; everything beside a path stays.
    """
    empty = F.create_map().cast("map<string,variant>")

    def put(held: Column, parts: list[str], value: Column) -> Column:
        fields = F.coalesce(F.try_variant_get(held, "$", "map<string,variant>"), empty)
        new = value.cast("variant") if len(parts) == 1 else put(F.try_element_at(fields, F.lit(parts[0])), parts[1:], value)
        rest = F.map_filter(fields, lambda k, _: k != parts[0])
        return F.call_function("to_variant_object", F.map_concat(rest, F.create_map(F.lit(parts[0]), new)))

    out = documents
    for path, value in values.items():
        if not all(path.split(".")):
            raise ValueError(f"not a path: {path!r}")
        out = out.withColumn(TYPED[path], value.cast("string")) if path in TYPED else out.withColumn("body", put(F.col("body"), path.split("."), value))
    return out


def documents_table(documents: DataFrame, limit: int = 2000) -> DataFrame:
    """``id`` and a text column ``section_key`` for each key of each section of the body; at most ``limit`` sections and keys."""
    names = documents.select(F.explode(F.map_keys(F.try_variant_get("body", "$", "map<string,variant>"))).alias("s")).distinct()
    sections = [r["s"] for r in names.orderBy("s").limit(limit + 1).collect()]
    if len(sections) > limit:
        raise ValueError(f"more than {limit} sections")
    columns = []
    for s in sections:
        held = F.try_variant_get("body", f"$['{s}']", "map<string,variant>") if "'" not in s else None
        held = held if held is not None else F.try_variant_get(F.try_element_at(F.try_variant_get("body", "$", "map<string,variant>"), F.lit(s)), "$", "map<string,variant>")
        columns += [F.try_variant_get(F.try_element_at(held, F.lit(k)), "$", "string").alias(f"{s}_{k}") for k in section_keys(documents, s, limit)]
    return documents.select("id", *columns)


def ontology_tables(documents: DataFrame, order: str = "id") -> DataFrame:
    """``grp, variables, id, session_id, dependency, row``: rows of ontology documents, grouped by their set of variables.

    A document names its variables (comma-separated) and holds one value for each as a map; those without data are left
    out. Groups are numbered from 1 by the first document that has their variables, whatever the order of the names.
    """
    names = F.try_variant_get("body", "$.ontologyTableRow.variableNames", "string")
    data = F.try_variant_get("body", "$.ontologyTableRow.data", "map<string,string>")
    rows = documents.select(
        "id", "session_id", F.col(order).alias("__o"), F.array_sort(F.split(names, ",")).alias("variables"), data.alias("row"),
        F.get("depends_on", 0)["value"].alias("dependency"),
    ).where("row is not null and cardinality(row) > 0")
    groups = rows.groupBy("variables").agg(F.min("__o").alias("__first"))
    numbered = groups.withColumn("grp", F.row_number().over(W.orderBy("__first")))  # one row for each set of variables
    return rows.join(numbered.drop("__first"), "variables").select("grp", "variables", "id", "session_id", "dependency", "row")


def ontology_table(rows: DataFrame, grp: int, variables: list[str]) -> DataFrame:
    """One group's table: ``id`` and a column for each variable."""
    return rows.where(F.col("grp") == grp).select("id", *[F.try_element_at("row", F.lit(v)).alias(v) for v in variables])


def stacked_ontology_table(rows: DataFrame, variables: list[str]) -> DataFrame:
    """All groups in one table; a variable that a group lacks is null."""
    return rows.select("grp", "id", *[F.try_element_at("row", F.lit(v)).alias(v) for v in variables])


def typed_table(documents: DataFrame, class_name: str, fields: list[str], section: str | None = None) -> DataFrame:
    """``id, depends_on`` (the first dependency's value) and fields of the class's section: metadata of one type."""
    rows = documents.where(F.col("class_name") == class_name)
    at = section or class_name
    return rows.select("id", F.get("depends_on", 0)["value"].alias("depends_on"), *[F.try_variant_get("body", f"$.{at}.{f}", "string").alias(f) for f in fields])


def treatment_table(documents: DataFrame, fields: list[str], dependency: str = "subject_id", hide_mixture: bool = True) -> DataFrame:
    """``id, <dependency>`` and fields of treatment documents; columns that name a mixture are hidden."""
    shown = [f for f in fields if not (hide_mixture and "mixture" in f.lower())]
    value = F.get(F.filter("depends_on", lambda d: d["name"] == dependency), 0)["value"]
    rows = search(documents, Query().isa("treatment"))
    return rows.select("id", value.alias(dependency), *[F.try_variant_get("body", f"$.treatment.{f}", "string").alias(f) for f in shown])


def path_table(documents: DataFrame, max_depth: int = 12) -> DataFrame:
    """``id, path, key, text, is_text``: every key of every object in the bodies, with its value as text; lists are not entered.

    Bodies are walked level by level within their row, so documents are read once and nothing is shuffled. An object deeper
    than ``max_depth`` is an error when the plan runs.
    """
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")

    def entries(held: Column) -> Column:
        """The fields of the objects of a level."""

        def of(x: Column) -> Column:
            path = lambda key: F.when(x["path"] == "", key).otherwise(F.concat(x["path"], F.lit("."), key))
            return F.transform(F.map_entries(x["m"]), lambda e: F.struct(path(e["key"]).alias("path"), e["key"].alias("key"), e["value"].alias("v")))

        opened = F.transform(held, lambda x: F.struct(x["path"].alias("path"), fields(x["v"]).alias("m")))
        return F.flatten(F.transform(F.filter(opened, lambda x: x["m"].isNotNull()), of))

    level = F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("key"), F.col("body").alias("v")))
    # No filter on bodies, and no plain explode: both would be pushed down, and bodies made or walked twice.
    rows = documents.select("id", level.alias("__l0"))
    for depth in range(1, max_depth + 1):
        rows = rows.withColumn(f"__l{depth}", entries(F.col(f"__l{depth - 1}")))
    last = F.col(f"__l{max_depth}")
    deep = F.when(F.exists(last, lambda x: fields(x["v"]).isNotNull()), F.raise_error(F.lit(f"objects deeper than {max_depth}"))).otherwise(last)
    every = F.concat(*[F.col(f"__l{depth}") for depth in range(1, max_depth)], deep)
    each = rows.select("id", every.alias("__all")).select("id", F.explode_outer("__all").alias("x")).where("x is not null")
    text, kind = F.try_variant_get("x.v", "$", "string"), F.schema_of_variant("x.v")
    return each.select("id", "x.path", "x.key", text.alias("text"), F.startswith(kind, F.lit("STRING")).alias("is_text"))


def content_search(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Ids of documents where some key, in any case, has a text value that contains ``text``, in any case."""
    t = path_table(documents)
    return t.where((F.lower("key") == key.lower()) & F.col("is_text") & F.contains(F.lower("text"), F.lit(text.lower()))).select("id").distinct()


def field_name_search(documents: DataFrame, key: str) -> DataFrame:
    """Ids of documents that have a key, in any case, in any object."""
    return path_table(documents).where(F.lower("key") == key.lower()).select("id").distinct()


FILES = "array<struct<name:string,locations:array<struct<uid:string,location:string,ingest:boolean,delete_original:boolean>>>>"


def file_rows(documents: DataFrame) -> DataFrame:
    """``id, name, uid, location`` of every location of every file of the documents."""
    info = documents.select("id", F.explode(F.try_variant_get("body", "$.files.file_info", FILES)).alias("f"))
    return info.select("id", "f.name", F.explode("f.locations").alias("l")).select("id", "name", "l.uid", "l.location")


def find_uid(documents: DataFrame, uid: str) -> DataFrame:
    """The first document, by id, with a file location of this uid."""
    hit = file_rows(documents).where(F.col("uid") == uid).agg(F.min("id").alias("id")).where("id is not null")
    return documents.join(hit, "id", "left_semi")


def add_file(files: Column, name: Column, location: Column, uid: Column, ingest: bool = True, delete_original: bool = False) -> Column:
    """A file list with one more location: of the file if it is listed, else of a new one behind it.

    A name that ends in ``#`` stands for a numbered series: the file gets the number after the largest that is listed, so a
    number that was removed before it does not make two files one.
    """
    where = F.struct(uid.alias("uid"), location.alias("location"), F.lit(ingest).alias("ingest"), F.lit(delete_original).alias("delete_original"))
    stem = F.regexp_replace(name, "#$", "")
    number = lambda f: F.when(F.startswith(f["name"], stem), F.when(F.substring(f["name"], F.length(stem) + 1, F.lit(20)).rlike("^[0-9]+$"), F.substring(f["name"], F.length(stem) + 1, F.lit(20)).try_cast("int")))
    largest = F.coalesce(F.array_max(F.transform(files, number)), F.lit(0))
    full = F.when(F.endswith(name, F.lit("#")), F.concat(stem, (largest + 1).cast("string"))).otherwise(name)
    more = F.transform(files, lambda f: F.struct(f["name"].alias("name"), F.when(f["name"] == full, F.concat(f["locations"], F.array(where))).otherwise(f["locations"]).alias("locations")))
    new = F.concat(files, F.array(F.struct(full.alias("name"), F.array(where).alias("locations"))))
    return F.when(F.exists(files, lambda f: f["name"] == full), more).otherwise(new)


def remove_file(files: Column, name: Column) -> Column:
    return F.filter(files, lambda f: f["name"] != name)


def has_file(files: Column, name: Column) -> Column:
    """Whether a file is listed; a name that ends in ``#`` stands for any number."""
    stem = F.regexp_replace(name, "#$", "")
    series = lambda f: F.startswith(f["name"], stem) & F.substring(f["name"], F.length(stem) + 1, F.lit(20)).rlike("^[0-9]+$")
    return F.exists(files, lambda f: F.when(F.endswith(name, F.lit("#")), series(f)).otherwise(f["name"] == name))


def of_element_epoch(documents: DataFrame, element_id: str, epoch_id: str, kind: str) -> DataFrame:
    """Documents of a class that depend on an element and belong to an epoch."""
    return search(documents, Query().isa(kind) & Query().depends_on("element_id", element_id) & (Query("epochid.epochid") == epoch_id))


#: Classes of documents that ingestion writes.
INGESTED = ("daqreader_epochdata_ingested", "daqmetadatareader_epochdata_ingested", "epochfiles_ingested")


def ingested_documents(documents: DataFrame, classes: tuple[str, ...] = INGESTED) -> DataFrame:
    """Documents of any of the classes that ingestion writes."""
    return search(documents, reduce(lambda a, b: a | b, [Query().isa(c) for c in classes]))


def probe_locations(elements: DataFrame, locations: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``root, probe, id``: location documents of the probe that each element rests on.

    ``elements`` has ``id, underlying`` (null for a probe itself); ``locations`` has ``id, probe``.
    """
    from .graph import ancestors

    edges = elements.where("underlying is not null").select(F.col("id").alias("src"), F.col("underlying").alias("dst"))
    below = elements.select(F.col("id").alias("root"), F.col("id")).unionByName(ancestors(edges, elements, max_depth).select("root", "id"))
    probes = below.join(elements.where("underlying is null").select("id"), "id", "left_semi").select("root", F.col("id").alias("probe"))
    return spread_join(probes, locations.select("id", "probe"), ["probe"]).select("root", "probe", "id")


def match_subjects(texts: DataFrame, subjects: DataFrame, text: str = "subject") -> DataFrame:
    """``texts`` with ``subject_id``: the subject whose id or local identifier the text is, null if there is none."""
    by_id = subjects.select(F.col("id").alias("__key"), F.col("id").alias("subject_id"), F.lit(0).alias("__p"))
    by_name = subjects.select(F.col("local_identifier").alias("__key"), F.col("id").alias("subject_id"), F.lit(1).alias("__p"))
    keys = by_id.unionByName(by_name).groupBy("__key").agg(F.min_by("subject_id", F.struct("__p", "subject_id")).alias("subject_id"))
    return texts.join(keys, F.col(text) == F.col("__key"), "left").drop("__key")


#: Text fields of a mixture's component.
COMPONENT = ("ontologyName", "name", "value", "ontologyUnit", "unitName")


def mixture_key(components: Column) -> Column:
    """A canonical text of a mixture: its components in any order, by their text fields."""
    return F.to_json(F.array_sort(F.transform(components, lambda c: F.struct(*[F.coalesce(c[f].cast("string"), F.lit("")).alias(f) for f in COMPONENT]))))


def match_mixtures(mixtures: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``id, mixture``: the dictionary's names for mixtures (``id, components``) with equal components."""
    a = mixtures.select("id", mixture_key(F.col("components")).alias("__k"))
    b = dictionary.select(F.col("name").alias("mixture"), mixture_key(F.col("components")).alias("__k"))
    return a.join(b, "__k").select("id", "mixture")


def subject_documents(subjects: DataFrame) -> DataFrame:
    """Documents of species, strain and sex for each subject (``subject_id, species, strain, sex``); a value that is null
    makes none, and each depends on its subject."""
    kinds = ("species", "strain", "sex")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
    rows = subjects.select("subject_id", F.explode(F.filter(each, lambda s: s["value"].isNotNull())).alias("s"))
    return rows.select(
        F.md5(F.concat_ws("/", "subject_id", "s.kind")).alias("id"), F.col("s.kind").alias("class_name"), F.col("s.value").alias("name"),
        F.array(F.struct(F.lit("subject_id").alias("name"), F.col("subject_id").alias("value"))).alias("depends_on"),
    )


def self_query(kind: str, **fields) -> Query:
    """The query that finds an object's own document: its class, and whatever else identifies it."""
    q = Query().isa(kind)
    for path, value in fields.items():
        q = q & (Query(path.replace("__", ".")) == value)
    return q


def validate_documents(documents: DataFrame, rules: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """``id, path, error`` of every property that breaks its class's schema, and of dependencies that are missing or dangle.

    ``rules`` has ``class_name, path, type, low, high, required``; ``type`` is string, integer, double, boolean, id or
    dependency. A property that is missing breaks a rule that requires it; an empty value passes. A rule holds for its
    class and for those that have it as a superclass. ``known_ids`` are ids that a dependency may name; without it they
    are not looked up.
    """
    classes = documents.select("id", "depends_on", F.explode(F.array_union(F.array("class_name"), F.coalesce("superclasses", F.array().cast("array<string>")))).alias("class_name"))
    rules = F.broadcast(rules)  # schemas of classes, which do not grow with the documents
    met = classes.join(rules, "class_name")
    paths = path_table(documents).join(rules.select("path").distinct().hint("broadcast"), "path", "left_semi").select("id", "path", "text")
    plain = met.where("type <> 'dependency'").join(paths, ["id", "path"], "left")
    text = F.col("text")
    good = (
        F.when(F.col("type") == "integer", text.try_cast("decimal(38,0)").isNotNull() & text.rlike(r"^\s*[+-]?\d+\s*$"))
        .when(F.col("type") == "double", text.try_cast("double").isNotNull())
        .when(F.col("type") == "boolean", F.lower(text).isin("true", "false"))
        .when(F.col("type") == "id", F.length(text) == 33)
        .otherwise(F.lit(True))
    )
    number = text.try_cast("double")
    error = (
        F.when(text.isNull() & F.col("required"), "missing").when(text.isNull() | (text == ""), None)
        .when(~F.coalesce(good, F.lit(False)), "type").when((number < F.col("low")) | (number > F.col("high")), "range")
    )
    wrong = plain.select("id", "path", error.alias("error"))
    value = F.get(F.filter("depends_on", lambda d: d["name"] == F.col("path")), 0)["value"]
    edges = met.where("type = 'dependency'").select("id", "path", "required", value.alias("__dst"))
    wrong = wrong.unionByName(edges.select("id", "path", F.when((F.coalesce("__dst", F.lit("")) == "") & F.col("required"), "missing").alias("error")))
    if known_ids is not None:
        dangling = edges.where("coalesce(__dst, '') <> ''").join(known_ids.select(F.col("id").alias("__dst")), "__dst", "left_anti")
        wrong = wrong.unionByName(dangling.select("id", "path", F.lit("dangling").alias("error")))
    return wrong.where("error is not null").distinct()
