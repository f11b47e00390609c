"""Validation from class definitions: schema files become rules by class, and documents are checked by their own.

A schema file is a JSON object with ``classname``, ``superclasses``, ``depends_on`` (``name``, ``mustbenotempty``) and, under the
class's name, its properties (``name``, ``type``, ``parameters``). A class inherits the sections of all classes above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import ancestors

PROPERTIES = "array<struct<name:string,type:string,low:double,high:double,length:double>>"


def parse_schemas(texts: DataFrame, text: str = "value") -> DataFrame:
    """``class_name, superclasses, depends_on, properties`` of JSON texts; those that are no schema are left out.

    Of several schemas of one class, the first by its text counts.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    rows = texts.select(F.try_parse_json(F.col(text)).alias("v"), F.col(text).alias("t"))
    named = rows.select("t", "v", get("v", "$.classname", "string").alias("class_name")).where("class_name is not null")
    own = F.try_element_at(get("v", "$", "map<string,variant>"), F.col("class_name"))

    def one(p: Column) -> Column:
        ends = get(p, "$.parameters", "array<double>")
        return F.struct(
            get(p, "$.name", "string").alias("name"), get(p, "$.type", "string").alias("type"),
            F.get(ends, 0).alias("low"), F.get(ends, 1).alias("high"), get(p, "$.parameters", "double").alias("length"),
        )

    listed = F.filter(F.transform(get(own, "$", "array<variant>"), one), lambda p: F.coalesce(p["name"], F.lit("")) != "")
    edges = F.transform(get("v", "$.depends_on", "array<struct<name:string,mustbenotempty:double>>"), lambda d: F.struct(d["name"].alias("name"), (F.coalesce(d["mustbenotempty"], F.lit(0.0)) != 0).alias("required")))
    supers = get("v", "$.superclasses", "array<string>")
    out = named.select(
        "class_name", "t", F.coalesce(supers, F.array().cast("array<string>")).alias("superclasses"),
        F.coalesce(edges, F.array().cast("array<struct<name:string,required:boolean>>")).alias("depends_on"),
        F.coalesce(listed, F.array()).cast(PROPERTIES).alias("properties"),
    )
    whole = F.struct("superclasses", "depends_on", "properties")
    return out.groupBy("class_name").agg(F.min_by(whole, "t").alias("s")).select("class_name", "s.*")


def read_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """The schemas of all ``*_schema.json`` files below a folder."""
    return parse_schemas(spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True, pathGlobFilter="*_schema.json"))


def compile_rules(schemas: DataFrame) -> DataFrame:
    """``class_name, sections, depends_on``: each class's own section first, then those of all classes above it.

    A section says whether it is the class's own, and whether its schema is known.
    """
    edges = schemas.select(F.col("class_name").alias("src"), F.explode("superclasses").alias("dst"))
    above = ancestors(edges, schemas.select(F.col("class_name").alias("id"))).select(F.col("root").alias("class_name"), F.col("id").alias("section")).where("class_name <> section")
    known = schemas.select(F.col("class_name").alias("section"), "properties")
    each = above.withColumn("own", F.lit(False)).unionByName(schemas.select("class_name", F.col("class_name").alias("section"), F.lit(True).alias("own")))
    met = each.join(known, "section", "left")
    section = F.struct((~F.col("own")).alias("later"), "section", "own", F.col("properties").isNotNull().alias("known"), "properties")
    listed = met.groupBy("class_name").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    return listed.join(schemas.select("class_name", "depends_on"), "class_name")


def _error(value: Column, rule: Column) -> Column:
    """What is wrong with a value (a variant, null where the property is missing), or null."""
    kind, kind_of = F.schema_of_variant(value), rule["type"]
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    is_text = kind == "STRING"
    is_number = kind.rlike("^(BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    whole = kind.rlike("^(BOOLEAN|TINYINT|SMALLINT|INT|BIGINT)") | (number == F.floor(number))
    good = (
        F.when(kind_of.isin("did_uid", "char", "string"), is_text)
        .when(kind_of == "integer", is_number & whole)
        .when(kind_of == "double", is_number)
        .when(kind_of == "timestamp", is_text & text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"))
        .when(kind_of == "matrix", F.startswith(kind, F.lit("ARRAY")))
        .when(kind_of == "structure", F.startswith(kind, F.lit("OBJECT")))
        .otherwise(True)
    )
    return (
        F.when(value.isNull(), "missing property")
        .when((kind == "VOID") | (is_text & (text == "")), None)
        .when(~F.coalesce(good, F.lit(False)), "type")
        .when((kind_of == "integer") & ((number < rule["low"]) | (number > rule["high"])), "range")
        .when((kind_of == "did_uid") & (rule["length"] > 0) & (F.length(text) != F.floor(rule["length"])), "length")
    )


def validate_by_class(documents: DataFrame, rules: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """``id, part, path, error`` of everything that breaks a document's class's rules; without a schema a document is valid.

    ``part`` is ``this``, the name of the superclass, or ``depends_on``. An empty or null value passes, a property that
    is missing does not. A document without a class's section lacks the section as a whole, if the class has
    properties. ``known_ids`` are ids that a dependency may name; without them these are not looked up. Identity fields
    are the ``base`` section of a body without one.
    """
    sections = F.try_variant_get("body", "$", "map<string,variant>")
    base = F.call_function("to_variant_object", F.struct(F.col("id"), F.col("session_id"), F.col("name"), F.col("datestamp")))
    met = documents.join(rules.withColumnRenamed("depends_on", "__edges"), "class_name")
    met = met.withColumn("__map", F.coalesce(sections, F.create_map().cast("map<string,variant>")))
    held = lambda s: F.when((s == "base") & ~F.map_contains_key("__map", "base"), base).otherwise(F.try_element_at("__map", s))

    def of_section(s: Column) -> Column:
        part = F.when(s["own"], "this").otherwise(s["section"])
        row = lambda path, error: F.struct(part.alias("part"), path.alias("path"), error.alias("error"))
        fields = F.try_variant_get(held(s["section"]), "$", "map<string,variant>")
        each = F.transform(s["properties"], lambda p: row(F.concat_ws(".", s["section"], p["name"]), _error(F.try_element_at(fields, p["name"]), p)))
        lacks = F.array(row(s["section"], F.when(F.size(s["properties"]) > 0, "missing section")))
        return F.when(~s["known"], F.array(row(s["section"], F.lit("no schema")))).when(fields.isNull(), lacks).otherwise(each)

    def of_edge(d: Column) -> Column:
        found = F.get(F.filter("depends_on", lambda e: e["name"] == d["name"]), 0)
        error = F.when(d["required"] & found.isNull(), "missing").when(d["required"] & (F.coalesce(found["value"], F.lit("")) == ""), "empty")
        return F.struct(F.lit("depends_on").alias("part"), d["name"].alias("path"), error.alias("error"))

    wrong = F.filter(F.concat(F.flatten(F.transform("sections", of_section)), F.transform("__edges", of_edge)), lambda e: e["error"].isNotNull())
    out = met.select("id", F.explode(wrong).alias("e")).select("id", "e.*")
    if known_ids is None:
        return out
    first = F.transform("__edges", lambda d: F.struct(d["name"].alias("name"), F.get(F.filter("depends_on", lambda e: e["name"] == d["name"]), 0)["value"].alias("value")))
    edges = met.select("id", F.explode(first).alias("d")).where("coalesce(d.value, '') <> ''").select("id", F.col("d.name").alias("path"), F.col("d.value").alias("__dst"))
    dangling = edges.join(known_ids.select(F.col("id").alias("__dst")).distinct(), "__dst", "left_anti")
    return out.unionByName(dangling.select("id", F.lit("depends_on").alias("part"), "path", F.lit("dangling").alias("error")))
