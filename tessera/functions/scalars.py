"""Scalar functions over columns: names, device strings, identifiers, time stamps, cells, bytes, and validation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID_PATTERN = r"^[0-9a-fA-F]{16}_[0-9a-fA-F]{16}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def variable_name(name: Column) -> Column:
    """Words capitalised and joined; colons and hyphens become underscores, other signs part words; a name that does not
    begin with a letter gets ``var_``, a blank one stays empty."""
    clean = F.regexp_replace(F.regexp_replace(name, "[:-]", "_"), "[^A-Za-z0-9_]", " ")
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100000))), "")
    return F.when(joined == "", "").when(joined.rlike("^[A-Za-z]"), joined).otherwise(F.concat(F.lit("var_"), joined))


def camel_name(name: Column) -> Column:
    """The first word in lower case, the others capitalised; a name that does not begin with a letter gets ``x``."""
    words = F.filter(F.split(F.regexp_replace(name, "[^A-Za-z0-9]", " "), " "), lambda w: w != "")
    put = lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100000))))
    joined = F.array_join(F.transform(words, put), "")
    return F.when(joined == "", "").when(joined.rlike("^[A-Za-z]"), joined).otherwise(F.concat(F.lit("x"), joined))


def channel_prefix(name: Column) -> Column:
    """What stands before the first digit, null if there is none."""
    return F.nullif(F.regexp_extract(name, r"^([^0-9]+)[0-9]+$", 1), F.lit(""))


def channel_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^[^0-9]+([0-9]+)$", 1).try_cast("int")


def device_name(text: Column) -> Column:
    return F.regexp_extract(text, "^([^:]*):", 1)


def device_channels(text: Column) -> Column:
    """The channels of ``device:ai1-5,7;di1;aep1-3_t2.5`` as sorted distinct ``struct<type, number>``; a threshold stays
    with its type."""
    parts = F.filter(F.split(F.regexp_extract(text, "^[^:]*:(.*)$", 1), ";"), lambda p: p != "")

    def of_part(p: Column) -> Column:
        kind, tail = F.regexp_extract(p, r"^([A-Za-z]+)", 1), F.regexp_extract(p, r"(_t-?[0-9.]+)$", 1)
        runs = F.split(F.regexp_replace(F.regexp_replace(p, r"^[A-Za-z]+", ""), r"_t-?[0-9.]+$", ""), ",")
        ends = lambda r: F.split(r, "-")
        first = lambda r: F.get(ends(r), 0).try_cast("int")
        last = lambda r: F.coalesce(F.get(ends(r), 1), F.get(ends(r), 0)).try_cast("int")
        good = F.filter(runs, lambda r: first(r).isNotNull() & last(r).isNotNull() & (first(r) <= last(r)))
        return F.flatten(F.transform(good, lambda r: F.transform(F.sequence(first(r), last(r)), lambda n: F.struct(F.concat(kind, tail).alias("type"), n.alias("number")))))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, of_part))))


def compact_runs(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, runs``: distinct numbers as runs such as ``1-5,7``."""
    each = rows.select(*keys, F.col(number).alias("n")).distinct()
    island = F.col("n") - F.row_number().over(W.partitionBy(*keys).orderBy("n"))
    spans = each.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = F.array_sort(F.collect_list(F.struct("a", text.alias("t"))))
    return spans.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["t"]), ",").alias("runs"))


def translate_pattern(pattern: str) -> str:
    """Word borders of another regular-expression dialect as ``\\b``; applying it twice changes nothing."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\[<>]", r"\1\\b", pattern)


def timestamp_of(text: Column) -> Column:
    """An ISO-8601 text as a timestamp, or null."""
    return F.when(text.rlike(ISO_PATTERN), F.try_to_timestamp(text))


def is_iso8601(text: Column) -> Column:
    return F.coalesce(timestamp_of(text).isNotNull(), F.lit(False))


def timestamp_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def unique_id(number: Column) -> Column:
    """An identifier that sorts by time: microseconds now, then a hash of ``number`` and a random value."""
    now = F.unix_micros(F.current_timestamp())
    return F.lower(F.format_string("%016x_%016x", now, F.xxhash64(number, F.rand())))


def is_id(text: Column) -> Column:
    return F.coalesce(text.rlike(ID_PATTERN), F.lit(False))


def pseudo_random(seed: int | None = None) -> Column:
    """Milliseconds since 2022-06-01 in whole seconds, plus 1 to 1000."""
    since = F.unix_timestamp() - F.unix_timestamp(F.lit("2022-06-01"), "yyyy-MM-dd")
    return since * 1000 + 1 + F.floor(F.rand(seed) * 1000)


def rehydrate(text: Column, nan: str = "__NaN__", inf: str = "__Infinity__", minus: str = "__-Infinity__") -> Column:
    """JSON text with its stand-ins for numbers that JSON lacks put back."""
    quoted = lambda t, s, v: F.replace(t, F.lit(f'"{s}"'), F.lit(v))
    return quoted(quoted(quoted(text, minus, "-Infinity"), inf, "Infinity"), nan, "NaN")


def unwrap(value: Column, depth: int) -> Column:
    """The first element, ``depth`` arrays deep; null or empty at any level gives NaN."""
    for _ in range(depth):
        value = F.get(value, 0)
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def hex_rows(data: Column, width: int = 16) -> Column:
    """Bytes as ``array<struct<offset, hex>>``, ``width`` bytes a row."""
    n = F.octet_length(data)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(width))
    return F.when(n > 0, F.transform(at, lambda o: F.struct(o.alias("offset"), F.hex(F.substring(data, o + 1, F.lit(width))).alias("hex")))).otherwise(F.array())


def hex_diff(a: Column, b: Column, width: int = 16) -> Column:
    """The rows of two byte strings that differ: ``array<struct<offset, a, b>>``."""
    n = F.greatest(F.octet_length(a), F.octet_length(b))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    piece = lambda d, o: F.hex(F.substring(d, o + 1, F.lit(width)))
    return F.filter(F.transform(at, lambda o: F.struct(o.alias("offset"), piece(a, o).alias("a"), piece(b, o).alias("b"))), lambda s: s["a"] != s["b"])


def is_local_identifier(text: Column) -> Column:
    """Not empty, no blanks, and an at sign."""
    return F.coalesce((text != "") & F.contains(text, F.lit("@")) & ~F.contains(text, F.lit(" ")), F.lit(False))


def check_rules(rows: DataFrame, key: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """``key, path, error``: a row for each rule (path, what must hold, message) that a row breaks; null passes."""
    found = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(m).alias("error"), F.coalesce(~ok, F.lit(False)).alias("bad")) for p, ok, m in rules])
    return rows.select(key, F.explode(F.filter(found, lambda s: s["bad"])).alias("s")).select(key, "s.path", "s.error")


def lookup_terms(rows: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Ontology look-up of ``PREFIX:term`` in a table ``prefix, id, name``; the prefix's case does not matter, and a term
    that is not found has nulls."""
    prefix = F.lower(F.regexp_extract(column, "^([^:]+):", 1))
    ident = F.regexp_extract(column, "^[^:]+:(.*)$", 1)
    t = terms.select(F.lower("prefix").alias("__p"), F.col("id").alias("__i"), F.col("name").alias("term_name"))
    return rows.join(t, (prefix == F.col("__p")) & (ident == F.col("__i")), "left").drop("__p", "__i")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def shape_of(data: Column) -> Column:
    """``struct<dim, coordinates>`` of a vector: its length, and the coordinates 0, 1 and so on."""
    n = F.size(data)
    return F.struct(F.array(n).alias("dim"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("coordinates"))


def file_facts(files: DataFrame) -> DataFrame:
    """``path, md5, modified, length`` of binary files as Spark reads them."""
    return files.select("path", F.md5("content").alias("md5"), F.col("modificationTime").alias("modified"), "length")


def dotted_class(name: Column) -> Column:
    """A class name with underscores as one with dots."""
    return F.replace(name, F.lit("_"), F.lit("."))


def underscored_class(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("_"))


def fully_matches(text: Column, pattern: str) -> Column:
    """Whether the whole text fits a pattern; null does not."""
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def require_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df``, or an error that names the columns whose type is not the one asked for; ``numeric`` is any number."""
    numeric = ("byte", "short", "integer", "long", "float", "double", "decimal")
    fits = lambda c, k: df.schema[c].dataType.typeName() in numeric if k == "numeric" else df.schema[c].dataType.simpleString() == k
    wrong = [c for c, k in kinds.items() if not fits(c, k)]
    if wrong:
        raise ValueError(f"columns of another type: {wrong}")
    return df
