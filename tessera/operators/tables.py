"""Relational helpers over tables: row filters, joins, unions, and tables made of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

TEXT_MODES = {
    "identical": lambda c, v: c == v,
    "ignoreCase": lambda c, v: F.lower(c) == F.lower(v),
    "contains": lambda c, v: F.rlike(c, v),
    "containsLiteral": lambda c, v: F.contains(c, v),
}
NUMBER_MODES = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
}


def match_rows(df: DataFrame, columns: list[str], values: list, text: str = "identical", number: str = "eq") -> DataFrame:
    """Rows where every column matches its value; text columns by ``text``, others by ``number``."""
    if text not in TEXT_MODES or number not in NUMBER_MODES:
        raise ValueError(f"unknown mode: {text}, {number}")
    for c, v in zip(columns, values, strict=True):
        is_text = isinstance(df.schema[c].dataType, StringType)
        df = df.where(TEXT_MODES[text](F.col(c), F.lit(v)) if is_text else NUMBER_MODES[number](F.col(c), F.lit(v)))
    return df


def valid_rows(df: DataFrame, columns: list[str], invalid=None) -> DataFrame:
    """Rows with a usable value in each column that exists: neither null nor NaN, and not ``invalid`` if given."""
    for c in [c for c in columns if c in df.columns]:
        kind = df.schema[c].dataType
        df = df.where(F.col(c).isNotNull())
        if kind.typeName() in ("double", "float"):
            df = df.where(~F.isnan(c))
        if invalid is not None:
            df = df.where(F.col(c) != F.lit(invalid))
    return df


def natural_join(tables: list[DataFrame], how: str = "inner", keys: list[str] | None = None) -> DataFrame:
    """Left fold of joins on common columns (sorted); tables without any are put below each other."""

    def one(a: DataFrame, b: DataFrame) -> DataFrame:
        on = keys or sorted(set(a.columns) & set(b.columns))
        return a.join(b, on, how) if on else a.unionByName(b, allowMissingColumns=True)

    return reduce(one, tables)


def outer_join(tables: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Left fold of full outer joins on the given keys, or on the columns that all tables have."""
    on = keys or sorted(set.intersection(*[set(t.columns) for t in tables]))
    return natural_join(tables, "outer", on)


def joined_values(c: str, order: Column) -> Column:
    """Distinct values of a group as one text, comma-separated, in the order of their first row; none: empty."""
    listed = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).cast("string").alias("v")))))
    return F.array_join(F.array_distinct(F.transform(listed, lambda s: s["v"])), ",")


def collapse(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key; every other column becomes its distinct values as one text, first seen first.

    ``order`` is the column that orders rows; without it values are in ascending order. Null keys are left out.
    """
    others = [c for c in df.columns if c not in keys and c != order]
    kept = df.na.drop(subset=keys)
    return kept.groupBy(*keys).agg(*[joined_values(c, F.col(order) if order else F.col(c).cast("string")).alias(c) for c in others])


def stack(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def move_left(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that exist come first, the others keep their order."""
    first = [c for c in columns if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def leaf_paths(schema: StructType, before: str = "", skip: tuple[str, ...] = ("depends_on", "files")) -> list[str]:
    """Dotted paths of all leaves, without the skipped names at any level."""
    out = []
    for f in schema.fields:
        if f.name in skip:
            continue
        path = f"{before}{f.name}"
        out += leaf_paths(f.dataType, f"{path}.", skip) if isinstance(f.dataType, StructType) else [path]
    return out


def flatten(df: DataFrame, depth: int | None = None) -> DataFrame:
    """Nested structs as columns named by their path; ``depth`` 1 opens one level only."""
    if depth is None:
        return df.select(*[F.col(p).alias(p.replace(".", "_")) for p in leaf_paths(df.schema)])
    out = []
    for f in df.schema.fields:
        inner = isinstance(f.dataType, StructType)
        out += [F.col(f"{f.name}.{g}").alias(f"{f.name}_{g}") for g in f.dataType.names] if inner else [F.col(f.name)]
    return df.select(*out)


def section_table(documents: DataFrame, class_name: str, fields: dict[str, str]) -> DataFrame:
    """``id`` and fields of a class's section, each read from the body as the given SQL type."""
    rows = documents.where(F.col("class_name") == class_name)
    return rows.select("id", *[F.try_variant_get("body", f"$.{class_name}.{k}", t).alias(k) for k, t in fields.items()])


def section_keys(documents: DataFrame, section: str, limit: int = 2000) -> list[str]:
    """The keys that occur in a section, in ascending order; more than ``limit`` is an error.

    The number of distinct keys bounds what the driver gets, so a table of documents can have columns at all.
    """
    keys = F.map_keys(F.try_variant_get("body", f"$.{section}", "map<string,variant>"))
    found = documents.select(F.explode(keys).alias("k")).distinct().orderBy("k").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} keys in {section}")
    return [r["k"] for r in found]


def document_table(documents: DataFrame, section: str) -> DataFrame:
    """``id`` and one text column for each key that any document has in the section."""
    keys = section_keys(documents, section)
    held = F.try_variant_get("body", f"$.{section}", "map<string,variant>")
    return documents.select("id", *[F.try_variant_get(F.try_element_at(held, F.lit(k)), "$", "string").alias(f"{section}_{k}") for k in keys])


def dependency_columns(documents: DataFrame, names: list[str]) -> DataFrame:
    """``id`` and one column ``depends_on_<name>`` for each edge name; an edge that is missing gives an empty text."""
    value = lambda n: F.get(F.filter("depends_on", lambda d: d["name"] == n), 0)["value"]
    return documents.select("id", *[F.coalesce(value(n), F.lit("")).alias(f"depends_on_{n}") for n in names])


def pivot_mean(df: DataFrame, keys: list[str], by: str, values: list[str], of: str) -> DataFrame:
    """Mean of ``of`` for each key, one column a value of ``by``; NaN counts as missing."""
    clean = F.when(~F.isnan(of), F.col(of))
    return df.groupBy(*keys).pivot(by, values).agg(F.avg(clean))


def percent_change(a: Column, b: Column) -> Column:
    """``100 * (a - b) / b``, null where ``b`` is 0 or missing."""
    return F.try_divide(100 * (a - b), b)


def grouped_mean(df: DataFrame, keys: list[str], of: str) -> DataFrame:
    """Mean without missing values and NaN, and the number of values, over the grouping columns."""
    clean = F.when(~F.isnan(F.col(of).cast("double")), F.col(of)) if isinstance(df.schema[of].dataType, NumericType) else F.col(of)
    return df.groupBy(*keys).agg(F.avg(clean).alias("mean"), F.count(clean).alias("n"))


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """The rows of a page, counted from 1."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes begin at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "number") -> DataFrame:
    """Rows numbered from 1 within their keys."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_rows(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return numbered(df, keys, order, "__n").where(F.col("__n") <= n).drop("__n")


def text_filter(df: DataFrame, column: str, value: str, how: str = "contains") -> DataFrame:
    """Rows whose lower-cased text contains, begins with or ends with the lower-cased value."""
    tests = {"contains": F.contains, "begins": F.startswith, "ends": F.endswith}
    return df.where(tests[how](F.lower(column), F.lit(value.lower())))


#: Lengths of the pieces by which needles are looked up; a needle is looked up by the longest that it has.
PIECES = (1, 2, 3, 6, 12)
#: Bytes of needles, or of their pieces, that every task may hold; more of them meet the texts by a shuffle.
HELD_BYTES = 16 << 20


def containing(texts: DataFrame, needles: DataFrame, text: str, needle: str, fold: bool = False) -> DataFrame:
    """All columns of ``texts`` with the needles that ``text`` contains, a row for each pair; ``fold`` ignores case.

    A needle is looked up by one piece of itself, the one that the fewest texts have, and texts by all their pieces of the
    needles' lengths; where these are equal the needle is compared. So both sides meet by a key, however many there are. A text
    has a piece for each of its characters, so texts stay where they are and only needles are broadcast, while they are at most
    ``HELD_BYTES``. Equal needles count each, an empty needle is in every text, null texts and needles match nothing.
    """
    low = lambda c: F.lower(c) if fold else c
    listed = needles.select(F.col(needle).alias("__needle")).where("__needle is not null").groupBy("__needle").agg(F.count("*").alias("__copies"))
    listed = listed.withColumn("__low", low(F.col("__needle"))).withColumn("__size", sum((F.length("__low") >= n).cast("int") for n in PIECES))
    facts = listed.groupBy("__size").agg(F.count("*").alias("n"), F.sum(F.octet_length("__needle") + F.octet_length("__low")).alias("b"), F.sum(F.length("__low")).alias("p"))
    sizes = {r["__size"]: r for r in facts.collect()}  # at most one for each length and 0

    def pieces(of: Column, n: int) -> Column:
        starts = F.when(F.length(of) >= n, F.sequence(F.lit(1), F.length(of) - n + 1))
        return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substring(of, i, F.lit(n)))), F.array().cast("array<string>"))

    rows = texts.where(F.col(text).isNotNull()).withColumn("__text", low(F.col(text)))
    out = rows.where(F.lit(False)).withColumn("__needle", F.lit("")).withColumn("__copies", F.lit(0).cast("long"))
    for size in sorted(sizes):
        if size == 0:
            copies = listed.where("__size = 0").first()["__copies"]
            met = rows.withColumn("__needle", F.lit("")).withColumn("__copies", F.lit(copies))
        else:
            n, fact = PIECES[size - 1], sizes[size]
            # Whatever the texts' files take, their pieces are many times as much: the planner's guess is not asked.
            held = lambda df, size_of: F.broadcast(df) if size_of <= HELD_BYTES else df.hint("merge")
            each = rows.withColumn("__piece", F.explode(pieces(F.col("__text"), n)))
            mine = listed.where(F.col("__size") == size)
            asked = mine.withColumn("__piece", F.explode(pieces(F.col("__low"), n)))
            few = fact["p"] * (64 + 4 * n)
            counted = each.join(F.broadcast(asked.select("__piece").distinct()), "__piece", "left_semi") if few <= HELD_BYTES else each
            often = counted.groupBy("__piece").agg(F.count("*").alias("__n"))
            rarest = asked.join(held(often, few), "__piece").groupBy("__needle", "__low", "__copies").agg(F.min_by("__piece", F.struct("__n", "__piece")).alias("__piece"))
            met = each.join(held(rarest, fact["b"] + fact["n"] * (64 + 4 * n)), "__piece").where(F.contains("__text", "__low"))
        out = out.unionByName(met.select(*out.columns))
    repeated = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select(*texts.columns, F.col("__needle").alias(needle))


#: Parts over which the rows of one key are dealt at least where two tables share few keys; rows of a part; rows of the second
#: table that stand together for one row of the first; and pairs of a task.
SPREAD, CHUNK, RUN, PAIRS = 16, 32_768, 256, 1 << 27


def spread_join(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of tables that share few keys, so that pairs are far more than rows; both have other columns besides.

    Each key's rows of either table are cut into chunks of some ``CHUNK`` rows, those of ``many`` into ``SPREAD`` at least. Two
    chunks that meet are one row of two lists, and these rows are dealt over the tasks by ranges, some ``PAIRS`` pairs each; so no
    task gets all pairs of a key, none of the pairs is shuffled, and what is shuffled is 1 / ``CHUNK`` of them. Pairs come in
    tiles: each row of ``many`` with the same ``RUN`` rows of ``few``, then each with the next. So in a columnar file one side is
    runs and the other repeats itself within a page, and a file has few values: a pair takes some tenth of a byte of a Parquet
    file, however many rows a key has.
    """
    spark = many.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, m = F.col("__n"), F.col("__m")
    sizes = many.groupBy(*on).agg(F.count("*").alias("__n")).join(few.groupBy(*on).agg(F.count("*").alias("__m")), on)
    cuts = lambda c: F.ceil(c / CHUNK)
    met = sizes.agg(F.max(n), F.max(m), F.sum(n.cast("double") * m), F.sum(F.greatest(F.lit(SPREAD), cuts(n)).cast("double") * cuts(m))).first()
    most, other, pairs, units = (x or 0 for x in met)
    tasks = max(tasks, int(min(units, pairs // PAIRS)))
    left = _chunks(many, on, max(SPREAD, -(-most // CHUNK)), "__many")
    right = _chunks(few, on, max(1, -(-other // CHUNK)), "__few")
    both = left.join(right, on).repartitionByRange(tasks, *on, "__many_at", "__few_at")
    a, b = ([c for c in df.columns if c not in on] for df in (many, few))
    column = lambda i: F.col(f"__few{i}")
    # Runs and rows are made by functions that Spark evaluates a row at a time; were all in one generated loop, it would hold all
    # pairs of two chunks before it hands the first on.
    runs = F.transform(F.sequence(F.lit(1), F.size("__few"), F.lit(RUN)), lambda i: F.slice("__few", i, RUN))
    rows = both.select(*on, "__many", F.explode(runs).alias("__few"))
    rows = rows.select(*on, "__many", *[F.col("__few")[c].alias(f"__few{i}") for i, c in enumerate(b)])
    rows = rows.select(*on, *map(column, range(len(b))), F.explode(F.transform("__many", lambda r: F.struct(*[r[c].alias(c) for c in a]))).alias("__row"))
    rows = rows.select(*on, *[F.col("__row")[c].alias(c) for c in a], *map(column, range(len(b))), F.posexplode(column(0)).alias("__at", b[0]))
    return rows.select(*on, *a, b[0], *[F.get(column(i), F.col("__at")).alias(c) for i, c in enumerate(b) if i])


def _chunks(df: DataFrame, on: list[str], parts: int, name: str) -> DataFrame:
    """``on``, a list of at most ``2 * CHUNK`` rows and its place; rows go by their hash, and equal rows in excess by their number."""
    rest = [c for c in df.columns if c not in on]
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*rest), F.lit(parts)))
    dealt = numbered(dealt, [*on, "__part"], rest, "__number")
    at = F.struct("__part", F.expr(f"__number div {2 * CHUNK}").alias("__more")).alias(f"{name}_at")
    return dealt.groupBy(*on, "__part", at).agg(F.collect_list(F.struct(*rest)).alias(name)).drop("__part")


def search_ids(df: DataFrame, needles: DataFrame, column: str = "id") -> DataFrame:
    """``needle, <column>``: a row for each id that contains a needle, in any case."""
    return containing(df.select(column), needles, column, "needle", fold=True).select("needle", column)


def combinations(inputs: list[DataFrame]) -> DataFrame:
    """All combinations of the rows of short input lists; an empty one gives none."""
    return reduce(lambda a, b: a.crossJoin(b), inputs)
