"""The dependency graph of documents: edges, closures, dangling references, adjacency and numbered lists."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or in local mode a fresh one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-work-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which goes when the driver ends; its lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def edges_of(documents: DataFrame) -> DataFrame:
    """``src, name, dst`` of every dependency with a value."""
    return documents.select(F.col("id").alias("src"), F.explode("depends_on").alias("d")).select(
        "src", F.col("d.name").alias("name"), F.col("d.value").alias("dst")
    ).where("dst is not null and dst <> ''")


#: Rounds that follow single steps before jumps are doubled, as a power of two of steps: 8 = 2 ** 3.
SINGLE_ROUNDS = 3


def closure(edges: DataFrame, start: DataFrame, towards: str, max_depth: int | None = None) -> DataFrame:
    """``root, id, depth``: what each start document reaches, and the least number of steps.

    The first steps follow single edges from a frontier. What is deeper than these is found by doubling: a table of jumps is
    joined with itself, so jumps are twice as long in each round, and all that is found so far takes one jump more. So a path of
    ``n`` steps takes about ``log2(n)`` rounds, and a cycle ends when a round finds nothing new. Edges, levels and jumps are
    written, so lineage stays short and a lost executor costs one round. Paths of more than ``max_depth`` steps raise
    ``RuntimeError``, where it is given.
    """
    near, far = ("dst", "src") if towards == "src" else ("src", "dst")
    steps = written(edges.select(F.col(near).alias("__at"), F.col(far).alias("id")).distinct())
    frontier = start.select(F.col("id").alias("root"), "id").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    rounds = 1 << SINGLE_ROUNDS
    for depth in range(1, rounds + 1):
        found = frontier.withColumnRenamed("id", "__at").join(steps, "__at").select("root", "id").distinct()
        frontier = written(found.join(seen.select("root", "id"), ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"paths of more than {max_depth} steps")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    else:
        seen = _doubled(seen, steps, rounds, max_depth)
    return seen.where("depth > 0")


def _doubled(seen: DataFrame, steps: DataFrame, length: int, max_depth: int | None) -> DataFrame:
    """``seen``, which has all pairs up to ``length`` steps (a power of two), with all others."""
    jumps = steps
    for _ in range(length.bit_length() - 1):
        jumps = _twice(jumps)
    n = None
    while True:
        further = seen.select("root", F.col("id").alias("__at"), "depth").join(jumps, "__at").select("root", "id", (F.col("depth") + length).alias("depth"))
        seen = written(seen.unionByName(further).groupBy("root", "id").agg(F.min("depth").alias("depth")))
        before, (n, deepest) = n, seen.agg(F.count("*"), F.max("depth")).first()
        if max_depth is not None and deepest > max_depth:
            raise RuntimeError(f"paths of more than {max_depth} steps")
        if n == before or deepest < 2 * length - 1:
            return seen
        jumps, length = _twice(jumps), 2 * length


def _twice(jumps: DataFrame) -> DataFrame:
    """Pairs that two jumps connect."""
    then = jumps.select(F.col("__at").alias("__mid"), F.col("id").alias("__to"))
    return written(jumps.select("__at", F.col("id").alias("__mid")).join(then, "__mid").select("__at", F.col("__to").alias("id")).distinct())


def ancestors(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Everything that the start documents depend on, each once for its root."""
    return closure(edges, start, "dst", max_depth)


def descendants(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Everything that depends on the start documents, each once for its root."""
    return closure(edges, start, "src", max_depth)


def parents(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, name, parent`` of the listed documents."""
    return edges.join(ids.select(F.col("id").alias("src")), "src").select(F.col("src").alias("id"), "name", F.col("dst").alias("parent"))


def children(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, name, child`` of the listed documents, by any edge."""
    return edges.join(ids.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("id"), "name", F.col("src").alias("child"))


def dangling(documents: DataFrame, *names: str) -> DataFrame:
    """Ids of documents with an edge (of the given names, if any) to an id that no document has; each id once."""
    edges = edges_of(documents)
    edges = edges.where(F.col("name").isin(*names)) if names else edges
    return edges.join(documents.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id")).distinct()


def adjacency(documents: DataFrame) -> DataFrame:
    """``id, parents, n_parents, n_children`` within the given documents; nodes without edges stay."""
    ids = documents.select("id")
    inside = edges_of(documents).join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    up = inside.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("parents"))
    down = inside.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_children"))
    empty = F.array().cast("array<string>")
    parents_ = F.coalesce("parents", empty)
    return (
        ids.join(up, "id", "left").join(down, "id", "left")
        .select("id", parents_.alias("parents"), F.size(parents_).cast("long").alias("n_parents"), F.coalesce("n_children", F.lit(0)).alias("n_children"))
    )


def neighbourhood(edges: DataFrame, ident: str) -> DataFrame:
    """``id, side``: the documents one step before and after a document."""
    up = edges.where(F.col("src") == ident).select(F.col("dst").alias("id"), F.lit("predecessor").alias("side"))
    down = edges.where(F.col("dst") == ident).select(F.col("src").alias("id"), F.lit("successor").alias("side"))
    return up.unionByName(down).distinct()


def class_closure(classes: DataFrame) -> DataFrame:
    """``class_name, ancestor, depth`` of a table ``class_name, superclass``; a class is not its own ancestor."""
    edges = classes.select(F.col("class_name").alias("src"), F.lit("isa").alias("name"), F.col("superclass").alias("dst"))
    found = ancestors(edges, classes.select(F.col("class_name").alias("id")))
    return found.select(F.col("root").alias("class_name"), F.col("id").alias("ancestor"), "depth")


def dependency_value(name: str) -> Column:
    """The value of the first edge with this name, in any case."""
    return F.get(F.filter("depends_on", lambda d: F.lower(d["name"]) == name.lower()), 0)["value"]


def set_dependency(name: str, value: Column) -> Column:
    """The edges with the named one's value replaced; a name that is missing is added."""
    same = lambda d: F.lower(d["name"]) == name.lower()
    changed = F.transform("depends_on", lambda d: F.when(same(d), d.withField("value", value.cast("string"))).otherwise(d))
    added = F.concat("depends_on", F.array(F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))))
    return F.when(F.exists("depends_on", same), changed).otherwise(added)


def numbered_dependencies(edges: DataFrame, name: str) -> DataFrame:
    """``src, number, dst`` of ``name_1, name_2, ...`` up to the first gap of each document; of equal numbers the smallest ``dst``."""
    number = F.regexp_extract("name", rf"(?i)^{name}_([0-9]+)$", 1).try_cast("int")
    listed = edges.select("src", number.alias("number"), "dst").where("number >= 1").groupBy("src", "number").agg(F.min("dst").alias("dst"))
    place = F.row_number().over(W.partitionBy("src").orderBy("number"))
    return listed.withColumn("__place", place).where("__place = number").drop("__place")
