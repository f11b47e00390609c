"""Calculators: which results to compute, tuning curves, best stimuli, and fitted-curve evaluation."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .diffs import agrees
from .graph import ancestors, edges_of
from .query import Query, search
from .tables import combinations

ACTIONS = ("ERROR", "NO_ACTION", "REPLACE", "REPLACE_IF_DIFFERENT")


def run_policy(inputs: DataFrame, existing: DataFrame, keys: list[str], action: str = "NO_ACTION", parameters: str = "parameters") -> DataFrame:
    """``inputs`` with ``todo``: ``compute``, ``keep`` or ``replace``, from the results that exist for the keys.

    ``ERROR`` makes the plan fail where a result exists. Parameters are compared as canonical text; of several results of a
    key, the one with the smallest parameters counts.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    had = existing.groupBy(*keys).agg(F.min(parameters).alias("__had"))
    both = inputs.join(had.withColumn("__known", F.lit(True)), keys, "left")
    known = F.col("__known").isNotNull()
    todo = {
        "ERROR": F.when(known, F.raise_error(F.lit("a result exists")).cast("string")),
        "NO_ACTION": F.when(known, F.lit("keep")),
        "REPLACE": F.when(known, F.lit("replace")),
        "REPLACE_IF_DIFFERENT": F.when(known & F.col("__had").eqNullSafe(F.col(parameters)), F.lit("keep")).when(known, F.lit("replace")),
    }[action]
    return both.withColumn("todo", F.coalesce(todo, F.lit("compute"))).drop("__had", "__known")


def tuning_curve(responses: DataFrame, stimulus: str, response: str, control: str | None = None, keys: list[str] = []) -> DataFrame:
    """``keys, stimulus, n, mean, stddev, stderr`` of the responses less their controls; NaN counts as missing."""
    value = F.col(response) if control is None else F.col(response) - F.col(control)
    value = F.when(~F.isnan(value), value)
    n, sd = F.count(value), F.stddev_samp(value)
    return responses.groupBy(*keys, stimulus).agg(n.alias("n"), F.avg(value).alias("mean"), sd.alias("stddev"), (sd / F.sqrt(n)).alias("stderr"))


def best_stimulus(responses: DataFrame, stimulus: str, response: str, control: str | None = None, imaginary: str | None = None, keys: list[str] = []) -> DataFrame:
    """The stimulus with the largest mean response (magnitude, if there is an imaginary part); of equal ones the smallest."""
    value = F.col(response) if control is None else F.col(response) - F.col(control)
    if imaginary is None:
        mean = F.avg(F.when(~F.isnan(value), value))
    else:
        mean = F.sqrt(F.pow(F.avg(value), 2) + F.pow(F.avg(imaginary), 2))
    means = responses.groupBy(*keys, stimulus).agg(mean.alias("best_value"))
    over = W.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc_nulls_last("best_value"), stimulus)
    if not keys:
        return means.orderBy(F.desc_nulls_last("best_value"), stimulus).limit(1)
    return means.withColumn("__n", F.row_number().over(over)).where("__n = 1").drop("__n")


def property_values(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values, and where each is first seen."""
    return rows.groupBy(value).agg(F.min(order).alias("first_seen"))


def f0_f1(values: Column, kind: Column, index: int | None = None) -> Column:
    """The response at an index (from 0), or the largest, as ``f0`` where the kind is mean and as ``f1`` where it is F1."""
    v = F.array_max(values) if index is None else F.get(values, index)
    return F.struct(F.when(F.lower(kind) == "mean", v).alias("f0"), F.when(F.lower(kind) == "f1", v).alias("f1"))


def temporal_frequency(parameters: Column, rules: list[dict]) -> Column:
    """The first rule whose parameter is there and numeric: ``value * multiplier + adder``, inverted for periods.

    A rule is ``{name, multiplier, adder, is_period, factor}``; ``factor`` names a second parameter to multiply by.
    """
    found = []
    for r in rules:
        v = F.try_element_at(parameters, F.lit(r["name"])).try_cast("double")
        out = v * r.get("multiplier", 1.0) + r.get("adder", 0.0)
        if r.get("is_period"):
            out = F.when(out != 0, 1 / out)
        if r.get("factor"):
            out = out * F.try_element_at(parameters, F.lit(r["factor"])).try_cast("double")
        found.append(out)
    return F.coalesce(*found)


_CALLS = {"exp": F.exp, "log": F.log, "sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "power": F.pow, "max": F.greatest, "min": F.least}
_SIGNS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow}


def curve(equation: str, names: dict[str, Column]) -> Column:
    """A fitted curve's formula as a column. ``^`` is a power; only arithmetic, known functions and names may occur."""
    text = equation.replace("^", "**").split("=")[-1]

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.BinOp) and type(node.op) in _SIGNS:
            return _SIGNS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -walk(node.operand) if isinstance(node.op, ast.USub) else walk(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            return _CALLS[node.func.id](*[walk(a) for a in node.args])
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")

    return walk(ast.parse(text.strip(), mode="eval"))


def stimulus_train(spark, stimuli: int, repeats: int, on: float = 10.0, gap: float = 5.0) -> DataFrame:
    """``presentation, stimulus, t_on, t_off``: each stimulus in turn, repeated, at even times."""
    n = stimuli * repeats
    rows = spark.range(n).withColumnRenamed("id", "presentation")
    t = F.col("presentation") * F.lit(on + gap)
    return rows.select("presentation", (F.col("presentation") % stimuli + 1).alias("stimulus"), t.alias("t_on"), (t + on).alias("t_off"))


def response_type(edges: DataFrame, scalars: DataFrame, start: DataFrame, depth: int = 1000) -> DataFrame:
    """``root, response_type``: edges named for response scalars or tuning curves are followed until a scalar is met; the
    nearest counts, of several the one with the smallest id."""
    steps = edges.where(F.contains("name", F.lit("stimulus_response_scalar")) | F.contains("name", F.lit("stimulus_tuningcurve")))
    found = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).unionByName(ancestors(steps, start, depth))
    return found.join(scalars, "id").groupBy("root").agg(F.min_by("response_type", F.struct("depth", "id")).alias("response_type"))


def default_parameters_query() -> Query:
    """What a tuning curve is made of unless told otherwise: response scalars of a mean or F1 response."""
    kind = Query("stimulus_response_scalar.response_type")
    return Query().isa("stimulus_response_scalar") & (kind.contains("mean") | kind.contains("F1"))


def simple_answer(documents: DataFrame, answer: float) -> DataFrame:
    """``id, depends_on_id, answer``: one result for each base document, whose id follows from the document's."""
    return search(documents, Query().isa("base")).select(F.md5(F.concat(F.lit("simple/"), "id")).alias("id"), F.col("id").alias("depends_on_id"), F.lit(answer).alias("answer"))


def tuning_curves_of(documents: DataFrame, element_id: str) -> DataFrame:
    """Tuning curves and response scalars that depend on an element."""
    return search(documents, (Query().isa("stimulus_tuningcurve") | Query().isa("stimulus_response_scalar")) & Query().depends_on("element_id", element_id))


def tuning_curve_log(documents: DataFrame, curves: DataFrame, edge: str = "stimulus_response_scalar_id", field: str = "log") -> DataFrame:
    """``id, log``: each curve's independent variable log, read from the response document that it depends on; none: null."""
    e = edges_of(curves).where(F.col("name") == edge).select(F.col("src").alias("id"), F.col("dst").alias("__r"))
    said = documents.select(F.col("id").alias("__r"), F.try_variant_get("body", f"$.stimulus_response_scalar.{field}", "string").alias("log"))
    return curves.select("id").join(e, "id", "left").join(said, "__r", "left").select("id", "log")


def app_documents(store: DataFrame, new: DataFrame, keys: list[str], action: str = "ERROR", parameters: str = "parameters") -> DataFrame:
    """The store after an app adds its documents under a policy for those that exist; see :func:`run_policy`."""
    todo = run_policy(new, store, keys, action, parameters)
    kept = store.join(todo.where("todo = 'replace'").select(*keys), keys, "left_anti").select(*store.columns)
    return kept.unionByName(todo.where("todo in ('compute', 'replace')").select(*store.columns))


def compare_results(made: DataFrame, expected: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """``key, column, ok``: a mock test's rows against what is expected, each column within its tolerance."""
    both = made.select(key, *[F.col(c).cast("double").alias(f"__a_{c}") for c in tolerances]).join(expected.select(key, *[F.col(c).cast("double").alias(f"__b_{c}") for c in tolerances]), key, "full")
    each = [F.struct(F.lit(c).alias("column"), agrees(F.col(f"__a_{c}"), F.col(f"__b_{c}"), "abs_difference", tol).alias("ok")) for c, tol in tolerances.items()]
    return both.select(key, F.explode(F.array(*each)).alias("s")).select(key, "s.column", "s.ok")


def input_sets(documents: DataFrame, fixed: dict[str, str], queries: dict[str, Query], valid: dict[str, Query] | None = None) -> DataFrame:
    """One column a dependency: the fixed ones, and every combination of the documents that the queries select.

    ``valid`` narrows a dependency to documents that a second query selects too; a dependency without an entry takes all. A
    query that selects nothing leaves no combination. Without queries there is one row, of the fixed dependencies.
    """
    valid = valid or {}
    unknown = set(valid) - set(queries)
    if unknown:
        raise ValueError(f"no query for {sorted(unknown)}")
    one = documents.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in fixed.items()])
    lists = [search(documents, q & valid[name] if name in valid else q).select(F.col("id").alias(name)) for name, q in queries.items()]
    return combinations([one, *lists]).select(*fixed, *queries)
