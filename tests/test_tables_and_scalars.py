import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import calc, summaries, tables
from tessera.plans import relations


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_row_matching(spark):
    t = spark.createDataFrame([("apple", 10.0), ("banana", 20.0), ("cherry", 30.0), ("APPLE pie", 40.0), (None, None)], "name string, n double")
    assert tables.match_rows(t, ["name"], ["apple"], text="contains").count() == 1
    assert tables.match_rows(t, ["name"], ["APPLE"], text="ignoreCase").count() == 1
    assert tables.match_rows(t, ["n"], [25.0], number="gt").count() == 2
    with pytest.raises(ValueError):
        tables.match_rows(t, ["n"], [1], number="near")
    nan = t.unionByName(spark.createDataFrame([("x", float("nan"))], "name string, n double"))
    assert tables.valid_rows(nan, ["n", "unknown"]).count() == 4
    assert tables.valid_rows(nan, ["name"], "apple").count() == 4


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, b string")
    assert tables.natural_join([a, b]).count() == 2
    assert tables.outer_join([a, b]).count() == 4
    assert tables.natural_join([a, spark.createDataFrame([(9,)], "z int")]).count() == 3
    c = spark.createDataFrame([(1, 2, "v"), (1, 1, "w"), (1, 3, "v"), (2, 1, None)], "k int, o int, t string")
    assert {(r.k, r.t) for r in tables.collapse(c, ["k"], "o").collect()} == {(1, "w,v"), (2, "")}
    assert tables.move_left(a, ["a", "no"]).columns == ["a", "k"]
    assert tables.page(a, ["k"], 2, 1).first().k == 2


def test_flatten(spark):
    d = spark.sql("SELECT named_struct('a', 1, 'depends_on', 5, 'in', named_struct('x', 2)) AS s, 3 AS t")
    assert tables.flatten(d).columns == ["s_a", "s_in_x", "t"]
    assert tables.flatten(d, 1).columns == ["s_a", "s_depends_on", "s_in", "t"]


@pytest.mark.parametrize("name, want", [("", ""), ("   ", ""), ("123abc", "var_123abc"), ("simple", "Simple"), ("two words", "TwoWords"), ("a:b-c", "A_b_c")])
def test_variable_name(spark, name, want):
    assert one(spark, scalars.variable_name(F.lit(name))) == want


def test_names_and_devices(spark):
    assert one(spark, scalars.camel_name(F.lit("Some big NAME"))) == "someBigName"
    assert one(spark, scalars.camel_name(F.lit("9 lives"))) == "x9Lives"
    assert one(spark, scalars.channel_prefix(F.lit("ai12"))) == "ai" and one(spark, scalars.channel_number(F.lit("ai12"))) == 12
    assert one(spark, scalars.channel_number(F.lit("12"))) is None
    got = one(spark, scalars.device_channels(F.lit("dev:ai1-3,7;di1;aep1-2_t2.5")))
    assert [(x["type"], x["number"]) for x in got] == [("aep_t2.5", 1), ("aep_t2.5", 2), ("ai", 1), ("ai", 2), ("ai", 3), ("ai", 7), ("di", 1)]
    runs = spark.createDataFrame([("d", n) for n in (1, 2, 3, 7, 9, 10)], "k string, n int")
    assert scalars.compact_runs(runs, ["k"], "n").first().runs == "1-3,7,9-10"
    assert scalars.translate_pattern(r"\<a\>") == r"\ba\b" == scalars.translate_pattern(r"\ba\b")


def test_identifiers_and_stamps(spark):
    assert one(spark, scalars.is_id(scalars.unique_id(F.lit(3))))
    assert not one(spark, scalars.is_id(F.lit("short")))
    assert one(spark, scalars.is_iso8601(F.lit("2018-12-05T18:36:47.241Z"))) and not one(spark, scalars.is_iso8601(F.lit("05.12.2018")))
    assert one(spark, scalars.is_local_identifier(F.lit("a@b"))) and not one(spark, scalars.is_local_identifier(F.lit("a @b")))
    assert math.isnan(one(spark, scalars.unwrap(F.array().cast("array<array<double>>"), 2)))
    assert one(spark, scalars.unwrap(F.array(F.array(F.lit(4.0))), 2)) == 4.0
    assert [tuple(x) for x in one(spark, scalars.hex_diff(F.lit(b"abc"), F.lit(b"abd")))] == [(0, "616263", "616264")]


def test_calculators(spark):
    r = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, 1.0), (2, 9.0, 8.0), (2, float("nan"), 0.0)], "s int, v double, c double")
    best = calc.best_stimulus(r, "s", "v", "c").first()
    assert (best.s, best.best_value) == (1, 2.0)
    curve = {x.s: (x.n, x["mean"]) for x in calc.tuning_curve(r, "s", "v", "c").collect()}
    assert curve == {1: (2, 2.0), 2: (1, 1.0)}
    assert one(spark, calc.curve("y = a*x^2 + 1", {"a": F.lit(3.0), "x": F.lit(2.0)})) == 13.0
    with pytest.raises(ValueError):
        calc.curve("__import__('os')", {})
    rules = [{"name": "tf"}, {"name": "period", "is_period": True}]
    params = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    assert one(spark, calc.temporal_frequency(params("tf", "4"), rules)) == 4.0
    assert one(spark, calc.temporal_frequency(params("period", "4"), rules)) == 0.25
    assert one(spark, calc.temporal_frequency(params("other", "4"), rules)) is None
    with pytest.raises(Exception, match="a result exists"):
        calc.run_policy(r.selectExpr("s", "'p' AS parameters"), r.selectExpr("s", "'p' AS parameters"), ["s"], "ERROR").collect()
    edges = spark.createDataFrame([("t", "stimulus_tuningcurve_id", "u"), ("u", "stimulus_response_scalar_id", "r")], "src string, name string, dst string")
    kinds = spark.createDataFrame([("r", "mean")], "id string, response_type string")
    assert calc.response_type(edges, kinds, spark.createDataFrame([("t",)], "id string"), 3).first().response_type == "mean"


def test_needles_meet_texts_by_a_key(spark):
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB_1") for _ in range(n))
    texts = [(i, word(rng.randint(0, 30))) for i in range(300)] + [(300, None), (301, "same"), (301, "same"), (302, "\u00c4x\U0001f600y")]
    needles = [word(rng.randint(1, 14)) for _ in range(2000)] + [t[3:11] for _, t in texts[:80]] + ["", "", "same", "\U0001f600", None]
    t, n = spark.createDataFrame(texts, "id int, name string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    for fold in (False, True):
        low = (lambda x: x.lower()) if fold else (lambda x: x)
        want = sorted((i, x, y) for i, x in texts if x is not None for y in needles if y is not None and low(y) in low(x))
        assert sorted(map(tuple, tables.containing(t, n, "name", "needle", fold).collect())) == want
    assert tables.containing(t, n.limit(0), "name", "needle").count() == 0 == tables.containing(t.limit(0), n, "name", "needle").count()
    many = spark.range(10_000).select(F.concat(F.lit("x"), "id").alias("needle"))
    found = tables.search_ids(spark.range(500).select(F.concat(F.lit("AX"), F.col("id") * 7, F.lit("b")).alias("id")), many)
    text = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert found.count() == sum(f"ax{7 * i}b".startswith(f"ax{str(7 * i)[:k]}") for i in range(500) for k in range(1, len(str(7 * i)) + 1) if str(7 * i)[:k] == str(int(str(7 * i)[:k])))


def test_rates_of_channels(spark):
    from tessera.operators import signals

    known = spark.createDataFrame([("e", "ai", 1, 100.0, 0.5, 2.0), ("e", "digital_in", 2, 0.0, 0.0, 1.0)], "epoch_id string, type string, number int, rate double, offset double, scale double")
    ask = lambda rows: spark.createDataFrame(rows, "epoch_id string, type string, number int, t double")
    got = {r.type: r for r in signals.probe_samples(ask([("e", "analog_in", 1, 0.125), ("e", "DI", 2, 1.0)]), known).collect()}
    assert got["analog_in"].sample == 12 and math.isnan(got["DI"].sample)
    back = signals.probe_times(spark.createDataFrame([("e", "ai", 1, 12.0)], "epoch_id string, type string, number int, sample double"), known)
    assert back.first().t == 0.12
    for missing, names in ((("e", "ai", 3, 0.0), "ai1, digital_in2"), (("f", "ai", 1, 0.0), "none")):
        with pytest.raises(Exception, match=f"no channel ai{missing[2]}; there are: {names}"):
            signals.probe_samples(ask([missing]), known).collect()


def test_paths_types_and_inputs(spark, tmp_path):
    from tessera.operators import doctables, epochs, store
    from tessera.operators.query import Query

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    docs = store.make_documents(rows, F.concat(F.lit("d"), "i"), "thing", ["base"])
    get = lambda p: F.try_variant_get("body", p, "string")
    out = doctables.set_paths(docs, {"thing.s": F.lit("new"), "thing.x.y.z": F.col("id"), "thing.x.w": F.lit(1), "base.session_id": F.lit("s9"), "thing.s.deep": F.lit("q")})
    r = out.where("id = 'd2'").select("session_id", get("$.thing.i"), get("$.thing.x.y.z"), get("$.thing.x.w"), get("$.thing.s.deep")).first()
    assert tuple(r) == ("s9", "2", "d2", "1", "q")
    none = doctables.set_paths(docs.withColumn("body", F.lit(None).cast("variant")), {"a.b": F.lit("v")})
    assert none.select(get("$.a.b")).first()[0] == "v"
    with pytest.raises(ValueError):
        doctables.set_paths(docs, {"a..b": F.lit(1)})
    (tmp_path / "map.json").write_text('[{"type":"n","classname":"c.two"},{"type":"n","classname":"c.one"},{"type":null}]')
    types = epochs.read_type_map(spark, str(tmp_path / "map.json"))
    probes = spark.createDataFrame([("p", "n"), ("q", "m"), ("r", None)], "name string, type string")
    assert {tuple(x) for x in epochs.probe_classes(probes, types).select("name", "classname").collect()} == {("p", "c.two"), ("q", None), ("r", None)}
    things = Query().isa("thing")
    sets = calc.input_sets(docs, {"app": "x"}, {"a": things, "b": things}, {"b": Query("thing.i") > 1})
    assert sorted(map(tuple, sets.collect())) == [("x", "d1", "d2"), ("x", "d2", "d2")]
    assert calc.input_sets(docs, {"app": "x"}, {}).collect()[0].app == "x" and calc.input_sets(docs, {}, {"a": Query.none()}).count() == 0
    with pytest.raises(ValueError):
        calc.input_sets(docs, {}, {}, {"a": things})


@pytest.mark.parametrize("held", [16 << 20, 0])
def test_only_needles_are_broadcast(spark, monkeypatch, held):
    monkeypatch.setattr(tables, "HELD_BYTES", held, raising=False)
    names = [f"Name#{i:05d}" for i in range(300)]
    asked = ["#00012", "E#0001", "299", "9", "#00012", "me#00", "no such text"]
    texts = spark.range(300).select(F.format_string("Name#%05d", "id").alias("t"))
    met = tables.containing(texts, spark.createDataFrame([(n,) for n in asked], "n string"), "t", "n", fold=True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == (held > 0)
    assert sorted(map(tuple, met.collect())) == sorted((t, n) for t in names for n in asked if n.lower() in t.lower())


def test_cube_reduces_rows_before_its_sets(spark, small):
    rows = [(a, b, v) for i in range(60) for a, b, v in [("xyz"[i % 3], [1, 2, None][i // 3 % 3], i % 7 or None), (None, i % 2, i % 5), ("x", 1, i)]]
    t = spark.createDataFrame(rows, "a string, b int, v long")
    want = t.cube("a", "b").agg(F.count("*").alias("n"), F.countDistinct("v").alias("parts"))
    got = summaries.cube_counts(t, ["a", "b"], "v", "parts")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Each set of the cube repeats its input, so its input must not be the table's rows.
    plan = relations.cube_counts(spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    under = [plan[i + 1] for i, line in enumerate(plan) if "Expand" in line]
    assert under and not any("Relation" in line or "Project" in line and "l_partkey" in line for line in under)
