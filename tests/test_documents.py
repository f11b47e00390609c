import pytest
from pyspark.sql import functions as F

from tessera.operators import diffs, graph, store, summaries
from tessera.operators.query import Query, search


def docs(spark, rows):
    """rows: id, session, name, class, superclasses, edges, JSON body."""
    kind = "id string, session_id string, name string, class_name string, superclasses array<string>, depends_on array<struct<name:string,value:string>>, body string"
    df = spark.createDataFrame(rows, kind).withColumn("datestamp", F.lit(None).cast("string"))
    return df.withColumn("body", F.parse_json("body")).select(*store.ENVELOPE, "body")


@pytest.fixture(scope="module")
def three(spark):
    return docs(
        spark,
        [
            ("a", "s1", "alpha", "base", [], [], '{"x": {"n": 1, "tags": ["p", "q"], "t": "Red"}}'),
            ("b", "s1", "beta", "child", ["base"], [("parent_doc", "a")], '{"x": {"n": 2, "t": null}}'),
            ("c", "s2", "gamma", "child", ["base"], [("parent_doc", "b"), ("other", "z")], '{"x": {"n": "many"}}'),
        ],
    )


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.mark.parametrize(
    "query, want",
    [
        (Query("base.name") == "beta", ["b"]),
        (Query("base.name") == "nonexistent", []),
        (Query("base.name") != "beta", ["a", "c"]),
        (Query("x.n") == 2, ["b"]),
        (Query("x.n") > 0, ["a", "b"]),
        (~(Query("x.n") > 1), ["a", "c"]),
        (Query("x.missing") != "v", ["a", "b", "c"]),
        (Query("base.name").contains("et"), ["b"]),
        (Query("base.name").match("^[ag]"), ["a", "c"]),
        (Query("x.t").equals_any_case("RED"), ["a"]),
        (Query("x.t").has_field(), ["a"]),
        (Query("x.tags").has_field(), ["a"]),
        (Query("x.tags").has_member("q"), ["a"]),
        (Query().isa("child"), ["b", "c"]),
        (Query().isa("base"), ["a", "b", "c"]),
        (Query.all(), ["a", "b", "c"]),
        (Query.none(), []),
        (Query().depends_on("parent_doc", "a"), ["b"]),
        (Query().depends_on("*", "z"), ["c"]),
        ((Query("base.name") == "alpha") | (Query("x.n") == 2), ["a", "b"]),
        (~((Query("base.name") == "alpha") & (Query("x.n") == 2)), ["c"]),
        (((Query("base.name") == "alpha") & (Query("x.n") == 2)).negate_all(), ["a", "b", "c"]),
    ],
)
def test_predicates(three, query, want):
    assert ids(search(three, query)) == want
    assert ids(search(three, Query.of_search(query.to_search()))) == want


def test_query_errors_and_scope(three):
    with pytest.raises(ValueError):
        Query.from_search("x", "no_such_operation", 1)
    with pytest.raises(ValueError):
        bool(Query("x"))
    assert (Query("x") == 5).terms[0].operation == "exact_number"
    assert (~~(Query("x") == 5)).terms[0].operation == "exact_number"
    assert ids(search(three, None, "s1")) == ["a", "b"]


def test_typed_columns_reach_the_scan(spark, three, tmp_path):
    store.save(three, str(tmp_path / "store"))
    plan = search(store.load(spark, str(tmp_path / "store")), Query("base.name") == "beta")._jdf.queryExecution().toString()
    assert "EqualTo(name,beta)" in plan


def test_store_writes(spark, three):
    new = docs(spark, [("b", "", "new", "child", [], [], "{}"), ("d", "", "x", "child", [], [], "{}"), ("d", "", "y", "child", [], [], "{}")])
    assert ids(store.bulk_add(three, new, "name")) == ["d"]
    assert store.bulk_counts(three, new).first() == (1, 2)
    assert ids(store.upsert(three, new.where("id = 'b'"))) == ["a", "b", "c"]
    assert ids(store.update(three, new.where("name <> 'y'"))) == ["a", "b", "c"]
    assert ids(store.remove(three, Query("x.n") == 2, three.where("id = 'a'"))) == ["c"]
    assert ids(store.remove_with_dependents(three, three.where("id = 'a'"))) == []
    with pytest.raises(Exception, match="document exists"):
        store.add(three, new.where("id = 'b'")).collect()
    with pytest.raises(Exception, match="another session"):
        store.stamp_session(three, "s1").collect()
    assert {r[0] for r in store.stamp_session(new, "s9").select("session_id").collect()} == {"s9"}


def test_lone_objects_load_as_lists(spark):
    text = '{"base": {"id": "c", "name": "n"}, "document_class": {"class_name": "k", "superclasses": {"definition": "x/base.json"}}, "depends_on": {"name": "parent_doc", "value": "p"}}'
    d = store.from_json(spark.createDataFrame([(text,), ("not json",)], "value string"))
    assert ids(search(d, Query().depends_on("parent_doc", "p"))) == ["c"]
    assert ids(search(d, Query().isa("base"))) == ["c"]


def test_closures_survive_cycles(spark):
    edges = spark.createDataFrame([("a", "e", "b"), ("b", "e", "c"), ("c", "e", "a"), ("c", "e", "d")], "src string, name string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    up = {(r.id, r.depth) for r in graph.ancestors(edges, start).collect()}
    assert up == {("b", 1), ("c", 2), ("d", 3)}
    down = {r.id for r in graph.descendants(edges, start.selectExpr("'d' AS id")).collect()}
    assert down == {"a", "b", "c"}


def test_deep_closures_take_few_rounds(spark, monkeypatch):
    """A chain of 4,000 documents, a long cycle, and shortcuts that shorten paths found earlier."""
    rounds = []
    plain = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or plain(df))
    n = 4000
    rows = [(f"c{i}", "e", f"c{i + 1}") for i in range(n)] + [(f"r{i}", "e", f"r{(i + 1) % 37}") for i in range(37)] + [("c5", "e", "c905"), ("c20", "e", "r3")]
    edges = spark.createDataFrame(rows, "src string, name string, dst string")
    start = spark.createDataFrame([("c0",), ("r0",), ("c3990",)], "id string")
    got = {(r.root, r.id): r.depth for r in graph.ancestors(edges, start).collect()}
    out = {}
    for s, _, d in rows:
        out.setdefault(s, []).append(d)
    want = {}
    for root in ("c0", "r0", "c3990"):
        level, depth, seen = [root], 0, set()
        while level:
            depth += 1
            level = sorted({d for x in level for d in out.get(x, []) if d not in seen and not seen.add(d)})
            want |= {(root, d): depth for d in level if d != root}
    assert got == want
    # Eight single steps, then jumps of 8 to 4,096 steps: two tables a round.
    assert len(rounds) <= 9 + 3 + 2 * 10
    with pytest.raises(RuntimeError):
        graph.ancestors(edges, start, 1000)


def test_graph_parts(spark, three):
    assert ids(graph.dangling(three)) == ["c"]
    assert ids(graph.dangling(three, "parent_doc")) == []
    near = {(r.id, r.n_parents, r.n_children) for r in graph.adjacency(three).collect()}
    assert near == {("a", 0, 1), ("b", 1, 1), ("c", 1, 0)}
    listed = spark.createDataFrame([("s", "d_1", "x"), ("s", "D_2", "y"), ("s", "d_4", "z")], "src string, name string, dst string")
    assert {(r.number, r.dst) for r in graph.numbered_dependencies(listed, "d").collect()} == {(1, "x"), (2, "y")}
    assert three.where("id = 'b'").select(graph.dependency_value("PARENT_DOC")).first()[0] == "a"
    changed = three.where("id = 'c'").select(graph.set_dependency("other", F.lit("w")).alias("d"), graph.set_dependency("new", F.lit("v")).alias("e")).first()
    assert [x["value"] for x in changed.d] == ["b", "w"] and len(changed.e) == 3


def test_differences(spark, three):
    same = three.withColumn("depends_on", F.reverse("depends_on")).withColumn("session_id", F.lit("other"))
    assert diffs.session_diff(three, same).count() == 0
    other = three.where("id <> 'a'").withColumn("name", F.when(F.col("id") == "b", "B").otherwise(F.col("name")))
    assert {(r.id, r.status) for r in diffs.session_diff(three, other).collect()} == {("a", "only_left"), ("b", "different")}
    nan = float("nan")
    v = spark.createDataFrame([(nan, nan, 1.0, 1.2, 0.0)], "a double, b double, c double, d double, z double")
    r = v.select(
        diffs.agrees(F.col("a"), F.col("b"), "difference").alias("x"),
        diffs.agrees(F.col("c"), F.col("d"), "abs_percent_difference", 25).alias("y"),
        diffs.agrees(F.col("z"), F.col("d"), "percent_difference", 25).alias("w"),
        diffs.agrees(F.col("a"), F.col("c"), "difference", 9).alias("u"),
    ).first()
    assert tuple(r) == (True, True, False, False)


def test_summaries(spark, three):
    counts = {r.class_name: r.n for r in summaries.type_histogram(three.withColumn("class_name", F.nullif("class_name", F.lit("base")))).collect()}
    assert counts == {"unknown": 1, "child": 2}
    stamps = spark.createDataFrame([("1", "k", "2020-01-01"), ("2", "k", "nonsense"), ("3", "k", "2021-01-01")], "id string, key string, datestamp string")
    assert summaries.newest(stamps, ["key"]).first().id == "3"
    rows = spark.createDataFrame([(1, "a,b", "va,vb", "1,2"), (2, "b,c", "other,vc", "9,3")], "o int, names string, variables string, terms string")
    assert {(r.name, r.variable, r.term) for r in summaries.variable_names(rows, "o").collect()} == {("a", "va", "1"), ("b", "vb", "2"), ("c", "vc", "3")}
    ids_ = spark.createDataFrame([("2", "x"), ("1", "x"), ("3", "")], "id string, k string")
    assert summaries.duplicates(ids_, F.col("k")).collect() == [("2", "1")]


def test_indexed_paths_reach_the_scan(spark, tmp_path):
    from tessera.operators.query import index_column

    rows = spark.createDataFrame([(i, float(i % 50), None if i % 7 == 0 else {"k": i % 11}) for i in range(400)], "i int, value double, props map<string,int>")
    docs = store.make_documents(rows, F.concat(F.lit("d"), "i"), "event", ["base"], section={"value": F.col("value"), "props": F.to_json("props"), "text": F.col("i").cast("string")})
    v, text = Query("event.value"), Query("event.text")
    queries = [(v > 10) & (v <= 12), text == "33", ~(v < 40), (text.contains("99") | (v == 3)) & ~(text == "3"), ~(Query("event.none") > 1), text.equals_any_case("33"), text.match("^3.$")]
    paths = store.hot_paths(queries)
    assert ("event.value", "double") in paths and ("event.text", "string") in paths and len(paths) == 3
    assert store.hot_paths(queries, 3) == [("event.text", "string"), ("event.value", "double")]
    folder = str(tmp_path / "store")
    store.save_indexed(docs, folder, paths, cluster=("event.value", "double"))
    kept = store.load_indexed(spark, folder)
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    for q in queries:
        found = search(kept, q)
        assert ids(found) == ids(search(docs, q)) and found.columns == docs.columns
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = search(kept, queries[0])._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    name = index_column("event.value", "double")
    assert "PushedFilters" in plan and f"GreaterThan({name},10.0)" in plan.replace("`", "") and f"LessThanOrEqual({name},12.0)" in plan.replace("`", "")
    store.save_indexed(docs.limit(3).withColumn("id", F.concat(F.lit("x"), "id")), folder, paths)
    assert store.load_indexed(spark, folder).count() == 403 and store.indexed_paths(spark, folder) == paths
    with pytest.raises(ValueError, match="indexed by"):
        store.save_indexed(docs, folder, paths[:1])
    store.save(docs, str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="no index"):
        store.load_indexed(spark, str(tmp_path / "plain"))


def test_stored_sessions_are_compared_by_their_hashes(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("k"), (F.col("id") % 13).alias("v"))
    docs = store.make_documents(rows, F.col("k"), "thing", ["base"], store.edge_list(store.edge("a", F.lit("x")), store.edge("b", F.col("v"))))
    other = docs.where("id <> 'd7'").withColumn("name", F.when(F.col("id") == "d1234", "new").otherwise(F.col("name")))
    other = other.unionByName(docs.where("id = 'd7'").withColumn("id", F.lit("e7"))).withColumn("depends_on", F.reverse("depends_on")).withColumn("session_id", F.lit("s2"))
    a, b, c = (str(tmp_path / n) for n in "abc")
    for df, path in ((docs, a), (other, b), (docs.repartition(7), c)):
        diffs.save_hashed(df, path)
    folders, leaves = diffs.unequal_ranges(spark, a, b)
    assert 1 <= len(folders) <= 3 and leaves.count() == 3 and diffs.unequal_ranges(spark, a, c)[0] == []
    found = diffs.stored_session_diff(spark, a, b)
    assert sorted(map(tuple, found.collect())) == [("d1234", "different"), ("d7", "only_left"), ("e7", "only_right")] == sorted(map(tuple, diffs.session_diff(docs, other).collect()))
    assert found.inputFiles() and "PartitionFilters: [" in found._jdf.queryExecution().toString()
    assert diffs.stored_session_diff(spark, a, c).count() == 0
    # Files of folders that agree are not opened.
    for path in (a, b):
        for folder in (tmp_path / path).glob("__folder=*"):
            if folder.name.removeprefix("__folder=") not in folders:
                for file in folder.glob("part-*"):
                    file.write_bytes(b"spoilt")
    assert diffs.stored_session_diff(spark, a, b).count() == 3


def test_file_numbers_follow_the_largest(spark):
    from tessera.operators import doctables

    df = spark.range(1).select(F.array().cast(doctables.FILES).alias("f"))
    for name in ("b#", "b#", "b#", "bx", "other#", "-b1", "-b2", "b#", "b3"):
        changed = doctables.remove_file(F.col("f"), F.lit(name[1:])) if name[0] == "-" else doctables.add_file(F.col("f"), F.lit(name), F.lit("/x"), F.lit("u"))
        df = graph.written(df.select(changed.alias("f")))
    got = df.first().f
    assert [(f.name, len(f.locations)) for f in got] == [("b3", 2), ("bx", 1), ("other1", 1), ("b4", 1)]


def test_of_equal_keys_the_same_row_stays(spark):
    from tessera.operators import calc

    rows = [("a", "s", "n2", "t", "c"), ("a", "s", "n1", "t", "c")]
    base = spark.createDataFrame([(*r, [], [], None) for r in rows], "id string, session_id string, name string, datestamp string, class_name string, superclasses array<string>, depends_on array<struct<name:string,value:string>>, body string")
    new = base.withColumn("body", F.parse_json("body"))
    for order in (new, new.orderBy("name"), new.orderBy(F.desc("name"))):
        assert [r.name for r in store.first_of_each(order.repartition(2)).collect()] == ["n1"]
    had = spark.createDataFrame([("k", "p2"), ("k", "p1")], "k string, parameters string")
    assert [r.todo for r in calc.run_policy(spark.createDataFrame([("k", "p1")], had.schema), had, ["k"], "REPLACE_IF_DIFFERENT").collect()] == ["keep"]


def test_sums_over_a_total_order_are_not_one_task(spark):
    import random

    from tessera.operators.segments import sums_before

    rng = random.Random(1)
    rows = [(rng.randint(0, 3), i, rng.randint(1, 9), f"k{i}") for i in range(500)]
    items = spark.createDataFrame(rows, "priority int, t int, bytes int, key string")
    got = {r.key: r.n for r in sums_before(items, [F.col("priority").asc(), F.col("t").desc()], F.col("bytes"), "n").collect()}
    total, want = 0, {}
    for p, _, n, k in sorted(rows, key=lambda r: (r[0], -r[1])):
        want[k], total = total, total + n
    assert got == want and sums_before(items.limit(0), [F.col("t").asc()], F.col("bytes"), "n").count() == 0
    for order, way in (("fifo", 1), ("lifo", -1)):
        gone, short = [], total + 50 - (total - 100)
        for p, x, n, k in sorted(rows, key=lambda r: (r[0], way * r[1])):
            if short > 0:
                gone.append(k)
                short -= n
        assert sorted(r.key for r in store.evictions(items, 50, total - 100, order).collect()) == sorted(gone)
    assert store.evictions(items, 1, total + 1).count() == 0
