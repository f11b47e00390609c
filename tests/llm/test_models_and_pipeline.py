import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.linear import block_features, labelled_sample
from tessera.llm.mixing import apply_rates, fit_rates, mix, rates_after
from tessera.llm.queries import MIX_TARGETS, ORACLES, QUERIES
from tessera.llm.toxicity import best_threshold, clean_only, fit_chain, score, toxicity


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    chain = fit_chain(docs, labels.where(~held), ["quality", "toxic"])
    got = score(docs, chain).select("doc_id", F.col("toxic").alias("said")).join(labels.where(held), "doc_id").toPandas()
    assert ((got.said == (got.toxic == 1)).mean()) > 0.93


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, labels):
    mine = spark.createDataFrame([(i, i % 2, int(i > 8)) for i in range(1, 13)] + [(None, 1, 1), (5, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity(odd_docs, mine)
    assert out.count() == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert toxicity(odd_docs, mine.where("doc_id > 1000")).where("toxic").count() == 0
    assert clean_only(no_docs, labels).count() == 0 and clean_only(odd_docs, mine).columns == odd_docs.columns
    assert toxicity(odd_docs, mine).orderBy("doc_id", "text").collect() == out.orderBy("doc_id", "text").collect()


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])
    assert 0.3 < best_threshold(p, y, np.ones(4)) < 0.8


def test_mixing_meets_its_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = mix(docs, labels, MIX_TARGETS).toPandas()
    names, p, n = out.domains[0], np.stack(out.posterior), out.n_tokens.to_numpy()
    share = (p * (n * out.rate.to_numpy())[:, None]).sum(0) / n.sum()
    assert (out.rate >= 0).all() and all(abs(s - MIX_TARGETS.get(d, 0)) < 0.02 for s, d in zip(share, names))


def test_sample_of_repeated_and_many_labels(spark):
    rows = [(i, f"word{i} other") for i in range(300)] + [(5, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = labelled_sample(docs, spark.createDataFrame([(5, 1)], "doc_id long, kind int"), ["kind"])
    assert len(one.weight) == 1
    with pytest.raises(ValueError, match="combinations"):
        labelled_sample(docs, spark.createDataFrame([(i, i) for i in range(300)], "doc_id long, kind int"), ["kind"])


def test_mixing_counts_its_own_input(spark):
    """Without the toxic documents, their labels are neither counted nor picked."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic = labels.where("toxic = 1").orderBy("doc_id")
    left = docs.join(toxic.offset(5), "doc_id", "left_anti")
    sample = labelled_sample(left, labels, ["quality", "toxic"], per_class=100)
    want = {(r.quality, r.toxic): r["count"] for r in labels.join(left, "doc_id", "left_semi").groupBy("quality", "toxic").count().collect()}
    got = {}
    for values, weight in zip(sample.labels.tolist(), sample.weight):
        got[tuple(values)] = got.get(tuple(values), 0) + weight
    assert want.keys() == got.keys() and all(abs(got[k] - n) < 1e-6 for k, n in want.items())
    sizes = Counter(map(tuple, sample.labels.tolist()))
    assert all(sizes[k] == min(n, 100) for k, n in want.items())


def test_rates_equal_a_direct_solution(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(3), 50)
    n, target, ridge = rng.integers(1, 100, 50), np.array([0.6, 0.3, 0.1]), 1e-2
    table = spark.createDataFrame([(i, int(k), [float(v) for v in x]) for i, (k, x) in enumerate(zip(n, p))], "doc_id long, n_tokens long, posterior array<double>")
    rate, _ = rates_after(p, fit_rates(table, target, ridge, rounds=60), ridge)
    w = n / n.sum()
    best = np.ones(50)
    for _ in range(20000):  # plain projected gradient descent
        best = np.maximum(0, best - 0.5 * (p @ ((best * w) @ p - target) + ridge * (best - 1)))
    assert np.abs(rate - best).max() < 0.02


def test_mixing_of_odd_rows(spark, odd_docs, no_docs, labels):
    rated = mix(odd_docs, labels.where("doc_id < 0"), {})
    assert rated.count() == odd_docs.count() and {tuple(r.domains) for r in rated.collect()} == {("all",)}
    assert mix(no_docs, labels, MIX_TARGETS).count() == 0
    out = apply_rates(odd_docs, rated.withColumn("rate", F.when(F.col("doc_id") == 5, 2.0).when(F.col("doc_id") == 8, 0.0).otherwise(1.0)))
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts[5] == 2 and 8 not in counts and counts[6] == 2 and counts[None] == 2 and out.columns == odd_docs.columns


def test_stages(spark, small, docs, tmp_path):
    """Every stage works on what the one before kept, and its decisions take effect."""
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, small).write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, now)
        if name != "packing":
            assert now.columns == docs.columns
    a, b = seen["toxicity"]
    said = {r.doc_id for r in toxicity(a, spark.read.parquet(f"{small}/labels.parquet")).where("toxic").collect()}
    assert {r.doc_id for r in a.collect()} - {r.doc_id for r in b.collect()} == said
    a, b = seen["pii"]
    assert a.count() == b.count() and b.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9-]+\.[a-z]")).count() == 0
    a, b = seen["mixing"]
    assert {r.doc_id for r in b.collect()} <= {r.doc_id for r in a.collect()}
    a, b = seen["packing"]
    assert b.where("piece = 0").count() == a.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]


def test_packing_stage_binds_every_capacity(spark, small):
    docs = spark.createDataFrame([(i, "a b") for i in range(200)] + [(1000 + i, "word " * 1100) for i in range(20)] + [(2000 + i, "word " * 500) for i in range(40)], "doc_id long, text string")
    bins = {}
    for r in corpus_pipeline.pack_sequences(spark, docs, small).collect():
        bins.setdefault(r.sequence_id, []).append(r.length)
    used = [(sum(b), len(b), sum(n * n for n in b)) for b in bins.values()]
    assert all(t <= 2048 and d <= 12 and c <= 3 * 1024**2 for t, d, c in used)
    assert any(d == 12 for _, d, _ in used) and any(t > 2000 for t, _, _ in used)


def test_packing_stage_takes_odd_and_empty_tables(spark, small, odd_docs, no_docs):
    stage = dict(corpus_pipeline.STAGES)["packing"]
    assert stage(spark, odd_docs, small).where("piece = 0").count() == odd_docs.count() and stage(spark, no_docs, small).count() == 0


def test_chain_equals_brute_force(spark, docs, labels):
    """Each probability from plain sums over a text's features, category by category."""
    chain = fit_chain(docs, labels, ["quality", "toxic"])
    rows = {r.doc_id: r for r in score(docs, chain).collect()}
    place = {int(h): i for i, h in enumerate(chain.features.kept)}
    for doc_id in sorted(rows)[:25]:
        r = rows[doc_id]
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        hashes, _, dense, _ = block_features(raw, np.array([0, len(raw)]))
        held, earlier = {place[int(h)] for h in hashes if int(h) in place}, []
        for name, m in zip(chain.categories, chain.models):
            x = [*dense[0], *[math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4))) for p in earlier]]
            z = [m.bias[c] + sum(v * m.dense[k][c] for k, v in enumerate(x)) + sum(m.sparse[f][c] for f in held) for c in range(2)]
            earlier.append(1 / (1 + math.exp(z[0] - z[1])))
            assert math.isclose(r[f"p_{name}"], earlier[-1], rel_tol=1e-6, abs_tol=1e-9)
        assert r.toxic == (r.p_toxic >= chain.thresholds[-1])


@pytest.mark.parametrize("number", range(4))
def test_stages_take_odd_and_empty_tables(spark, small, odd_docs, no_docs, number):
    _, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, odd_docs, small).columns == odd_docs.columns
    assert stage(spark, no_docs, small).count() == 0


def test_registered_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
