import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard_join
from tessera.llm.components import components
from tessera.llm.jaccard_join import near_duplicates, one_of_each
from tessera.llm.vectors import codes_of, hadamard, near_vectors


def union_find(pairs):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return top


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    where = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = []
    for i, (a, s) in enumerate(sets):
        for j, o in Counter(j for g in s for j in where[g] if j < i).items():
            b, t = sets[j]
            if a is not None and b is not None and 100 * o >= 80 * (len(s) + len(t) - o):
                pairs.append((a, b))
    top = union_find(pairs)
    return sorted(((d, len(s), None if d is None else top(d)) for d, s in sets), key=str)


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_join_equals_brute_force(request, which):
    docs = request.getfixturevalue(which)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == brute(docs.collect())


def test_join_over_small_groups(spark, monkeypatch):
    """A family of near copies in groups of a few sets each, chains, and many texts around one passage."""
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(0, 10**6)
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = []
    for i in range(60):
        text = list(base)
        text[int(rng.integers(0, 60))] = word()
        rows.append((i, " ".join(text)))
    chain = [word() for _ in range(100)]
    for i in range(60, 80):
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append((i, " ".join(chain)))
    for i in range(80, 140):
        rows.append((i, " ".join(passage + [word() for _ in range(int(rng.integers(2, 9)))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 8)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == brute(docs.collect())


def test_stage_keeps_one_of_each(spark, odd_docs, no_docs):
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and one_of_each(no_docs).count() == 0
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 8, 10, 11, 12, None, None], key=str)


def test_stage_keeps_unlike_rows_of_one_id(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(30)), "x"), (1, " ".join(f"b{i}" for i in range(30)), "y"), (2, " ".join(f"c{i}" for i in range(30)), "z"), (2, " ".join(f"c{i}" for i in range(30)), "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text[0], r.source) for r in one_of_each(docs).collect())
    assert got == [(1, "a", "x"), (1, "b", "y"), (2, "c", "w")]


def test_hub_meets_its_edges(spark):
    """A hub with most of all edges, and one hub hanging on another."""
    edges = spark.createDataFrame([(1000, i) for i in range(1001, 1400)] + [(1399, i) for i in range(1400, 1600)] + [(5, 6)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {5: 5, 6: 5, **{i: 1000 for i in range(1000, 1600)}}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (102, 100), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(edges.where("a > 1000")).count() == 0


def brute_vectors(rows, threshold=0.9):
    good = [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.vec_id is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    pairs, links = [], Counter()
    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    top = union_find(pairs)
    return {(r.vec_id, links[r.vec_id], None if r.vec_id is None else top(r.vec_id)) for r in rows}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for _ in range(40):
        center = rng.normal(size=48)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((n, [float(v) for v in center + rng.normal(size=48) * 0.2]))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, [2 * v for v in rows[0][1]]), (n + 2, None), (n + 3, [0.0] * 48), (n + 4, [float("nan")] + [1.0] * 47), (n + 5, []), (n + 6, [1.0, None]), (None, rows[0][1]), (n + 7, [1.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_vectors(df).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == brute_vectors(df.collect())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None) and len(got) == len(rows)
    assert near_vectors(df.where("vec_id > 100000")).count() == 0


def test_hot_bucket_is_split(spark, monkeypatch):
    from tessera.llm import vectors

    rng = np.random.default_rng(3)
    center = rng.normal(size=16)
    df = spark.createDataFrame([(i, [float(v) for v in center + rng.normal(size=16) * 0.05]) for i in range(90)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "BLOCK", 20)
    got = near_vectors(df).collect()
    assert all(r.n_links == 89 and r.component_id == 0 for r in got)


@pytest.mark.parametrize("hashes", [2, 3, 4])
def test_recall_with_more_hashes(spark, hashes):
    """Pairs just over the threshold, far from all others; every one that is missed counts."""
    rng = np.random.default_rng(hashes)
    rows = []
    for _ in range(400):
        x = rng.normal(size=64)
        y = rng.normal(size=64)
        x, y = x / np.linalg.norm(x), y - x * (x @ y) / (x @ x)
        y = 0.91 * x + np.sqrt(1 - 0.91**2) * y / np.linalg.norm(y)
        rows += [x, y]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    want = brute_vectors(df.collect())
    got = {(r.vec_id, r.n_links, r.component_id) for r in near_vectors(df, hashes=hashes).collect()}
    assert len(got & want) >= 0.98 * len(want) and all(n <= 1 for _, n, _ in got)


def test_long_vectors(spark):
    """Vectors of 8,192 components under two hashes, where a signed axis needs 14 bits: all 180 links are found."""
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(90):
        x = rng.normal(size=8192)
        rows += [x, x + rng.normal(size=8192) * 0.3]
    df = spark.createDataFrame([(i, v.astype("f4").tolist(), "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, bucket string")
    got = near_vectors(df, hashes=2).collect()
    assert sum(r.n_links for r in got) == 180 and all(r.component_id == r.vec_id // 2 * 2 for r in got)
    with pytest.raises(ValueError, match="tables"):
        near_vectors(df, hashes=20)


def test_hadamard_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose((hadamard(x) ** 2).sum(1), 32 * (x**2).sum(1)) and np.allclose(hadamard(hadamard(x)), 32 * x)
    assert len(set(codes_of(np.array([[[1, 2]], [[2, 1]], [[1, 3]]])).ravel().tolist())) == 3
