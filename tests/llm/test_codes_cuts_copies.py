import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import exact_dedup, fim, vector_codes
from tessera.llm.exact_dedup import chunk_ends, cut_places, exact_groups
from tessera.llm.fim import fill_in_middle, restored, starts_from, summary
from tessera.llm.vector_codes import compress, intervals, nearest

VECTORS = "vec_id long, embedding array<double>, label string, n long, code string, error string"


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Plain Python integers over ``(vec_id, embedding, label)``."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    dim = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    width = dim // parts
    q = [[int(np.floor(scale * x)) for x in r[1]] + [0] * (dim - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[q[i][p * width : (p + 1) * width] for i in first] for p in range(parts)]

    def best(v, p):
        part = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in q:
                members[best(v, p)[1]].append(v[p * width : (p + 1) * width])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if members[k] else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(v, p) for p in range(parts)] for v in q]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, errors)]


def codes(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_equal_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=20).round(2).tolist(), ["a", "b", None][i % 3]) for i in range(90)]
    rows += [(5, rows[5][1], "a"), (5, [0.5] * 20, "a"), (None, [0.25] * 20, "null"), (91, None, "a"), (92, [], "a"), (93, [1.0] * 7, None)]
    rows += [(94, [1.0, None] * 10, "a"), (95, [float("nan")] * 20, "a"), (96, [float("-inf")] + [0.0] * 19, "b"), (97, [-0.001] * 20, "b")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)
    assert codes(compress(df)) == sorted(brute_codes(rows), key=str)
    few = [r for r in rows if r[0] in (1, 2, 3)]
    assert codes(compress(df.where("vec_id IN (1, 2, 3)"))) == sorted(brute_codes(few), key=str)
    assert codes(compress(df.limit(0))) == [] and compress(df.where("vec_id = 95")).count() == 0


def test_codes_of_the_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert codes(compress(df)) == sorted(brute_codes(rows), key=str)


def test_a_component_beyond_the_exact_range_raises(spark):
    with pytest.raises(Exception, match="64 bits"):
        compress(spark.createDataFrame([(1, [1e12] * 16, None, 1, "", "")], VECTORS)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40), st.sampled_from([3, 300, 20_000_000]), st.integers(0, 10**6))
def test_intervals_hold_the_exact_score_and_ties_go_to_the_lower_index(width, entries, most, seed):
    rng = np.random.default_rng(seed)
    values, book = rng.integers(-most, most, (50, width)), rng.integers(-most, most, (entries, width))
    scores, radius = intervals(values, book)
    exact = (book * book).sum(axis=1).astype(object) - 2 * (values.astype(object) @ book.T.astype(object))
    assert all(abs(int(e) - s) <= r for e, s, r in zip(exact.ravel(), scores.ravel(), radius.ravel()))
    index, best = nearest(values, book)
    full = ((values[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert index.tolist() == full.argmin(axis=1).tolist() and best.tolist() == full.min(axis=1).tolist()


UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("which,piece", [("docs", 1 << 20), ("odd_docs", 1 << 20), ("odd_docs", 5), ("docs", 501), ("no_docs", 5)])
def test_fill_in_middle_equals_brute_force_whole_and_in_pieces(request, which, piece):
    docs = request.getfixturevalue(which)
    if piece == 5:
        docs = docs.where("text IS NULL OR length(text) < 5000")
    out = fill_in_middle(docs, piece).withColumn("back", restored(fim.F.col("output"), fim.F.col("form"))).collect()
    want = sorted(((*brute_fim(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want


def test_sentinels_and_units_that_span_pieces(spark):
    texts = ["x<P>", "ab<", "<<S>>", "<M", "a<M>b", "<p>", "aé<Sb>", "PP<PP>", "é" * 9 + "<P>", "abcdefghijklmnop", "<P", "S><S"]
    rows = [(i + 100 * k, t) for k in range(4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute_fim(*r) for r in rows)
    for piece in (1, 2, 3):
        assert sorted(tuple(r) for r in fill_in_middle(docs, piece).collect()) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aPSM<>. \né\U0001f600", max_size=6), max_size=6))
def test_summaries_compose_to_the_whole_text(pieces):
    raw = [np.frombuffer(p.encode(), np.uint8) for p in pieces]
    kinds = [fim.KIND[ord(c)] if ord(c) < 128 else fim.OTHER for c in "".join(pieces)]
    left = fim.NOTHING
    for r in raw:
        left = left.then(summary(r))
    right = fim.NOTHING
    for r in reversed(raw):
        right = summary(r).then(right)
    for state in range(4):
        want = fim.run_from(state, kinds)
        assert want == (left.end[state], left.units[state], left.marks[state]) == (right.end[state], right.units[state], right.marks[state])
        if raw:
            assert len(starts_from(raw[0], state)) == summary(raw[0]).units[state]
    assert fim.run_from(fim.BREAK, kinds)[1] == len(UNITS.findall("".join(pieces)))


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("which,sizes", [("docs", (2048, 13, 65536)), ("odd_docs", (2048, 13, 65536)), ("odd_docs", (32, 4, 100)), ("docs", (40, 5, 90)), ("no_docs", (32, 4, 100))])
def test_exact_groups_equal_brute_force(request, which, sizes):
    docs = request.getfixturevalue(which)
    got = exact_groups(docs, *sizes).collect()
    want, distinct = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == distinct and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_texts_that_differ_in_one_byte_or_in_the_order_of_chunks(spark):
    rng = np.random.default_rng(7)
    blocks = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(6)]
    whole = "".join(blocks)
    rows = [(1, whole), (2, whole), (3, whole[:-1] + "!"), (4, "!" + whole[1:]), (5, "".join(blocks[::-1])), (6, whole + whole), (7, whole + whole), (8, whole)]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), 64, 8, 2048).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 8, 3), (2, 8, 3), (8, 8, 3), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 7, 2), (7, 7, 2)}


def test_clashing_digests_are_found_and_another_digest_taken(docs, monkeypatch):
    """Under the first digest most chunks clash."""
    import xxhash

    def weak(chunk, seed):
        full = xxhash.xxh3_128_digest(chunk, seed=seed)
        return (full if seed else bytes([chunk[0] % 3]) * 16) + len(chunk).to_bytes(4, "little")

    monkeypatch.setattr(exact_dedup, "digest_of", weak)
    rows = docs.select("doc_id", fim.F.substring("text", 1, 40).alias("text"))
    weakly = exact_dedup.recipes_of(exact_dedup.texts_of(rows), 0, (32, 4, 64))
    texts = rows.select("text").distinct().count()
    assert weakly.select("recipe").distinct().count() < texts and exact_dedup.clashes(exact_dedup.texts_of(rows), weakly, 0, (32, 4, 64)) > 0
    got = exact_groups(rows, 32, 4, 64).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_groups([(r.doc_id, r.text) for r in rows.collect()])[0]


def test_bit_table_holds_every_identifier(spark, monkeypatch):
    ids = spark.range(20_000).select(fim.F.unhex(fim.F.md5(fim.F.col("id").cast("string"))).alias("id"))
    for most in (27, 18):
        monkeypatch.setattr(exact_dedup, "MOST_BITS", most)
        bits = np.unpackbits(exact_dedup.bit_table(ids))
        want = {int.from_bytes(bytes(r.id[:4]), "big") % len(bits) for r in ids.collect()}
        assert set(np.flatnonzero(bits).tolist()) == want and len(bits) <= 1 << most
    assert not exact_dedup.bit_table(ids.limit(0)).any()


def test_cuts_move_with_the_text():
    data = np.random.default_rng(1).integers(0, 256, 400_000).astype(np.uint8)
    moved = np.concatenate([np.arange(777).astype(np.uint8), data])

    def chunks(x):
        ends = chunk_ends(cut_places(x, 10).tolist(), 0, len(x), 256, 8192)
        assert ends[-1] == len(x) and all(b - a <= 8192 for a, b in zip([0, *ends], ends)) and all(b - a >= 256 for a, b in zip([0, *ends], ends[:-1]))
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    one, other = chunks(data), chunks(moved)
    assert len(one & other) > 0.9 * len(one)
    places = cut_places(data, 10)
    edge = exact_dedup.SEGMENT
    assert edge > len(data) or len(places)
    exact_dedup.SEGMENT = 5000
    try:
        assert np.array_equal(cut_places(data, 10), places)
    finally:
        exact_dedup.SEGMENT = edge
