import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring, perplexity
from tessera.llm.elias_fano import Sequence, build_trie, dequantise, dequantise_weight, mapped_trie, pack_sequence
from tessera.llm.licenses import license_matches, oracle_sql
from tessera.llm.lm_scoring import lm_scores, smoothed
from tessera.llm.perplexity import fit_models, kneser_ney, opened, quality_rules
from tessera.llm.pii import BASE, KINDS, calibrate, fit_detector, pii_report, redact, tree_sql, with_planted, with_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_personal_data(request, which):
    docs = request.getfixturevalue(which)
    want = []
    for r in docs.collect():
        spans = base_spans(r.text or "")
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((r.doc_id, *[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    got = pii_report(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)


def test_base_patterns_equal_the_plain_ones(spark):
    rng = np.random.default_rng(4)
    alphabet = list("a.b@-+1234567890 ().%_") + ["@x.y", "10.0.0.1", "+1 555"]
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for kind in KINDS:
        got = {r.doc_id: r.v for r in df.select("doc_id", F.regexp_extract_all("text", F.lit(BASE[kind]), F.lit(0)).alias("v")).collect()}
        assert all(got[i] == [m[0] for m in re.finditer(PLAIN[kind], t)] for i, t in enumerate(texts)), kind


def test_redaction_keeps_columns(odd_docs, no_docs):
    out = redact(odd_docs)
    assert out.columns == odd_docs.columns and redact(no_docs).count() == 0
    ten = out.where("doc_id = 10").first()
    assert ten.text == "mail [EMAIL], call [PHONE] or [CARD] at [IP] and 10.0.0.256" and ten.vector == "v"
    assert out.where("doc_id = 1").first().text is None and out.count() == odd_docs.count()


def test_wider_spans_are_selected(spark):
    """A phone number without a plus and a spelt-out e-mail are added; dates, ids, quads and prose are not."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        d = rng.integers(2, 10, 12)
        n = "".join(map(str, d))
        rows.append([
            f"Call +1 ({n[:3]}) {n[3:6]}-{n[6:10]} now", f"please call ({n[:3]}) {n[3:6]}-{n[6:10]} now", f"write to bob{n[0]} [at] mail{n[1]} [dot] org today",
            f"on 20{n[0]}{n[1]}-0{n[2]}-1{n[3]} 10 it was", f"order id {n[:3]} {n[3:6]} {n[6:10]} came", f"host 9{n[:2]}.{n[2:4]}.{n[4:6]}.{n[6:8]} fell", f"They met at noon{n[0]}. Then rain",
        ][i % 7])
    asked = {
        "please call (555) 123-4567 now": "phone:12:26", "write to ann [at] example [dot] org today": "email:9:35", "on 2024-03-14 10 it was": "",
        "order id 555 123 4567 came": "", "host 955.23.45.67 fell": "", "They met at noon. Then rain": "",
    }
    docs = spark.createDataFrame(list(enumerate(rows + list(asked))), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_report(docs).collect()}
    assert [got[len(rows) + i] for i in range(len(asked))] == list(asked.values())


def test_planted_strings_are_told_from_decoys(spark, small):
    """Fitted on one table and asked about strings written into another: what is found beyond the base spans."""
    fitted_on = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 10**6).alias("doc_id"), "text")
    asked = asked.unionByName(asked.withColumn("doc_id", F.col("doc_id") + 5000)).unionByName(asked.withColumn("doc_id", F.col("doc_id") + 9000))
    detector = fit_detector(fitted_on)
    assert sorted(detector.thresholds) == [KINDS.index("email"), KINDS.index("phone")]
    rows = with_spans(with_planted(asked), detector).collect()
    found = wrong = planted = 0
    for r in rows:
        more = [s for s in r["__spans"] if not s.base]
        hit = [s for s in more if abs(s.start - r["__from"]) <= 2 and abs(s.end - r["__to"]) <= 2 and s.kind == r["__kind"]]
        planted += r["__true"]
        found += r["__true"] and bool(hit)
        wrong += len(more) - (len(hit) if r["__true"] else 0)
    assert planted > 100 and found >= 0.85 * planted and wrong <= 0.05 * found


def test_wide_matches_inside_a_base_span_train_nothing(spark):
    """In the tables every grouped number stands behind a plus; one that stands alone is found all the same."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    mine = spark.createDataFrame([(-1, "please call (555) 123-4567 now"), (-2, "host 955.23.45.67 fell")], "doc_id long, text string")
    out = with_spans(mine, fit_detector(docs))
    assert {r.doc_id: [s["kind"] for s in r["__spans"]] for r in out.collect()} == {-1: [KINDS.index("phone")], -2: []}


def test_trees_and_calibration():
    text = "DecisionTreeRegressionModel: uid\n  If (feature 1 <= 2.5)\n   Predict: -1.0\n  Else (feature 1 > 2.5)\n   If (feature 0 <= 1.0)\n    Predict: 0.5\n   Else (feature 0 > 1.0)\n    Predict: 2.0\n"
    assert tree_sql(text) == "(CASE WHEN x[1] <= 2.5D THEN (-1.0D) ELSE (CASE WHEN x[0] <= 1.0D THEN (0.5D) ELSE (2.0D) END) END)"
    assert calibrate([(0.1, 50, 0), (0.5, 50, 30), (0.9, 50, 50)], 0.98) == 0.9
    assert calibrate([(0.1, 50, 10)], 0.98) is None


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs", "more"])
def test_language_model(request, spark, which):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if which == "more" else request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    tokens = [WORD.findall(lower(r.text)) + ["</s>\x00"] for r in rows]
    held = [zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]
    counts = Counter(t for x, h in zip(tokens, held) if not h for t in x)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((str(r.doc_id), h, len(x), sum(counts[t] > 0 for t in x), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x)) for r, h, x in zip(rows, held, tokens)), key=str)
    got = lm_scores(docs).collect()
    mine = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [x[:5] for x in mine] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in mine], [x[5] for x in want], rtol=1e-9)
    want = brute_scores(tokens, held, counts, n, v)
    assert np.allclose(sorted(r.score for r in got), sorted(want), rtol=1e-6)
    if which == "docs":
        out = [r for r in got if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)  # held-out text is likelier with contexts


def brute_scores(tokens, held, counts, n, v):
    """Interpolated trigrams from plain dictionaries, with the same quantisation."""
    grams = {2: defaultdict(Counter), 3: defaultdict(Counter)}
    around = []
    for x, h in zip(tokens, held):
        padded = [None, None, *x]
        around.append([(padded[i + 1 : i + 2], padded[i : i + 2], t) for i, t in enumerate(x)])
        for one, two, t in [] if h else around[-1]:
            grams[2][tuple(one)][t] += 1
            grams[3][tuple(two)][t] += 1
    model = {}
    for order, table in grams.items():
        for context, successors in table.items():
            c = np.array(list(successors.values()))
            values, weight, _ = smoothed(c, np.zeros(1, np.int64), np.zeros(len(c), np.int64))
            d, b = dequantise(values), dequantise_weight(weight)[0]
            assert 1 - 0.0006 * b <= d.sum() + b <= 1 + 1e-12
            model[order, context] = (dict(zip(successors, d)), b)
    scores = []
    for doc in around:
        total = 0.0
        for one, two, t in doc:
            p = (counts[t] + 0.1) / (n + 0.1 * (v + 1))
            for key in ((2, tuple(one)), (3, tuple(two))):
                d, b = model.get(key, ({}, 1.0))
                p = d.get(t, 0.0) + b * p
            total += math.log10(p)
        scores.append(total)
    return scores


def test_split_contexts_score_alike(spark, docs, monkeypatch):
    """Shards of a few thousand bytes split every frequent context; scores move by no more than the quantisation."""
    one = {r.doc_id: r.score for r in lm_scores(docs).collect()}
    many = {(r.doc_id, r.n_tokens): r.score for r in lm_scores(docs, shard_bytes=1 << 14).collect()}
    assert all(abs(s - one[i]) < 0.035 * n for (i, n), s in many.items())
    assert abs(sum(many.values()) / sum(one.values()) - 1) < 0.01
    chunks = lm_scoring.chunk_table(docs)
    heavy = lm_scoring.heavy_contexts(chunks, 50)
    assert len(heavy.contexts) and heavy.parts.sum() <= 4 * 2 * 50


def test_counts_are_64_bits_wide():
    keys, count = lm_scoring.pack_keys(np.array([1 << 21], np.uint64)), lm_scoring.pack_small(np.array([5_000_000_000]), "<u8")
    none, small = lm_scoring.pack_keys(np.zeros(1, np.uint64)), lambda x: lm_scoring.pack_small(np.array([x]), "<u4")
    row = lambda n: {"shard": 0, "chunk": n, "words": keys, "roots": keys, "vocabulary": keys, "keys2": none, "fan3": small(1), "keys3": small(0), "word_counts": count, "counts2": count, "counts3": count}
    out = lm_scoring.shard_answers(pa.Table.from_pylist([row(0), row(1)]), lm_scoring.NO_HEAVY)
    assert lm_scoring.unpack_small(out.column("counts")[1].as_py(), "<u8").tolist() == [10_000_000_000] and out.column("tokens")[0].as_py() == 10_000_000_000


def test_packed_numbers():
    from tessera.llm.number_planes import pack_keys, pack_small, unpack_keys, unpack_small

    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 5000):
        keys = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (unpack_keys(pack_keys(keys)) == keys).all() and len(unpack_keys(pack_keys(keys))) == n
        for kind, most in (("u1", 256), ("<u2", 2**16), ("<u4", 2**32), ("<u8", 2**63)):
            values = rng.integers(0, most, n)
            assert (unpack_small(pack_small(values, kind), kind) == values).all()


def test_elias_fano():
    rng = np.random.default_rng(6)
    for n, top in ((0, 10), (1, 5), (1000, 900), (5000, 2**40)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        s = Sequence({k: v for k, v in pack_sequence(values, top).items()})
        if n:
            assert (s.get(np.arange(n)) == values).all()


def test_trie_equals_a_dictionary():
    rng = np.random.default_rng(7)
    roots, words = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (50, 300))
    seen = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 900), rng.integers(0, 300, 900))} | {(r, 7) for r in range(50)})
    pairs = tuple(np.array(x) for x in zip(*seen))
    deep = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, len(seen), 2000), rng.integers(0, 300, 2000))})
    triples = tuple(np.array(x) for x in zip(*deep))
    v2, w2, v3, w3 = (rng.integers(1, most, n) for most, n in ((256, len(seen)), (60_000, 50), (256, len(deep)), (60_000, len(seen))))
    trie = mapped_trie(build_trie(roots, words, pairs, v2, w2, triples, v3, w3))
    # Asked about more roots, words, pairs and triples than it holds, by places among these.
    all_roots, all_words = (np.unique(np.append(x, rng.integers(0, 2**63, 40).astype(np.uint64))) for x in (roots, words))
    ask2 = (rng.integers(0, len(all_roots), 4000), rng.integers(0, len(all_words), 4000))
    ask2 = tuple(np.append(a, np.searchsorted(of, table[p])) for a, of, table, p in zip(ask2, (all_roots, all_words), (roots, words), pairs))
    ask3 = (rng.integers(0, len(ask2[0]), 4000), rng.integers(0, len(all_words), 4000))
    ask3 = (np.append(ask3[0], 4000 + triples[0]), np.append(ask3[1], np.searchsorted(all_words, words[triples[1]])))
    got = trie.look_up(all_roots, all_words, ask2, ask3)
    root_of, word_of = ({int(h): i for i, h in enumerate(x)} for x in (roots, words))
    at2, at3 = {p: i for i, p in enumerate(seen)}, {t: i for i, t in enumerate(deep)}
    place = [at2.get((root_of.get(int(all_roots[a]), -1), word_of.get(int(all_words[b]), -1))) for a, b in zip(*ask2)]
    third = [at3.get((-1 if place[a] is None else place[a], word_of.get(int(all_words[b]), -1))) for a, b in zip(*ask3)]
    of = lambda table, at: [0 if i is None else int(table[i]) for i in at]
    assert [x.tolist() for x in got] == [of(w2, [root_of.get(int(h)) for h in all_roots]), of(v2, place), of(w3, place), of(v3, third)]
    none = np.zeros(0, np.int64)
    empty = mapped_trie(build_trie(none.astype(np.uint64), none.astype(np.uint64), (none, none), none, none, (none, none), none, none))
    assert [x.tolist() for x in empty.look_up(roots[:2], words[:2], (np.array([0]), np.array([1])), (np.array([0]), np.array([0])))] == [[0, 0], [0], [0], [0]]


def test_words_never_seen_score_alike_after_a_busy_context(spark):
    """Every text ends in a word of its own behind the same two words."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("user id n"), "id").alias("text"))
    for shard_bytes in (1 << 23, 1 << 16):
        scores = [r.score for r in lm_scores(docs, shard_bytes).where("held_out").select("score").collect()]
        assert len(scores) > 2500 and max(scores) - min(scores) < 1e-9


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_quality_rules(request, which):
    docs = request.getfixturevalue(which)

    def base(text):
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = Counter(runs)
        covered = {i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed

    want = sorted(((r.doc_id, *base(r.text or "")) for r in docs.collect()), key=str)
    got = quality_rules(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert not any(r.kept and r.base_failed for r in got)
    if which == "docs":
        good = [r for r in got if not r.base_failed]
        assert sum(r.kept for r in good) > 0.8 * len(good)


def test_every_language_has_a_model(spark, monkeypatch):
    """Ten languages of equal size: each has its own model and band, also where they take several waves."""
    rng = np.random.default_rng(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(10):
        mine = [letters[(k + j * (k + 1)) % 26] for j in range(9)]
        for i in range(12):
            rows.append((len(rows), f"l{k}", " ".join("".join(rng.choice(mine, 5)) for _ in range(400))))
    rows += [(len(rows), "l3", " ".join("".join(rng.choice(list("qzxjv#|$"), 5)) for _ in range(400))), (len(rows) + 1, "tiny", " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    one = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert {r.model for r in one.values()} == {*[f"l{k}" for k in range(10)], "*"} and one[121].model == "*"
    assert not one[120].kept and sum(r.kept for r in one.values() if r.doc_id < 120) > 110
    assert len({(r.model, r.band_low) for r in one.values()}) == 11
    monkeypatch.setattr(perplexity, "WAVE", 3)
    assert {r.doc_id: r for r in quality_rules(docs).collect()} == one


def test_a_language_may_be_named_as_the_pooled_model(spark):
    rng = np.random.default_rng(12)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, "*" if i % 2 else "=", text("abcdefgh" if i % 2 else "pqrstuvw", 400)) for i in range(24)] + [(24, "tiny", text("abcxyz", 60))]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    bands = {(r.model, r.band_low) for r in got.values()}
    assert {m for m, _ in bands} == {"*", "="} and len(bands) == 3 and got[24].band_low != got[1].band_low


def test_bands_are_percentiles(spark):
    rng = np.random.default_rng(10)
    values = rng.normal(1.0, 0.1, 500)
    df = spark.createDataFrame([("m", float(v)) for v in values] + [("m", None)], "model string, log10_perplexity double")
    r = perplexity.bands(df, 5.0, 0.05).first()
    low, mid, high = np.sort(np.floor(values * 1e4) / 1e4)[[49, 249, 449]]
    assert np.allclose([r.band_low, r.band_high], [mid - 5 * (mid - low), mid + 5 * (high - mid)])


def test_perplexity_equals_brute_force(spark, docs):
    """The score of a text is the mean of its symbols' log probabilities, each backed off symbol by symbol."""
    some = docs.where("lang is not null and doc_id < 12")
    rows = some.select("doc_id", "text", "lang")
    texts = {d.doc_id: d.text for d in rows.collect()}
    models = opened(fit_models(rows.select("lang", "text")))
    table = perplexity._symbols()
    for r in perplexity.measure(rows, fit_models(rows.select("lang", "text"))).collect():
        text, m = texts[r.doc_id], models[r.model]
        symbols = [int(table[ord(c)]) for c in text]
        symbols = [s for i, s in enumerate(symbols) if i == 0 or s or symbols[i - 1]]
        known = {int(k): (float(p), float(b)) for k, p, b in zip(m.keys, m.logp, m.backoff)}

        def at(gram):
            code = sum(s << (5 * (len(gram) - 1 - i)) for i, s in enumerate(gram))
            return known.get(int(perplexity.ngram_hash(len(gram), np.array([code], np.uint64))[0]))

        total, padded = 0.0, [0, 0, 0, *symbols]
        for i in range(3, len(padded)):
            for n in range(4, 0, -1):
                hit = at(padded[i - n + 1 : i + 1])
                if hit:
                    total += hit[0]
                    break
                back = at(padded[i - n + 1 : i]) if n > 1 else None
                total += back[1] if back else 0.0
        assert math.isclose(r.log10_perplexity, -total / len(symbols), rel_tol=1e-5) and r.n_chars == len(symbols)


def test_every_character_of_a_text_is_a_symbol():
    """Only what follows a blank and is blank itself is left out, also where blanks take several bytes."""
    rng = np.random.default_rng(13)
    letters = [*"ab1#. \t\n", "\x85", "\xa0", "\u2003", "\u3000", "\u0300", "\xe9", "\u03a9", "\u6f22", "\U0001f600"]
    texts = ["", "\u3000\u3000", "a\xa0", " b", *["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(400)]]
    encoded = [x.encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])])
    codes, counts = perplexity.symbol_codes(np.frombuffer(b"".join(encoded), np.uint8), offsets)
    table, want = perplexity._symbols(), []
    for x in texts:
        symbols = [int(table[ord(c)]) for c in x]
        symbols = [s for i, s in enumerate(symbols) if i == 0 or s or symbols[i - 1]]
        padded = [0, 0, 0, *symbols]
        want.append([(a << 15) | (b << 10) | (c << 5) | d for a, b, c, d in zip(padded, padded[1:], padded[2:], symbols)])
    assert counts.tolist() == [len(w) for w in want] and codes.tolist() == [x for w in want for x in w]
    assert perplexity.symbol_codes(np.frombuffer(b"a\xffb", np.uint8), np.array([0, 3]))[1].tolist() == [3]  # not UTF-8


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(8)
    codes = np.unique(rng.integers(0, 32**4, 4000))
    model = kneser_ney(codes, rng.integers(1, 9, len(codes)))
    for context in rng.integers(0, 32**3, 5):
        p = 10 ** model.log10((np.uint32(context) << np.uint32(5)) | np.arange(32, dtype=np.uint32))
        assert abs(p.sum() - 1) < 1e-3


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_licences_equal_their_sql(request, which):
    docs = request.getfixturevalue(which)
    documents = docs.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents_", documents)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM documents_")
    out = con.execute(oracle_sql())
    names = [d[0] for d in out.description]
    want = sorted(str([r[names.index(c)] for c in ("doc_id", "scope", "line_no", "license_id", "digest")]) for r in out.fetchall())
    assert sorted(str(list(r)) for r in license_matches(docs).collect()) == want


def test_full_texts(spark):
    """Every known text is found when its paragraphs are wrapped anew, in other case and marks, and not when a word is changed."""
    import textwrap

    from tessera.llm.license_texts import FULL_TEXTS, KNOWN, SHORT_TEXTS

    names = {*FULL_TEXTS.values(), *[n for n, _, _ in SHORT_TEXTS]}
    wholes = [(n, t) for n, t in KNOWN if n in names and not t.startswith("SPDX") and len(t) > 300]
    rows = []
    for i, (_, text) in enumerate(wholes):
        wrapped = []
        for line in re.split(r"\n[ \t]*\n", text):
            notice = "copyright" in line.lower()
            wrapped.append(line if notice else textwrap.fill(" ".join(line.split()), 60 + i))
        words = text.split(" ")
        middle = next(j for j in range(len(words) // 2, len(words)) if words[j].isalpha())
        rows += [(3 * i, "Copyright (c) 2001 Someone\n\n" + "\n\n".join(wrapped)), (3 * i + 1, text.upper().replace(",", ";")), (3 * i + 2, " ".join([*words[:middle], "zebra", *words[middle + 1 :]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license_id) for r in license_matches(docs).where("scope = 'document'").collect()}
    assert got == {(3 * i + k, n) for i, (n, _) in enumerate(wholes) for k in (0, 1)}
    mine = spark.createDataFrame([("X", "My own words.")], "license_id string, known string")
    assert license_matches(spark.createDataFrame([(1, "my OWN words")], "doc_id long, text string"), mine).where("scope = 'document'").count() == 1


def test_licence_spellings(spark):
    text = "Copyright (c) 2020 Someone\nRELEASED under the  MIT Licence!"
    rows = license_matches(spark.createDataFrame([(1, text), (2, "Released under the MIT License, mostly.")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.scope, r.license_id) for r in rows} == {(1, "document", "MIT"), (1, "line", "MIT")}
