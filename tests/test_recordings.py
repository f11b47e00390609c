import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clocks, epochs, signals, tables
from tessera.sources import files


@pytest.fixture(scope="module")
def wave(spark):
    values = [0, 0, 1, 1, 0, 1, 0, 0]
    return spark.createDataFrame([("e", "c", i, v) for i, v in enumerate(values)], "epoch_id string, channel string, sample_idx int, value int")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_events_by_type(wave, spark):
    read = lambda kind: pairs(signals.read_events(kind, wave), "sample_idx", "event")
    assert read("dep") == [(2, 1), (5, 1)] and read("den") == [(4, 1), (6, 1)] and read("aen_t0.5") == [(4, 1), (6, 1)] and read("aep_t0.5") == [(2, 1), (5, 1)]
    assert read("dimp") == read("aimp_t0.5") == [(2, 1), (4, -1), (5, 1), (6, -1)] and read("aimn_t0.5") == [(2, -1), (4, 1), (5, -1), (6, 1)]
    native = spark.createDataFrame([("e", "c", 3, 7)], "epoch_id string, channel string, sample_idx int, event int")
    assert pairs(signals.read_events("marker", None, native), "sample_idx", "event") == [(3, 7)]
    with pytest.raises(ValueError):
        signals.read_events("marker")


def test_conversions(spark):
    r = spark.createDataFrame([(0, 0.0), (1000, 0.1), (2000, 0.2)], "s long, t double")
    got = r.select(signals.sample_time(F.col("s"), F.lit(30000.0)), signals.time_sample(F.col("t"), F.lit(30000.0))).collect()
    assert [x[0] for x in got] == [0.0, 1000 / 30000, 2000 / 30000] and [x[1] for x in got] == [0, 3000, 6000]
    inf = spark.createDataFrame([(float("-inf"),), (float("inf"),)], "t double")
    assert [x[0] for x in inf.select(signals.time_sample(F.col("t"), F.lit(10.0), F.lit(0.0), F.lit(1.0))).collect()] == [0, 10]


def test_edges_and_pulses(wave):
    assert pairs(signals.digital_edges(wave), "sample_idx") == [(2,), (5,)]
    assert pairs(signals.digital_edges(wave, at="before"), "sample_idx") == [(1,), (4,)]
    assert pairs(signals.digital_edges(wave, rising=False), "sample_idx") == [(4,), (6,)]
    assert pairs(signals.digital_pulses(wave), "sample_idx", "event") == [(2, 1), (4, -1), (5, 1), (6, -1)]
    assert pairs(signals.crossings(wave, 0.5, "down"), "sample_idx", "event") == [(4, -1), (6, -1)]
    assert pairs(signals.analog_pulses(wave, 0.5, False), "sample_idx", "event") == [(2, -1), (4, 1), (5, -1), (6, 1)]
    assert pairs(signals.decimate(wave, 3), "sample_idx") == [(0,), (3,), (6,)]
    assert pairs(signals.read_samples(wave, 1, 3), "sample_idx") == [(1,), (2,), (3,)]


def test_markers(spark):
    m = spark.createDataFrame([("e", 1.0, 1, 1.0), ("e", 2.0, 1, -1.0), ("e", 3.0, 1, 1.0), ("e", 0.9, 2, 7.0), ("e", 2.9, 2, 8.0)], "k string, t double, marker int, value double")
    got = sorted((r.place, r.t_on, r.t_off, r.stimulus) for r in signals.decode_markers(m, ["k"]).collect())
    assert got == [(1, 1.0, 2.0, 7.0), (2, 3.0, None, 8.0)]


def test_types(spark):
    r = spark.createDataFrame([("ai",), ("aep_t2.5",), ("odd",)], "k string")
    every = spark.createDataFrame([(k,) for k in signals.CHANNEL_TYPES], "k string").select("k", signals.standard_type(F.upper("k")).alias("full"), signals.storage_type(F.col("k"))["kind"].alias("kind"), signals.type_prefix(F.col("k")).alias("short"))
    assert {x.k: x.full for x in every.collect()} == signals.CHANNEL_TYPES and {x.kind for x in every.collect()} == {"float64", "uint8"}
    assert {x.k: x.short for x in every.collect()} == {k: {"aux": "ax", "tx": "tx"}.get(k, k) for k in signals.CHANNEL_TYPES}
    got = r.select(signals.standard_type(F.col("k")), signals.is_analog_event(F.col("k")), signals.event_threshold(F.col("k"))).collect()
    assert [tuple(x) for x in got] == [("analog_in", False, None), ("aep_t2.5", True, 2.5), ("odd", False, None)]


def test_filter_and_downsampling(spark):
    b, a = signals.chebyshev(4, 0.8, 0.25)
    assert np.allclose(b, [0.004656, 0.018623, 0.027935, 0.018623, 0.004656], atol=1e-6)
    assert np.allclose(a, [1, -2.674786, 3.145960, -1.836779, 0.447286], atol=1e-6)
    t = np.arange(4000) / 1000
    low, high = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 300 * t)
    y = signals.zero_phase(*signals.chebyshev(4, 0.8, 0.2), low + high)[500:-500]
    gain = y @ low[500:-500] / (low[500:-500] @ low[500:-500])
    assert 0.8 < gain < 1.01 and np.abs(y - gain * low[500:-500]).max() < 0.02
    rows = spark.createDataFrame([("e", i / 1024, float(low[i])) for i in range(400)], "e string, t double, value double")
    assert signals.downsample(rows, 128.0, ["e"]).count() == 100
    assert signals.downsample(rows, 600.0, ["e"]).count() == 400
    assert signals.downsample(rows, 128.0, ["e"], resample=True).count() == 100
    odd = spark.createDataFrame([("same", 1.0, 2.0)] * 3 + [("null", None, 1.0), ("null", 1.0, None)], "e string, t double, value double")
    assert signals.downsample(odd, 128.0, ["e"]).count() == 3


def test_filter_in_blocks_equals_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=9000))
    b, a = signals.chebyshev(4, 0.8, 0.25)
    state, plain = np.zeros(4), []  # sample by sample, from rest
    for v in x[:500]:
        y = b[0] * v + state[0]
        state = np.array([*(state[1:] + b[1:4] * v - a[1:4] * y), b[4] * v - a[4] * y])
        plain.append(y)
    assert np.allclose(signals._filter(b, a, np.concatenate([[0.0], x[:500]]))[1:], plain)
    rows = spark.createDataFrame([("e", i / 1024, float(v)) for i, v in enumerate(x)], "e string, t double, value double")
    whole = {r.t: r.value for r in signals.downsample(rows, 128.0, ["e"]).collect()}
    monkeypatch.setattr(signals, "BLOCK", 2000)
    cut = {r.t: r.value for r in signals.downsample(rows, 128.0, ["e"]).collect()}
    assert len(whole) == 2250 and whole.keys() == cut.keys() and max(abs(whole[t] - cut[t]) for t in whole) < 1e-6
    want = signals.zero_phase(*signals.chebyshev(4, 0.8, 0.25), x)[::4]
    assert np.allclose([whole[t] for t in sorted(whole)], want, atol=1e-6)
    grid = signals.downsample(rows, 100.0, ["e"], resample=True).collect()
    assert sorted(r.t for r in grid) == pytest.approx([k / 200 for k in range(len(grid))]) and len(grid) == int(8999 / 1024 * 200) + 1


def test_mappings(spark):
    m = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = spark.range(1).select(
        clocks.apply_mapping(m(2, 1), F.lit(5.0)), clocks.invert(m(2, 4)), clocks.compose(m(2, 1), m(3, 4)), clocks.apply_mapping(m(1, 0, -1), F.lit(3.0))
    ).first()
    assert r[0] == 11.0 and r[1] == [0.5, -2.0] and r[2] == [6.0, 7.0] and r[3] == 8.0
    with pytest.raises(Exception, match="cannot be inverted"):
        spark.range(1).select(clocks.invert(m(0, 1))).collect()


def test_rules_and_paths(spark):
    nodes = spark.createDataFrame([(1, "a", "utc"), (2, "b", "approx_utc"), (3, "b", "no_time"), (4, "a", "utc")], "node_id int, objectname string, clock string")
    assert pairs(clocks.clock_edges(nodes, []), "src", "dst", "cost") == [(1, 2, 100.0), (4, 2, 100.0)]
    shared = spark.createDataFrame([(1, "a", "f1"), (1, "a", "f2"), (1, "a", "f3"), (2, "b", "f1"), (2, "b", "f2"), (3, "b", "f1")], "node_id int, objectname string, path string")
    assert pairs(clocks.shared_file_edges(shared), "src", "dst") == [(1, 2), (2, 1)]
    e = spark.createDataFrame([("a", "b", 100.0, [1.0, 1.0]), ("b", "c", 1.0, [2.0, 3.0]), ("a", "c", 500.0, [9.0, 9.0]), ("c", "a", 1.0, [1.0, 0.0])], "src string, dst string, cost double, mapping array<double>")
    paths = {r.id: (r.cost, r.mapping) for r in clocks.cheapest_paths(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert paths == {"a": (0.0, [1.0, 0.0]), "b": (100.0, [1.0, 1.0]), "c": (101.0, [2.0, 5.0])}
    both = clocks.cheapest([e, e.withColumn("cost", F.lit(1.0))])
    assert {r.rule for r in both.collect()} == {1, 2} and both.where("src = 'a' AND dst = 'b'").first().cost == 1.0


def test_fits(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.uniform(0.5, 2.0, 30))
    a = spark.createDataFrame([("k", float(x)) for x in t], "k string, t double")
    b = spark.createDataFrame([("k", float(2 * x + 1)) for x in t[4:]], "k string, t double")
    assert clocks.trigger_fit(a, b, ["k"]).count() == 0
    fit = clocks.pulse_fit(a, b, ["k"]).first()
    assert fit.lag == -4 and math.isclose(fit.mapping[0], 2, rel_tol=1e-6) and math.isclose(fit.mapping[1], 1, abs_tol=1e-6)
    odd = {"k": "k", "i": "i", "j": "j", "x": "x", "y": "y", "n": "n", "lag": "lag"}
    wide = lambda df: df.select(*[F.lit(v).alias(c) for c, v in odd.items()], "t")
    again = clocks.pulse_fit(wide(a), wide(b), ["k", "i", "j", "x", "y"]).first()
    assert again.lag == -4 and clocks.trigger_fit(wide(a), wide(a), ["k", "i", "x", "y"]).first().n == 30
    exact = clocks.trigger_fit(a, a.withColumn("t", F.col("t") * 3), ["k"]).first()
    assert exact.n == 30 and math.isclose(exact.mapping[0], 3, rel_tol=1e-9)


def correlated(t1, t2):
    """The lag of the largest correlation of normalised intervals, over all lags."""
    z1, z2 = (((g := np.diff(t)) - g.mean()) / (g.std() + 1e-15) for t in (t1, t2))
    return len(z2) - 1 - int(np.argmax(np.correlate(z1, z2, mode="full")))


def test_pulse_fit_equals_the_full_correlation_at_any_lag(spark):
    rng = np.random.default_rng(5)
    free, few = np.cumsum(rng.uniform(0.5, 2.0, 7000)), np.cumsum(rng.choice([1.0, 1.5, 2.0], 3000))
    jitter = free[:2000] + rng.normal(0, 0.005, 2000)
    cases = {
        "late": (free, 1.5 * free[5000:] + 3), "early": (free[5200:], 2 * free - 8), "few": (few, few[700:] * 3 + 1), "same": (free[:50], free[:50]),
        "jitter": (free[:2000], 1.1 * jitter[300:] + 2), "other": (free[:400], np.cumsum(rng.uniform(0.5, 2.0, 400))), "even": (np.arange(40.0), np.arange(40.0)),
    }
    side = lambda i: spark.createDataFrame([(k, float(x)) for k, v in cases.items() for x in v[i]], "k string, t double")
    got = {r.k: r for r in clocks.pulse_fit(side(0), side(1), ["k"]).collect()}
    assert set(got) == {"late", "early", "few", "same", "jitter"}
    for k, r in got.items():
        a, b = cases[k]
        assert r.lag == correlated(a, b)
        n = min(len(a), len(b) - r.lag) - max(0, -r.lag)
        x, y = a[max(0, -r.lag) :][:n], b[max(0, r.lag) :][:n]
        assert r.n == n and np.allclose(r.mapping, np.polyfit(x, y, 1), rtol=1e-6)


def test_segments_give_what_one_window_gives_and_bound_it(spark, monkeypatch):
    rng = np.random.default_rng(11)
    place = np.sort(rng.choice(9000, 5000, replace=False))
    rows = [("e", "c", int(i), float(v)) for i, v in zip(place, rng.integers(0, 2, 5000))] + [(None, "c", i, float(i % 3 == 0)) for i in range(40)]
    rows += [("one", "c", 7, 1.0)]
    one = spark.createDataFrame(rows, "epoch_id string, channel string, sample_idx int, value double")
    monkeypatch.setattr("tessera.operators.segments.SEGMENT", 100)
    over = "OVER (PARTITION BY epoch_id, channel ORDER BY sample_idx)"
    plain = one.selectExpr("*", f"lag(value) {over} AS prev", f"lag(sample_idx) {over} AS at", f"row_number() {over} - 1 AS n", f"lead(value) {over} AS nxt")
    was = sorted(map(tuple, plain.select("epoch_id", "sample_idx", "value", "prev", "at").collect()), key=str)
    got = signals.with_previous(one)
    assert sorted(map(tuple, got.select("epoch_id", "sample_idx", "value", "__prev", "__at").collect()), key=str) == was
    want = sorted(map(tuple, plain.where("n % 7 = 0").select("epoch_id", "sample_idx", "value").collect()), key=str)
    assert sorted(map(tuple, signals.decimate(one, 7).select("epoch_id", "sample_idx", "value").collect()), key=str) == want
    made = plain.selectExpr("epoch_id", "explode(sequence(0, 2)) j", "sample_idx * 3 + j AS s", "value + (coalesce(nxt, value) - value) * j / 3 AS v").select("epoch_id", "s", "v")
    fine = signals.interpolate_to(one, 3, signals.KEYS).select("epoch_id", "sample_idx", "value")
    assert sorted(map(tuple, fine.collect()), key=str) == sorted(map(tuple, made.collect()), key=str)
    dist = signals.intervals(one.withColumn("t", F.col("sample_idx") * 2.0), signals.KEYS, ["sample_idx"], counted=True).select("epoch_id", "sample_idx", "interval")
    assert sorted(map(tuple, dist.collect()), key=str) == sorted(map(tuple, plain.selectExpr("epoch_id", "sample_idx", "2.0D * (sample_idx - at)").collect()), key=str)
    # The window is dealt by segment, so a task has the rows of one segment and one more at most.
    from tessera.operators.segments import carried

    sizes = carried(one, signals.KEYS, "sample_idx", "value").groupBy("epoch_id", "channel", "__seg").count()
    assert sizes.agg(F.max("count")).first()[0] <= 101
    text = signals.digital_edges(one)._jdf.queryExecution().toString()
    assert "Window" in text and "__seg" in text


def test_medians(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=101), "b": rng.normal(size=100), "c": np.array([0.1, 0.1, 0.1, 0.1 + 1e-12]), "d": np.array([5.0]), "e": rng.integers(0, 3, 50) * 1.0}
    values["f"] = 1 + rng.uniform(size=400) * 1e-9  # all within a few single-precision numbers
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("none", None)], "k string, v double")
    from tessera.operators.segments import grouped_median

    assert {r.k: r["median"] for r in grouped_median(rows, "k", "v").collect()} == {k: float(np.median(v)) for k, v in values.items()}


def plainly_downsampled(t, x, limit):
    """As one array: the rate by the median distance, the filter over all samples, every step-th one."""
    if len(t) < 2 or (dt := np.median(np.diff(t))) <= 0 or 1 / dt <= 2 * limit:
        return t, x
    y = signals.zero_phase(*signals.chebyshev(4, 0.8, 2 * limit * dt), x)
    step = max(1, int(1 / dt / (2 * limit) * (1 + 1e-6)))
    return t[::step], y[::step]


def test_downsampling_by_the_median_distance(spark, monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(signals, "BLOCK", 1000)
    whole = np.arange(4000)
    paused = np.where(whole < 2500, whole / 1024, whole / 1024 + 8)
    channels = {"paused": paused, "jitter": np.sort(whole / 1024 + rng.normal(0, 1e-5, 4000)), "slow": whole[:300] / 100, "one": np.array([3.0]), "same": np.array([1.0, 1.0, 1.0])}
    channels |= {f"kHz{n}": np.arange(n) / 1000 for n in (22, 399, 2000)}
    data = {k: (t, np.cumsum(rng.normal(size=len(t)))) for k, t in channels.items()}
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (t, x) in data.items() for a, b in zip(t, x)], "e string, t double, value double")
    for limit in (128.0, 100.0):
        got = {}
        for r in signals.downsample(rows, limit, ["e"]).collect():
            got.setdefault(r.e, []).append((r.t, r.value))
        for k, (t, x) in data.items():
            a, b = plainly_downsampled(t, x, limit)
            out = sorted(got[k])
            assert [p for p, _ in out] == a.tolist(), k
            assert k == "same" or np.allclose([v for _, v in out], b, atol=1e-6), k
    assert sum(r.e == "paused" for r in signals.downsample(rows, 128.0, ["e"]).collect()) == 1000
    assert [sum(r.e == f"kHz{n}" for r in signals.downsample(rows, 100.0, ["e"]).collect()) for n in (22, 399, 2000)] == [5, 80, 400]
    # On an even grid, across the pause.
    t, x = data["paused"]
    y = signals.zero_phase(*signals.chebyshev(4, 0.8, 2 * 128 / 1024), x)
    grid = t[0] + np.arange(int((t[-1] - t[0] + 1e-12) * 256) + 1) / 256
    out = sorted((r.t, r.value) for r in signals.downsample(rows.where("e = 'paused'"), 128.0, ["e"], resample=True).collect())
    assert np.allclose([p for p, _ in out], grid) and np.allclose([v for _, v in out], np.interp(grid, t, y), atol=1e-6)
    null = spark.createDataFrame([(None, i / 1024, 1.0) for i in range(100)], "e string, t double, value double")
    assert signals.downsample(null, 128.0, ["e"]).count() == 25


def test_windows_of_any_length_in_one_table(spark):
    rng = np.random.default_rng(8)
    events = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 600), rng.uniform(-50, 1000, 600)))] + [(1, float(2**k), 700 + k) for k in range(-3, 10)]
    windows = [(int(k), float(a), float(a + n)) for k, a, n in zip(rng.integers(0, 4, 200), rng.uniform(-50, 1000, 200), 10 ** rng.uniform(-6, 4, 200))]
    windows += [(1, float(2**k), float(2 ** (k + 1))) for k in range(-3, 9)] + [(0, 5.0, 5.0), (0, 6.0, 1.0), (2, float("-inf"), 100.0), (3, 900.0, float("inf")), (9, 0.0, 1.0)]
    e = spark.createDataFrame(events, "k int, t double, i int")
    w = spark.createDataFrame([(*x, n) for n, x in enumerate(windows)], "k int, t_on double, t_off double, n int")
    want = sorted((i, n) for k, t, i in events for n, (k2, a, b) in enumerate(windows) if k == k2 and a <= t < b)
    assert pairs(signals.in_windows(e, w, ["k"]), "i", "n") == want
    assert signals.in_windows(e, w.limit(0), ["k"]).count() == 0


def test_files(spark, tmp_path):
    for name in ("x/rec_1.rhd", "x/rec_2.rhd", "x/rec_1.epoch", "y/rec_3.rhd", "x/.hidden.rhd"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    found = files.listing(spark, str(tmp_path))
    assert found.count() == 4
    groups = files.file_groups(found, ["#.rhd", "#.epoch"]).collect()
    assert len(groups) == 1 and [p[-5:] for p in groups[0].files] == ["1.rhd", "2.rhd", "epoch"]
    series = files.series_epochs(found, "#.rhd", ["#.epoch"]).collect()
    assert [(r.prefix) for r in series] == ["rec_1"]
    epochs = spark.createDataFrame([("ep1", ["/data/recording_001.dat"])], "epoch_id string, files array<string>")
    assert files.files_of_name(spark.createDataFrame([("recording_001.dat",)], "filename string"), epochs).first().epoch_id == "ep1"


def test_binary_files(spark):
    raw = files.grid_bytes([1, 2, 3, 4], "int16")
    rows = spark.createDataFrame([("p", raw)], "path string, content binary")
    assert files.read_grid(rows, "int16", [2, 2]).first().data == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(Exception, match="bytes, not"):
        files.read_grid(rows, "int16", [3, 2]).collect()
    with pytest.raises(ValueError):
        files.read_grid(rows, "quad", [4])
    records = [{"clock": "utc", "times": [1.0, 2.0, 3.0, 4.0], "events": [(0.5, 1.0)]}, {"clock": "dev_local_time", "times": [5.0] * 4, "events": []}]
    p = spark.createDataFrame([("p", files.presentation_bytes(records))], "path string, content binary")
    got = files.read_presentation(p, 2, 9).collect()
    assert [(r.number, r.clock) for r in got] == [(2, "dev_local_time")]
    assert files.read_presentation(p).first().events == [[0.5, 1.0]]


def test_pairs_of_one_key_are_dealt_over_tasks(spark):
    k = F.when(F.col("id") >= 0, "k").alias("k")
    many, few = spark.range(400).select(k, "id"), spark.range(50).select(k, F.col("id").alias("other"))
    met = tables.spread_join(many, few, ["k"])
    assert met.count() == met.distinct().count() == 20_000
    assert sum(n > 0 for n in met.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 1


def test_pairs_of_chunks_are_those_of_a_join(spark, monkeypatch):
    monkeypatch.setattr(tables, "CHUNK", 3, raising=False)
    monkeypatch.setattr(tables, "RUN", 2, raising=False)
    many = spark.createDataFrame([(k, i % 5 or None, f"m{i % 7}") for i in range(60) for k in ("a", "b", None)] + [("a", 1, "m1")] * 40 + [("x", 1, "m")], "k string, i int, m string")
    few = spark.createDataFrame([(k, f"f{i % 9}" if i % 9 else None, i % 3) for i in range(30) for k in ("a", "b", None, "y")] + [("b", "f1", 1)] * 20, "k string, f string, j int")
    key = lambda r: tuple(map(str, r))
    for a, b in ((many, few), (many, few.limit(0)), (many.limit(0), few)):
        found = tables.spread_join(a, b, ["k"])
        assert found.columns == ["k", "i", "m", "f", "j"]
        assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, a.join(b, "k").collect()), key=key)


def test_files_of_pairs_take_a_fraction_of_a_byte_a_pair(spark, tmp_path):
    """However many rows a key has: pairs come in tiles, and none waits for the others of its chunks."""
    k = F.when(F.col("id") >= 0, "k").alias("k")
    table = lambda n, name: spark.range(n).select(k, F.concat(F.lit(name), F.col("id").cast("string")).alias(name))
    tables.spread_join(table(400, "m"), table(8_000, "f"), ["k"]).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 3_200_000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.5 * 3_200_000
    assert len(tables.spread_join(table(30_000, "m"), table(30_000, "f"), ["k"]).take(5)) == 5


def test_epochs_of_elements_are_numbered_once_a_parent(spark):
    elements = spark.createDataFrame([("a", "p", True), ("b", "p", True), ("c", None, False), ("d", "p", True), ("d", "q", True), ("e", "q", True), ("e", None, False), ("f", "none", True)], "element_id string, parent_id string, direct boolean")
    parents = spark.createDataFrame([("p", "e3"), ("p", "e1"), ("q", "e2"), ("q", "e1")], "element_id string, epoch_id string")
    own = spark.createDataFrame([("c", "x2"), ("c", "x1"), ("e", "a9"), ("a", "y")], "element_id string, epoch_id string")
    found = epochs.element_epochs(elements, parents, own)
    want = {"a": ["e1", "e3"], "b": ["e1", "e3"], "c": ["x1", "x2"], "d": ["e1", "e1", "e2", "e3"], "e": ["a9", "e1", "e2"]}
    assert sorted(map(tuple, found.collect())) == sorted((k, e, i + 1) for k, v in want.items() for i, e in enumerate(v))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # the pairs of single elements go to no window


def test_clock_edges_of_one_scope_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(clocks, "LISTED", 7, raising=False)
    clock = F.element_at(F.array(F.lit("utc"), F.lit("approx_utc"), F.lit("no_time")), (F.col("id") % 3 + 1).cast("int"))
    nodes = spark.range(300).select(F.col("id").alias("node_id"), F.when(F.col("id") >= 0, "s").alias("session"), (F.col("id") % 5).alias("objectname"), clock.alias("clock"))
    found = clocks.clock_edges(nodes, ["session"])
    want = [(a, b) for a in range(0, 300, 3) for b in range(300) if b % 3 < 2 and a % 5 != b % 5]
    assert sorted(map(tuple, found.select("src", "dst").collect())) == sorted(want)
    assert sum(n > 0 for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 1


def test_edges_of_clocks_come_in_runs_of_one_owner(spark, tmp_path):
    """Owners are drawn at random; files of edges stay a fraction of a byte an edge."""
    owner = (F.xxhash64("id") % 5).alias("objectname")
    nodes = spark.range(6_000).select(F.col("id").alias("node_id"), F.lit("s").alias("session"), owner, F.when(F.col("id") % 10 == 0, "utc").otherwise("approx_utc").alias("clock"))
    found = clocks.clock_edges(nodes, ["session"]).select("src", "dst")
    found.write.parquet(f"{tmp_path}/edges")
    n = nodes.select("node_id", "objectname", "clock")
    want = n.where("clock = 'utc'").alias("a").join(n.alias("b"), F.expr("a.objectname <> b.objectname")).count()
    assert spark.read.parquet(f"{tmp_path}/edges").distinct().count() == want
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.4 * want
