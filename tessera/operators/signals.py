"""Sampled channels and events: conversions, range reads, edges, thresholds, pulses, markers, decimation.

Samples are rows ``epoch_id, channel, sample_idx, value``; every window runs within an epoch and a channel. The ``keys``
arguments name those columns.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .segments import grouped_median, laid_out, placed, with_neighbour

KEYS = ["epoch_id", "channel"]
# Abbreviations of channel types and their full names.
CHANNEL_TYPES = {
    "ai": "analog_in", "ao": "analog_out", "di": "digital_in", "do": "digital_out", "ax": "auxiliary_in", "aux": "auxiliary_in",
    "t": "time", "e": "event", "mk": "marker", "tx": "text",
}
# Storage type and bits of each kind of channel.
STORAGE = {
    "analog_in": ("float64", 64), "analog_out": ("float64", 64), "auxiliary_in": ("float64", 64), "time": ("float64", 64), "digital_in": ("uint8", 8),
    "digital_out": ("uint8", 8), "event": ("float64", 64), "marker": ("float64", 64), "text": ("float64", 64), "eventmarktext": ("float64", 64),
}


def sample_time(sample: Column, rate: Column, t0: Column | None = None) -> Column:
    """Time of a 0-based sample; minus infinity is the beginning."""
    start = F.lit(0.0) if t0 is None else t0
    return F.when(sample == F.lit(float("-inf")), start).when(rate > 0, start + sample / rate)


def time_sample(t: Column, rate: Column, t0: Column | None = None, t1: Column | None = None) -> Column:
    """The sample nearest to a time (half to even); minus infinity is sample 0, plus infinity the epoch's last time."""
    start = F.lit(0.0) if t0 is None else t0
    at = F.when(t == F.lit(float("-inf")), F.lit(0.0))
    if t1 is not None:
        at = at.when(t == F.lit(float("inf")), F.rint((t1 - start) * rate))
    return at.when(rate > 0, F.rint((t - start) * rate)).cast("long")


def channel_facts(wanted: DataFrame, inventory: DataFrame, keys: list[str] = ["epoch_id"]) -> DataFrame:
    """``wanted`` (``keys, type, number``) with the ``rate, offset, scale`` of its channels, by type in any spelling and number.

    ``inventory`` has a row for each channel of an epoch. A channel that is not there is an error when the plan runs, which
    names those of the epoch.
    """
    known = inventory.select(*keys, standard_type(F.col("type")).alias("__type"), "number", "rate", "offset", "scale", F.concat("type", F.col("number").cast("string")).alias("__name"))
    names = known.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("__name")), ", ").alias("__names"))
    met = wanted.withColumn("__type", standard_type(F.col("type"))).join(known.drop("__name").withColumn("__there", F.lit(True)), [*keys, "__type", "number"], "left").join(names, keys, "left")
    said = F.concat(F.lit("no channel "), "type", F.col("number").cast("string"), F.lit("; there are: "), F.coalesce("__names", F.lit("none")))
    checked = F.when(F.col("__there"), F.col("type")).otherwise(F.raise_error(said).cast("string"))
    return met.withColumn("type", checked).select(*wanted.columns, "rate", "offset", "scale")


def probe_samples(times: DataFrame, inventory: DataFrame, keys: list[str] = ["epoch_id"], t: str = "t") -> DataFrame:
    """Each time of a channel as ``sample``: the nearest one (half to even) at the channel's own rate in that epoch, counted from
    time 0 whenever the epoch begins; NaN where the rate is not above 0."""
    met = channel_facts(times, inventory, keys)
    sample = F.when(F.col("rate") > 0, F.rint(F.col(t) * F.col("rate"))).otherwise(F.lit(float("nan")))
    return met.select(*times.columns, sample.alias("sample"))


def probe_times(samples: DataFrame, inventory: DataFrame, keys: list[str] = ["epoch_id"], sample: str = "sample") -> DataFrame:
    """The reverse of :func:`probe_samples`: ``t``, NaN where the rate is not above 0."""
    met = channel_facts(samples, inventory, keys)
    t = F.when(F.col("rate") > 0, F.col(sample) / F.col("rate")).otherwise(F.lit(float("nan")))
    return met.select(*samples.columns, t.alias("t"))


def read_samples(samples: DataFrame, first: int, last: int, channels: list | None = None, segment: int | None = None) -> DataFrame:
    """Samples ``first`` to ``last``, both included; ``segment``, the samples in a stored segment, prunes partitions."""
    out = samples.where(F.col("sample_idx").between(first, last))
    if segment is not None:
        out = out.where(F.col("segment").between(first // segment + 1, last // segment + 1))
    return out if channels is None else out.where(F.col("channel").isin(channels))


def wide_samples(samples: DataFrame, channels: list) -> DataFrame:
    """One row a sample, one column a channel."""
    return samples.groupBy("epoch_id", "sample_idx").pivot("channel", channels).agg(F.first("value"))


def scaled(value: Column, offset: Column, scale: Column) -> Column:
    """``(value - offset) * scale``."""
    return (value - offset) * scale


def in_range(events: DataFrame, t0: float, t1: float, t: str = "t") -> DataFrame:
    """Events in the closed interval."""
    return events.where(F.col(t).between(t0, t1))


def with_previous(samples: DataFrame, keys: list[str] = KEYS, order: str = "sample_idx", value: str = "value") -> DataFrame:
    """Samples with the value and place of the one before; windows run within segments (see :mod:`.segments`)."""
    return with_neighbour(samples, keys, order, value).withColumnRenamed("__near", "__prev")


def digital_edges(samples: DataFrame, rising: bool = True, at: str = "after", keys: list[str] = KEYS) -> DataFrame:
    """Samples where a 0/1 channel changes, with ``event`` 1; ``at`` ``before`` gives the sample before the change."""
    before, after = (0, 1) if rising else (1, 0)
    hit = with_previous(samples, keys).where((F.col("__prev") == before) & (F.col("value") == after))
    when = F.col("__at") if at == "before" else F.col("sample_idx")
    return hit.select(*keys, when.alias("sample_idx"), F.lit(1).alias("event"))


def digital_pulses(samples: DataFrame, positive: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Beginnings (1) and ends (-1) of pulses of a 0/1 channel."""
    sign = 1 if positive else -1
    event = F.when((F.col("__prev") == 0) & (F.col("value") == 1), sign).when((F.col("__prev") == 1) & (F.col("value") == 0), -sign)
    return with_previous(samples, keys).withColumn("event", event).where("event is not null").select(*keys, "sample_idx", "event")


def crossings(samples: DataFrame, threshold: float, direction: str = "up", keys: list[str] = KEYS) -> DataFrame:
    """Threshold crossings at the later sample: 1 upwards, -1 downwards; ``direction`` is up, down or both."""
    up = (F.col("__prev") < threshold) & (F.col("value") >= threshold)
    down = (F.col("__prev") >= threshold) & (F.col("value") < threshold)
    event = F.when(up, 1).when(down, -1)
    out = with_previous(samples, keys).withColumn("event", event).where("event is not null").select(*keys, "sample_idx", "event")
    return out if direction == "both" else out.where(F.col("event") == (1 if direction == "up" else -1))


def analog_pulses(samples: DataFrame, threshold: float, positive: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Beginnings (1) and ends (-1) of excursions above (``positive``) or below the threshold."""
    both = crossings(samples, threshold, "both", keys)
    return both if positive else both.withColumn("event", -F.col("event"))


def pair_by_place(on: DataFrame, off: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    """The k-th beginning beside the k-th end of each key: ``place, t_on, t_off``; unmatched ones are null."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("t"))
    a = on.select(*keys, F.col("t").alias("t_on"), place.alias("place"))
    b = off.select(*keys, F.col("t").alias("t_off"), place.alias("place"))
    return a.join(b, [*keys, "place"], how)


def decode_markers(events: DataFrame, keys: list[str]) -> DataFrame:
    """Stimuli of a marker channel (``t, marker, value``): marker 1 switches on (above 0) and off (-1), marker 2 names
    the stimulus, marker 3 opens and closes; closings are the ends where marker 1 has none."""
    one = events.where("marker = 1")
    spans = pair_by_place(one.where("value > 0"), one.where("value = -1"), keys)
    place = F.row_number().over(W.partitionBy(*keys).orderBy("t"))
    ids = events.where("marker = 2").select(*keys, F.col("value").alias("stimulus"), place.alias("place"))
    three = events.where("marker = 3")
    opened = pair_by_place(three.where("value > 0"), three.where("value = -1"), keys).withColumnsRenamed({"t_on": "t_open", "t_off": "t_close"})
    out = spans.join(ids, [*keys, "place"], "full").join(opened, [*keys, "place"], "full")
    return out.withColumn("t_off", F.coalesce("t_off", "t_close"))


def by_channel_order(events: DataFrame, keys: list[str]) -> DataFrame:
    """Stimuli where each channel is one: its rank is the stimulus, its events above 0 begin, those below end."""
    ranked = events.withColumn("stimulus", F.dense_rank().over(W.partitionBy(*keys).orderBy("channel")))
    on = ranked.where("value > 0").select(*keys, "stimulus", "t")
    off = ranked.where("value < 0").select(*keys, "t")
    place = F.row_number().over(W.partitionBy(*keys).orderBy("t"))
    stim = on.select(*keys, "stimulus", place.alias("place"))
    return pair_by_place(on.select(*keys, "t"), off, keys).join(stim, [*keys, "place"], "left")


def intervals(events: DataFrame, keys: list[str], order: list[str], t: str = "t", counted: bool = False) -> DataFrame:
    """Each event's distance from the one before it, null for the first; ``counted`` says that ``order`` is one column that
    counts, so that windows run within segments."""
    if counted:
        near = with_neighbour(events, keys, order[0], t)
        return near.withColumn("interval", F.col(t) - F.col("__near")).drop("__near", "__at")
    return events.withColumn("interval", F.col(t) - F.lag(t).over(W.partitionBy(*keys).orderBy(*order)))


def decimate(samples: DataFrame, step: int, keys: list[str] = KEYS, order: str = "sample_idx", gapless: bool = False) -> DataFrame:
    """Every ``step``-th sample from the first; ``gapless`` says that ``order`` counts 0, 1, 2 and so on, which saves the
    shuffle."""
    if gapless:
        return samples.where(F.col(order) % step == 0)
    return placed(samples, keys, order).where(F.col("__n") % step == 0).drop("__n")


def standard_type(kind: Column) -> Column:
    """A channel type's full name; a name that is unknown stays."""
    table = F.create_map(*[F.lit(x) for pair in CHANNEL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(kind)), kind)


def storage_type(kind: Column) -> Column:
    """``struct<kind, bits>`` in which a channel of a standard type is stored, null for other types."""
    table = F.create_map(*[v for k, (t, n) in STORAGE.items() for v in (F.lit(k), F.struct(F.lit(t).alias("kind"), F.lit(n).alias("bits")))])
    return F.try_element_at(table, standard_type(kind))


def type_prefix(kind: Column) -> Column:
    """The usual abbreviation of a channel type; one without stays as it is."""
    short = {full: k for k, full in CHANNEL_TYPES.items() if k not in ("aux", "tx")}
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    return F.coalesce(F.try_element_at(table, standard_type(kind)), kind)


def read_events(kind: str, samples: DataFrame | None = None, native: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """``keys, sample_idx, event`` of an event channel, by its type: derived from a digital or analog channel's samples,
    or as recorded. An analog type carries its threshold, as in ``aep_t2.5``; without one it is 0."""
    base, _, number = kind.partition("_t")
    threshold = float(number or 0)
    derived = {
        "dep": lambda: digital_edges(samples, True, keys=keys), "den": lambda: digital_edges(samples, False, keys=keys),
        "dimp": lambda: digital_pulses(samples, True, keys), "dimn": lambda: digital_pulses(samples, False, keys),
        "aep": lambda: crossings(samples, threshold, "up", keys), "aen": lambda: crossings(samples, threshold, "down", keys).withColumn("event", F.lit(1)),
        "aimp": lambda: analog_pulses(samples, threshold, True, keys), "aimn": lambda: analog_pulses(samples, threshold, False, keys),
    }
    if base in derived:
        return derived[base]()
    if native is None:
        raise ValueError(f"no recorded events for {kind}")
    return native.select(*keys, "sample_idx", "event")


def event_threshold(kind: Column) -> Column:
    """The number after ``_t`` in a channel type such as ``aep_t2.5``, or null."""
    return F.regexp_extract(kind, r"_t(-?[0-9.]+)$", 1).try_cast("double")


def is_analog_event(kind: Column) -> Column:
    return F.regexp_replace(kind, r"_t-?[0-9.]+$", "").isin("aep", "aen", "aimp", "aimn")


def channel_groups(channels: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Place of each channel within its group, and of its group by first use, both from 0."""
    inside = F.row_number().over(W.partitionBy(*keys, "grp").orderBy(order)) - 1
    first = F.min(order).over(W.partitionBy(*keys, "grp"))
    out = channels.withColumn("in_group", inside).withColumn("__first", first)
    return out.withColumn("group_place", F.dense_rank().over(W.partitionBy(*keys).orderBy("__first", "grp")) - 1).drop("__first")


# --- Numeric filters: blocks of one epoch's channel, in Arrow batches ---

#: Samples of a block, without the overlap on either side.
BLOCK = 1 << 14


def chebyshev(order: int, ripple_db: float, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Chebyshev I low-pass filter; ``cutoff`` is relative to half the rate."""
    eps = math.sqrt(10 ** (ripple_db / 10) - 1)
    mu = math.asinh(1 / eps) / order
    poles = -np.sinh(mu + 1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    gain = np.prod(-poles).real / (math.sqrt(1 + eps * eps) if order % 2 == 0 else 1.0)
    warped = 4 * math.tan(math.pi * cutoff / 2)
    poles, gain = poles * warped, gain * warped**order
    gain *= np.real(1 / np.prod(4 - poles))
    b = gain * np.poly(-np.ones(order))
    return b.real, np.poly((4 + poles) / (4 - poles)).real


@lru_cache(maxsize=64)
def _impulse(b: tuple, a: tuple) -> np.ndarray:
    """The filter's answer to a single 1, until it has died away."""
    radius = float(np.abs(np.roots(a)).max(initial=0.0))
    n = len(b) + (math.ceil(math.log(1e-13) / math.log(radius)) if 0 < radius < 1 else 0)
    out = np.zeros(n)
    for i in range(n):
        past = sum(a[k] * out[i - k] for k in range(1, min(i, len(a) - 1) + 1))
        out[i] = (b[i] if i < len(b) else 0.0) - past
    return out


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter over ``x``, as if its first value had stood for ever before it."""
    h = _impulse(tuple(b), tuple(a))
    before = len(h) - 1
    return np.convolve(np.concatenate([np.full(before, x[0]), x]), h)[before : before + len(x)]


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter run forwards and backwards over an odd extension of the signal, starting from rest."""
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    if pad < 1:
        return x.copy()
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _filter(b, a, _filter(b, a, ext)[::-1])[::-1]
    return y[pad : len(y) - pad]


def downsample(samples: DataFrame, limit: float, keys: list[str], t: str = "t", value: str = "value", resample: bool = False) -> DataFrame:
    """``keys, t, value``: low-pass filtered without phase shift and decimated (or interpolated on an even grid).

    A channel's rate is the reciprocal of the median distance of its samples, so a pause does not change it; the filter runs
    over the samples in order, across pauses. A channel whose rate is at most twice ``limit``, one with a median of 0, and one
    with a single sample stay as they are. Every ``int(rate / (2 * limit))``-th sample is kept; a quotient that lies within
    a millionth below a whole number counts as that number, as times are rounded. Rows without a time or a value are left
    out; null keys are a channel. A channel is filtered in blocks of ``BLOCK`` samples that overlap by what the filter takes
    to settle, so no channel gathers in one task, and blocks agree with the whole to rounding.
    """
    if limit <= 0:
        raise ValueError("the limit must be above 0")
    rows = samples.select(*keys, F.col(t).cast("double").alias("__t"), F.col(value).cast("double").alias("__v")).where("__t is not null and __v is not null")
    laid = laid_out(rows, keys, "__t", "__v")
    middle = grouped_median(laid, "__k", "__dt")
    ends = laid.groupBy("__k").agg(F.min("__t").alias("__first"), F.count("*").alias("__n"))
    rate = F.when(F.col("median") > 0, 1 / F.col("median"))
    rates = ends.join(middle, "__k", "left").select("__k", "__first", "__n", F.when(rate > 2 * limit, rate).alias("__rate"))
    rated = laid.join(rates, "__k")
    plain = rated.where("__rate is null").select("__k.*", F.col("__t").alias(t), F.col("__v").alias(value))
    # The filter settles within a number of samples that grows with the rate over the limit; 400 of these are ample.
    reach = (F.lit(400) * F.ceil(F.col("__rate") / (2 * limit))).cast("long")
    size = F.greatest(F.lit(BLOCK).cast("long"), 4 * reach)
    last = F.floor((F.col("__n") - 1) / size)
    lo, hi = F.floor((F.col("__index") - reach) / size), F.floor((F.col("__index") + reach) / size)
    spread = F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, last))
    fast = rated.where("__rate is not null").withColumn("__size", size).withColumn("__block", F.explode(spread))
    schema = StructType([*[samples.schema[k] for k in keys], StructField(t, DoubleType()), StructField(value, DoubleType())])
    flat = fast.select(*[F.col(f"__k.{k}").alias(f"__k{i}") for i, k in enumerate(keys)], "__t", "__v", "__index", "__first", "__n", "__rate", "__size", "__block")

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("__index")
        x, y, i = (part.column(c).to_numpy() for c in ("__t", "__v", "__index"))
        head = part.slice(0, 1).to_pylist()[0]
        begin = head["__block"] * head["__size"]
        end = begin + head["__size"]
        y = zero_phase(*chebyshev(4, 0.8, 2 * limit / head["__rate"]), y)
        if resample:
            # Grid points from this block's first time on, up to the next block's; the last block has those up to the end.
            step, first = 1 / (2 * limit), head["__first"]
            a = x[np.searchsorted(i, begin)]
            b = x[-1] + 1e-12 if end >= head["__n"] else x[np.searchsorted(i, end)]
            k = np.arange(math.ceil((a - first) / step) - 1, math.ceil((b - first) / step) + 2)
            grid = first + k * step
            grid = grid[(k >= 0) & (grid >= a) & (grid < b)]
            x, y = grid, np.interp(grid, x, y)
        else:
            step = max(1, int(head["__rate"] / (2 * limit) * (1 + 1e-6)))
            mine = (i >= begin) & (i < end) & (i % step == 0)
            x, y = x[mine], y[mine]
        named = {k: part.column(f"__k{n}").take(pa.array(np.zeros(len(x), np.int64))) for n, k in enumerate(keys)}
        return pa.table({**named, t: pa.array(x), value: pa.array(y)}).combine_chunks()

    return plain.unionByName(flat.groupBy(*[f"__k{i}" for i in range(len(keys))], "__block").applyInArrow(run, schema))


def interpolate_to(samples: DataFrame, factor: int, keys: list[str], order: str = "sample_idx", value: str = "value") -> DataFrame:
    """A channel of a lower rate on the main channel's samples: ``factor`` times as many, linear between its own."""
    near = with_neighbour(samples, keys, order, value, ahead=True).withColumn("__next", F.coalesce("__near", value))
    each = near.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    made = F.col(value) + (F.col("__next") - F.col(value)) * F.col("__j") / factor
    return each.select(*keys, (F.col(order) * factor + F.col("__j")).alias(order), made.alias(value))


def as_of(events: DataFrame, marks: DataFrame, keys: list[str], t: str = "t", carry: str = "mark") -> DataFrame:
    """Each event with the last mark at or before it: a union and one window, no join of inequalities."""
    a = events.select(*keys, F.col(t), F.struct(*events.columns).alias("__e"), F.lit(None).cast(marks.schema[carry].dataType).alias(carry), F.lit(1).alias("__side"))
    b = marks.select(*keys, F.col(t), F.lit(None).cast(a.schema["__e"].dataType).alias("__e"), carry, F.lit(0).alias("__side"))
    over = W.partitionBy(*keys).orderBy(t, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(carry, F.last(carry, ignorenulls=True).over(over))
    return both.where("__side = 1").select("__e.*", carry)


#: The level of windows without an end: one bucket for all times.
ENDLESS = 2000


def in_windows(events: DataFrame, windows: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Events inside windows ``t_on <= t < t_off``; ends may be infinite, and a window that is not before its end holds none.

    A window belongs to a level whose buckets are a power of two wide, once to four times its length, so it lies in two of
    them at most; an event is in one bucket of each level that some window has. Both sides meet by level and
    bucket, so long and short windows may stand in one table.
    """
    length = F.col("t_off") - F.col("t_on")
    endless = F.abs(length) == float("inf")
    spans = windows.where(F.col("t_on") < F.col("t_off")).withColumn("__level", F.when(endless, ENDLESS).otherwise(F.ceil(F.log2(length)) + 1).cast("int"))
    levels = [r[0] for r in spans.select("__level").distinct().collect()]  # as many as there are powers of two between the lengths

    def bucket(c: str) -> Column:
        return F.when(F.col("__level") == ENDLESS, 0).otherwise(F.floor(F.col(c) / F.pow(F.lit(2.0), "__level"))).cast("long")

    spread = spans.withColumn("__b", F.explode(F.array_distinct(F.array(bucket("t_on"), bucket("t_off")))))
    each = events.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>"))).withColumn("__b", bucket(t))
    met = each.join(spread, [*keys, "__level", "__b"])
    return met.where((F.col(t) >= F.col("t_on")) & (F.col(t) < F.col("t_off"))).drop("__b", "__level")
