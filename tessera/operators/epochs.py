"""Epochs, probes and elements as tables: who recorded what in which epoch, on which channels, and when.

An epoch is a row ``daq, epoch_id, clocks, probe_map``: ``clocks`` is an array of ``struct<clock, t0, t1>``, and
``probe_map`` one of ``struct<name, reference, type, device>`` where ``device`` reads ``daq:ai1-4``. Everything is a
projection, an equi-join or a window within an owner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalars

from .tables import spread_join, top_rows

from .query import Query, search
from .segments import sums_before
from .signals import time_sample

PROBE = ["name", "reference", "type"]


def numbered_epochs(epochs: DataFrame, keys: list[str], order: str = "epoch_id") -> DataFrame:
    """Epochs of each owner in order, with ``epoch_number`` from 1."""
    return epochs.withColumn("epoch_number", F.row_number().over(W.partitionBy(*keys).orderBy(order)))


def daq_epochs(navigator: DataFrame, ingested: DataFrame) -> DataFrame:
    """A recorder's epochs, numbered: those found on disk, where an ingested one of the same id gives the clocks."""
    known = ingested.select("daq", "epoch_id", F.col("clocks").alias("__c"))
    both = navigator.join(known, ["daq", "epoch_id"], "left").withColumn("clocks", F.coalesce("__c", "clocks")).drop("__c")
    return numbered_epochs(both, ["daq"])


def probe_entries(epochs: DataFrame) -> DataFrame:
    """One row for each entry of the probe maps: ``daq, epoch_id, clocks, name, reference, type, device``."""
    return epochs.select("daq", "epoch_id", "clocks", F.explode("probe_map").alias("__p")).select("daq", "epoch_id", "clocks", "__p.*")


def probe_epochs(epochs: DataFrame) -> DataFrame:
    """Each probe's epochs, numbered: those whose map names it on the recorder itself, whatever the case of its name.

    Of several entries of a map for one probe, the first by its device counts.
    """
    mine = probe_entries(epochs).where(F.lower(scalars.device_name(F.col("device"))) == F.lower("daq"))
    return numbered_epochs(top_rows(mine, [*PROBE, "daq", "epoch_id"], ["device"]), PROBE)


def read_type_map(spark: SparkSession, path: str) -> DataFrame:
    """``type, classname`` of a JSON list of objects: which class handles which type of probe."""
    return spark.read.option("multiLine", "true").schema("type string, classname string").json(path).where("type is not null")


def probe_classes(probes: DataFrame, types: DataFrame) -> DataFrame:
    """The probes with the ``classname`` of their type, null for a type that the map does not have; of several entries of a type
    the last by its class name counts."""
    one = types.groupBy("type").agg(F.max("classname").alias("classname"))
    return probes.join(one, "type", "left").select(*probes.columns, "classname")


def entry_matches(entry: Column, name: str | None = None, reference: int | None = None, kind: str | None = None) -> Column:
    """Whether a probe-map entry has the given name, reference and type; what is not given matches anything."""
    wanted = {"name": name, "reference": reference, "type": kind}
    return reduce(lambda a, b: a & b, [entry[k] == v for k, v in wanted.items() if v is not None], F.lit(True))


def probes_of(epochs: DataFrame, stored: DataFrame | None = None, **wanted) -> DataFrame:
    """``name, reference, type, stored`` of all probes that maps or stored elements name, each once; ``wanted`` filters."""
    found = probe_entries(epochs).select(*PROBE, F.lit(False).alias("stored"))
    if stored is not None:
        found = found.unionByName(stored.select(*PROBE, F.lit(True).alias("stored")))
    out = found.groupBy(*PROBE).agg(F.max("stored").alias("stored"))
    return out.where(matches_given(wanted))


def matches_given(wanted: dict) -> Column:
    """Equality on every column with a value; ``None`` matches anything."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items() if v is not None], F.lit(True))


def elements_of(documents: DataFrame, **fields) -> DataFrame:
    """Element documents whose section has all the given values."""
    q = Query().isa("element")
    for name, value in fields.items():
        q = q & (Query(f"element.{name}") == value)
    return search(documents, q)


def named_like(documents: DataFrame, isa: str, pattern: str, session: str | None = None) -> DataFrame:
    """Documents of a class whose name fits a pattern, in a session if one is given."""
    return search(documents, Query().isa(isa) & Query("base.name").match(pattern), session)


def objects_named(parts: dict[str, DataFrame], name: str, kind: str | None = None) -> DataFrame:
    """``kind, id, name`` of whatever has a name, over several tables of objects."""
    rows = [df.select(F.lit(k).alias("kind"), "id", "name") for k, df in parts.items() if kind in (None, k)]
    return reduce(DataFrame.unionByName, rows).where(F.col("name") == name)


def matched_epochs(epochs: DataFrame, number: int | None = None, epoch_id: str | None = None) -> DataFrame:
    """Epochs with a number, an id, both, or all of them."""
    return epochs.where(matches_given({"epoch_number": number, "epoch_id": epoch_id}))


def epoch_range(epochs: DataFrame, keys: list[str], first: int | str, last: int | str) -> DataFrame:
    """Epochs ``first`` to ``last`` of each owner, both included, by number or by id; a range that runs backwards is an
    error when the plan runs, and an owner that lacks either end has no rows."""
    own = W.partitionBy(*keys)
    at = lambda end: F.lit(end) if isinstance(end, int) else F.max(F.when(F.col("epoch_id") == end, F.col("epoch_number"))).over(own)
    ends = epochs.withColumn("__a", at(first)).withColumn("__b", at(last))
    good = F.when(F.col("__a") > F.col("__b"), F.raise_error(F.lit("the range of epochs runs backwards")).cast("boolean"))
    return ends.where(F.coalesce(good, F.col("epoch_number").between(F.col("__a"), F.col("__b")))).drop("__a", "__b")


def has_clock(clocks: Column, clock: str) -> Column:
    return F.coalesce(F.exists(clocks, lambda c: c["clock"] == clock), F.lit(False))


def clock_range(clocks: Column, clock: str) -> Column:
    """``struct<t0, t1>`` of a clock, null if the epoch has no such clock."""
    hit = F.get(F.filter(clocks, lambda c: c["clock"] == clock), 0)
    return F.when(hit.isNotNull(), F.struct(hit["t0"].alias("t0"), hit["t1"].alias("t1")))


def clock_bounds(clocks: Column) -> Column:
    """All clocks' bounds as rows ``[t0, t1]``; no clocks: no rows."""
    return F.transform(F.coalesce(clocks, F.array().cast("array<struct<clock:string,t0:double,t1:double>>")), lambda c: F.array(c["t0"], c["t1"]))


def epoch_record(epochs: DataFrame) -> DataFrame:
    """``epoch_id, record``: each epoch as one JSON text; :func:`epoch_of_record` reads it back."""
    return epochs.select("epoch_id", F.to_json(F.struct("daq", "epoch_id", "clocks", "probe_map")).alias("record"))


RECORD = "daq string, epoch_id string, clocks array<struct<clock:string,t0:double,t1:double>>, probe_map array<struct<name:string,reference:int,type:string,device:string>>"


def epoch_of_record(records: DataFrame) -> DataFrame:
    return records.select(F.from_json("record", RECORD).alias("r")).select("r.*")


def channel_devices(entries: DataFrame) -> DataFrame:
    """``entries`` with ``device_name`` and one row for each channel of the device string: ``channel_type, channel``."""
    each = entries.withColumn("device_name", scalars.device_name(F.col("device"))).withColumn("__c", F.explode(scalars.device_channels(F.col("device"))))
    return each.select(*entries.columns, "device_name", F.col("__c.type").alias("channel_type"), F.col("__c.number").alias("channel"))


def channel_inventory(channels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, channel_type, channels``: the distinct channels of each type, in order."""
    return channels.groupBy(*keys, "channel_type").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def channels_of_type(inventory: DataFrame, kind: str) -> DataFrame:
    return inventory.where(F.col("channel_type") == kind)


def elements_of_epochs(requested: DataFrame, element_epochs: DataFrame, name: str | None = None, kind: str | None = None) -> DataFrame:
    """``pos, epoch_id, elements``: for each requested id, in any case, the sorted ids of the elements that have it; none:
    an empty list."""
    those = element_epochs.where(matches_given({"name": name, "type": kind})).select(F.lower("epoch_id").alias("__e"), "element_id")
    met = requested.join(those, F.lower("epoch_id") == F.col("__e"), "left")
    return met.groupBy("pos", "epoch_id").agg(F.array_sort(F.collect_set("element_id")).alias("elements"))


def element_epochs(elements: DataFrame, parents: DataFrame, registered: DataFrame) -> DataFrame:
    """``element_id, epoch_id, epoch_number``: a direct element has its parent's epochs, any other those registered for it.

    Epochs are numbered once for a parent, and its elements take the numbers over. Only elements that are listed more than once
    are numbered from all their epochs.
    """
    listed = elements.select("element_id", "parent_id", "direct", (F.count("*").over(W.partitionBy("element_id")) > 1).alias("__twice"))
    theirs = numbered_epochs(parents.select(F.col("element_id").alias("parent_id"), "epoch_id"), ["parent_id"])
    met = lambda e: spread_join(e.where("direct").select("element_id", "parent_id"), theirs, ["parent_id"]).select("element_id", "epoch_id", "epoch_number")
    own = listed.where("not direct").select("element_id", "__twice").join(registered.select("element_id", "epoch_id"), "element_id")
    mixed = met(listed.where("__twice")).drop("epoch_number").unionByName(own.where("__twice").drop("__twice"))
    once = numbered_epochs(own.where("not __twice").drop("__twice").unionByName(mixed), ["element_id"])
    return met(listed.where("not __twice")).unionByName(once)


def read_by_time(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """The samples of each request ``request, epoch_id, channel, rate, start, t0, t1``, with their times.

    Bounds become sample numbers (``t1`` may be infinite: to the end), so samples are met by epoch and channel and
    kept by number. ``requests`` are few for an epoch; samples are read once.
    """
    first = time_sample(F.col("t0"), F.col("rate"), F.col("start")).alias("__first")
    last = F.when(F.col("t1") == float("inf"), F.lit(2**62)).otherwise(time_sample(F.col("t1"), F.col("rate"), F.col("start"))).alias("__last")
    wanted = requests.select("request", "epoch_id", "channel", "rate", "start", first, last)
    met = samples.join(wanted, ["epoch_id", "channel"]).where(F.col("sample_idx").between(F.col("__first"), F.col("__last")))
    return met.select("request", "epoch_id", "channel", "sample_idx", (F.col("start") + F.col("sample_idx") / F.col("rate")).alias("t"), "value")


def element_series(elements: DataFrame, stored: DataFrame, samples: DataFrame) -> DataFrame:
    """``element_id, epoch_id, sample_idx, t, value``: an element's stored vector, or its parent's samples where it has none.

    ``stored`` has ``element_id, epoch_id, start, rate, values``; ``samples`` are the parents' (``epoch_id, channel,
    sample_idx, t, value``, the channel being the parent). One element's epoch is stored as a whole or not at all.
    """
    own = stored.select("element_id", "epoch_id", "start", "rate", F.posexplode("values").alias("i", "value"))
    own = own.select("element_id", "epoch_id", F.col("i").cast("long").alias("sample_idx"), (F.col("start") + F.col("i") / F.col("rate")).alias("t"), "value")
    theirs = samples.select(F.col("channel").alias("parent_id"), "epoch_id", "sample_idx", "t", "value").join(elements.select("element_id", "parent_id"), "parent_id")
    rest = theirs.join(stored.select("element_id", "epoch_id"), ["element_id", "epoch_id"], "left_anti")
    return own.unionByName(rest.select(*own.columns))


def one_epoch(samples: DataFrame, epochs: DataFrame, keys: list[str], order: str = "epoch_number") -> DataFrame:
    """All epochs of each owner as one: ``t`` and ``sample_idx`` of an epoch follow those of the epochs before it.

    ``epochs`` has ``keys, epoch_id, order, n_samples, duration``; only these few rows meet in a window.
    """
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    offsets = epochs.select(
        *keys, "epoch_id", F.coalesce(F.sum("n_samples").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("duration").over(before), F.lit(0.0)).alias("__t")
    )
    met = samples.join(offsets, [*keys, "epoch_id"])
    return met.select(*keys, (F.col("sample_idx") + F.col("__n")).alias("sample_idx"), (F.col("t") + F.col("__t")).alias("t"), "value")


def spikes_element(spikes: DataFrame, probe_epoch_ids: DataFrame, name: str, reference: int) -> DataFrame:
    """``name, reference, type, n_epochs, n_spikes`` of a spikes element; an epoch that the probe lacks is an error when
    the plan runs."""
    known = probe_epoch_ids.select("epoch_id", F.lit(True).alias("__known")).distinct()
    met = spikes.groupBy("epoch_id").agg(F.count("*").alias("n")).join(known, "epoch_id", "left")
    checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("not an epoch of the probe: "), F.col("epoch_id"))).cast("long")).otherwise(F.col("n"))
    sums = met.agg(F.count("*").alias("n_epochs"), F.coalesce(F.sum(checked), F.lit(0)).alias("n_spikes"))
    return sums.select(F.lit(name).alias("name"), F.lit(reference).alias("reference"), F.lit("spikes").alias("type"), "n_epochs", "n_spikes")


def ingest_epochs(epochs: DataFrame, ingested: DataFrame) -> DataFrame:
    """Rows to append: ``id, daq, epoch_id, clocks`` of every epoch that is not ingested; ids follow from both names."""
    new = epochs.join(ingested.select("daq", "epoch_id"), ["daq", "epoch_id"], "left_anti")
    return new.select(F.md5(F.concat_ws("/", "daq", "epoch_id")).alias("id"), "daq", "epoch_id", "clocks")


def delete_epoch(rows: DataFrame, epoch_id: str) -> DataFrame:
    return rows.where(F.col("epoch_id") != epoch_id)


def ingest_status(epochs: DataFrame, ingested: DataFrame) -> DataFrame:
    """``daq, n_epochs, n_ingested, complete`` of each recorder."""
    met = epochs.select("daq", "epoch_id").distinct().join(ingested.select("daq", "epoch_id", F.lit(1).alias("__i")).distinct(), ["daq", "epoch_id"], "left")
    out = met.groupBy("daq").agg(F.count("*").alias("n_epochs"), F.count("__i").alias("n_ingested"))
    return out.withColumn("complete", F.col("n_epochs") == F.col("n_ingested"))


def ingested_entry(ingested: DataFrame, wanted: DataFrame) -> DataFrame:
    """``daq, epoch_id, clocks`` for each wanted epoch; one that is not ingested has null clocks."""
    return wanted.join(ingested.select("daq", "epoch_id", "clocks"), ["daq", "epoch_id"], "left")


def valid_events(events: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Events inside any valid interval (``t_on <= t < t_off``) of their owner; an owner without intervals is all valid."""
    from .signals import in_windows

    inside = in_windows(events.withColumn("__id", F.monotonically_increasing_id()), intervals, keys)
    bounded = intervals.select(*keys).distinct()
    free = events.join(bounded, keys, "left_anti")
    return inside.dropDuplicates(["__id"]).select(*events.columns).unionByName(free)


def epoch_files(epochs: DataFrame, number: int | None = None, epoch_id: str | None = None) -> DataFrame:
    """``epoch_id, path, ingested`` of the files of matching epochs; an ingested epoch's file is a URI, not a path."""
    each = matched_epochs(epochs, number, epoch_id).select("epoch_id", F.explode("files").alias("path"))
    return each.withColumn("ingested", F.startswith("path", F.lit("epochid://")))


def navigator_epochs(groups: DataFrame, sidecars: DataFrame, folder: str) -> DataFrame:
    """``group, files, epoch_id, folder, epoch_number``: a file group's id is what its sidecar holds, or follows from its files.

    ``groups`` has ``group, files``; ``sidecars`` has ``group, text``. ``folder`` is what generated ids begin with.
    """
    told = sidecars.select("group", F.trim("text").alias("__id"))
    made = F.concat(F.lit(f"{folder}_"), F.md5(F.array_join(F.array_sort("files"), "\n")))
    met = groups.join(told, "group", "left").withColumn("epoch_id", F.coalesce(F.nullif("__id", F.lit("")), made)).drop("__id")
    placed = sums_before(met.withColumn("folder", F.lit(folder)), [F.col("epoch_id").asc()], F.lit(1).cast("long"), "__n")
    return placed.withColumn("epoch_number", (F.col("__n") + 1).cast("int")).drop("__n")
