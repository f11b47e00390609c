"""Windows over long recordings without a task that takes a whole recording.

A recording is cut into segments of its order column. Each segment hands its last row to the next one that has rows (or its
first row to the one before), as an extra row that only the window sees; what segments hand on is one row each. Where
rows have no whole-number order, they are laid out by ranges instead, and places and distances are completed from the
ranges' counts and ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written

#: Samples of a segment.
SEGMENT = 1 << 16


def segment_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def carried(rows: DataFrame, keys: list[str], order: str, value: str, width: int | None = None, ahead: bool = False) -> DataFrame:
    """The rows with ``__seg``, and each segment's neighbour row (its ``order`` and ``value`` alone) marked by ``__halo``.

    The neighbour is the last row before the segment, or with ``ahead`` the first one after it. The order column counts.
    """
    seg = segment_of(order, width or SEGMENT)
    pick, end, step = (F.min_by, F.min, F.lag) if ahead else (F.max_by, F.max, F.lead)
    kind = dict(rows.dtypes)
    ends = rows.groupBy(*keys, seg.alias("__seg")).agg(pick(value, order).alias(value), end(order).alias(order))
    over = W.partitionBy(*keys).orderBy("__seg")
    halo = ends.withColumn("__seg", step("__seg").over(over)).where("__seg is not null").withColumn("__halo", F.lit(True))
    halo = halo.withColumn(value, F.col(value).cast(kind[value])).withColumn(order, F.col(order).cast(kind[order]))
    return rows.withColumn("__seg", seg).withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)


def over_segment(keys: list[str], *order: str):
    return W.partitionBy(*keys, "__seg").orderBy(*order)


def with_neighbour(rows: DataFrame, keys: list[str], order: str, value: str, width: int | None = None, ahead: bool = False) -> DataFrame:
    """Rows with the ``value`` and ``order`` of the row before (or with ``ahead`` after) as ``__near`` and ``__at``."""
    step = F.lead if ahead else F.lag
    over = over_segment(keys, order)
    both = carried(rows, keys, order, value, width, ahead)
    out = both.withColumn("__near", step(value).over(over)).withColumn("__at", step(order).over(over))
    return out.where(~F.col("__halo")).drop("__seg", "__halo")


def placed(rows: DataFrame, keys: list[str], order: str, name: str = "__n", width: int | None = None) -> DataFrame:
    """Each row's place within its key, from 0: its place within its segment after the rows of all segments before."""
    seg = segment_of(order, width or SEGMENT)
    counts = rows.groupBy(*keys, seg.alias("__seg")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select(*keys, "__seg", before.alias("__before"), F.lit(True).alias("__halo"))
    both = rows.withColumn("__seg", seg).withColumn("__halo", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy(*keys, "__seg").orderBy(F.desc("__halo"), order)) - 2
    out = both.withColumn(name, place + F.max("__before").over(W.partitionBy(*keys, "__seg")))
    return out.where(~F.col("__halo")).drop("__seg", "__halo", "__before")


def laid_out(rows: DataFrame, keys: list[str], t: str, tie: str) -> DataFrame:
    """``__k`` (the keys as a struct, null ones like any other), ``t``, ``tie``, ``__index`` and ``__dt``.

    ``__index`` is a row's place within its key by ``t`` and ``tie``, from 0, and ``__dt`` its distance from the row before. The
    rows are written in ranges of keys and times, so a long key takes as many tasks as it has ranges.
    """
    own = rows.select(F.struct(*keys).alias("__k"), t, tie)
    spread = own.repartitionByRange("__k", t, tie).sortWithinPartitions("__k", t, tie).withColumn("__id", F.monotonically_increasing_id())
    laid = written(spread).withColumn("__part", F.shiftright("__id", 33))
    spans = laid.groupBy("__k", "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__size"), F.max(t).alias("__last"))
    by_part = W.partitionBy("__k").orderBy("__part")
    before = F.coalesce(F.sum("__size").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("__k", "__part", (before - F.col("__first")).alias("__shift"), F.lag("__last").over(by_part).alias("__carry"))
    inside = F.lag(t).over(W.partitionBy("__k", "__part").orderBy("__id"))
    near = laid.withColumn("__was", inside).join(spans, ["__k", "__part"])
    return near.select("__k", t, tie, (F.col("__id") + F.col("__shift")).alias("__index"), (F.col(t) - F.coalesce("__was", "__carry")).alias("__dt"))


def sums_before(rows: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """The rows with the sum of ``amount`` over all rows before them in a total order; no task takes all rows.

    The rows are written in ranges of the order; a range's own sums follow from it, and one row a range gives what comes before.
    """
    spread = rows.withColumn(name, amount).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    laid = written(spread).withColumn("__part", F.shiftright("__id", 33))
    totals = laid.groupBy("__part").agg(F.sum(name).alias("__sum"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("__part", F.coalesce(F.sum("__sum").over(earlier(W.orderBy("__part"))), F.lit(0)).alias("__of_ranges"))
    inside = F.coalesce(F.sum(name).over(earlier(W.partitionBy("__part").orderBy("__id"))), F.lit(0))
    out = laid.withColumn(name, inside).join(before, "__part").withColumn(name, F.col(name) + F.col("__of_ranges"))
    return out.select(*rows.columns, name)


def grouped_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, median``: the exact median of each key's values that are not null, the mean of the middle two of an even number.

    Values are counted by their nearest single-precision number, and only those of the middle one's are counted exactly, so
    a key with many values is never sorted or held as a whole.
    """
    some = rows.select(key, F.col(value).alias("__v")).where("__v is not null")
    upto = lambda *by: F.sum("__c").over(W.partitionBy(key, *by).orderBy("__x").rowsBetween(W.unboundedPreceding, 0))
    coarse = some.groupBy(key, F.col("__v").cast("float").alias("__x")).agg(F.count("*").alias("__c"))
    total = F.sum("__c").over(W.partitionBy(key))
    ranks = coarse.select(key, "__x", upto().alias("__to"), "__c", F.floor((total - 1) / 2).alias("__lo"), F.floor(total / 2).alias("__hi"))
    holds = lambda rank: (F.col("__to") - F.col("__c") <= F.col(rank)) & (F.col("__to") > F.col(rank))
    middle = ranks.where(holds("__lo") | holds("__hi")).select(key, F.col("__x").alias("__b"), (F.col("__to") - F.col("__c")).alias("__before"), "__lo", "__hi")
    near = some.withColumn("__b", F.col("__v").cast("float")).join(middle, [key, "__b"])
    fine = near.groupBy(key, "__b", "__before", "__lo", "__hi", F.col("__v").alias("__x")).agg(F.count("*").alias("__c"))
    fine = fine.select(key, "__x", "__c", "__lo", "__hi", (F.col("__before") + upto("__b")).alias("__to"))
    half = lambda rank: F.sum(F.when(holds(rank), F.col("__x")))
    return fine.groupBy(key).agg(((half("__lo") + half("__hi")) / 2).alias("median"))
