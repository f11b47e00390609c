"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_keyed, stage_table


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """``node, root`` of every node that has an edge to another; ``root`` is the component's smallest node.

    Each round hooks every node to the smallest of its neighbours, first from the side of its larger neighbours,
    then from that of its smaller ones; nothing but edges is shuffled, hubs meet their edges by broadcast, and each
    round is written to the shared folder, so no lineage grows. Loops and repeated edges do no harm; an empty table gives no rows.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    now = stage_table(edges.where(F.col(a) != F.col(b)).select(*pair(F.col(a), F.col(b))).distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = tuple(now.select(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = join_keyed(both, least, "u", "n", 2 * mark[0]).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        large = stage_table(large.distinct(), "stars")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = join_keyed(large, low, "hi", "n", large.count()).select(*pair(F.col("lo"), F.col("m")))
        small = small.unionByName(low.select("hi", F.col("m").alias("lo")))
        old, now = now, stage_table(small.where("hi <> lo").distinct(), "edges")
        drop_table(old)
        drop_table(large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def roots_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the given links."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    return label
