"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long), root being the smallest node it reaches.

    Each round is written to the shared folder, which cuts lineage and survives lost executors; only a
    count and a checksum reach the driver. Rounds go on until nothing changes, which takes about the square of
    log n of them at most. Self-loops and repeated edges are allowed; a node without an edge does not appear.

    A node may have a third of all edges. Its minimum is pre-aggregated before the shuffle and written before it
    is joined: both sides of the join are then dealt for it alone, so that a small side is broadcast by its size and
    the rows of a hot node are split by AQE otherwise.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now, seen = table(pairs, "edges"), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = table(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = table(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for used in (now, low, large, least):
            drop_table(used)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
