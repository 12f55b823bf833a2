"""Exact quantiles by rank selection: no buffer of a group's values anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of each group, one column a name of ``probs``; nulls do not count.

    Equal values are counted first, so a frequent one is one row. Counts are range-partitioned by (group, value); the counts of
    a group by partition tell in which of them its ranks lie, and only there values are put in order. A hot
    group thus spreads over as many partitions as its values need. Groups without a value have no row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    # equal values lie in one partition, and partitions in order
    parts = written(counted.repartitionByRange(*group, "__v").withColumn("__part", F.spark_partition_id()), "quantiles")
    by_part = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a group and partition
    held = parts.groupBy(*group, "__part").agg(F.sum("__c").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(by_part), F.lit(0)))
    totals = held.groupBy(*group).agg(F.sum("__n").alias("__all"))
    place = lambda p: (F.col("__all") - 1) * F.lit(p)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probs.values()])))
    asked = totals.select(*group, "__all", F.explode(ranks).alias("__rank"))
    within = asked.alias("q").join(held.alias("h"), [F.col(f"q.{g}").eqNullSafe(F.col(f"h.{g}")) for g in group] + [F.col("__rank") >= F.col("__before"), F.col("__rank") < F.col("__before") + F.col("__n")])
    found = within.select(*[F.col(f"q.{g}").alias(g) for g in group], "__part", "__all", "__rank", (F.col("__rank") - F.col("__before")).alias("__at"))
    wanted = found.groupBy(*group, "__part").agg(F.collect_list(F.struct("__at", "__rank", "__all")).alias("__asked"))  # two ranks a quantile at most
    rows = parts.alias("r").join(wanted.alias("w"), [F.col(f"r.{g}").eqNullSafe(F.col(f"w.{g}")) for g in group] + [F.col("r.__part") == F.col("w.__part")])
    rows = rows.select(*[F.col(f"r.{g}").alias(g) for g in group], F.col("r.__part").alias("__part"), "__v", "__c", "__asked")
    until = F.sum("__c").over(Window.partitionBy(*group, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = rows.withColumn("__to", until).select(*group, "__v", F.explode(F.filter("__asked", lambda a: (a["__at"] < F.col("__to")) & (a["__at"] >= F.col("__to") - F.col("__c")))).alias("a"))
    value_at = lambda rank: F.max(F.when(F.col("a.__rank") == rank, F.col("__v")))
    out = picked.withColumn("__all", F.col("a.__all")).groupBy(*group, "__all")
    low = {name: value_at(F.floor(place(p))) for name, p in probs.items()}
    high = {name: value_at(F.ceil(place(p))) for name, p in probs.items()}
    named = out.agg(*[low[k].alias(f"__low_{k}") for k in probs], *[high[k].alias(f"__high_{k}") for k in probs])
    part = lambda p: place(p) - F.floor(place(p))
    between = lambda k, p: F.when(F.col(f"__low_{k}") == F.col(f"__high_{k}"), F.col(f"__low_{k}")).otherwise((1 - part(p)) * F.col(f"__low_{k}") + part(p) * F.col(f"__high_{k}"))
    return named.select(*group, *[between(k, p).alias(k) for k, p in probs.items()])
