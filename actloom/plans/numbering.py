"""Numbers over a whole table in order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Adds the place of each row, from 1, in the given order.

    Rows are range-partitioned by the order and written with their partition's number; a row's place is its place
    inside the partition plus the rows of the partitions before it. Rows that tie in the order are placed together in
    one partition, in any order.
    """
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    # a row a partition
    before = counts.select("__part", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__in", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")
