"""Tables and files on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, deleted when the application ends; only a local master may lack it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="actloom-")
    path = f"{where.rstrip('/')}/actloom-{name}-{uuid.uuid4().hex}"
    files(spark, path)[0].deleteOnExit(files(spark, path)[1])
    return path


def files(spark: SparkSession, path: str):
    """(file system, path object) of a path in any store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rename_part(spark: SparkSession, folder: str, to: str) -> None:
    """The single part file of a folder takes the path ``to``."""
    fs, target = files(spark, folder)
    parts = [s.getPath() for s in fs.listStatus(target) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} has {len(parts)} part files")
    goal = files(spark, to)[1]
    fs.mkdirs(goal.getParent())
    if not fs.rename(parts[0], goal):
        raise OSError(f"cannot write {to}")
