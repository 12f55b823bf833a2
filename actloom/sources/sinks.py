"""Writers for records, contexts, reports and snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import files


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_contexts(segments: DataFrame, path: str) -> None:
    """One folder of JSON lines a forum."""
    segments.withColumnRenamed("ctx", "forum_id").write.mode("overwrite").partitionBy("forum_id").json(path)


def write_vectors(df: DataFrame, path: str, key: str | None = None) -> int:
    """Vectors as Parquet. With ``key`` a run goes on where the last one ended: only rows whose key is not there yet are
    added. Gives the number of rows that are there afterwards."""
    spark = df.sparkSession
    fs, target = files(spark, path)
    if key is None or not fs.exists(target):
        df.write.mode("overwrite").parquet(path)
    else:
        df.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def log_events(df: DataFrame, path: str, kind: str) -> None:
    """Rows as events of a run's log: JSON lines with a type and, unless the row has one, a time."""
    stamped = df if "ts" in df.columns else df.withColumn("ts", F.unix_timestamp())
    stamped.withColumn("type", F.lit(kind)).write.mode("append").json(path)


def publish(spark: SparkSession, staged: str, library: str, name: str) -> str:
    """Moves a finished artifact's folder into the library in one step, replacing an older one of that name."""
    fs, source = files(spark, staged)
    goal = files(spark, f"{library}/{name}")[1]
    fs.mkdirs(goal.getParent())
    if fs.exists(goal):
        fs.delete(goal, True)
    if not fs.rename(source, goal):
        raise OSError(f"cannot publish {name}")
    return f"{library}/{name}"


def push_frames(df: DataFrame, event: str) -> DataFrame:
    """Rows as server-sent events: a name, the row as JSON, a blank line."""
    data = F.to_json(F.struct(*df.columns))
    return df.select(F.concat(F.lit(f"event: {event}\ndata: "), data, F.lit("\n\n")).alias("frame"))


def document(row_frame: DataFrame) -> str:
    """A report of one row as indented JSON."""
    rows = row_frame.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    return json.dumps(json.loads(rows[0]), indent=2, sort_keys=True)


def latex_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Table rows a & b \\\\ of any number; a null is a dash."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))


def latex_rows(df: DataFrame, columns: list[str], most: int = 10_000) -> str:
    """A small report as one text of table rows; more than ``most`` rows raise, as for :func:`document`."""
    lines = [r.line for r in latex_lines(df, columns).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"a report has {most} rows at most")
    return "\n".join(lines)


def requirements(df: DataFrame, dependencies: str) -> DataFrame:
    """Distinct dependencies in order."""
    return df.select(F.explode(dependencies).alias("name")).filter("name <> ''").distinct().orderBy("name")


def snapshots(payloads: DataFrame) -> DataFrame:
    """(url, payload) as the table that lookups join."""
    return payloads.select(F.sha2("url", 256).alias("url_sha256"), "url", F.unix_timestamp().alias("fetched_at"), "payload")
