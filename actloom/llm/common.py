"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII whitespace bytes (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``; a temporary folder is used only where that
    setting is absent, as in local tests.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = spark.conf.get("spark.actloom.local.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="actloom-")
        spark.conf.set("spark.actloom.local.dir", where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/actloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def dropped_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of a write as it ends, on all nodes; the table written replaces them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with dropped_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`table`, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        if "/actloom-" in parent:
            target = jvm.org.apache.hadoop.fs.Path(parent)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound Arrow batches by bytes, so that whole texts of many rows do not meet in one worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to clash with a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list:
    """The columns of ``df`` by name, whatever the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(col):
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


PIECE = 1 << 20  # bytes of a long text that are worked on at once
_BLANK = re.compile(rb"[ \t\n\v\f\r]")


def word_pieces(body: bytes):
    """The words of a text, as lists of those of about PIECE bytes, so that a long text is never split at once."""
    begin = 0
    while begin < len(body):
        stop = begin + PIECE
        blank = _BLANK.search(body, stop) if stop < len(body) else None
        stop = blank.start() if blank else len(body)
        if words := body[begin:stop].split():
            yield words
        begin = stop


def shingle_hashes(words_of_pieces, shingle: int, seed: int):
    """XXH64 of each run of ``shingle`` words, joined by spaces, as arrays; of all words if there are fewer."""
    import xxhash

    carry, some = [], False
    for words in words_of_pieces:
        words = carry + words
        n = len(words) - shingle + 1
        if n > 0:
            text = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            parts = map(text.__getitem__, map(slice, starts[:n].tolist(), ends[shingle - 1 :].tolist()))
            yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)
            some = True
        carry = words[len(words) - shingle + 1 :] if n > 0 and shingle > 1 else [] if n > 0 else words
    if not some and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], np.uint64)
