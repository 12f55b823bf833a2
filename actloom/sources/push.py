"""A streaming sink that pushes rows as server-sent events, each micro-batch once."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


def opened(target: str):
    """(file system, path) of a folder in any store that Arrow reaches; a path without a scheme is local."""
    from pyarrow import fs

    if "://" not in target and not target.startswith("file:"):
        return fs.LocalFileSystem(), target
    return fs.FileSystem.from_uri("file://" + target.removeprefix("file:") if target.startswith("file:/") and not target.startswith("file://") else target)


@dataclass
class Sent(WriterCommitMessage):
    """What a task has sent: the file that holds its frames, and how many."""

    name: str | None
    frames: int


class PushWriter(DataSourceStreamWriter):
    """Tasks write frames to files that nobody reads yet; the driver's commit names an epoch's files in one file.

    A reader takes the files that epochs name. An epoch that is replayed finds its name taken, and its new files go;
    so do those of a failed epoch. A task that is tried again writes a file that no commit names.
    """

    def __init__(self, target: str, event: str):
        self.target, self.event = target, event

    def write(self, iterator):
        store, root = opened(self.target)
        name, n, out = None, 0, None
        for row in iterator:
            if out is None:
                name = f"frames-{uuid.uuid4().hex}.sse"
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
            out.write(f"event: {self.event}\ndata: {row[0]}\n\n".encode())
            n += 1
        if out is not None:
            out.close()
        return Sent(name, n)

    def _drop(self, messages):
        store, root = opened(self.target)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")

    def commit(self, messages, batchId):
        from pyarrow import fs

        store, root = opened(self.target)
        epoch = f"{root}/epoch-{batchId:020d}.json"
        if store.get_file_info(epoch).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        store.create_dir(root, recursive=True)
        part = f"{root}/.epoch-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps({"files": [m.name for m in messages if m is not None and m.name], "frames": sum(m.frames for m in messages if m is not None)}).encode())
        store.move(part, epoch)  # the epoch is there as a whole or not at all

    def abort(self, messages, batchId):
        self._drop(messages)


class PushSource(DataSource):
    """``writeStream.format("push")`` with the options ``path`` and ``event``; rows have one text column, JSON."""

    @classmethod
    def name(cls):
        return "push"

    def streamWriter(self, schema, overwrite):
        return PushWriter(self.options["path"], self.options.get("event", "message"))


def push(stream: DataFrame, path: str, event: str, checkpoint: str):
    """Starts pushing a stream's rows as JSON; gives the query."""
    stream.sparkSession.dataSource.register(PushSource)
    rows = stream.select(F.to_json(F.struct(*stream.columns)).alias("data"))
    return rows.writeStream.format("push").option("path", path).option("event", event).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pushed(spark: SparkSession, path: str) -> DataFrame:
    """(event, data) of every frame that a committed epoch names."""
    listed = spark.read.schema("files array<string>").option("pathGlobFilter", "epoch-*.json").json(path).select(F.explode("files").alias("name"))
    frames = spark.read.option("lineSep", "\n\n").option("pathGlobFilter", "*.sse").text(path).select("value", F.col("_metadata.file_name").alias("name"))
    told = frames.join(listed, "name", "left_semi").filter("value <> ''")
    return told.select(F.regexp_extract("value", r"^event: (.*)", 1).alias("event"), F.regexp_extract("value", r"\ndata: (.*)", 1).alias("data"))
