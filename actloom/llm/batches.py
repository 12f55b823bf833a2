"""Whole documents in compressed batches that lie bucketed in the shared folder, and what a batch is asked and told.

Operators whose rounds need the texts again read these batches in place: replies, which are narrow rows dealt by
batch, meet them without a shuffle of texts.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped_shuffles, new_path, own_columns, small_batches

BATCH_BYTES = 8 << 20
MOST_ROWS = 50_000
COLUMNS = ("batch_id", "meta", "lens", "body")
_SCHEMA = "batch_id long, meta binary, lens binary, body binary"


def bucket_of(x: int, n: int) -> int:
    """The bucket that Spark gives to a long: Murmur3 with seed 42, modulo n."""
    m = 0xFFFFFFFF
    rol = lambda v, r: ((v << r) | (v >> (32 - r))) & m
    h = 42
    for k in (x & m, (x >> 32) & m):
        k = rol(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rol(h ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 8
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % n


def _pack(n: int, batch_bytes: int):
    """A task's batches all lie in one bucket of ``n``."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        number = task << 36
        squeeze = zstandard.ZstdCompressor(level=3)
        metas, texts, held = [], [], 0

        def out():
            nonlocal number
            number += 1
            while bucket_of(number, n) != task % n:
                number += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, metas[0].schema) as to:
                for m in metas:
                    to.write_batch(m)
            lens = np.array([len(t) for t in texts], np.int64)
            cells = [sink.getvalue().to_pybytes(), lens.tobytes(), squeeze.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c], pa.binary()) for c in cells)], names=list(COLUMNS))

        for batch in batches:
            meta = batch.select([x for x in batch.schema.names if x != "body"])
            begin = 0
            for i, t in enumerate(batch.column("body").to_pylist()):
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= batch_bytes or len(texts) >= MOST_ROWS:
                    metas.append(meta.slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield out()
                    metas, texts, held = [], [], 0
            if begin < batch.num_rows:
                metas.append(meta.slice(begin))
        if texts:
            yield out()

    return run


def pack_batches(src: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``src`` (any columns, and body: binary) in batches of about ``batch_bytes``; a longer text is a batch alone.

    Batch numbers are chosen so that a task writes to one bucket, for which the texts are not shuffled. The table's
    name is dropped from the catalogue at once, its files when the application ends.
    """
    spark = src.sparkSession
    n = max(1, min(src.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name, path = f"actloom_{uuid.uuid4().hex}", new_path(spark, "batches")
    with dropped_shuffles(spark):
        src.mapInArrow(_pack(n, batch_bytes), _SCHEMA).write.bucketBy(n, "batch_id").option("path", path).option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out.select(*COLUMNS)


def read_meta(cell: bytes):
    """The rows of a batch without their texts."""
    import pyarrow as pa

    return pa.ipc.open_stream(pa.py_buffer(cell)).read_all().combine_chunks()


def open_texts(lens: bytes, body: bytes):
    """(end of each text, all bytes) of a batch."""
    import zstandard

    return np.cumsum(np.frombuffer(lens, np.int64)), np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)


def _opened(batches, i: int):
    """(batch_id, meta, ends, buf) of a batch, whose cells are read in place."""
    meta, lens, body = (batches.column(c)[i].as_buffer() for c in COLUMNS[1:])
    return batches.column(COLUMNS[0])[i].as_py(), read_meta(meta), *open_texts(lens, body)


def release() -> None:
    """Gives what Arrow keeps of freed memory back to the system: workers stay between the stages of all that runs."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def each_batch(step):
    """mapInArrow function from ``step(batch_id, meta, ends, buf)``, which gives an Arrow table."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from step(*_opened(batch, i)).to_batches(max_chunksize=100_000)
                release()

    return run


def meta_rows(texts: DataFrame, schema: str) -> DataFrame:
    """(batch_id, row, and the columns of ``schema``) of every row; texts are not read."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for batch_id, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                meta = read_meta(cell)
                n = meta.num_rows
                made = pa.table({"batch_id": pa.array(np.full(n, batch_id, np.int64)), "row": pa.array(np.arange(n, dtype=np.int32))} | {c: meta.column(c) for c in names})
                yield from made.to_batches(max_chunksize=100_000)

    return texts.select("batch_id", "meta").mapInArrow(run, f"batch_id long, row int, {schema}")


def with_replies(texts: DataFrame, replies: DataFrame, step, schema: str) -> DataFrame:
    """``step(batch_id, meta, ends, buf, replies)`` over each batch and the rows of ``replies`` for it, maybe none."""

    def run(left, right):
        release()  # what the batch before has left
        return step(*_opened(left, 0), right)

    return texts.groupBy("batch_id").cogroup(replies.groupBy("batch_id")).applyInArrow(run, schema)


def bodies_of(ends: np.ndarray, buf: np.ndarray, rows) -> list[bytes]:
    """The texts of some rows of a batch."""
    return [buf[ends[r - 1] if r else 0 : ends[r]].tobytes() for r in rows]


def fetched(texts: DataFrame, asked: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` of the asked rows: the batches' own, ``body``, and those of ``asked`` (batch_id, row, ...).

    Only what is asked for leaves its batch, whatever the number of rows asked for; other texts are not even unpacked.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
            return pa.table({n: pa.array([], kinds[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)})
        _, meta, lens, body = (left.column(c)[0].as_py() for c in COLUMNS)
        rows = right.column("row").to_pylist()
        held = read_meta(meta).take(pa.array(rows, pa.int32()))
        found = {"body": pa.array(bodies_of(*open_texts(lens, body), rows), pa.binary())}
        return pa.table({n: found[n] if n in found else held.column(n) if n in held.schema.names else right.column(n) for n in names})

    return texts.groupBy("batch_id").cogroup(asked.groupBy("batch_id")).applyInArrow(run, schema)


def in_slices(rows, size: int = 1 << 20):
    """The same Arrow table in chunks of about ``size`` bytes, each of which is sent and held by the JVM apart; a longer row is a chunk alone."""
    import pyarrow as pa

    n = max(1, rows.num_rows * size // max(1, rows.nbytes))
    return pa.concat_tables([rows.slice(i, n) for i in range(0, max(1, rows.num_rows), n)])


class Rows:
    """Rows of any columns in batches, their text apart from the rest.

    ``batches`` have, beside ``more``, the columns of ``docs`` under names of their own (c0, c1, ...), so that no name
    of the caller's can clash with one in here. Rows come back with their own names and types.
    """

    def __init__(self, docs: DataFrame, text_col: str, more: dict):
        small_batches(docs.sparkSession, "2m")
        self.schema, self.text = docs.schema, docs.columns.index(text_col)
        own = [c.alias(f"c{i}") for i, c in enumerate(own_columns(docs)) if i != self.text]
        text = F.col(text_col).cast("string")
        self.batches = pack_batches(docs.select(*own, text.isNull().alias("no_text"), *[c.alias(n) for n, c in more.items()], text_bytes(text)))

    def mapped(self, replies: DataFrame, change) -> DataFrame:
        """``change(rows, replies)`` of each batch: its rows as an Arrow table of the caller's columns, and the rows of
        ``replies`` (batch_id, row, ...) for it, maybe none. No text is shuffled, whatever the number of replies."""
        names, text = self.schema.names, self.text

        def step(batch_id, meta, ends, buf, told):
            import pyarrow as pa
            import pyarrow.compute as pc

            offsets = np.concatenate([[0], ends])
            kind, width = (pa.LargeStringArray, np.int64) if offsets[-1] >= 1 << 31 else (pa.StringArray, np.int32)
            body = kind.from_buffers(meta.num_rows, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(buf))
            body = pc.if_else(meta.column("no_text"), pa.scalar(None, body.type), body)
            return in_slices(change(pa.Table.from_arrays([body if i == text else meta.column(f"c{i}") for i in range(len(names))], names=names), told))

        return with_replies(self.batches, replies, step, self.schema)

    def without(self, gone: DataFrame) -> DataFrame:
        """All rows but those of ``gone`` (batch_id, row)."""

        def change(rows, told):
            import pyarrow as pa

            keep = np.ones(rows.num_rows, bool)
            keep[told.column("row").to_numpy()] = False
            return rows.filter(pa.array(keep))

        return self.mapped(gone.select("batch_id", "row"), change)


def column(table, name: str, kind=np.int64) -> np.ndarray:
    """A column of longs without nulls as numpy, seen as ``kind``."""
    return table.column(name).to_numpy().astype(np.int64, copy=False).view(kind)


def rows_of(columns: dict):
    """An Arrow table of numpy columns, unsigned ones as longs."""
    import pyarrow as pa

    return pa.table({n: pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for n, c in columns.items()})


def text_bytes(column):
    """A text as UTF-8 bytes, null as none."""
    return F.encode(F.coalesce(column, F.lit("")), "UTF-8").alias("body")
