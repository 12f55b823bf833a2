"""Line deduplication: range-partitioned line hashes, streamed in order, giving per-document keep bitmaps.

Lines long enough to count become (128-bit hash, document, positions) rows, one for each document that holds a line.
The rows are range-partitioned on (hash, document) and sorted within partitions by hash and document (largest first),
so a hot line is spread over as many partitions as its rows need. Each partition is streamed: the first document of
a hash is the one that keeps its lines; lines of later documents are dropped once enough documents have
been seen. A hash cut by a partition's edge is left pending, as is one with more than HELD undecided rows; their document
counts (two hashes a partition, and one for HELD rows, at most) are added up and sent back to the pending rows. Dropped positions become one zlib-compressed bitmap
a document. Text never takes part in the sort; it meets its bitmap once.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import Rows, meta_rows
from .common import fresh, load, own_columns, small_batches, table

MIN_CHARS = 40
MIN_DOCS = 5
HELD = 10_000  # rows of an undecided hash that a task holds; rows of one id may be many
NULL_ID = np.iinfo(np.int64).min
_CONTINUATION = bytes(range(0x80, 0xC0))


def _hashes(min_chars: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = ([], [], [], [], [])
            for d, f, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: dict[bytes, list[int]] = {}
                for pos, line in enumerate(text.split(b"\n")):
                    line = line.strip().lower()  # of bytes: the six ASCII blanks, A-Z only
                    if len(line) >= min_chars and len(line.translate(None, _CONTINUATION)) >= min_chars:
                        held.setdefault(hashlib.blake2b(line, digest_size=16).digest(), []).append(pos)
                for h, at in held.items():
                    for column, x in zip(out, (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), d, f, np.array(at, np.int32).tobytes()), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["hi", "lo", "id", "fp", "pos"])

    return run


def _stream(min_docs: int):
    """Sorted rows in. Out: kind 0, a line to drop; kind 1, a row of a hash cut by the partition's first edge,
    or one that the last edge leaves undecided; kind 2, what a decided hash at the last edge held."""

    def run(batches):
        import pyarrow as pa

        key, docs, last, first, cut = None, 0, None, None, True
        held: list[tuple] = []  # rows of under min_docs documents: still undecided
        for batch in batches:
            out: list[tuple] = []
            for hi, lo, d, f, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hi, lo) != key:
                    cut = key is None
                    key, docs, last, first, held = (hi, lo), 0, None, d, []
                new = d != last
                docs, last = docs + new, d
                if cut:
                    out.append((1, hi, lo, d, f, pos, int(new)))
                elif docs < min_docs:
                    held.append((1, hi, lo, d, f, pos, int(new)))
                    if len(held) > HELD:
                        out, held, cut = out + held, [], True
                else:
                    out += [(0, *x[1:]) for x in held if x[3] != first]
                    held = []
                    if d != first:
                        out.append((0, hi, lo, d, f, pos, 0))
            if out:
                yield _rows(pa, out)
        if key is not None and not cut:
            yield _rows(pa, held if docs < min_docs else [(2, *key, first, 0, b"", docs)])

    return run


def _rows(pa, rows):
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    names = ["kind", "hi", "lo", "id", "fp", "pos", "docs"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _bitmaps(batches):
    """Positions to a keep bitmap: bit i says whether line i stays; lines past its end stay."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for packed in batch.column(2).to_pylist():
            positions = np.frombuffer(b"".join(packed), np.int32)
            keep = np.ones(int(positions.max()) + 1, bool)
            keep[positions] = False
            out.append(zlib.compress(np.packbits(keep).tobytes() if len(keep) % 8 == 0 else np.packbits(np.r_[keep, np.ones(-len(keep) % 8, bool)]).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "fp", "keep_bits"])


def kept_lines(text: str | bytes | None, bits: bytes | None):
    """(lines before, lines dropped, text left) of one document under its bitmap."""
    blank = "" if text is None or isinstance(text, str) else b""
    lines = (text or blank).split("\n" if blank == "" else b"\n")
    if bits is None:
        return len(lines), 0, text or blank
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))
    left = [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]
    return len(lines), len(lines) - len(left), ("\n" if blank == "" else b"\n").join(left)


def _keyed(docs: DataFrame, id_col: str, text_col: str):
    """A document is told by its id (null: the smallest) and a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keep bitmaps (id, fp, keep_bits) of the documents that lose lines; all others keep everything."""
    small_batches(docs.sparkSession)
    i, f = _keyed(docs, id_col, text_col)
    src = docs.select(i.alias("id"), f.alias("fp"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))
    lines = table(src.mapInArrow(_hashes(min_chars), "hi long, lo long, id long, fp long, pos binary"), "lines")
    dealt = lines.repartitionByRange("hi", "lo", F.desc("id")).sortWithinPartitions("hi", "lo", F.desc("id"), "fp")
    found = table(dealt.mapInArrow(_stream(min_docs), "kind int, hi long, lo long, id long, fp long, pos binary, docs long"), "drops")
    cut = found.filter("kind > 0").groupBy("hi", "lo").agg(F.sum("docs").alias("n"), F.max("id").alias("top")).filter(f"n >= {min_docs}")
    # hashes cut by an edge, at most two for each partition, and those with more than HELD rows: dealt or broadcast by size
    late = found.filter("kind = 1").join(table(cut, "cut"), ["hi", "lo"]).filter("id < top")
    drops = found.filter("kind = 0").unionByName(late.select(*found.columns))
    # rows of one id and text hold a line at the same places: one of them stands for all, so an array has a cell a line
    drops = drops.groupBy("hi", "lo", "id", "fp").agg(F.min("pos").alias("pos"))
    return drops.groupBy("id", "fp").agg(F.collect_list("pos").alias("pos")).mapInArrow(_bitmaps, "id long, fp long, keep_bits binary")


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The documents with their bitmaps, and that column's name."""
    (i, f), (own, own_fp, bits) = _keyed(docs, id_col, text_col), fresh(docs, "__id", "__fp", "__bits")
    ki, kf = fresh(docs, "__kept_id", "__kept_fp")
    named = bitmaps.select(F.col("id").alias(ki), F.col("fp").alias(kf), F.col("keep_bits").alias(bits))
    keyed = docs.withColumns({own: i, own_fp: f})
    return keyed.join(named, (F.col(own) == F.col(ki)) & (F.col(own_fp) == F.col(kf)), "left").select(*own_columns(docs), bits), bits


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents without the dropped lines, same columns, whatever their names; ``chars_col``, if there, is counted anew.

    Null texts stay null. A very long text is cut like any other; an empty table gives an empty result.
    """

    i, f = _keyed(docs, id_col, text_col)
    rows = Rows(docs, text_col, {"id": i, "fp": f})
    replies = table(meta_rows(rows.batches, "id long, fp long").join(bitmaps, ["id", "fp"]).select("batch_id", "row", "keep_bits"), "bitmaps")

    def change(held, told):
        import pyarrow as pa

        texts = held.column(text_col).to_pylist()
        for row, bits in zip(told.column("row").to_pylist(), told.column("keep_bits").to_pylist(), strict=True):
            texts[row] = None if texts[row] is None else kept_lines(texts[row], bits)[2]
        return held.set_column(held.schema.get_field_index(text_col), text_col, pa.array(texts, held.schema.field(text_col).type)) if told.num_rows else held

    out = rows.mapped(replies, change)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out


def _digest(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [(n, k, hashlib.sha256(t).hexdigest()) for n, k, t in (kept_lines(t, b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256.

    Null and empty texts are one empty line. Documents are told apart by id; rows that repeat an id count as
    one document, and null ids (and the smallest long) count as one document below every other. A line that one document holds
    several times stays or goes with all its repeats. Extra columns are ignored; an empty table gives an
    empty result.
    """
    bitmaps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined, bits = _with_bitmaps(src, bitmaps, "doc_id", "text")
    joined = joined.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), bits)
    return joined.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("doc_id", id_col)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(load(spark, sf_dir, "documents"))


SQL = {
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, pos, line, hot.k IS NOT NULL AND doc_id < top AS gone
  FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
}
