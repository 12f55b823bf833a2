"""Quality rules: base counts of each text, and cross-document line frequency by host.

Every line is normalised and hashed (128 bits). For each host the documents that hold a line are counted; a line in
more than LINE_DOCS of them is boilerplate and is taken out of all its documents, whatever the host's size. A document
that keeps too few of its words is depleted and rejected. One scan gives the base counts and a row's distinct lines
with their positions; the line counts are pre-aggregated before their shuffle, and what is removed meets its document
by a row number written with the base counts, so texts are not shuffled for the verdicts; cleaned texts meet their
removed lines once.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, fresh, load, own_columns, small_batches, table, word_pieces

LINE_DOCS = 20  # a line may stand in so many documents of a host
KEEP_SHARE = 0.5  # of its words that a document must keep
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_BLANK = b" \t\n\v\f\r"


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more, its first finding included."""
    return _repeated(_hashed(words))


def _hashed(words: list) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _repeated(hashes: np.ndarray) -> int:
    """The same for words' 64-bit hashes. Windows are equal if their mixed hashes are."""
    n = len(hashes)
    if n < 4:
        return 0
    code = hashes[:-2] + hashes[1:-1] * _MIX[0] + hashes[2:] * _MIX[1]
    ordered = np.sort(code)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    del ordered
    found = np.isin(code, twice)
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= found
    return int(covered.sum())


def _line_pieces(body: bytes):
    """The lines of a text, in lists of about PIECE bytes."""
    begin = 0
    while True:
        stop = body.find(b"\n", begin + PIECE)
        if stop < 0:
            yield body[begin:].split(b"\n")
            return
        yield body[begin:stop].split(b"\n")
        begin = stop + 1


def _digests(lines: list) -> bytes:
    return b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in lines])


def _pairs(packed: list[bytes]) -> np.ndarray:
    """Digests of 16 bytes as (hi, lo) records, which numpy puts in order."""
    return np.frombuffer(b"".join(packed), [("hi", ">i8"), ("lo", ">i8")])


def base_counts(body: bytes):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    hashes = [_hashed(words) for words in word_pieces(body)]
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    whole = _pairs([_digests([x for x in lines if x.strip()]) for lines in _line_pieces(body)])
    repeats = len(whole) - len(np.unique(whole)) if len(whole) > 1 else 0
    return len(hashes), len(body.translate(None, _BLANK + _CONTINUATION)), len(body) - len(body.translate(None, SYMBOLS)), repeats, _repeated(hashes)


def text_lines(body: bytes):
    """Distinct normalised lines of a text as columns: hi, lo, words of all their places, and those places, packed.

    Lines are taken in pieces and kept as numbers, so a text of many short lines takes some times its size.
    """
    packed, words, places, at = [], [], [], 0
    for lines in _line_pieces(body):
        split = [x.lower().split() for x in lines]
        some = np.fromiter((len(w) for w in split), np.int64, len(split))
        packed.append(_digests([b" ".join(w) for w in split if w]))
        words.append(some[some > 0])
        places.append((np.flatnonzero(some) + at).astype(np.int32))
        at += len(lines)
    keys, words, places = _pairs(packed), np.concatenate(words), np.concatenate(places)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(words[order], first) if len(first) else np.zeros(0, np.int64)
    return keys["hi"][first].astype(np.int64), keys["lo"][first].astype(np.int64), sums, np.concatenate([first, [len(keys)]]), places[order]


LINES = 20_000  # lines in one row of the scan; a text with more has several rows


def _scan(batches):
    """One row a text with its counts, and its lines in that row and, where they are many, in rows that have lines only."""
    import pyarrow as pa

    for batch in batches:
        held = [batch.column(c).to_pylist() for c in (*_ROW, "body")]
        rows, parts, n = [], [], 0

        def out(rows, parts):
            hi, lo, words, sizes, places = ([p[k] for p in parts] for k in range(5))
            lengths = np.concatenate([np.zeros(1, np.int64), *sizes])
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(lengths) - 1, [None, pa.py_buffer((4 * np.cumsum(lengths)).astype(np.int32).tobytes()), pa.py_buffer(np.concatenate([np.zeros(0, np.int32), *places]).tobytes())])
            flat = pa.StructArray.from_arrays([*(pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (hi, lo, words)), binary], names=["hi", "lo", "words", "pos"])
            offsets = pa.array(np.cumsum([0, *(len(x) for x in hi)]).astype(np.int32))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * 5)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, flat)], names=[*_ROW, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

        for *row, body in zip(*held, strict=True):
            counts = base_counts(body)
            hi, lo, words, bounds, places = text_lines(body)
            for begin in range(0, max(1, len(hi)), LINES):
                stop = min(begin + LINES, len(hi))
                rows.append((*row, *(counts if begin == 0 else [None] * 5)))
                parts.append((hi[begin:stop], lo[begin:stop], words[begin:stop], np.diff(bounds[begin : stop + 1]), places[bounds[begin] : bounds[stop]]))
                n += stop - begin
                if n >= LINES:
                    yield out(rows, parts)
                    rows, parts, n = [], [], 0
        if rows:
            yield out(rows, parts)


_ROW = ("rid", "id", "host", "fp")


def _host(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("\0"))


def _fingerprint(text_col: str, host_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), _host(host_col))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_docs: int, keep_share: float) -> tuple[DataFrame, DataFrame]:
    """(verdict of each row, removed lines of each row: rid, id, fp, words, pos)."""
    small_batches(docs.sparkSession)
    src = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("id"),
        _host(host_col).alias("host"),
        _fingerprint(text_col, host_col).alias("fp"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"),
    )
    base = "rid long, id long, host string, fp long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    scanned = table(src.mapInArrow(_scan, base + ", lines array<struct<hi:long,lo:long,words:long,pos:binary>>"), "scanned")
    keys = scanned.select("host", F.explode("lines").alias("x")).select("host", "x.hi", "x.lo")
    above = table(keys.groupBy("host", "hi", "lo").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > line_docs).select("host", "hi", "lo"), "above")
    lines = scanned.select("rid", "id", "fp", "host", F.explode("lines").alias("x")).select("rid", "id", "fp", "host", "x.*")
    removed = lines.join(above, ["host", "hi", "lo"], "left_semi").select("rid", "id", "fp", "words", "pos")
    lost = removed.groupBy("rid").agg(F.sum("words").alias("n_removed_words"))
    out = scanned.filter("n_words IS NOT NULL").drop("lines", "host").join(lost, "rid", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < keep_share * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("depleted", depleted).withColumn("kept", ~failed & ~depleted), removed


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """One row per input row: id, base counts, base_failed, n_removed_words, depleted, kept.

    A null or empty text has no words and fails the base rules. Null hosts form one host of their own; null
    and repeated ids are kept as they are, each row being a document. Lines are normalised by lower-casing
    A-Z and single spaces between words; lines without a word are ignored. A very long text is one row of counts. An
    empty table gives an empty result and extra columns are ignored.
    """
    out, _ = _judged(docs, id_col, text_col, host_col, line_docs, keep_share)
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "depleted", "kept",
    )


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The kept documents without their boilerplate lines, with the columns of ``docs``.

    Rows of equal id, text and host have the same verdict and the same lines.
    """
    out, removed = _judged(docs, id_col, text_col, host_col, line_docs, keep_share)
    kept = out.filter("kept").select("rid", "id", "fp")
    gone = removed.groupBy("rid").agg(F.collect_list("pos").alias("pos"))
    i, f, own, own_fp, at = fresh(docs, "__id", "__fp", "__own", "__print", "__pos")
    plan = kept.join(gone, "rid", "left").groupBy("id", "fp").agg(F.first("pos").alias(at)).withColumnsRenamed({"id": i, "fp": f})
    keyed = docs.withColumns({own: F.col(id_col).cast("long"), own_fp: _fingerprint(text_col, host_col)})

    @F.pandas_udf("string")
    def left(text, positions):
        import pandas as pd

        def cut(t, packed):
            drop = set(np.frombuffer(b"".join(packed), np.int32).tolist())
            return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop)

        return pd.Series([t if p is None else cut(t, p) for t, p in zip(text, positions, strict=True)], dtype=object)

    joined = keyed.join(plan, F.col(own).eqNullSafe(F.col(i)) & (F.col(own_fp) == F.col(f)))
    return joined.withColumn(text_col, left(F.col(text_col), F.col(at))).select(*own_columns(docs))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))


SQL = {
    "op2_quality_rules": r"""
WITH t AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
base AS (
  SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM t),
raw_lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM t),
lines AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
win AS (
  SELECT doc_id, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS c FROM win WHERE w3 IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM counted WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
norm AS (
  SELECT doc_id, host, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k, sum(len(w)) AS n
  FROM lines GROUP BY ALL),
above AS (SELECT host, k FROM norm GROUP BY host, k HAVING count(*) > 20),
gone AS (SELECT doc_id, sum(n) AS n FROM norm SEMI JOIN above USING (host, k) GROUP BY doc_id),
j AS (
  SELECT base.*, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - n_removed_words < 0.5 * n_words AS depleted FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, depleted,
       NOT base_failed AND NOT depleted AS kept FROM v
"""
}
