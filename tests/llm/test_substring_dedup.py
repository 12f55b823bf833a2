import hashlib
import random

import pytest

from pyspark.sql import functions as F

from actloom.llm.batches import bucket_of
from actloom.llm.substring_dedup import LENGTH, op5_substring_dedup, repeated_spans, substring_dedup


def brute(rows):
    """rows: (doc_id, text or None)."""
    first: dict[bytes, int] = {}
    big = 2**63 - 1
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            first[w] = min(first.get(w, big), big if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        drop = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if first[b[p : p + LENGTH]] < (big if d is None else d):
                drop[p : p + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i in range(len(b)) if drop[i] and (i == 0 or not drop[i - 1]))
        kept = bytes(x for x, y in zip(b, drop) if not y)
        out.append((d, len(b), sum(drop), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edge_cases(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "δέλτα", "epsilon", "zeta", "eta", "theta", "iota"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(100)) for _ in range(n))
    base = [text(60) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, "short"), (23, base[0]), (24, base[0]), (None, base[1]), (None, base[1])]
    for i in range(30, 50):  # near copies, spliced and shifted passages
        a, b = rng.choice(base), rng.choice(base)
        i0, j0 = rng.randrange(len(a)), rng.randrange(len(b))
        rows.append((i, a[i0 : i0 + rng.randrange(20, 200)] + rng.choice(["", " ", "x"]) + b[j0 : j0 + rng.randrange(20, 200)]))
    rows += [(60, "a" * 400), (61, "a" * 49), (62, "b" + "a" * 50), (63, "ab" * 200), (64, "ba" * 30), (65, base[2][:50]), (66, base[2][:49]), (3, base[4])]
    rows += [(70, base[5] + base[6]), (70, base[5] + base[6])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, bucket string").repartition(3)
    assert got(substring_dedup(df)) == brute(rows)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op5_substring_dedup(spark, d)) == brute(rows)


@pytest.mark.parametrize("records", [7, 10_000])
def test_rounds_across_small_batches(spark, records):
    """Batches of 4 KB and Arrow batches of seven rows: all rounds cross batches, runs and held rows cross edges."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").repartition(5)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(records))
    try:
        assert got(substring_dedup(docs, batch_bytes=4096)) == brute(rows)
    finally:
        spark.conf.unset(name)


def test_hot_gram_in_many_contexts(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    hot = "the same twenty bytes"
    rows = [(i, noise(40) + hot + noise(rng.randrange(60))) for i in range(600)]
    rows += [(1000 + i, rows[i][1][:90]) for i in range(0, 600, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(substring_dedup(df, batch_bytes=2048)) == brute(rows)


def test_spans_and_kept_bytes(spark):
    rows = [(1, "x" * 3 + "0123456789" * 6), (2, "y" * 5 + "0123456789" * 6 + "é")]
    out = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].spans == [] and bytes(out[1].kept).decode() == rows[0][1]
    assert [(s.start, s.end) for s in out[2].spans] == [(5, 65)] and bytes(out[2].kept).decode() == "y" * 5 + "é"


def test_bucket_numbers_are_sparks(spark):
    numbers = [0, 1, -1, 5 << 36, (7 << 36) + 3, 2**62]
    df = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", F.pmod(F.hash("x"), F.lit(13)).alias("b"))
    assert all(bucket_of(r.x, 13) == r.b for r in df.collect())


def test_long_text(spark):
    """50 MB in one row beside short ones."""
    rng = random.Random(5)
    piece = "".join(rng.choice("abcdefgh") for _ in range(1 << 20))
    long = piece + "".join(rng.choice("ijklmnop") for _ in range(48 << 20)) + piece
    rows = [(1, piece[:100]), (2, long), (3, long[5_000_000:5_000_300])]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[2].n_bytes == len(long) and out[2].n_removed == 200 and out[3].n_removed == 300
