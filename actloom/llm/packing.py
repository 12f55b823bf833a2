"""Packing into optimal length buckets.

A histogram of all lengths, exact up to 1,024 and in 64 steps an octave above, has 4,500 bins at most whatever the
corpus; each bin knows its true greatest length. Dynamic programming over it chooses, among these lengths, the bucket
boundaries that minimise padding.
Inside a bucket documents are numbered in a seeded order without gaps: the number inside a (bucket, salt)
group plus the size of the groups before it, so no bucket is numbered in one task. A batch takes
``budget // boundary`` documents, padded to the boundary; a document longer than the budget is a batch alone.
Only ids and lengths are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, n_words, table

BUCKETS = 16
BUDGET = 65_536  # padded tokens in a batch
SALTS = 4096
EXACT, STEPS = 1024, 6  # lengths kept exact; log2 of the steps in each octave above
SEED = 11


def binned(length):
    """The histogram bin of a length, named by the length that it is rounded up to."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(length)) - 1 - STEPS, F.lit(0)))
    return F.when(length <= EXACT, length).otherwise(((length + step - 1) / step).cast("long") * step)


def boundaries(lengths, counts, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding for this histogram."""
    order = np.argsort(lengths)
    q, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    h = len(q)
    if not h:
        return []
    below = np.concatenate([[0.0], np.cumsum(c)])
    cost = q * below[1:]  # one bucket for bins 0..j
    back = []
    for _ in range(min(buckets, h) - 1):
        new, frm = cost.copy(), np.full(h, -1)
        for j in range(1, h):
            total = cost[:j] + q[j] * (below[j + 1] - below[1 : j + 1])
            i = int(np.argmin(total))
            if total[i] < new[j]:
                new[j], frm[j] = total[i], i
        back.append(frm)
        cost = new
    ends, j, k = [], h - 1, len(back) - 1
    while j >= 0:
        ends.append(int(q[j]))
        while k >= 0 and back[k][j] < 0:
            k -= 1
        if k < 0:
            break
        j, k = int(back[k][j]), k - 1
    return ends[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """One row per input row: id, n_tokens, bucket, padded_to, batch, slot, padding.

    Tokens are words. Null and empty texts have length 0 and fill batches of the first bucket without using
    its budget up faster than one token each. Rows that repeat an id, and null ids, are packed one by one.
    The seeded order is by id and row number, which also spread null and repeated ids over the salts. A very long text
    is one length like any other. An empty table gives an empty result and extra columns are ignored.
    """
    spark = docs.sparkSession
    sized = table(docs.select(F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("n_tokens"), F.monotonically_increasing_id().alias("rid")), "lengths")
    bins = sized.groupBy(binned(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    ends = boundaries([r.top for r in bins], [r.n for r in bins], buckets) or [0]
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= e, F.lit(i)) for i, e in enumerate(ends)], F.lit(len(ends) - 1))
    salt = F.pmod(F.xxhash64("id", "rid", F.lit(seed)), F.lit(SALTS)).cast("int")
    placed = sized.withColumn("bucket", bucket).withColumn("salt", salt)
    sizes = placed.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most buckets * SALTS rows
    offsets = F.broadcast(sizes.select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("bucket", "salt").orderBy(F.xxhash64("id", "rid", F.lit(seed + 1)), "rid")
    caps = F.element_at(F.array(*[F.lit(max(1, budget // max(1, e))).cast("long") for e in ends]), F.col("bucket") + 1)
    upto = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1)
    rank = F.col("offset") + F.col("rank") - 1
    out = placed.withColumn("rank", F.row_number().over(inside)).join(offsets, ["bucket", "salt"]).withColumn("cap", caps).withColumn("at", rank)
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", upto.alias("padded_to"),
        F.floor(F.col("at") / F.col("cap")).cast("long").alias("batch"), (F.col("at") % F.col("cap")).cast("int").alias("slot"), (upto - F.col("n_tokens")).alias("padding"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
