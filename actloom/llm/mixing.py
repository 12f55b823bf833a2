"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words to take are cut into BLOCKS equal blocks. Sources get blocks by highest quotients of their targets
(t / 1, t / 3, t / 5 ...), then each source's blocks go to its shards the same way, by shard size, so every
shard has an integer quota. A source has about one shard for 256 blocks: 4,096 shards plus one a source at
most over all sources, so the quota tables are bounded by the sources, and a hot source has many shards.

In a shard documents stand in a seeded order, cut into blocks of equal words; the rows of one id and text are counted first and go round the shards. A quota takes the shard's whole stream as
often as it fits; of the last pass it selects as many blocks as are left, from a seeded block on and around the
shard's end. As the order is seeded too, that is a uniform choice of blocks, and it cuts two documents a shard instead
of two a block. Only ids and sizes are shuffled.
"""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import Rows, meta_rows
from .common import load, n_words, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEAT = 2  # a document, and so a source, is taken twice at most
BLOCKS = 1 << 20
SHARD_BLOCKS = 256
SEED = 17
RUN = 10_000  # rows of one (id, text) that are opened at once


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = REPEAT) -> list[float]:
    """Weights over ``share`` of all sizes; what a source cannot take goes to the others by weight."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))])
    cap = most * np.array(sizes, np.float64)
    got, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    total = share * float(sum(sizes))
    while free.any():
        left = total - got[~free].sum()
        part = left * w / w[free].sum()
        over = free & (part > cap)
        if not over.any():
            got[free] = part[free]
            break
        got[over] = cap[over]
        free &= ~over
    return got.tolist()


def apportion(votes, seats: int, caps=None) -> list[int]:
    """Sainte-Lague seats by highest quotients; ties go to the larger vote, then to the earlier party.

    A party at its cap gets no more; seats that no party may take stay empty.
    """
    v = np.array(votes, np.float64)
    cap = np.full(len(v), np.inf) if caps is None else np.array(caps, np.float64)
    if not len(v) or seats <= 0 or v.sum() <= 0:
        return [0] * len(v)
    seats = int(min(seats, cap[v > 0].sum()))
    low, high = 0.0, 2 * v.max() + 1  # divisors; at the larger one no seat is given
    for _ in range(100):
        mid = (low + high) / 2
        if np.minimum(np.floor(v / mid + 0.5), cap).sum() > seats:
            low = mid
        else:
            high = mid
    got = np.minimum(np.floor(v / high + 0.5), cap).astype(np.int64)
    queue = [(-v[i] / (2 * got[i] + 1), -v[i], i) for i in range(len(v)) if v[i] > 0 and got[i] < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        if not queue:
            break
        _, _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(queue, (-v[i] / (2 * got[i] + 1), -v[i], i))
    return got.tolist()


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows, sent as Arrow: a list would start Python workers of another kind on all executors."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cells = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, kinds[t]) for n, t, c in zip(names, types, cells, strict=True)}), schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """One row per input row: id, fp (hash of the text), size, source_size, target, taken, copies.

    ``taken`` counts the words of the selected blocks, ``copies`` the times that a block or pass takes the document's
    first word: whole documents in place of cut ones. A null text has size 0; a null source is one source, last in
    order. Null and repeated ids are rows of their own; fully equal rows come in any order, which their sums do not
    show. taken is at most twice size and copies at most 2. The table of sources (a name and some numbers each) goes to
    the driver. A very long text is one size like any other. An empty table gives an empty result and extra
    columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    # rows of equal id and text are one row with their number, so that many of them are neither one sort nor one shard
    sized = table(src.groupBy("id", "fp", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    found = [(r.source, int(r["size"])) for r in sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).toLocalIterator()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s in found]
    aims = targets(sizes, weights, share)
    block = max(1, math.ceil(share * sum(sizes) / blocks))
    seats = apportion(aims, round(sum(aims) / block), [math.ceil(REPEAT * s / block) for s in sizes])
    shards = [max(1, math.ceil(s / (SHARD_BLOCKS * block))) for s in sizes]
    # a row a source, and a row a shard: both are broadcast or dealt by their size, as the planner sees it
    plan = _small(
        spark,
        [(i, name, s, t, k) for i, ((name, s), t, k) in enumerate(zip(found, aims, shards, strict=True))],
        "number int, source string, source_size long, target double, shards int",
    )
    named = sized.join(plan, sized.source.eqNullSafe(plan.source)).drop("source")
    # the rows of one (id, text) go round the shards
    home = F.pmod(F.xxhash64("id", "fp", F.lit(seed)), F.col("shards"))
    turns = named.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.col("shards")) - 1)))
    share = F.floor((F.col("n") - F.col("turn") + F.col("shards") - 1) / F.col("shards")).cast("long")
    dealt = table(turns.withColumn("shard", ((home + F.col("turn")) % F.col("shards")).cast("int")).withColumn("n", share).drop("turn", "shards"), "dealt")
    per = {}
    for r in dealt.groupBy("number", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("size")).toLocalIterator():
        per.setdefault(r.number, []).append((r.shard, int(r["size"])))
    quotas = []
    for number, held in per.items():
        held.sort()
        whole = aims[number] >= REPEAT * sizes[number]  # all of it, last part blocks included
        got = apportion([s for _, s in held], seats[number], [math.floor(REPEAT * s / block) for _, s in held])
        quotas += [(number, shard, s, *selected(s, REPEAT * s if whole else q * block, block, (number, shard, seed))) for (shard, s), q in zip(held, got, strict=True)]
    quotas = _small(spark, quotas, "number int, shard int, shard_size long, passes int, begin long, stop long")
    order = Window.partitionBy("number", "shard").orderBy(F.xxhash64("id", "fp", F.lit(seed + 1)), "id", "fp", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    # each row of a group has its own place: a group is opened in runs of bounded length
    run = placed.withColumn("begin_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    run = run.withColumn("row", F.explode(F.sequence(F.col("begin_row"), F.least(F.col("begin_row") + RUN, F.col("n")) - 1)))
    out = run.withColumn("at", F.col("at") + F.col("row") * F.col("size")).join(quotas, ["number", "shard"])
    # the selected words are [begin, stop); what lies past the shard's end goes on at its start
    beyond = F.col("stop") - F.col("shard_size")
    inside = lambda a, b: F.greatest(F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a), F.lit(0))
    taken = F.col("passes") * F.col("size") + inside(F.col("begin"), F.col("stop")) + inside(F.lit(0), beyond)
    first = ((F.col("at") >= F.col("begin")) & (F.col("at") < F.col("stop"))) | (F.col("at") < beyond)
    return out.select(F.col("id").alias(id_col), "fp", "size", "source_size", "target", taken.cast("long").alias("taken"), (F.col("passes") + first.cast("int")).alias("copies"))


def selected(size: int, quota: int, block: int, seed) -> tuple[int, int, int]:
    """(passes, first word, end) of a shard's selection; an end past ``size`` goes on at the shard's start."""
    if size <= 0:
        return 0, 0, 0
    begin = random.Random(repr(seed)).randrange(-(-size // block)) * block
    return quota // size, begin, begin + quota % size


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole, with the columns of ``docs``.

    Rows of equal id and text share their copies evenly, rounded down. Documents without a word take part like
    others; a very long text comes whole or not at all. Columns keep their values, whatever their names. An empty
    table gives an empty result.
    """
    rows = Rows(docs, text_col, {"id": F.col(id_col).cast("long"), "fp": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    plan = mix(docs, id_col, text_col, source_col, **options).groupBy(F.col(id_col).alias("of"), "fp").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    plan = table(plan.select("of", "fp", F.floor(F.col("copies") / F.col("rows")).cast("int").alias("times")).filter("times > 0"), "plan")
    at = meta_rows(rows.batches, "id long, fp long")
    taken = at.join(plan.withColumnRenamed("fp", "print"), F.col("id").eqNullSafe(F.col("of")) & (F.col("fp") == F.col("print"))).select("batch_id", "row", "times")

    def change(held, told):
        import pyarrow as pa

        return held.take(pa.array(np.repeat(told.column("row").to_numpy(), told.column("times").to_numpy())))

    return rows.mapped(table(taken, "taken"), change)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).drop("fp", "copies")
