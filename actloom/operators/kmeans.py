"""k-means over whole tables: D^2 starts, rounds until labels are stable, mini-batches.

Vectors stay where they are. A round is one pass: tasks label their vectors with the centers at hand and those before, and
give one row a cluster: sum, count, and labels that changed. Only the k centers, k by definition, are on the driver and
broadcast. Every draw is the smallest of seeded MD5 values, so any engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

EVERY = 32  # starts that a pass over the rows serves at most
HELD = 16  # rows fetched for each of them
_TOP = 2.0**52


def uniform(row: Column, *what) -> Column:
    """A number in (0, 1] from the MD5 of ``<row>:<what>...``, of 52 bits."""
    told = F.concat_ws(":", row.cast("string"), *[F.lit(str(w)) for w in what])
    return (F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") + 1) / _TOP


def _drawn(u, d):
    """What rows draw for a start: the smaller, the farther they are from the starts before."""
    import numpy as np

    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(d == 0, np.inf, -np.log(u) / d)


def _smallest(draws: list[int], first: bool):
    """Rows (row, v, d, u of each draw) to the HELD smallest of each draw, a task's: (draw, key, u, row, v, d)."""

    def best(table):
        import numpy as np

        draw, key, u = (table.column(i).to_numpy() for i in range(3))
        order = np.lexsort((u, key, draw))
        ranked = draw[order]
        return table.take(order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < HELD])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            d, us = batch.column(2).to_numpy(zero_copy_only=False), _points(batch.column(3))
            keys = us if first else _drawn(us, d[:, None])
            least = np.partition(keys, min(HELD, n) - 1, axis=0)[min(HELD, n) - 1]
            at = [np.flatnonzero(~(keys[:, i] > least[i])) for i in range(len(draws))]
            at = [some[np.lexsort((us[some, i], keys[some, i]))[:HELD]] for i, some in enumerate(at)]
            which, rows = np.repeat(np.arange(len(draws)), [len(some) for some in at]), np.concatenate(at)
            told = [pa.array(np.array(draws, np.int32)[which]), pa.array(keys[rows, which]), pa.array(us[rows, which]), *[batch.column(i).take(pa.array(rows)) for i in range(3)]]
            table = pa.Table.from_arrays(told, names=["draw", "key", "u", "row", "v", "d"])
            kept = best(table if kept is None else pa.concat_tables([kept, table]))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return run


def _nearer(new: list):
    """Rows (row, v, d) with d to the nearest of some more starts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                d, points = batch.column(2).to_numpy(zero_copy_only=False), _points(batch.column(1))
                for center in new:
                    d = np.fmin(d, ((points - np.asarray(center)) ** 2).sum(axis=1))  # passes over NaN, for none so far
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["row", "v", "d"])

    return run


def dsquared_starts(df: DataFrame, row: str, vector: str, k: int, seed: int = 42) -> list[tuple]:
    """(row, vector) of k starts: the first by chance, each other with a chance in proportion to its squared distance to the
    nearest start before.

    The draw takes the smallest -ln(u) / distance. A pass serves up to EVERY starts: distances only fall, so what a row draws
    over its distance now is a bound for every later start. Of each start to come the HELD rows of smallest bounds are
    fetched and drawn over the starts found since; the smallest is exact if no row left out has a smaller bound, else the
    next pass begins with that start. Where every distance is 0 all rows have the same chance, as they have when k is
    more than the distinct vectors.
    """
    import numpy as np

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(row).alias("row"), F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("d"))
    kind = dict(rows.dtypes)["row"]
    by_rank = Window.partitionBy("draw").orderBy("key", "u", "row")
    found: list[tuple] = []
    while len(found) < k:
        draws = list(range(len(found), min(len(found) + EVERY, k))) if found else [0]
        asked = rows.select("row", "v", "d", F.array(*[uniform(F.col("row"), seed, i) for i in draws]).alias("u"))
        small = asked.mapInArrow(_smallest(draws, not found), f"draw int, key double, u double, row {kind}, v array<double>, d double")
        held: dict[int, list] = {i: [] for i in draws}
        for r in small.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= HELD).collect():
            held[r.draw].append(r)
        new: list[list] = []
        for i in draws:
            order = lambda key, r: (bool(np.isnan(key)), float(key), r.u, r.row)
            nearest_of = lambda r: min([r.d, *[float(((np.array(r.v) - np.array(c)) ** 2).sum()) for c in new]])
            told = [(order(_drawn(r.u, nearest_of(r)) if new else r.key, r), r) for r in held[i]]
            if not told:
                return found
            key, best = min(told, key=lambda x: x[0])
            if new and len(told) == HELD and key > max(order(r.key, r) for r in held[i]):
                break
            found.append((best.row, list(best.v)))
            new.append(list(best.v))
        if len(found) < k:
            rows = written(rows.mapInArrow(_nearer(new), f"row {kind}, v array<double>, d double"), "distances")
    return found


def nearest(points, centers):
    """(label, squared distance) of each point: the nearest center, the first on a tie."""
    import numpy as np

    labels, best = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    step = max(1, (1 << 22) // max(1, len(points)))  # centers at once
    for begin in range(0, len(centers), step):
        some = centers[begin : begin + step]
        d = (points * points).sum(axis=1)[:, None] + (some * some).sum(axis=1)[None, :] - 2 * points @ some.T
        at = d.argmin(axis=1)
        low = d[np.arange(len(points)), at]
        closer = low < best
        labels[closer], best[closer] = at[closer] + begin, low[closer]
    return labels, np.maximum(best, 0)


def _points(column):
    import numpy as np

    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return values.reshape(len(column), -1)


def _partials(shared):
    """Vectors to one row a cluster and task: (cluster, n, changed, sums)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, before = shared.value
        n, changed, sums = np.zeros(len(now), np.int64), np.zeros(len(now), np.int64), np.zeros(now.shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _points(batch.column(0))
            labels = nearest(points, now)[0]
            old = nearest(points, before)[0] if before is not None else np.zeros(len(points), np.int64)
            n += np.bincount(labels, minlength=len(now))
            changed += np.bincount(labels[labels != old], minlength=len(now))
            np.add.at(sums, labels, points)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(n), pa.array(changed), pa.array(list(sums))], names=["cluster", "n", "changed", "sums"])

    return run


def _summed(vectors: DataFrame, now, before):
    """Counts, changes and sums of all clusters; a row a cluster comes to the driver."""
    import numpy as np

    shared = vectors.sparkSession.sparkContext.broadcast((now, before))
    parts = vectors.mapInArrow(_partials(shared), "cluster int, n long, changed long, sums array<double>")
    each = parts.select("cluster", "n", "changed", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("changed").alias("changed"), F.sum("x").alias("x"))
    found = each.groupBy("cluster").agg(F.first("n").alias("n"), F.first("changed").alias("changed"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sums")).collect()
    shared.destroy()
    n, changed, sums = np.zeros(len(now), np.int64), 0, np.zeros(now.shape)
    for r in found:
        n[r.cluster], changed, sums[r.cluster] = r.n, changed + r.changed, r.sums
    return n, changed, sums


def lloyd(df: DataFrame, row: str, vector: str, starts, max_iter: int = 50, seed: int = 42):
    """(centers at the last labelling, rounds): rounds until no label changes, or ``max_iter`` of them.

    Before the first round every label is 0. A cluster that loses all its members goes on from a row drawn by a seeded
    hash of round and cluster.
    """
    import numpy as np

    vectors = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    now, before = np.array(starts, np.float64), None
    for i in range(1, max_iter + 1):
        n, changed, sums = _summed(vectors, now, before)
        if not changed or i == max_iter:
            return now, i
        before, now = now, sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0).tolist()
        if empty:
            draws = [F.min_by(F.col(vector).cast("array<double>"), F.struct(uniform(F.col(row), seed, i, c), F.col(row))).alias(f"c{c}") for c in empty]
            drawn = df.filter(F.col(vector).isNotNull()).agg(*draws).first()
            for c in empty:
                now[c] = drawn[f"c{c}"]
    return now, max_iter


def labelled(df: DataFrame, row: str, vector: str, centers) -> DataFrame:
    """(row, cluster_id, distance) of every row; a null vector has neither."""
    shared = df.sparkSession.sparkContext.broadcast(centers)
    kept = dict(df.dtypes)[row]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            labels, d = nearest(_points(batch.column(1)), shared.value) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.int32()), pa.array(d, pa.float64())], names=[row, "cluster_id", "distance"])

    full = df.filter(F.col(vector).isNotNull()).select(row, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"`{row}` {kept}, cluster_id int, distance double")
    return full.unionByName(df.filter(F.col(vector).isNull()).select(row, F.lit(None).cast("int").alias("cluster_id"), F.lit(None).cast("double").alias("distance")))


def kmeans_stable(df: DataFrame, row: str, vector: str, k: int, seed: int = 42, max_iter: int = 50) -> DataFrame:
    """(row, cluster_id, distance): k-means from D^2 starts until labels are stable. An empty table has no rows."""
    import numpy as np

    starts = [v for _, v in dsquared_starts(df, row, vector, k, seed)]
    if not starts:
        return labelled(df, row, vector, np.zeros((1, 1)))
    return labelled(df, row, vector, lloyd(df, row, vector, starts, max_iter, seed)[0])


def minibatch(df: DataFrame, row: str, vector: str, k: int, seed: int = 42, max_iter: int = 50, batch: int = 1024) -> DataFrame:
    """(row, cluster_id, distance) by mini-batches: a round moves its batch's centers by members / members so far.

    The batches, about ``batch`` rows a round by a seeded draw, are what the method samples; they are written
    once, by round, and each round sums up its own in tasks. Every row is labelled in the end.
    """
    import numpy as np

    rows = df.filter(F.col(vector).isNotNull())
    share = min(1.0, batch / max(1, rows.count()))
    draws = F.filter(F.sequence(F.lit(1), F.lit(max_iter)), lambda i: F.pmod(F.xxhash64(F.col(row), i, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = written(rows.select(F.explode(draws).alias("round"), F.col(vector).cast("array<double>").alias("v")).repartition("round"), "batches")
    starts = [v for _, v in dsquared_starts(df, row, vector, k, seed)]
    if not starts:
        return labelled(df, row, vector, np.zeros((1, 1)))
    centers, seen = np.array(starts, np.float64), np.zeros(len(starts))
    for i in range(1, max_iter + 1):
        n, _, sums = _summed(drawn.filter(F.col("round") == i).select("v"), centers, None)
        seen += n
        some = n > 0
        centers[some] += (sums[some] / n[some][:, None] - centers[some]) * (n[some] / seen[some])[:, None]
    return labelled(df, row, vector, centers)
