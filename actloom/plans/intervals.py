"""Bootstrap intervals of ratios over groups that are drawn whole."""

from __future__ import annotations

import hashlib
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_steps() -> list[float]:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable of mean 1, until 32 bits tell no difference."""
    steps, term, k = [], exp(-1), 0
    while not steps or steps[-1] < 1 - 2.0**-32:
        steps.append((steps[-1] if steps else 0.0) + term)
        k += 1
        term /= k
    return steps


def group_weights(group: str, replicates: int, seed: int):
    """How often each replicate draws a group: Poisson counts from MD5 of ``<group>:<seed>:<block>``, four a digest."""
    import numpy as np

    blocks = -(-replicates // 4)
    drawn = b"".join(hashlib.md5(f"{group}:{seed}:{b}".encode()).digest() for b in range(blocks))
    return np.searchsorted(poisson_steps(), np.frombuffer(drawn, ">u4")[:replicates] / 2.0**32, side="right").astype(np.float64)


def _partial_sums(n: int, replicates: int, seed: int):
    """Rows (group, numerators and denominators by turns) to one row a ratio and task: its sums by replicate."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((2 * n, replicates))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for group, row in zip(batch.column(0).to_pylist(), values, strict=True):
                sums += np.outer(row, group_weights(group, replicates, seed))
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(sums[::2])), pa.array(list(sums[1::2]))], names=["ratio", "above", "below"])

    return run


def ratio_intervals(rows: DataFrame, group: Column, ratios: dict[str, tuple[Column, Column]], replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(metric, value, low, high, groups): ratios of sums with percentile intervals, groups being drawn with replacement.

    A group has one count a replicate from a seeded hash, so the draw does not hang on the order or place of rows. Groups are
    summed up first; a task then keeps its sums by replicate and gives one row a ratio, so no row is multiplied. A
    null group is the empty text; a null term counts as 0. Replicates without a denominator are left out; without
    rows there is no interval.
    """
    names = list(ratios)
    terms = [F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).alias(f"{side}{i}") for i, pair in enumerate(ratios.values()) for side, c in zip(("a", "b"), pair, strict=True)]
    summed = rows.groupBy(F.coalesce(group.cast("string"), F.lit("")).alias("group")).agg(*terms)
    parts = summed.mapInArrow(_partial_sums(len(names), replicates, seed), "ratio int, above array<double>, below array<double>")
    each = parts.select("ratio", F.posexplode(F.arrays_zip("above", "below")).alias("replicate", "s"))
    drawn = each.groupBy("ratio", "replicate").agg(F.try_divide(F.sum("s.above"), F.sum("s.below")).alias("r"))
    tail = (1 - level) / 2
    limits = drawn.groupBy("ratio").agg(*[F.round(F.percentile("r", F.lit(p)), 6).alias(n) for n, p in (("low", tail), ("high", 1 - tail))])  # of as many values as replicates
    whole = summed.agg(F.count(F.lit(1)).alias("groups"), *[F.round(F.try_divide(F.sum(f"a{i}"), F.sum(f"b{i}")), 6).alias(f"v{i}") for i in range(len(names))])
    told = whole.select("groups", F.posexplode(F.array(*[F.col(f"v{i}") for i in range(len(names))])).alias("ratio", "value"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("ratio") + 1)
    return told.join(limits, "ratio").select(named.alias("metric"), "value", "low", "high", "groups")


def metric_terms() -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator, by move, of the run metrics of :func:`.arena.metrics`."""
    one, bad = F.lit(1), F.coalesce(F.col("status") != "ok", F.lit(True))
    gold = F.col("gold_intent").isNotNull()
    right = gold & (F.col("intent") == F.col("gold_intent")) & (F.col("skill") == F.col("gold_skill"))
    count = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "ok_rate": (count(~bad), one), "missing_or_fail_rate": (count(bad), one), "halluc_missing_rate": (count(bad & (F.col("n_claims") > 0)), one),
        "claim_support_proxy": (F.col("n_cited"), F.col("n_claims")), "plan_acc": (count(right), count(gold)),
    }
