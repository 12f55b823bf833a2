"""SimHash near-deduplication with the generalised pigeonhole principle.

Texts become 64-bit fingerprints of their word shingles. Two fingerprints link at ``radius`` or fewer
differing bits. The bits are grouped into partitions, correlated bits together, and each partition i gets
a threshold t_i with sum(t_i) = radius - m + 1; by the generalised pigeonhole principle linked fingerprints
differ by t_i bits or fewer in at least one partition (a threshold of -1 leaves a partition out). The number
of partitions and the thresholds come from dynamic programming over candidate counts, estimated on a
bounded sample of fingerprints; the sample steers cost only, never the result.

Distinct fingerprints are stored under their partition values and probe all values within t_i bits.
A bucket's members are verified in numpy by blocks and give a spanning forest, never all pairs; a bucket
above BLOCK members is cut into blocks whose pairs are dealt out to tasks. Components are then found over
fingerprints, so copies count once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, shingle_hashes, small_batches, table, word_pieces
from .components import components

RADIUS = 3
SHINGLE = 3
SAMPLE = 4096  # fingerprints that steer the choice of partitions
BLOCK = 4096  # members of a bucket that one task compares at once
PAIR_COST, ROW_COST = 1.0, 60.0  # a verified pair against a shuffled row, in the same unit
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(word_pieces(body.translate(_LOWER)), shingle, SEED):
        total += len(hashes)
        for i in range(0, len(hashes), 4096):
            ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def _prints(shingle: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(b, shingle) for b in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def _within(a: np.ndarray, bits: list[int], most: int) -> float:
    """Pairs of the sample that differ in ``most`` bits or fewer among ``bits``."""
    if most < 0:
        return 0.0
    mask = np.uint64(sum(1 << b for b in bits))
    x = a & mask
    return float(sum((np.bitwise_count(x[i : i + 256, None] ^ x[None, :]) <= most).sum() for i in range(0, len(x), 256)) - len(x)) / 2


def _groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups, each grown from its seed by the bit that correlates most with the group."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    spread = bits - bits.mean(axis=0)
    norm = np.sqrt((spread**2).sum(axis=0))
    norm[norm == 0] = 1
    like = np.abs(spread.T @ spread) / np.outer(norm, norm)
    free, groups = list(range(64)), []
    for g in range(m):
        size = len(free) // (m - g)
        seed = max(free, key=lambda b: like[b][free].sum())
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(free, key=lambda b: like[b][group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, total: int, radius: int) -> list[tuple[list[int], int]]:
    """Partitions (bits, threshold) of least estimated cost; partitions with threshold -1 are left out."""
    best, chosen = None, []
    scale = (total / max(1, len(sample))) ** 2
    for m in range(1, 7):
        groups = _groups(sample, m)
        want = radius - m + 1
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of thresholds so far -> cost, thresholds
        for i, bits in enumerate(groups):
            cost = {}
            for t in range(-1, min(2, radius) + 1):
                probes = 0 if t < 0 else sum(sum(1 for _ in combinations(range(len(bits)), k)) if len(bits) < 24 or k < 2 else len(bits) * (len(bits) - 1) // 2 for k in range(t + 1))
                # a sample without a pair says little of many rows: half a pair is the least it can mean
                pairs = scale * max(_within(sample, bits, t), 0.5 if t >= 0 and total > len(sample) else 0.0)
                copies = 1 + 2 * pairs / max(1, total) / BLOCK  # blocks that a row is dealt to
                cost[t] = ROW_COST * total * probes * copies + PAIR_COST * pairs if t >= 0 else 0.0
            after: dict[int, tuple[float, list[int]]] = {}
            for done, (paid, ts) in state.items():
                for t, c in cost.items():
                    if done + t not in after or paid + c < after[done + t][0]:
                        after[done + t] = (paid + c, [*ts, t])
            state = after
        if want in state and (best is None or state[want][0] < best):
            best = state[want][0]
            chosen = [(bits, t) for bits, t in zip(groups, state[want][1], strict=True) if t >= 0]
    return chosen


def _signatures(plan):
    """(part, value, fp, probe) rows: the stored value of each partition, and the values within its threshold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (bits, most) in enumerate(plan):
                mask = np.uint64(sum(1 << b for b in bits))
                for k in range(most + 1):
                    for flip in combinations(bits, k):
                        value = (fp & mask) ^ np.uint64(sum(1 << b for b in flip))
                        n = len(fp)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(n, k > 0))], names=["part", "value", "fp", "probe"])

    return run


def forest(stored: np.ndarray, others: np.ndarray, radius: int):
    """Edges (member, root) that span the links of ``stored`` among itself and with ``others``."""
    every = np.concatenate([stored, others])
    root = np.arange(len(every))
    for i in range(0, len(stored), 256):
        part = stored[i : i + 256]
        near = np.bitwise_count(part[:, None] ^ every[None, :]) <= radius
        a, b = np.nonzero(near)
        a += i
        keep = a != b
        a, b = a[keep], b[keep]
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    member = np.flatnonzero(root != np.arange(len(every)))
    return every[member], every[root[member]]


def _link(radius: int):
    """Rows sorted by (part, value, i, j): one block pair after the other."""

    def run(batches):
        import pyarrow as pa

        now, held = None, []

        def done():
            fp, probe, block = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first = np.unique(np.stack([fp.view(np.int64), probe.astype(np.int64), block]), axis=1, return_index=True)
            fp, probe, block = fp[first], probe[first], block[first]
            i, j = now[2], now[3]
            # stored members of block i against all of block j, and the other way round
            ends = [forest(fp[~probe & (block == x)], fp[(block == y) & (probe | (x != y))], radius) for x, y in {(i, j), (j, i)}]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in ends]).view(np.int64)) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "value", "i", "j", "fp", "probe", "block")]
            keys = np.stack([c.astype(np.int64) for c in cols[:4]])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), keys.shape[1]], strict=True):
                if a == b:
                    continue
                key = tuple(keys[:, a].tolist())
                if key != now and held:
                    yield done()
                    held = []
                now = key
                held.append((cols[4][a:b].view(np.uint64), cols[5][a:b].astype(bool), cols[6][a:b].astype(np.int64)))
        if held:
            yield done()

    return run


def linked(prints: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that span every link of ``radius`` bits or fewer."""
    spark = prints.sparkSession
    total = prints.count()
    some = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    if total < 2:
        return spark.createDataFrame([], "u long, v long")
    plan = allocate(some, total, radius)
    rows = prints.select("fp").mapInArrow(_signatures(plan), "part int, value long, fp long, probe boolean")
    sizes = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("idle")).filter("n > 1 and not idle")
    sizes = sizes.select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, ["part", "value"]).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    # block b meets every block: once as the smaller and once as the larger of a pair
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "probe", "block")
    dealt = dealt.repartition("part", "value", "i", "j").sortWithinPartitions("part", "value", "i", "j")
    return dealt.mapInArrow(_link(radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other. component_id is the smallest id
    reachable over links; null ids never give a component its name unless all its ids are null. Rows that
    repeat an id are kept as they are. A very long text is worked through in pieces. Extra columns are ignored and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))
    prints = table(src.mapInArrow(_prints(shingle), "id long, fp long"), "prints")
    nodes = table(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(linked(nodes, radius, sample, block))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # written, so that the join deals both sides anew and AQE can split a component that holds many rows
    lows = table(named.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    known = named.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return prints.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents"))
