"""Near copies: candidates by SimHash links and MinHash bands, every one verified on the whole texts.

Two texts are near copies if their sets of distinct 5-word shingles have a Jaccard similarity of 0.8 or more.
Candidates are the SimHash links of simhash_dedup and, as these alone miss a part of the near copies, texts
that share one of BANDS bands of ROWS minima: a pair at exactly 0.8 shares none in 0.3 % of cases, one at 0.85 in
0.004 %. Candidate links only form candidate groups, so a chance link costs time and never a document.

A candidate group is dealt to parts of bounded size. First each part compares its texts with one another and with
the group's leader, which settles groups of one part, and all copies of a leader, in rows linear in the group. Where
several components are left in a group of several parts, the texts outside its largest component, in blocks, meet
all its texts, in blocks; texts of the largest one are not compared with one another again. A task compares texts until
they are known to be in one component and gives a spanning forest of the links that hold. Components are then found
over these links only. Texts of the same words are one node. Rows lie in compressed batches in the shared folder
(:mod:`.batches`): texts of candidates are fetched by address, and rows that go are told to their batches, so texts without a
candidate never move, whatever the numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Rows, bodies_of, each_batch, fetched
from .common import drop_table, shingle_hashes, small_batches, table, word_pieces
from .components import components
from .simhash_dedup import _LOWER, RADIUS, SEED, fingerprint, linked

WORDS = 5
ALIKE = (4, 5)  # similarity from which texts are near copies, as a fraction
BANDS, ROWS = 32, 8
BLOCK_TEXTS, BLOCK_BYTES = 512, 4 << 20
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(body: bytes) -> np.ndarray:
    """Distinct XXH64 of the 5-word shingles, sorted; of all words if there are fewer; none without words."""
    found = [np.zeros(0, np.uint64), *(np.unique(h) for h in shingle_hashes(word_pieces(body.translate(_LOWER)), WORDS, SEED))]
    return np.unique(np.concatenate(found))


def bands(found: np.ndarray) -> np.ndarray:
    """One value a band: the hash of its ROWS minima and its number; none for an empty set."""
    import xxhash

    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, (found[i : i + 512, None] * _FACTORS[None, :]).min(axis=0), out=least)
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[i * ROWS * 8 : (i + 1) * ROWS * 8], i) for i in range(BANDS)], np.uint64).view(np.int64)


def _scan(batch_id, meta, ends, buf):
    """Address, row number and id of each text with what its candidates are found by."""
    import hashlib

    import pyarrow as pa

    keys, prints, cut, sizes = [], [], [], []
    for row in range(meta.num_rows):
        body = bodies_of(ends, buf, [row])[0]
        key = hashlib.blake2b(b" ".join(body.translate(_LOWER).split()), digest_size=16).digest()
        keys.append(np.frombuffer(key, np.int64))
        prints.append(fingerprint(body))
        cut.append(bands(shingles(body)))
        sizes.append(len(body))
    both = np.array(keys, np.int64).reshape(-1, 2)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int32)
    return pa.table(
        {
            "batch_id": pa.array(np.full(meta.num_rows, batch_id, np.int64)),
            "row": pa.array(np.arange(meta.num_rows, dtype=np.int32)),
            "rid": meta.column("rid"),
            "id": meta.column("id"),
            "hi": pa.array(both[:, 0].copy()),
            "lo": pa.array(both[:, 1].copy()),
            "fp": pa.array(np.array(prints, np.uint64).view(np.int64)),
            "size": pa.array(sizes, pa.int64()),
            "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *cut]))),
        }
    )


def verified_forest(sets: list[np.ndarray], alike=ALIKE, joined: int = 0):
    """Pairs (i, j) that span the links of ``sets``, of which the first ``joined`` are known to be in one component."""
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(number.max()) + 1 if len(number) else 1, bool)
    most, of = alike
    edges, free = [], np.arange(n)
    while len(free):
        first = max(1, joined) if not edges and len(free) == n else 1
        ahead, free = free[:first].tolist(), free[first:]
        while ahead and len(free):
            p = ahead.pop()
            mine = number[starts[p] : starts[p + 1]]
            fit = (of * np.minimum(sizes[free], sizes[p]) >= most * np.maximum(sizes[free], sizes[p])) & (sizes[free] > 0)
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            mark[mine] = True
            held = np.zeros(len(at), np.int64)
            for i in range(0, len(at), 256):
                some = free[at[i : i + 256]]
                flat = np.concatenate([mark[number[starts[x] : starts[x + 1]]] for x in some])
                held[i : i + 256] = np.add.reduceat(flat.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            mark[mine] = False
            near = of * held >= most * (sizes[free[at]] + sizes[p] - held)
            new = free[at[near]].tolist()
            edges += [(x, p) for x in new]
            ahead += new
            free = np.delete(free, at[near])
    return edges


def _verify(batches):
    """Rows (root, i, j, node, body) sorted by (root, i, j): one pair of blocks after the other."""
    import pyarrow as pa

    now, held, core = None, {}, set()

    def done():
        nodes = sorted(held, key=lambda x: (x not in core, x))
        edges = np.array(verified_forest([held[x] for x in nodes], joined=len(core)), np.int64).reshape(-1, 2)
        ids = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[edges[:, 0]]), pa.array(ids[edges[:, 1]])], names=["u", "v"])

    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("root", "i", "j", "node", "body", "core")]
        for root, i, j, node, body, joined in zip(*cols, strict=True):
            if (root, i, j) != now:
                if held:
                    yield done()
                now, held, core = (root, i, j), {}, set()
            held[node] = shingles(body)
            if joined:
                core.add(node)
    if held:
        yield done()


def candidate_groups(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, root): groups joined by any candidate link; nodes alone in their group are left out."""
    prints = table(nodes.select("fp").distinct(), "fps")
    # prints stand as nodes of their own: this links equal prints, and a chance equality only widens a group
    links = linked(prints, radius).unionAll(nodes.select(F.col("node").alias("u"), F.col("fp").alias("v")))
    values = nodes.select("node", F.explode("bands").alias("value"))
    firsts = table(values.groupBy("value").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("value", "first"), "firsts")
    shared = values.join(firsts, "value").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    roots = components(links.unionAll(shared))
    grouped = table(nodes.select("node", "size").join(roots, "node").select("node", "size", "root"), "grouped")
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("leader")).filter("n > 1")
    sizes = table(sizes.select("root", "leader", _blocks("n", "bytes").alias("blocks")), "blocks")
    return grouped.join(sizes, "root").select("node", "size", "root", "blocks", "leader")


def _blocks(n: str, size: str):
    return F.least(F.greatest(F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)), F.greatest(F.col(n), F.lit(1))).cast("int")


def _block(count: str):
    return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")


def _compared(dealt: DataFrame) -> DataFrame:
    """Verified edges of rows (root, i, j, node, body, core), a task's texts at a time."""
    keys = ("root", "i", "j")
    return table(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify, "u long, v long"), "verified")


def verified_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v) that span the links of candidate groups (node, size, root, blocks, leader, rid); texts are (rid, body)."""
    no = F.lit(False).alias("core")
    own = members.select("root", _block("blocks").alias("i"), "node", "rid")
    # the leader goes to every part of its group: a row a part
    lead = members.filter("node = leader and blocks > 1").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "node", "rid")
    parts = own.unionAll(lead).distinct().select("root", "i", F.col("i").alias("j"), "node", "rid", no)
    first = _compared(parts.join(texts, "rid"))

    # groups of several parts in which several components are left
    large = members.filter("blocks > 1").select("node", "size", "root", "rid")
    named = table(_named(large, first), "named")
    parts = named.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    core = parts.groupBy("root").agg(F.max(F.struct("n", "bytes", "part")).alias("c"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    core = core.select("root", F.col("c.part").alias("core_part"), F.col("c.n").alias("core_n"), F.col("c.bytes").alias("core_bytes"), (F.col("n") - F.col("c.n")).alias("rest_n"), (F.col("bytes") - F.col("c.bytes")).alias("rest_bytes"))
    core = table(core.select("root", "core_part", _blocks("core_n", "core_bytes").alias("a"), _blocks("rest_n", "rest_bytes").alias("b")), "cores")
    left = named.join(core, "root").withColumn("core", F.col("part") == F.col("core_part"))
    # blocks 0 to a - 1 hold the largest component, a to a + b - 1 the rest; a block of the rest meets every block
    mine = F.when(F.col("core"), _block("a")).otherwise(F.col("a") + _block("b"))
    rest = F.sequence(F.col("a"), F.col("a") + F.col("b") - 1)
    every = F.sequence(F.lit(0), F.col("a") + F.col("b") - 1)
    meets = F.when(F.col("core"), rest).otherwise(F.filter(every, lambda x: x != F.col("mine")))
    left = left.withColumn("mine", mine).withColumn("other", F.explode(meets))
    pairs = left.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "rid", "core")
    return first.unionAll(_compared(pairs.join(texts, "rid")))


def _named(large: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the component that ``edges`` put them in."""
    found = components(edges).select("node", F.col("root").alias("part"))
    return large.join(found, "node", "left").select("node", "size", "root", "rid", F.coalesce("part", "node").alias("part"))


def near_copy_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies.

    That is the row with the smallest id, null ids last; rows of one id and equal words are copies like any
    others, so one of them stays. Null and empty texts are copies of each other. A very long text is a batch alone. An empty
    table gives an empty result; the columns are those of ``docs``, whatever their names.
    """
    small_batches(docs.sparkSession)
    # row numbers are written with the rows, so that all later reads agree on them
    rows = Rows(docs, text_col, {"id": F.col(id_col).cast("long"), "rid": F.monotonically_increasing_id()})
    scanned = table(rows.batches.mapInArrow(each_batch(_scan), "batch_id long, row int, rid long, id long, hi long, lo long, fp long, size long, bands array<long>"), "scanned")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    lows = scanned.groupBy("hi", "lo").agg(F.min(place).alias("best")).select("best", F.col("best.rid").alias("rid"))
    nodes = table(lows.join(scanned.drop("id", "hi", "lo"), "rid").withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = table(candidate_groups(nodes, radius).join(nodes.select("node", "rid", "batch_id", "row"), "node"), "members")
    texts = table(fetched(rows.batches, members.select("batch_id", "row"), "rid long, body binary"), "texts")
    roots = components(verified_links(members.drop("batch_id", "row"), texts))
    drop_table(texts)
    named = nodes.select("node", "best").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    keep = table(named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.rid").alias("rid")), "keep")
    return rows.without(scanned.select("batch_id", "row", "rid").join(keep, "rid", "left_anti"))
