"""Exact deduplication with an extendible-hash index on shared files.

1. Every text gets a 64-bit key and a SHA-256. Texts lie in compressed batches in the shared folder (:mod:`.batches`);
   the narrow entries (address, id, key, digest) are what is indexed.
2. The directory maps key prefixes to buckets. It begins with one bucket; a bucket with more than its capacity of
   distinct keys is split by the next bit of the key, and the directory doubles when a bucket that is as deep as the
   directory splits. It is held run-length encoded (one entry a bucket), so doubling moves nothing and depth has no
   bound but the key's 64 bits, where equal keys are chained. The keys are counted in Spark, prefix by prefix, and
   finer only below prefixes that are still overfull. Directory and buckets are files in the shared folder.
3. Owner tasks process key ranges, each a run of whole buckets; the entries of a key that holds more than a part of an
   owner's fair share are dealt to all owners. Texts of keys that occur once are settled by the index and never move,
   at any size: the others are fetched by address. They go to their key's owner, which chains the different texts of a key and compares bytes;
   each chain link is a class. Copies are compared and merged in every Arrow batch before the shuffle; a key with
   many rows is compared by sqrt(n) salted groups first, so that no owner gets all its texts.
4. Entries meet the classes to get their group; AQE splits a key that holds many rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import fetched, meta_rows, pack_batches, text_bytes
from .common import drop_table, load, small_batches, table

CAPACITY = 20_000  # distinct keys in a bucket
MOST_BUCKETS = 1 << 16  # capacity grows with the keys so that about so many buckets hold them
HOT = 1_000  # rows of a key from which its texts are compared by salted groups first
HOT_PARTS = 4  # a key with more than one part in so many of an owner's fair share of rows is dealt to all owners
FINER = 6  # bits by which a histogram looks below an overfull prefix


class Directory:
    """Buckets as (local depth, prefix), in key order; slots of one bucket are adjacent and not written out."""

    def __init__(self):
        self.depth, self.leaves = 0, [(0, 0)]

    def split(self, at: int) -> None:
        """Split bucket ``at`` by the next bit; the directory doubles if the bucket is as deep as it."""
        local, prefix = self.leaves[at]
        if local == self.depth:
            self.depth += 1  # every bucket's run of slots is twice as long now
        self.leaves[at : at + 1] = [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]

    def slots(self) -> list[int]:
        """The directory written out: the bucket of each prefix of ``depth`` bits."""
        return [i for i, (d, _) in enumerate(self.leaves) for _ in range(1 << (self.depth - d))]

    def starts(self) -> np.ndarray:
        """Smallest key (unsigned) of each bucket."""
        return np.array([p << (64 - d) if d else 0 for d, p in self.leaves], np.uint64)


def grow(count, capacity: int) -> tuple[Directory, list[int]]:
    """The directory whose buckets hold ``capacity`` keys at most, and each bucket's keys.

    ``count(prefixes)`` gives {(depth, prefix): keys} for FINER more bits below each (depth, prefix). A bucket as deep
    as the key is not split.
    """
    d, sizes = Directory(), [None]
    known: dict[tuple[int, int], int] = {}

    def size(local, prefix):
        if (local, prefix) in known:
            return known[local, prefix]
        if local % FINER == 0:
            return 0  # counted, and nothing found
        reach = min(FINER - local % FINER, 64 - local)
        return sum(known.get((local + reach, (prefix << reach) + i), 0) for i in range(1 << reach))

    total = sum(count([(0, 0)]).values())
    if not total:
        return d, [0]
    level = [(0, 0)]
    while level:
        known |= count(level)
        nxt, at = [], 0
        inside = set(level)
        while at < len(d.leaves):
            local, prefix = d.leaves[at]
            base = local - local % FINER
            if (base, prefix >> (local - base)) not in inside:
                at += 1
                continue
            n = total if local == 0 else size(local, prefix)
            if n <= capacity or local == 64:
                sizes[at] = n
                at += 1
                continue
            d.split(at)
            sizes[at : at + 1] = [None, None]
            if (local + 1) % FINER == 0:  # the halves are known, what lies below them is not
                for half in (0, 1):
                    if known.get((local + 1, 2 * prefix + half), 0) > capacity and local + 1 < 64:
                        nxt.append((local + 1, 2 * prefix + half))
                    else:
                        sizes[at + half] = known.get((local + 1, 2 * prefix + half), 0)
                at += 2
        level = nxt
    return d, sizes


def _histogram(keys: DataFrame):
    """``count`` of :func:`grow` over a table of distinct keys."""

    def count(prefixes):
        depth = prefixes[0][0]
        finer = min(depth + FINER, 64)
        prefix = lambda bits: F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
        rows = keys if depth == 0 else keys.filter(prefix(depth).isin([p - (1 << 64) if p >> 63 else p for _, p in prefixes]))
        found = rows.groupBy(prefix(finer).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        return {(finer, r.p % (1 << 64)): r.n for r in found}

    return count


def _owner_starts(directory: Directory, sizes: list[int], owners: int) -> np.ndarray:
    """Smallest key of each owner: runs of whole buckets with about equal numbers of keys."""
    upto = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    share = max(1, -(-sum(sizes) // owners))
    _, first = np.unique(upto // share, return_index=True)
    return directory.starts()[first]


def _located(starts: np.ndarray, name: str, spread: np.ndarray | None = None):
    """Add the number of the range of ``starts`` that a row's key lies in; rows of keys to ``spread`` go round."""

    def run(batches):
        import pyarrow as pa

        turn = 0
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            at = (np.searchsorted(starts, key, side="right") - 1).astype(np.int32)
            if spread is not None and len(spread):
                hot = np.flatnonzero(np.isin(key, spread))
                at[hot] = (turn + np.arange(len(hot))) % len(starts)
                turn += len(hot)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([at, *batch.columns], names=[name, *batch.schema.names])

    return run


def merge_copies(bodies, keys, digests, counts, tops):
    """Rows of equal bytes merged: places of the rows that stay, their counts and largest ids.

    Rows of one key are compared byte by byte with the different texts that the key has had so far.
    """
    chains: dict[int, list[int]] = {}
    n, top, stay = list(counts), list(tops), []
    for i, k in enumerate(keys):
        chain = chains.setdefault(k, [])
        same = next((j for j in chain if bodies[j] == bodies[i]), None)
        if same is None:
            if any(digests[j] == digests[i] for j in chain):
                raise ValueError(f"two texts of key {k} share a SHA-256")
            chain.append(i)
            stay.append(i)
            continue
        n[same] += n[i]
        top[same] = top[i] if top[same] is None else top[same] if top[i] is None else max(top[same], top[i])
    return stay, [n[i] for i in stay], [top[i] for i in stay]


_TEXTS = "key long, digest string, body binary, n long, top long, salts int"


def _merge(batches):
    """Copies inside an Arrow batch become one row."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            cols = {c: batch.column(c).to_pylist() for c in ("body", "key", "digest", "n", "top")}
            stay, n, top = merge_copies(*cols.values())
            at = pa.array(stay, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("digest").take(at), batch.column("body").take(at), pa.array(n, pa.int64()), pa.array(top, pa.int64()), batch.column("salts").take(at)], names=["key", "digest", "body", "n", "top", "salts"])


def _chain(with_text: bool):
    """Rows in order of (key, salt): the different texts of one key are chained, all others compared with them."""

    def run(batches):
        import pyarrow as pa

        now, chain = None, []  # [body, digest, n, top, salts] of each link

        def out():
            cols = [pa.array([now[0]] * len(chain), pa.int64()), pa.array([x[1] for x in chain], pa.string())]
            cols += [pa.array([x[0] for x in chain], pa.binary())] if with_text else [pa.array(range(len(chain)), pa.int32())]
            cols += [pa.array([x[2] for x in chain], pa.int64()), pa.array([x[3] for x in chain], pa.int64())]
            cols += [pa.array([x[4] for x in chain], pa.int32())] if with_text else []
            return pa.RecordBatch.from_arrays(cols, names=["key", "digest", "body", "n", "top", "salts"] if with_text else ["key", "digest", "link", "n", "top"])

        for batch in batches:
            for k, salt, digest, body, n, top, salts in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "digest", "body", "n", "top", "salts")), strict=True):
                if (k, salt) != now:
                    if chain:
                        yield out()
                    now, chain = (k, salt), []
                link = next((x for x in chain if x[0] == body), None)
                if link is None:
                    if any(x[1] == digest for x in chain):
                        raise ValueError(f"two texts of key {k} share a SHA-256")
                    chain.append([body, digest, n, top, salts])
                else:
                    link[2] += n
                    link[3] = top if link[3] is None else link[3] if top is None else max(link[3], top)
        if chain:
            yield out()

    return run


def build_index(entries: DataFrame, keys: DataFrame, capacity: int | None = None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(directory table, bucket files, smallest key of each owner) in the shared folder.

    The directory has a row a bucket (bucket, depth, prefix, keys); a bucket's entries lie together in their owner's
    file, in key order. Entries of hot keys, HOT_PARTS an owner at most, lie in the files of all owners.
    """
    spark = entries.sparkSession
    keys = keys if "n" in keys.columns else keys.withColumn("n", F.lit(1))
    total, rows = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    directory, sizes = grow(_histogram(keys), capacity or max(CAPACITY, total // MOST_BUCKETS))
    leaves = [(i, d, p - (1 << 64) if p >> 63 else p, n) for i, ((d, p), n) in enumerate(zip(directory.leaves, sizes, strict=True))]
    listed = table(spark.createDataFrame(leaves, "bucket int, depth int, prefix long, keys long").coalesce(1), "directory")
    starts = _owner_starts(directory, sizes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = keys.filter(F.col("n") > max(HOT, rows // (HOT_PARTS * len(starts)))).select("key").collect()
    spread = np.array([r.key for r in hot], np.int64).view(np.uint64)
    columns = "id long, key long, digest string"
    dealt = entries.select("id", "key", "digest").mapInArrow(_located(starts, "owner", spread), "owner int, " + columns).repartitionById(len(starts), F.col("owner")).drop("owner")
    buckets = table(dealt.mapInArrow(_located(directory.starts(), "bucket"), "bucket int, " + columns).sortWithinPartitions("bucket", F.shiftrightunsigned("key", 1), "key"), "buckets")
    return listed, buckets, starts


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key=None, hot: int = HOT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as the empty text. A null id
    loses against any id; if a whole group has null ids, keep_id is null and its rows are kept. Rows that
    repeat an id count in group_size and share that id's verdict. A very long text is compared like any other and
    moves only if its key repeats. Extra columns are ignored. An empty table gives an empty result. ``key`` (a function
    of the text column) is for tests that force collisions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), (key or F.xxhash64)(text).alias("key"), F.sha2(text, 256).alias("digest"), text_bytes(text))
    packed = pack_batches(src)
    entries = table(meta_rows(packed, "id long, key long, digest string"), "entries")
    keys = table(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    _, buckets, starts = build_index(entries, keys, capacity)

    # keys of one row need no comparison; the salts of a hot key are written with it
    salts = F.when(F.col("n") > hot, F.ceil(F.sqrt("n"))).otherwise(1).cast("int")
    repeated = table(keys.filter("n > 1").select("key", salts.alias("salts")), "repeated")
    asked = table(entries.join(repeated, "key").select("batch_id", "row", F.col("id").alias("top"), F.lit(1).cast("long").alias("n"), "salts"), "asked")
    texts = fetched(packed, asked, _TEXTS)
    # merged twice as text, by the batch and by salted groups: a hot key's owner gets sqrt(n) texts
    merged = texts.mapInArrow(_merge, _TEXTS)
    salted = table(merged, "texts")
    drop_table(packed)
    hot_rows = salted.filter("salts > 1").withColumn("salt", F.pmod(F.xxhash64("top", F.lit(3)), F.col("salts")).cast("int"))
    some = hot_rows.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_chain(True), _TEXTS)
    last = salted.filter("salts = 1").unionAll(some).withColumn("salt", F.lit(0))
    owned = last.mapInArrow(_located(starts, "owner"), "owner int, " + _TEXTS + ", salt int").repartitionById(len(starts), F.col("owner")).sortWithinPartitions("key", "salt")
    classes = table(owned.mapInArrow(_chain(False), "key long, digest string, link int, n long, top long"), "classes")
    out = buckets.join(classes.select("key", "digest", "n", "top"), ["key", "digest"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top"))  # no class: the key occurs once
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
}
