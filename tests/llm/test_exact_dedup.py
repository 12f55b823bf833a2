"""The extendible-hash index against brute force: doubling, forced collisions, hot keys, very long texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from actloom.llm.exact_dedup import FINER, Directory, build_index, exact_dedup, grow, merge_copies


def counter(keys):
    """Prefix counts of unsigned keys as Spark gives them."""

    def count(prefixes):
        depth = prefixes[0][0]
        finer, found = min(depth + FINER, 64), {}
        for k in keys:
            if (depth, k >> (64 - depth) if depth else 0) in prefixes:
                p = (finer, k >> (64 - finer))
                found[p] = found.get(p, 0) + 1
        return found

    return count


def test_a_full_depth_bucket_doubles_the_directory():
    d = Directory()
    d.split(0)
    assert (d.depth, d.slots()) == (1, [0, 1])
    d.split(1)
    assert (d.depth, d.slots()) == (2, [0, 0, 1, 2])  # doubled: the shallow bucket has two slots
    d.split(0)
    assert (d.depth, d.slots()) == (2, [0, 1, 2, 3])  # not doubled: the bucket was shallower
    assert d.starts().tolist() == [0, 1 << 62, 2 << 62, 3 << 62]


@pytest.mark.parametrize("seed", range(6))
def test_buckets_hold_their_capacity(seed):
    rng = random.Random(seed)
    keys = sorted({rng.getrandbits(64) for _ in range(400)} | {(5 << 50) + i for i in range([0, 90][seed % 2])})
    capacity = rng.choice([1, 3, 20, 1000])
    d, sizes = grow(counter(keys), capacity)
    owner = np.searchsorted(d.starts(), np.array(keys, np.uint64), side="right") - 1
    assert np.bincount(owner, minlength=len(sizes)).tolist() == sizes and max(sizes) <= capacity
    assert d.depth == max(x for x, _ in d.leaves) and sum(2.0**-x for x, _ in d.leaves) == 1
    for (depth, prefix), other in zip(d.leaves, sizes, strict=True):  # no bucket was split without need
        if depth:
            sibling = sum(1 for k in keys if k >> (65 - depth) == prefix >> 1)
            assert sibling > capacity, (depth, prefix, other)


def test_keys_that_agree_in_all_but_the_last_bit():
    d, sizes = grow(counter([6, 7]), 1)
    assert d.depth == 64 and sum(sizes) == 2 and max(sizes) == 1
    assert grow(counter([]), 4)[1] == [0]


def test_copies_are_compared_by_bytes():
    stay, n, top = merge_copies([b"x", b"y", b"x", b"y", b"x"], [1, 1, 1, 1, 2], ["a", "b", "a", "b", "a"], [1, 2, 3, 4, 5], [None, 9, 7, 3, None])
    assert (stay, n, top) == ([0, 1, 4], [4, 6, 5], [7, 9, None])
    with pytest.raises(ValueError):
        merge_copies([b"x", b"y"], [1, 1], ["a", "a"], [1, 1], [1, 2])


def documents():
    rng = random.Random(3)
    texts = [None, "", "x", "X", "ünï 文字", "long " * 3000] + [f"text {i}" for i in range(40)]
    rows = [(rng.randrange(200) if rng.random() > 0.05 else None, rng.choice(texts)) for _ in range(300)]
    return rows + [(1000 + i, "hot text") for i in range(150)] + [(None, "only null ids"), (None, "only null ids")]


KEYS = {
    "hash": None,
    "one chain": lambda c: F.lit(5).cast("long"),
    "many chains": lambda c: F.length(c).cast("long"),
    "top and bottom of the range": lambda c: F.when(F.length(c) % 2 == 0, F.lit(-1)).otherwise(F.lit(0)).cast("long"),
}


@pytest.mark.parametrize("name", KEYS)
@pytest.mark.parametrize("options", [{}, {"capacity": 2, "hot": 3}])
def test_groups_equal_brute_force(spark, name, options):
    rows = documents()
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    want = []
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    df = spark.createDataFrame([(t, d, 1, "k") for d, t in rows], "text string, doc_id long, n int, key string").repartition(4)
    got = [tuple(r) for r in exact_dedup(df, key=KEYS[name], **options).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_index_lies_in_the_shared_folder(spark):
    entries = spark.range(1000).select("id", F.xxhash64("id").alias("key"), F.lit("d").alias("digest"))
    directory, buckets, starts = build_index(entries, entries.select("key"), 30)
    sizes = {r.bucket: r.n for r in buckets.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert all(sizes.get(r.bucket, 0) == r["keys"] <= 30 for r in directory.collect()) and sum(sizes.values()) == 1000
    assert len(starts) > 1 and all("actloom-buckets" in f for f in buckets.inputFiles())


def test_long_text(spark):
    long = "abcdefgh " * (50 << 20 >> 3)
    rows = [(1, long), (2, long + "x"), (3, "s"), (4, long)]
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (4, 2), 2: (2, 1), 3: (3, 1), 4: (4, 2)}
