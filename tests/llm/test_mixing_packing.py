"""The whole queries op3 and op8 against brute force on small tables."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from actloom.llm.mixing import REPEAT, SHARD_BLOCKS, apportion, mix, mixed_documents, selected, targets
from actloom.llm.packing import BUDGET, EXACT, boundaries, pack


def words(t):
    return sum(1 for w in (t or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w)


def brute_targets(sizes):
    """Weights 5, 2, 1 over 150 % of all words; water poured over the cups that are not full yet."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got, left = [0.0] * len(sizes), 1.5 * sum(sizes)
    for _ in range(10_000):
        free = [i for i in range(len(sizes)) if got[i] < 2 * sizes[i] - 1e-9]
        if not free or left < 1e-9:
            break
        step = min([left / sum(w[i] for i in free)] + [(2 * sizes[i] - got[i]) / w[i] for i in free])
        for i in free:
            got[i] += step * w[i]
        left -= step * sum(w[i] for i in free)
    return got


def test_targets_equal_poured_water():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 12))]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6) for a, b in zip(targets(sizes), brute_targets(sizes), strict=True))


def brute_mix(rows, shard_of, order_of, blocks, seed):
    """rows: (source, size). Words taken of each, block after block, by the apportionment itself."""
    names = sorted({s for s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for s, n in rows if s == name) for name in names]
    aims = brute_targets(sizes)
    block = max(1, math.ceil(1.5 * sum(sizes) / blocks))
    seats = apportion(aims, round(sum(aims) / block), [math.ceil(REPEAT * s / block) for s in sizes])
    taken = [0] * len(rows)
    for k, name in enumerate(names):
        count = max(1, math.ceil(sizes[k] / (SHARD_BLOCKS * block)))
        shards = {}
        for i, (s, _) in enumerate(rows):
            if s == name:
                shards.setdefault(shard_of(i, count), []).append(i)
        held = sorted((x, sum(rows[i][1] for i in members)) for x, members in shards.items())
        got = apportion([s for _, s in held], seats[k], [math.floor(REPEAT * s / block) for _, s in held])
        for (x, size), q in zip(held, got, strict=True):
            quota = REPEAT * size if aims[k] >= REPEAT * size and aims[k] >= REPEAT * sizes[k] else q * block
            passes, begin, stop = selected(size, quota, block, (k, x, seed))
            line = [i for i in sorted(shards[x], key=order_of) for _ in range(rows[i][1])]  # one entry a word
            for i in shards[x]:
                taken[i] += passes * rows[i][1]
            for at in range(begin, stop):
                taken[line[at % size]] += 1
    return taken


def test_mix_equals_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice(["a", "b", "c", "d", "d", "d", None]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 300]))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    for blocks, seed in ((64, 17), (4096, 3)):
        keys = {r.doc_id: (r.h, r.o, r.fp) for r in df.withColumn("fp", F.xxhash64("text")).withColumns({"h": F.xxhash64("doc_id", "fp", F.lit(seed)), "o": F.xxhash64("doc_id", "fp", F.lit(seed + 1))}).collect()}
        want = brute_mix([(s, words(t)) for _, s, t in docs], lambda i, n: keys[i][0] % n, lambda i: (keys[i][1], i), blocks, seed)
        got = {r.doc_id: r.taken for r in mix(df, blocks=blocks, seed=seed).collect()}
        assert [got[i] for i in range(len(docs))] == want


def test_selection_wraps_around_and_fills():
    assert selected(0, 0, 5, 1) == (0, 0, 0)
    for seed in range(50):
        passes, begin, stop = selected(23, 30, 5, seed)
        assert passes == 1 and begin % 5 == 0 and begin < 23 and stop - begin == 7
    assert len({selected(230, 30, 5, seed)[1] for seed in range(200)}) > 20


def test_documents_of_the_mix_are_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    out = mixed_documents(docs).collect()
    copies, total, aim, by = Counter(r.doc_id for r in out), Counter(), {}, {r.doc_id: r for r in mix(docs).collect()}
    assert max(copies.values()) <= 2 and all(before[r.doc_id] == r for r in out)
    for r in out:
        total[r.source] += words(r.text)
    for i, r in by.items():
        aim[before[i].source] = r.target
    longest = max(words(r.text) for r in before.values())
    assert all(abs(total[s] - t) <= 2 * longest for s, t in aim.items())
    # equal rows share
    twice = spark.createDataFrame([(1, "a", "x y")] * 2 + [(2, "b", "z " * 50)], "doc_id long, source string, text string")
    assert max(Counter(r.doc_id for r in mixed_documents(twice).collect()).values()) <= 4


def brute_padding(lengths, buckets):
    """Least padding over all choices of boundaries among the lengths themselves."""
    q = sorted(set(lengths))
    count = Counter(lengths)
    cost = [[sum((q[j] - q[m]) * count[q[m]] for m in range(i, j + 1)) for j in range(len(q))] for i in range(len(q))]
    best = [cost[0][j] for j in range(len(q))]
    for _ in range(buckets - 1):
        best = [min([best[j]] + [best[i - 1] + cost[i][j] for i in range(1, j + 1)]) for j in range(len(q))]
    return best[-1]


def test_packing_equals_brute_force(spark):
    rng = random.Random(9)
    lengths = [0, 0, 1, 1, 2] + [rng.choice([3, 8, 9, 40, 41, 100, 333, 1000, 1024]) for _ in range(120)] + [1999]
    df = spark.createDataFrame([(i if i % 9 else None, " ".join(["w"] * n)) for i, n in enumerate(lengths)], "doc_id long, text string").repartition(3)
    for buckets in (1, 3, 5):
        rows = pack(df, buckets=buckets, budget=4000).collect()
        assert sorted(r.n_tokens for r in rows) == sorted(lengths)
        assert sum(r.padding for r in rows) == brute_padding(lengths, buckets)
        assert all(r.padded_to == min(x.padded_to for x in rows if x.padded_to >= r.n_tokens) for r in rows)
        held = Counter((r.bucket, r.batch) for r in rows)
        for r in rows:
            cap = max(1, 4000 // max(1, r.padded_to))
            assert 0 <= r.slot < held[r.bucket, r.batch] <= cap
        for b in {r.bucket for r in rows}:
            n, cap = sum(r.bucket == b for r in rows), max(1, 4000 // max(1, next(r.padded_to for r in rows if r.bucket == b)))
            assert sorted((r.batch, r.slot) for r in rows if r.bucket == b) == [(i // cap, i % cap) for i in range(n)]


def test_long_lengths_are_padded_to_a_length_that_occurs(spark):
    rng = random.Random(2)
    lengths = [rng.randrange(1, 9000) for _ in range(300)]
    rows = pack(spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(lengths)], "doc_id long, text string")).collect()
    assert {r.padded_to for r in rows} <= set(lengths) and EXACT < max(r.padded_to for r in rows) == max(lengths)
    assert BUDGET > max(lengths) and boundaries([5, 9], [1, 1], 1) == [9]
