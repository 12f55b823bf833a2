import random

import numpy as np
import xxhash

from actloom.llm.simhash_dedup import allocate, fingerprint, op7_simhash_dedup, simhash_components


def print_of(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, radius=3):
    """rows: (id, fingerprint) -> {(id, hex, component)}."""
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprint():
    for t in (None, "", " \t\n", "One", "one TWO", "A b c", "É é A ü x y z " * 30, "\x0b\x0ca\x1cb c d"):
        assert fingerprint((t or "").encode()) == print_of(t)


def test_edge_cases_and_blocks(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 400))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)] + [(40, None), (41, ""), (42, " \n"), (None, base[0]), (None, "solo text of a null id here"), (7, base[7]), (7, base[8])]
    for i in range(50, 140):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(9))
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, fp int").repartition(3)
    want = classes([(d, print_of(t)) for d, t in rows])
    assert got(simhash_components(df)) == want
    assert got(simhash_components(df, block=7)) == want
    assert got(simhash_components(df, radius=7)) == classes([(d, print_of(t)) for d, t in rows], 7)


def test_thresholds_obey_the_pigeonhole():
    a = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for total, radius in ((10, 3), (10**4, 3), (10**7, 3), (10**10, 3), (10**5, 7), (10**5, 1)):
        plan = allocate(a, total, radius)
        assert plan and sum(len(b) for b, _ in plan) <= 64
        rng = random.Random(2)
        for _ in range(300):  # so many flips stay within a threshold somewhere
            flips = set(rng.sample(range(64), radius))
            assert any(len(flips & set(bits)) <= t for bits, t in plan)


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, print_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op7_simhash_dedup(spark, sf_dir)) == classes(rows)
