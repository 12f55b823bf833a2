import random

import numpy as np

import corpus_pipeline
from actloom.llm import near_copies
from actloom.llm.near_copies import near_copy_rows, verified_forest


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def groups(rows):
    """Rows (id, text) to groups of row numbers, by brute force over all pairs at 0.8 or more."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def edited(rng, text, n):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def made():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 300))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(rng, rng.choice(base), rng.randrange(1, 8))) for i in range(150)]
    rng.shuffle(rows)
    return rows


def stay(spark, rows):
    df = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, __k int").repartition(3)
    out = near_copy_rows(df)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_links_are_those_of_brute_force(spark, monkeypatch):
    rows = made()
    want = sorted((min((rows[i][0], rows[i][1]) for i in g) for g in groups(rows)), key=str)
    assert stay(spark, rows) == want
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", 3)  # groups cut into parts and blocks give the same rows
    assert stay(spark, rows) == want


def test_one_group_of_many_parts_and_components(spark, monkeypatch):
    """All texts are candidates of each other; parts, leader, largest component and rest find what brute force finds."""
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", 7)
    rng = random.Random(12)
    big = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    chain = [big]
    for _ in range(12):  # each is like the one before it, few are like the first
        chain.append(edited(rng, chain[-1], 1))
    rows = list(enumerate(chain + [edited(rng, big, 1) for _ in range(60)] + [t for _, t in made()[:60]]))
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "rid long, body binary")
    members = spark.createDataFrame([(i, len(t), -1, -(-len(rows) // 7), 0, i) for i, t in rows], "node long, size long, root long, blocks int, leader long, rid long")
    found = {r.node: r.root for r in near_copies.components(near_copies.verified_links(members, texts)).collect()}
    want = {i: min(g) for g in groups(rows) for i in g}
    assert {i: found.get(i, i) for i, _ in rows} == want


def test_chance_prints_lose_no_document(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(" ".join(f"u{i}x{k}" for k in range(80)) for i in range(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # all texts are candidates of each other: 64 bits link every print
    monkeypatch.setattr(corpus_pipeline, "NEAR_BITS", 64)
    monkeypatch.setattr(near_copies, "linked", lambda prints, radius: prints.crossJoin(prints.selectExpr("min(fp) as v")).selectExpr("fp as u", "v"))
    assert corpus_pipeline.near_duplicates(spark, df, "").count() == 12


def test_one_row_of_repeated_and_null_ids(spark):
    long = " ".join(f"a{i}" for i in range(100))
    rows = [(7, long), (7, long), (8, long), (None, "only null ids hold these words"), (None, "only null ids hold these words"), (None, None), (None, ""), (9, "one two"), (9, "another text of the id")]
    got = stay(spark, rows)
    assert [r for r in got if r[1]] == sorted([(7, long), (None, "only null ids hold these words"), (9, "one two"), (9, "another text of the id")], key=str)
    assert len([r for r in got if not r[1]]) == 1


def test_the_forest_spans_the_links():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [2, 3, 4, 5], [9], [], [], [9])]
    assert len(verified_forest(sets)) == 3
    assert verified_forest([]) == []
    known = [np.array(x, np.uint64) for x in ([1, 2], [8, 9], [1, 2, 3, 4, 5], [1, 2, 3, 4], [8, 9, 10, 11, 12])]
    assert verified_forest(known, joined=2) == [(3, 2)]  # the first two are joined, and nothing is compared with itself


def test_an_empty_table(spark):
    assert near_copy_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
