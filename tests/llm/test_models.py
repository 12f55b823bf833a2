"""Held-out accuracy and brute-force versions of the trained and optimising operators."""

import itertools
import math
import random
from collections import Counter

from actloom.llm.line_dedup import line_dedup
from actloom.llm.mixing import apportion, mix, targets
from actloom.llm.packing import boundaries, op8_packing
from actloom.llm.quality_rules import cleaned_documents, quality_rules, repeated_words


def brute_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), votes[i], -i))
        got[i] += 1
    return got


def test_apportionment_equals_highest_quotients():
    rng = random.Random(4)
    for _ in range(200):
        votes = [rng.choice([rng.random() * 100, float(rng.randrange(1, 9)), 1e6]) for _ in range(rng.randrange(1, 12))]
        seats = rng.randrange(0, 60)
        assert apportion(votes, seats) == brute_seats(votes, seats)
    assert apportion([5, 5, 0], 9, [1, 2, 9]) == [1, 2, 0] and apportion([], 4) == [] and apportion([0, 0], 4) == [0, 0]


def test_targets_fill_and_stop_at_twice():
    t = targets([10, 1000, 1000, 50])
    assert t[0] == 20 and math.isclose(sum(t), 1.5 * 2060) and all(x <= 2 * s + 1e-9 for x, s in zip(t, [10, 1000, 1000, 50], strict=True))
    assert targets([]) == [] and targets([0, 0]) == [0, 0]


def test_mix_comes_near_its_targets(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, aim = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        aim[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= max(2, 0.01 * t) for s, t in aim.items())


def test_boundaries_are_optimal():
    rng = random.Random(6)
    for _ in range(60):
        h = rng.randrange(1, 8)
        q = sorted(rng.sample(range(1, 50), h))
        c = [rng.randrange(1, 20) for _ in q]
        k = rng.randrange(1, 5)
        cost = lambda ends: sum(min(e for e in ends if e >= x) * n for x, n in zip(q, c, strict=True))
        best = min(cost(ends) for m in range(1, min(k, h) + 1) for ends in itertools.combinations(q, m) if ends[-1] == q[-1])
        got = boundaries(q, c, k)
        assert len(got) <= k and cost(got) == best
    assert boundaries([], [], 4) == []


def test_batches_keep_their_budget(spark, sf_dir):
    rows = op8_packing(spark, sf_dir).collect()
    held = Counter((r.bucket, r.batch) for r in rows)
    for r in rows:
        assert r.n_tokens <= r.padded_to and r.padding == r.padded_to - r.n_tokens
        assert held[r.bucket, r.batch] * r.padded_to <= 65_536 or held[r.bucket, r.batch] == 1
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    for b in {r.bucket for r in rows}:  # all batches but one are full
        sizes = [n for (x, _), n in held.items() if x == b]
        assert sum(n < max(sizes) for n in sizes) <= 1


def test_repeated_words_equal_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        w = [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert repeated_words(w) == len(hit)


def test_boilerplate_depletes_a_document(spark):
    line = "this line stands in every document of the host and has many words in it"
    unique = lambda i, n: " ".join(f"u{i}x{j}" for j in range(n))
    rows = [(i, "h", f"{line.upper() if i % 2 else line}\n{unique(i, 60)}") for i in range(30)] + [(99, "h", "\n".join([line] * 2 + [unique(99, 40)][:1]).replace(unique(99, 40), unique(99, 10)) + " " + unique(7, 25)), (100, "g", f"{line}\n{unique(100, 60)}")]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(out[i].n_removed_words == 15 and out[i].kept for i in range(30))
    assert out[100].n_removed_words == 0 and out[100].kept
    assert out[99].n_removed_words == 30
    texts = {r.doc_id: r.text for r in cleaned_documents(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert texts == {i: unique(i, 60) for i in range(30)} | {100: rows[-1][2]} | ({99: rows[30][2].split("\n")[-1]} if out[99].kept else {})


def test_a_frequent_line_goes_from_a_host_of_any_size(spark):
    """21 documents are above the limit among 40 and among 4,000."""
    line = "home | about | contact"
    text = lambda h, i: " ".join(f"{h}{i}x{j}" for j in range(60))
    rows = [(n * 10_000 + i, f"h{n}", (f"{line}\n" if i < 21 else "") + text(f"h{n}", i)) for n in (40, 4000) for i in range(n)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)).filter("n_removed_words > 0").collect()
    assert sorted(r.doc_id for r in out) == [n * 10_000 + i for n in (40, 4000) for i in range(21)] and all(r.n_removed_words == 5 for r in out)


def test_a_hot_line_over_many_partitions(spark):
    hot, warm = "h" * 45, "w" * 44
    rows = [(i, "\n".join([hot, "short", warm if i < 4 else "z" * 50 + str(i), hot])) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == {i: (4, 0 if i == 299 else 2) for i in range(300)}


def test_rows_of_one_id_hold_a_line_without_bound(spark, monkeypatch):
    """Null ids are one document: its rows of a line are not held, and the line counts as one document more."""
    from actloom.llm import line_dedup as module

    monkeypatch.setattr(module, "HELD", 3)
    hot, cool = "h" * 45, "c" * 45
    rows = [(None, f"{hot}\n{i}") for i in range(40)] + [(i, f"{hot}\n{cool}\n{hot}") for i in range(4)] + [(None, cool)]
    rows += [(i, f"{cool}x" * 2) for i in range(9)]
    out = sorted((r.doc_id, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 4").collect())
    nulls = [r.n_dropped for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id is null").collect()]
    # hot and cool stand in four documents and the null one, of which the largest id keeps its lines; the second rows'
    # line stands in nine
    assert sorted(n for _, n in out) == [0, 1, 1, 1, 1, 3, 3, 3]
    assert nulls == [1] * 41
