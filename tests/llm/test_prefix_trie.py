"""The prefix trie against a dictionary of prefixes, with many partitions, long chains and hot prefixes."""

import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from actloom.llm import prefix_trie as T
from actloom.llm.prefix_trie import conversation_trie, op13_prefix_trie, ordered_turns, prefix_trie, rebuilt, turn_arrays


def brute(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].split()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, convs):
    return spark.createDataFrame([(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)], "conv_id long, turn int, role string, text string")


@pytest.mark.parametrize("parts", [1, 3, 17])
@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, monkeypatch, parts, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(T, "HELD", 2)
    monkeypatch.setattr(T, "CHUNK", 3)
    convs = {c: [("u", rng.choice("ab") + " x" * rng.randint(0, 1)) for _ in range(rng.randint(1, 6))] for c in rng.sample(range(-50, 300), 120)}
    convs |= {1000 + c: [("u", "a")] * 4 for c in range(60)} | {2000 + c: [("u", "hot"), ("a", str(c))] for c in range(60)}
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert rows(conversation_trie(frame(spark, convs))) == brute(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_long_chains_and_turnless(spark):
    convs = {7: [("u", "w w")] * 3000, 8: [("u", "w w")] * 2999 + [("u", "z")], 9: []}
    arrays = turn_arrays(ordered_turns(frame(spark, convs)).unionByName(spark.createDataFrame([(9, None, None, None)], "conv_id long, pos int, digest binary, words int")))
    got = rows(prefix_trie(arrays))
    assert len(got) == 3002 and got[0][:7] == (7, 0, -1, 3, 1, 2, 2999 * 2) and got[0][7] == hashlib.sha256(b"9").hexdigest()
    assert (8, 3000, 7, 1, 0, 1, 0, hashlib.sha256(b"8").hexdigest()) in got


def test_edges(spark):
    schema = "conv_id long, turn int, role string, text string, pos string, digest int, key int, words string, kind int"
    data = [(1, None, None, None), (1, 2, "u", "b"), (1, 2, "u", "a"), (2, 1, "", ""), (2, 3, "u", "a"), (None, 1, "u", "x"), (3, 1, "u", "long " * 200_000), (3, 1, "u", "long " * 200_000)]
    want = {1: [("", ""), ("u", "a"), ("u", "b")], 2: [("", ""), ("u", "a")], 3: [("u", "long " * 200_000)] * 2}
    assert rows(conversation_trie(spark.createDataFrame([(*d, "p", 1, 2, "w", 3) for d in data], schema))) == brute(want)
    assert conversation_trie(spark.createDataFrame([], schema)).collect() == []
    # a turn is told by where its role ends, too
    assert conversation_trie(spark.createDataFrame([(1, 1, "ab", "c"), (2, 1, "a", "bc")], "conv_id long, turn int, role string, text string")).count() == 3


def test_query_by_brute_force(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text").collect():
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    made = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 4
        made[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    assert rows(op13_prefix_trie(spark, sf_dir)) == brute(made)


def test_rebuilt_can_be_turnless(spark):
    c = next(c for c in range(21, 40) if crc32(str(c).encode()) % 4 == 3)
    made = rebuilt(ordered_turns(spark.createDataFrame([(c, 1, "u", "a")], "conv_id long, turn int, role string, text string")))
    assert [(r.conv_id, r.pos) for r in made.collect()] == [(c, None)]
    assert rows(prefix_trie(turn_arrays(made))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
