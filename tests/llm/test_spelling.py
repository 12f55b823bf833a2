"""Spelling groups against all pairs of words."""

import random
import re
from zlib import crc32

import pytest

from actloom.llm import spelling as S
from actloom.llm.spelling import Trie, chain_ends, one_edit, runs_of, spelling_groups, spelling_variants, word_counts


def edits(a, b):
    """Whether exactly one edit turns a into b, by trying all of them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts):
    out, form = [], {}
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def words(rng, n, letters="abß", low=1, high=6):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(20))
def test_trie(seed):
    rng = random.Random(seed)
    held = words(rng, 150)
    trie = Trie.from_bytes(Trie.built(held, range(len(held))).to_bytes())
    for w in words(rng, 100, "abßc", 0, 7) + held:
        got = [held[k] for k in trie.near(w)]
        assert sorted(got) == [v for v in held if edits(w, v)]
        for v in held:
            assert one_edit(w, v) == edits(w, v)


def test_long_words():
    a = "x" * 3_000_000
    held = sorted([a, a + "y", "y" + a, a[:1000] + "q" + a[1001:]])
    trie = Trie.built(held, [1] * 4)
    assert sorted(held[k] for k in trie.near(a)) == [v for v in held if v != a]


@pytest.mark.parametrize(("shard", "size"), [(500_000, 48 << 20), (7, 300)])
def test_groups(spark, monkeypatch, shard, size):
    monkeypatch.setattr(S, "SHARD_WORDS", shard)
    monkeypatch.setattr(S, "ROUND_BYTES", size)
    rng = random.Random(shard)
    counts = {w: 10 ** rng.randint(0, 5) + rng.randint(0, 2) for w in words(rng, 60)}
    got = [tuple(r) for r in spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()]
    assert sorted(got, key=repr) == brute(counts)


def test_round_sizes():
    assert S.rounds_of([("a", 5), ("b", 5), ("c", 9), ("d", 20), ("e", 1)], 10) == [["a", "b"], ["c"], ["d"], ["e"]]


def test_chains(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)] + [("v", "w000")]
    assert {r.word: r.root for r in chain_ends(spark.createDataFrame(forms, "word string, form string")).collect()} == {w: "w100" for w, _ in forms}


def test_runs_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 10)
    text = "Straße ÉTÉ × x1y àÿĀb " * 50
    assert [w for ws in runs_of(text.encode()) for w in ws] == ["straße", "ÉtÉ", "×", "x", "y", "àÿ", "b"] * 50


def test_edges(spark):
    schema = "doc_id long, text string, word string, n int, root string, body string"
    long = "lettere " * 300_000 + "q" * 400_000 + " " + "q" * 400_000
    data = [(1, None), (1, ""), (None, "abcdefg abcdefh"), (None, "abcdefg abcdefh"), (2, "abcdefg " * 30), (3, long), (3, "1 2 3")]
    frame = spark.createDataFrame([(*d, "w", 1, "r", "b") for d in data], schema)
    got = {r.word: tuple(r)[1:] for r in spelling_variants(frame).collect()}
    assert got == {
        "abcdefg": (None, "abcdefg", 32, 1, None), "abcdefh": ("abcdefg", "abcdefg", 2, 1, 32),
        "lettere": (None, "lettere", 300_000, 0, None), "q" * 400_000: (None, "q" * 400_000, 2, 0, None),
    }
    assert spelling_variants(spark.createDataFrame([], schema)).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, "no word")], "doc_id long, text string")).collect() == []


def test_planted_misspellings(spark):
    data = [(i, f"Wortlänge {i}anderes") for i in range(300)] + [(None, "wortlänge wortlänge")]
    want = {}
    for i, text in data:
        for run in re.findall("[a-zÀ-ÿ]+", text.lower()):
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] = want.get(run, 0) + 1
    got = {r.word: r.n for r in word_counts(spark.createDataFrame(data, "doc_id long, text string"), drop_every=31, min_count=1).collect()}
    assert got == want and len(got) > 2
