"""What a task of the group keys holds does not grow with its texts."""

import tracemalloc

import pyarrow as pa

from actloom.operators import cluster


def test_pieces_are_of_bounded_bytes_and_whole():
    texts = pa.array(["x" * 1000] * 5000 + [None, "y" * (3 << 20), ""])
    pieces = list(cluster._pieces(texts))
    assert [t for _, p in pieces for t in p.to_pylist()] == texts.to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= cluster.PIECE for _, p in pieces)
    assert [b for b, _ in pieces] == [sum(len(p) for _, p in pieces[:i]) for i in range(len(pieces))]


def test_digests_of_many_words_are_not_all_kept():
    keys = cluster._fingerprints(12)
    tracemalloc.start()
    for i in range(20):
        keys(pa.array([" ".join(f"w{i}x{j}x{k}" for k in range(20)) for j in range(1000)]))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 20e6, held  # 400,000 words met


def test_a_key_is_the_same_in_every_slice():
    texts = pa.array(["alpha beta gamma", None, "the of", "delta " * 300_000, "alpha beta gamma"])
    keys = cluster._fingerprints(12)
    whole = keys(texts).to_pylist()
    assert whole == [k for i in range(len(texts)) for k in keys(texts.slice(i, 1)).to_pylist()] and whole[1:3] == [0, 0] and whole[0] == whole[4] != 0
