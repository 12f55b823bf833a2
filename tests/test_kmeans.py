"""Whole-table k-means against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actloom.operators import cluster, kmeans


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.6, (60, 4)) for c in (-4, 0, 5)])


def frame(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").repartition(5)


def brute(points, centers, rounds):
    """Labels, 0 at first, until they are stable; no cluster may lose all members."""
    labels = np.zeros(len(points), int)
    for i in range(rounds):
        new = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == labels).all() or i == rounds - 1:
            return new, centers
        labels, centers = new, np.array([points[new == c].mean(axis=0) for c in range(len(centers))])
    raise AssertionError


@pytest.mark.parametrize("rounds", [1, 2, 40])
def test_rounds(spark, points, rounds):
    starts = points[[0, 1, 2]]
    df = frame(spark, points)
    centers, took = kmeans.lloyd(df, "id", "v", starts.tolist(), rounds)
    labels, want = brute(points, starts, rounds)
    assert np.allclose(centers, want) and took <= rounds
    got = kmeans.labelled(df, "id", "v", centers).collect()
    assert [r.cluster_id for r in sorted(got, key=lambda r: r.id)] == labels.tolist()
    assert all(abs(r.distance - ((points[r.id] - centers[r.cluster_id]) ** 2).sum()) < 1e-9 for r in got)


def test_one_center_stays_at_its_start(spark, points):
    centers, took = kmeans.lloyd(frame(spark, points), "id", "v", [points[7].tolist()])
    assert took == 1 and np.allclose(centers, points[7])


def test_lost_clusters_go_on_elsewhere(spark, points):
    starts = [[900.0] * 4, [901.0] * 4, points[0].tolist()]
    centers, _ = kmeans.lloyd(frame(spark, points), "id", "v", starts, 30)
    assert np.abs(centers).max() < 10
    scoped = frame(spark, points).withColumn("s", F.lit("a"))
    assert {r.cluster_id for r in cluster.kmeans_scoped(scoped, "s", "v", "id", 3).collect()} == {0, 1, 2}


def test_starts_follow_squared_distances(spark):
    """Of two rows at distances 1 and 3 the farther is drawn nine times in ten."""
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [-3.0])], "id long, v array<double>")
    first = df.select("id", "v", F.lit(1).alias("one"))
    drawn = []
    for seed in range(60):
        a, b = kmeans.dsquared_starts(first, "id", "v", 2, seed)
        if a[0] == 0:
            drawn.append(b[0])
    assert len(drawn) >= 10 and drawn.count(2) >= 0.7 * len(drawn)


def test_starts_of_few_and_repeated_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)] + [(9, None)], "id long, v array<double>")
    starts = kmeans.dsquared_starts(df, "id", "v", 10)
    assert len(starts) == 10 and {r for r, _ in starts} <= {0, 1, 2, 3}
    got = {r.id: r.cluster_id for r in kmeans.kmeans_stable(df, "id", "v", 3).collect()}
    assert got[9] is None and {got[i] for i in range(4)} == {0}
    assert kmeans.kmeans_stable(df.limit(0), "id", "v", 3).collect() == []


def test_minibatches_find_the_clouds(spark, points):
    got = {r.id: r.cluster_id for r in kmeans.minibatch(frame(spark, points), "id", "v", 3, batch=60, max_iter=15).collect()}
    assert all(len({got[i] for i in range(b, b + 60)}) == 1 for b in (0, 60, 120)) and len(set(got.values())) == 3
