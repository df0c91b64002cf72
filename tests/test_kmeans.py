"""The k-means of many sets: the same at every size and on any partitioning, and what it equals."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapspark.config import ClusteringConfig
from gapspark.operators import clustering as C
from gapspark.operators import kmeans as K


def cloud(spark, n=400, dims=5, seed=0, scopes=1):
    rng = np.random.default_rng(seed)
    rows = [(s, f"r{i:05d}", [float(x) for x in rng.normal(0, 1, dims) + 3 * (i % 4)]) for s in range(scopes) for i in range(n)]
    return spark.createDataFrame(rows, "scope int, row_id string, vector array<double>")


def told(fits):
    labels = {(r.scope, r.row_id, r.fit): (r.cluster, round(r.distance, 9)) for r in fits.labels.collect()}
    best = {(r.scope, r.fit): (r.k, r.start, round(r.cost, 6), np.round(np.array(r.centres), 9).tolist()) for r in fits.best.collect()}
    return labels, best


@pytest.mark.parametrize("init", ["k-means||", "random"])
def test_same_centres_inside_tasks_by_passes_and_on_any_partitioning(spark, init):
    points = cloud(spark, scopes=2)
    jobs = spark.createDataFrame([(s, k, k, 42) for s in (0, 1) for k in (2, 3, 5)] + [(0, 99, 5, 43)], "scope int, fit int, k int, seed long")
    inside = told(K.fitted(points.repartition(1), jobs, n_init=3, init=init))
    assert set(inside[1]) == {(0, 2), (0, 3), (0, 5), (0, 99), (1, 2), (1, 3), (1, 5)} and len(inside[0]) == 400 * 7
    assert told(K.fitted(points.repartition(40), jobs, n_init=3, init=init, task_rows=10)) == inside
    mixed = points.where("scope = 0").unionByName(points.where("scope = 1").limit(50))  # a large scope and a small one
    small, both = told(K.fitted(mixed, jobs, n_init=2, init=init, task_rows=4096)), told(K.fitted(mixed, jobs, n_init=2, init=init, task_rows=100))
    assert small == both


def test_steps_are_those_of_plain_lloyd(spark):
    points = cloud(spark, 200)
    jobs = spark.createDataFrame([(0, 0, 4, 7)], "scope int, fit int, k int, seed long")
    r = K.fitted(points, jobs, n_init=1, init="random", tol=0.0).best.first()
    import hashlib

    rows = {p.row_id: np.array(p.vector) for p in points.collect()}
    c = np.array([rows[i] for i in sorted(rows, key=lambda i: hashlib.md5(f"7:0:{i}".encode()).hexdigest())[:4]])
    x = np.array([rows[i] for i in sorted(rows)])
    while True:
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[label == k].mean(0) for k in range(4)])
        if np.abs(new - c).max() < 1e-12:
            break
        c = new
    order = sorted(range(4), key=lambda k: np.flatnonzero(label == k)[0])
    assert np.allclose(np.array(r.centres), c[order]) and r.cost == pytest.approx(((x - c[label]) ** 2).sum())


def test_seeding_is_as_good_as_many_random_starts(spark):
    points = cloud(spark, 600)
    jobs = spark.createDataFrame([(0, 0, 4, 1)], "scope int, fit int, k int, seed long")
    one = K.fitted(points, jobs, n_init=1).best.first().cost
    assert one <= 1.001 * K.fitted(points, jobs, n_init=20, init="random").best.first().cost


def test_the_race_is_in_proportion_to_squared_distances():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    keys = np.arange(4)
    first = [int(K.race(x, keys, x[:1], 1, seed, 0, 1)[0][0]) for seed in range(4000)]
    share = np.bincount(first, minlength=4) / 4000
    assert np.allclose(share, np.array([0, 1, 4, 9]) / 14, atol=0.03)


def test_ties_repeats_and_more_clusters_than_places(spark):
    points = spark.createDataFrame([(0, i, [float(i % 2), 0.0]) for i in range(12)], "scope int, row_id long, vector array<float>")
    jobs = spark.createDataFrame([(0, 0, 4, 1), (0, 1, 2, 1)], "scope int, fit int, k int, seed long")
    for rows in (4096, 1):
        labels, best = told(K.fitted(points, jobs, n_init=2, task_rows=rows))
        assert all(labels[0, i, 0] == (i % 2, 0.0) and labels[0, i, 1] == (i % 2, 0.0) for i in range(12))
        assert best[0, 0][2] == 0.0 and len(best[0, 0][3]) == 4


def test_nearest_where_products_cancel():
    rng = np.random.default_rng(1)
    c = np.concatenate((rng.normal(1e6, 1e-3, (3, 4)), rng.normal(0, 1, (2, 4))))
    x = rng.normal(1e6, 1e-3, (50, 4))
    label, d = K.nearest(x, c)
    exact = ((x[:, None] - c) ** 2).sum(2)
    assert (label == exact.argmin(1)).all() and np.allclose(d, exact.min(1), rtol=1e-12)


def test_choice_of_k_at_every_size(spark):
    vectors = cloud(spark, 120).select("row_id", "vector")
    one = C.select_k(vectors, ClusteringConfig(n_init=3, k_max=6))
    far = C.select_k(vectors.repartition(9), ClusteringConfig(n_init=3, k_max=6, task_rows=20))
    assert (one.k, one.rule, one.k_range) == (far.k, far.rule, far.k_range)
    assert np.allclose(one.wcss, far.wcss) and np.allclose(one.silhouette, far.silhouette)


def test_silhouettes_of_several_labellings_at_once(spark):
    points = cloud(spark, 60, scopes=2)
    labels = points.select("scope", "row_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("fit")).withColumn("cluster", F.expr("cast(substr(row_id, 2) as int) % (fit * 2)"))
    labels = labels.unionByName(points.select("scope", "row_id", F.lit(9).alias("fit"), F.lit(0).alias("cluster")))
    whole = {(r.scope, r.fit): r.silhouette for r in C.silhouettes(points, labels).collect()}
    cut = {(r.scope, r.fit): r.silhouette for r in C.silhouettes(points, labels, block=7).collect()}
    assert whole.keys() == cut.keys() == {(s, f) for s in (0, 1) for f in (1, 2, 3, 9)}
    assert all(whole[k] == pytest.approx(cut[k], abs=1e-12) for k in whole) and whole[0, 9] == -1.0
    rows = [(int(r.row_id[1:]) % 4, np.array(r.vector)) for r in points.where("scope = 0").collect()]
    each = []
    for i, (c, v) in enumerate(rows):
        mean = {k: np.mean([np.linalg.norm(v - w) for j, (o, w) in enumerate(rows) if o == k and j != i]) for k in range(4)}
        a, b = mean[c], min(m for k, m in mean.items() if k != c)
        each.append((b - a) / max(a, b))
    assert whole[0, 2] == pytest.approx(np.mean(each))


def test_distances_of_5000_points_take_little_memory():
    x = np.random.default_rng(0).normal(size=(5000, 128))
    labels = np.random.default_rng(1).integers(0, 10, (9, 5000))
    tracemalloc.start()
    C.distance_sums(x, x, labels, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6


def test_distances_where_products_cancel():
    a = np.array([[1e6, 1.0], [1e6, 1.0 + 1e-4], [0.0, 0.0]])
    exact = np.sqrt(((a[:, None] - a) ** 2).sum(2))
    assert np.allclose(C.distances(a, a), exact, rtol=1e-9, atol=0)


def test_passes_use_all_cores_however_few_files_the_points_came_from(spark, monkeypatch):
    seen = []

    class Watched(K._Passes):
        def __init__(self, points, jobs, tol):
            seen.append(points.rdd.getNumPartitions())
            super().__init__(points, jobs, tol)

    monkeypatch.setattr(K, "_Passes", Watched)
    jobs = spark.createDataFrame([(0, 2, 2, 42)], "scope int, fit int, k int, seed long")
    K.fitted(cloud(spark).coalesce(1), jobs, n_init=1, init="random", task_rows=10)
    assert seen and seen[0] >= spark.sparkContext.defaultParallelism


def test_each_distance_serves_both_of_its_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(21, 4))
    of_a, of_b = np.eye(3)[rng.integers(0, 3, 30)], np.eye(3)[rng.integers(0, 3, 21)]
    d = np.sqrt(((a[:, None] - b) ** 2).sum(2))
    measured = []
    whole = C.distances
    monkeypatch.setattr(C, "distances", lambda x, y: measured.append(len(x) * len(y)) or whole(x, y))
    forth, back = C.distance_sums_both(a, b, of_a, of_b, numbers=100)
    assert np.allclose(forth, d @ of_b) and np.allclose(back, d.T @ of_a) and sum(measured) == 30 * 21 and max(measured) <= 100
