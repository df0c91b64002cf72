import numpy as np
import pytest

from gapspark.config import CombinationWeights, GapConfig
from gapspark.operators import pairs as P

SCHEMA = "cluster int, keyword string, first struct<row_id:long,pos:int>, frequency long, tfidf double, vector array<double>"


def bundles(seed, clusters=2, n=240, bundle=20, dims=40, spread=0.02):
    """Keywords in tight bundles around axes that stand at 60 degrees or at right angles to each other, and some vectors without length."""
    rng = np.random.default_rng(seed)
    axes = np.eye(dims)[: n // bundle]
    axes[1::2] = 0.5 * axes[::2] + np.sqrt(0.75) * axes[1::2]
    out = []
    for c in range(clusters):
        for i in range(n):
            v = axes[i // bundle] * (1 + i % 3) + spread * rng.normal(size=dims)
            out.append((c, f"c{c} k{i}", (int(rng.integers(1000)) * 1000 + i, i % 4), int(rng.integers(2, 12)), float(rng.random() * 0.12), (v * (i % 53 != 5)).tolist()))
    return out


def brute(rows, met, config):
    w, best = config.combination_weights, config.combination_similarity_optimum
    (low, high), out = config.combination_similarity_range, {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[2])
        x = P.unit(np.array([r[5] for r in mine]))
        sim, found = x @ x.T, []
        for i, a in enumerate(mine):
            for j in range(i + 1, len(mine)):
                b, t = mine[j], (a[4] + mine[j][4]) / 2
                if low < sim[i, j] < high and t >= config.min_tfidf and (c, *sorted((a[1], b[1]))) not in met:
                    score = w.similarity * (1 - 2 * abs(sim[i, j] - best)) + w.frequency * min((a[3] + b[3]) / 10, 1) + w.tfidf * min(10 * t, 1)
                    found.append((-round(score, 9), a[2], b[2], a[1], b[1]))
        out[c] = sorted(found)
    return out


@pytest.mark.parametrize("config,share", [
    (GapConfig(min_tfidf=0.005), 0.5),
    (GapConfig(min_tfidf=0.05, combination_similarity_range=(0.3, 0.6), max_gaps_per_cluster=7), 0.5),
    (GapConfig(min_tfidf=0.0, combination_weights=CombinationWeights(1.3, -0.5, 0.2), max_gaps_per_cluster=5), 1.0),  # rare keywords score best: looser bounds
])
def test_best_pairs_equal_brute_force_and_skip_blocks(spark, config, share):
    rows = bundles(3)
    every = brute(rows, set(), config)
    met = {(c, *sorted(p[3:])) for c, ps in every.items() for p in ps[:4:2]}  # the best and the third best occur together
    want = {(c, p[3], p[4], round(-p[0], 6)) for c, ps in brute(rows, met, config).items() for p in ps[: config.max_gaps_per_cluster]}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    together = spark.createDataFrame(sorted(met), "cluster int, left string, right string")
    log = []
    got = {(r.cluster, r.keyword_1, r.keyword_2, round(r.score, 6)) for r in P.best_pairs(df, together, config, block=20, wave=4, log=log).collect()}
    assert got == want and len(want) == 2 * config.max_gaps_per_cluster
    assert log[0]["compared"] < log[0]["all"] * share  # the other pairs of blocks were never multiplied
    one = {(r.cluster, r.keyword_1, r.keyword_2, round(r.score, 6)) for r in P.best_pairs(df, together, config).collect()}
    assert one == want


def test_bounds_hold_for_every_pair(spark):
    rows = bundles(5, clusters=1, n=80, spread=0.3)
    config = GapConfig(min_tfidf=0.0, combination_similarity_range=(0.0, 0.999))
    cells, pivots = P.placed(spark.createDataFrame(rows, SCHEMA), ["cluster"], P._merit(config), 10)
    bounds = P.block_pairs(cells, pivots, ["cluster"], config).toPandas()
    at = {(tuple(r.i), tuple(r.j)): r for r in bounds.itertuples()}
    cells = cells.toPandas()
    x, w = P.unit(np.array(cells["vector"].tolist())), config.combination_weights
    key = list(zip(cells["pivot"], cells["block"]))
    assert len(set(key)) > 8
    for a in range(len(cells)):
        for b in range(a):
            r = at[min(key[a], key[b]), max(key[a], key[b])]
            sim, t = x[a] @ x[b], (cells["tfidf"][a] + cells["tfidf"][b]) / 2
            score = w.similarity * (1 - 2 * abs(sim - config.combination_similarity_optimum)) + w.frequency * min((cells["frequency"][a] + cells["frequency"][b]) / 10, 1) + w.tfidf * min(10 * t, 1)
            assert r.low <= sim <= r.high and (score <= r.bound or not config.combination_similarity_range[0] < sim < config.combination_similarity_range[1])


def test_a_hot_bundle_is_cut_and_nothing_gives_nothing(spark):
    rows = bundles(7, clusters=1, n=60, bundle=60)
    config = GapConfig(min_tfidf=0.0, combination_similarity_range=(0.1, 0.99999))
    cells, _ = P.placed(spark.createDataFrame(rows, SCHEMA), ["cluster"], P._merit(config), 10)
    assert cells.groupBy("pivot", "block").count().agg({"count": "max"}).first()[0] <= 20 and cells.count() == 60
    none = spark.createDataFrame([], "cluster int, left string, right string")
    empty = P.best_pairs(spark.createDataFrame([], SCHEMA), none, config)
    assert empty.collect() == [] and {"keyword_1", "first_2", "score"} <= set(empty.columns)
    outside = P.best_pairs(spark.createDataFrame(rows[:1], SCHEMA), none, config)
    assert outside.collect() == []
