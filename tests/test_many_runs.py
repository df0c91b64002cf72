"""Runs as keys of one plan: the same rows as runs made one by one, and what they cost."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from gapspark.config import ClusteringConfig, EncoderConfig, GapConfig, RunConfig
from gapspark.functions.quantiles import exact_quantiles
from gapspark.functions import scores
from gapspark.plans import consensus, pipelines
from gapspark.sources import corpus as S

CONFIG = RunConfig(None, None, EncoderConfig(dimensions=8), EncoderConfig(dimensions=8), ClusteringConfig(k_max=4, n_init=2), GapConfig(max_keyword_frequency=2, min_tfidf=0.0, combination_similarity_range=(0.0, 0.99)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    themes = ["water", "energy", "health", "law"]
    rows = []
    for i in range(60):
        t = themes[i % 4]
        kws = [f"{t} policy", f"{t} {rng.choice(['model', 'survey', 'market'])}", f"{t} rare{i % 9}"] + ([f"{rng.choice(themes)} bridge"] if i % 3 == 0 else [])
        rows.append((f"{t} study {i}", f"On {t} {t} policy and {rng.choice(['model', 'survey', 'market'])} in place {i % 5}", "; ".join(kws), str(2000 + i % 20), str(i * 2), f"10.1/{i}"))
    return S.from_dataframe(spark.createDataFrame(rows, "Title string, Abstract string, `Author Keywords` string, Year string, `Cited by` string, DOI string").coalesce(1))


def told(rows):
    return sorted((r.gap_type, r.keyword, r.keyword_display, round(r.score, 9), r.frequency, r.cluster_label) for r in rows)


@pytest.mark.parametrize("mode, problem, gaps", [("articles_first", None, {"min_citations": 4}), ("keywords_first", "energy market", {"max_keyword_frequency": None})])
def test_runs_are_those_of_the_loop(corpus, mode, problem, gaps):
    config = CONFIG.replace(problem_description=problem, gaps=dataclasses.replace(CONFIG.gaps, periphery_percentile=60.0, **gaps))
    sizes, seeds = [30, None], [5, 6]
    found = consensus.consensus_gaps(corpus, mode, config, seeds=seeds, sizes=sizes)
    assert {(r.run_id, r.seed, r.size) for r in found.grid.collect()} == {(i, seed, size) for i, (size, seed) in enumerate((n, x) for n in sizes for x in seeds)}
    rows = found.runs.collect()
    for size, seed in ((30, 6), (None, 5)):
        one = pipelines.run(corpus, mode, config.replace(top_n_articles=size).seeded(seed))
        mine = [r for r in rows if r.seed == seed and r.size == size]
        assert told(mine) == told(one.gaps.select("gap_type", "keyword", "keyword_display", "score", "frequency", "cluster_label").collect())
        assert mine or mode == "keywords_first"


def test_twenty_runs_cost_less_than_three(spark, corpus):
    """In Spark jobs, which a loaded machine does not change."""
    config = CONFIG.replace(top_n_articles=40)
    sc = spark.sparkContext

    def jobs(name, work):
        sc.setJobGroup(name, name)
        try:
            work()
        finally:
            sc.setJobGroup("rest", "rest")
        return len(sc.statusTracker().getJobIdsForGroup(name))

    def many():
        found = consensus.consensus_gaps(corpus, "articles_first", config, seeds=range(5), sizes=[30, 40, 50, 60])
        assert found.grid.count() == 20 and found.summary()["n_pooled"] > 0

    one = jobs("one", lambda: pipelines.run(corpus, "articles_first", config).gaps.count())
    assert one > 10 and jobs("many", many) < 3 * one


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(500)] + [("b", 1.0)] * 40 + [(None, float(i % 3)) for i in range(17)] + [("c", 10.0 ** -i) for i in range(30)] + [("d", None), ("e", 7.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.quantile for r in exact_quantiles(df, ["g"], "x", share).collect()}
        expected = {r.g: r.q for r in df.where("x is not null").groupBy("g").agg(F.percentile("x", F.lit(share)).alias("q")).collect()}
        assert got.keys() == expected.keys() and all(got[g] == pytest.approx(expected[g], rel=1e-12, abs=1e-300) for g in got)


def test_scalings_equal_those_of_windows(spark):
    rows = [(g, float(x), float(y)) for g, x, y in [("a", 1, 5), ("a", 3, 5), ("a", 8, 5), ("b", 2, 1), ("c", 4, 1), ("c", 4, 9)]]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = scores.scaled(df, ("g",), {"mz": "z", "my": "y"}, {"z": "x"}).collect()
    by_window = df.withColumn("z", scores.zscore(F.col("x"), "g")).withColumns({"mz": scores.minmax(F.col("z"), "g"), "my": scores.minmax(F.col("y"), "g")}).collect()
    assert sorted((r.g, r.x, r.y, round(r.z, 12), round(r.mz, 12), round(r.my, 12)) for r in out) == sorted((r.g, r.x, r.y, round(r.z, 12), round(r.mz, 12), round(r.my, 12)) for r in by_window)
