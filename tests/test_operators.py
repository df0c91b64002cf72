"""Operators on small designed inputs with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from gapspark.config import ClusteringConfig, CombinationWeights, CrossClusterWeights, EmergingWeights, GapConfig
from gapspark.functions import scores, text as T, vectors as V
from gapspark.operators import clustering as C, detectors as D, keywords as K, tfidf as TF


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("raw,expected", [("  Deep  Learning\t", "deep learning"), ("A", "a"), ("", ""), ("x-Y", "x-y")])
def test_normalize_keyword(spark, raw, expected):
    assert one(spark, T.normalize_keyword(F.lit(raw))) == expected


def test_token_count(spark):
    assert [one(spark, T.token_count(F.lit(x))) for x in ("", " ", "a", "a  b c")] == [0, 0, 1, 3]


def test_split_author_keywords(spark):
    assert one(spark, T.split_author_keywords(F.lit("A b; C |d;; ; |"))) == ["A b", "C", "d"]
    assert one(spark, T.split_author_keywords(F.lit(None).cast("string"))) == []


def test_years_and_numbers(spark):
    assert [one(spark, T.coerce_year(F.lit(x))) for x in ("2019-03-01", "c. 1999/2000", "19", "", None)] == [2019, 1999, None, None, None]
    assert [one(spark, T.coerce_number(F.lit(x))) for x in (" 12 ", "n/a", "NaN", None)] == [12.0, None, None, None]


def test_methodological_terms(spark):
    told = {x: one(spark, T.is_methodological(F.lit(x))) for x in ("sem", "semantic web", "factor analysis of x", "case", "digital market", "spss")}
    assert told == {"sem": True, "semantic web": False, "factor analysis of x": True, "case": True, "digital market": False, "spss": True}


def test_scores(spark):
    lit = F.lit
    assert one(spark, scores.emerging(lit(1.0), lit(0.5), lit(0.8), lit(0.5), EmergingWeights())) == pytest.approx(0.715)
    assert one(spark, scores.combination(lit(0.45), lit(6), lit(6), lit(0.2), CombinationWeights(), 0.45)) == pytest.approx(1.0)
    assert one(spark, scores.combination(lit(-0.9), lit(0), lit(0), lit(0.0), CombinationWeights(), 0.45)) == pytest.approx(0.4 * (1 - 2.7))
    assert one(spark, scores.cross_cluster(lit(2), lit(0.1), lit(0.3), lit(0.6), CrossClusterWeights())) == pytest.approx(0.1 + 0.315 + 0.2)
    assert one(spark, scores.cross_cluster(lit(9), lit(0.0), lit(0.3), lit(0.0), CrossClusterWeights())) == pytest.approx(0.25 + 0.35)


def test_scalings_of_constants(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    got = {(r.g, r.x): (r.m, r.z) for r in rows.select("g", "x", scores.minmax(F.col("x"), "g").alias("m"), scores.zscore(F.col("x"), "g").alias("z")).collect()}
    assert got == {("a", 1.0): (0.0, -1.0), ("a", 3.0): (1.0, 1.0), ("b", 2.0): (0.5, 0.0)}


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(-3.0))
    assert one(spark, V.l2_normalize(a)) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.distance(a, b, "cosine")) == pytest.approx(1.0) and one(spark, V.distance(a, b, "euclidean")) == pytest.approx(math.sqrt(50))
    with pytest.raises(ValueError):
        V.distance(a, b, "manhattan")


def articles(spark, rows):
    """rows: (row_id, cluster, year, citations, keywords)"""
    return spark.createDataFrame([(i, f"t{i}", f"d{i}" if i % 2 else "", c, y, x, list(k), [z.lower() for z in k]) for i, c, y, x, k in rows], "row_id long, title string, doi string, cluster int, year int, citations double, author_keywords array<string>, keywords_normalized array<string>")


@pytest.fixture(scope="module")
def arts(spark):
    return articles(spark, [
        (0, 0, 2005, 60.0, ["Local theme", "Shared Theme"]), (1, 0, 2023, 60.0, ["shared theme", "alpha topic"]), (2, 0, 2024, None, ["beta topic"]),
        (3, 1, 2024, 1.0, ["Shared Theme", "remote theme"]), (4, 1, None, 7.0, ["remote theme", "solo theme", "three word theme"]), (5, 1, 2020, 2.0, []),
    ])


def test_frequencies_count_records_and_order_by_first_appearance(arts):
    got = [(r.keyword, r.kw_ord) for r in K.unique_keywords(K.keyword_bag(arts)).orderBy("kw_ord").collect()]
    assert [k for k, _ in got] == ["local theme", "shared theme", "alpha topic", "beta topic", "remote theme", "solo theme", "three word theme"] and [o for _, o in got] == list(range(7))
    assert {r.keyword: r.frequency for r in K.keyword_frequencies(K.keyword_bag(arts)).collect()}["shared theme"] == 3


def test_spelling_ties_go_to_the_first(arts):
    got = {r.keyword: r.spelling for r in K.spellings(arts).collect()}
    assert got["shared theme"] == "Shared Theme" and got["local theme"] == "Local theme"


def test_core_terms_are_strictly_above_the_share(spark, arts):
    f = K.keyword_frequencies(K.keyword_bag(arts))
    assert {r.keyword for r in K.core_terms(f, F.lit(6), 0.5).collect()} == set()
    assert {r.keyword for r in K.core_terms(f, F.lit(6), 0.49).collect()} == {"shared theme"}


def test_ceiling_rounds_half_to_even(spark):
    assert [one(spark, K.frequency_ceiling(F.lit(n))) for n in (10, 75, 125, 176)] == [1, 2, 2, 4]


def test_velocity_uses_the_latest_year_of_the_scope(arts):
    bag = K.keyword_bag(arts, "cluster")
    got = {(r.cluster, r.keyword): (r.citations, r.velocity) for r in K.citation_support(bag, arts, GapConfig(), "cluster").collect()}
    assert got[0, "local theme"] == (60.0, 3.0) and got[0, "alpha topic"] == (60.0, 30.0)
    assert got[0, "beta topic"] == (None, None) and got[1, "solo theme"] == (7.0, None)
    fixed = {r.keyword: r.velocity for r in K.citation_support(bag, arts, GapConfig(citation_year_reference=2034)).collect()}
    assert fixed["local theme"] == 2.0


@pytest.mark.parametrize("options,kept", [
    ({}, {"a", "b", "c"}), ({"min_citations": 5}, {"b", "c"}), ({"max_citations": 4}, {"a", "c"}), ({"min_citations": 5, "keep_uncited_candidates": False}, {"b"}), ({"min_citations_per_year": 1.5}, {"b", "c"}), ({"min_citations": 5, "max_citations": 5}, {"c"}),
])
def test_citation_filter(spark, options, kept):
    rows = spark.createDataFrame([("a", 3.0, 1.0), ("b", 9.0, 2.0), ("c", None, None)], "keyword string, citations double, velocity double")
    config = GapConfig(**options)
    assert {r.keyword for r in K.citation_filtered(rows.select("keyword"), rows, config).collect()} == kept


def test_tfidf_crosses_keywords_and_backs_off(spark):
    a = articles(spark, [(0, 0, None, None, ["deep learning", "c++"]), (1, 0, None, None, ["deep model"]), (2, 0, None, None, [])])
    voc = {r.term: r.score for r in TF.vocabulary(a, 1, 2).collect()}
    assert set(voc) == {"deep", "learning", "c", "deep learning", "learning c", "model", "deep model"}
    rare, common = math.log(3 / 2) + 1, 1.0
    n0 = math.sqrt(4 * rare**2 + common**2)
    assert voc["deep learning"] == pytest.approx(rare / n0 / 2) and voc["deep"] == pytest.approx((common / n0 + common / math.sqrt(2 * rare**2 + 1)) / 2)
    got = {r.keyword: (r.match_type, r.tfidf) for r in TF.matched_salience(spark.createDataFrame([(k,) for k in ("deep model", "c++", "deep thought process", "zz yy", "xx")], "keyword string"), TF.vocabulary(a, 1, 2)).collect()}
    assert got["deep model"][0] == "exact" and got["c++"] == ("contains", pytest.approx(voc["c"])) and got["deep thought process"][0] == "contains"
    assert got["zz yy"] == ("fallback", 0.001) and got["xx"] == ("fallback", 0.001)


def test_overlap_needs_half_of_the_tokens(spark):
    terms = spark.createDataFrame([("graph search", 0.4), ("tree walk", 0.2)], "term string, score double")
    got = {r.keyword: (r.match_type, r.tfidf) for r in TF.matched_salience(spark.createDataFrame([("fast graph",), ("fast graph search tool",), ("one two graph",), ("walk",)], "keyword string"), terms).collect()}
    assert got == {"fast graph": ("overlap", 0.4), "fast graph search tool": ("contains", 0.4), "one two graph": ("fallback", 0.001), "walk": ("contains", 0.2)}


def angle(a):
    return [math.cos(math.radians(a)), math.sin(math.radians(a)), 0.0]


NO_METHODS = dict(methodological_patterns=(), methodological_tools=())


@pytest.mark.parametrize("a,found", [(63, True), (10, False), (88, False)])
def test_type2_window_on_designed_angles(spark, a, found):
    arts = articles(spark, [(0, 0, None, None, ["alpha topic", "gamma topic"]), (1, 0, None, None, ["alpha topic"]), (2, 0, None, None, ["beta topic"]), (3, 0, None, None, ["beta topic"]), (4, 0, None, None, ["gamma topic"])])
    bag = K.keyword_bag(arts, "cluster")
    space = K.keyword_frequencies(bag, "cluster")
    vec = spark.createDataFrame([("alpha topic", angle(0)), ("beta topic", angle(a)), ("gamma topic", angle(1))], "keyword string, vector array<double>")
    sal = spark.createDataFrame([(k, 0.5) for k in ("alpha topic", "beta topic", "gamma topic")], "keyword string, tfidf double")
    got = D.conceptual_combinations(space, vec, bag, arts, sal, GapConfig(**NO_METHODS)).collect()
    assert ("alpha topic x beta topic" in {r.keyword for r in got}) == found
    assert "alpha topic x gamma topic" not in {r.keyword for r in got}
    for r in got:
        assert r.n_articles == 0 and r.citations is None and r.frequency == 4 and len(r.members) == 2


def test_blocks_of_pairs_find_what_one_block_finds(spark):
    rows = spark.createDataFrame([(c, f"k{i}", (i, 0), 2, 0.1, [math.cos(i * 0.37 + c), math.sin(i * 0.37 + c), 0.1 * i]) for c in (0, 1) for i in range(40)], "cluster int, keyword string, first struct<row_id:long,pos:int>, frequency long, tfidf double, vector array<double>")
    pairs = lambda b: {(r.cluster, r.keyword_1, r.keyword_2, round(r.similarity, 9)) for r in D.related_pairs(rows, GapConfig(), b).collect()}
    assert pairs(7) == pairs(1000) and len(pairs(7)) > 10


def test_type3_and_evidence_elsewhere(spark, arts):
    bag = K.keyword_bag(arts, "cluster")
    sal = spark.createDataFrame([(k, 0.1) for k in ("local theme", "shared theme", "remote theme", "solo theme", "alpha topic")] + [("beta topic", 0.0)], "keyword string, tfidf double")
    got = {(r.cluster, r.keyword): r for r in D.cross_cluster_concepts(bag, arts, sal, None, GapConfig(max_presence_ratio=0.4, **NO_METHODS)).collect()}
    assert set(got) == {(0, "remote theme"), (0, "solo theme"), (1, "local theme"), (1, "alpha topic")}
    r = got[0, "remote theme"]
    assert (r.frequency, r.n_articles, r.citations, r.article_titles) == (2, 2, 7.0, ["t3", "t4"])
    assert r.score == pytest.approx(0.25 * 0.4 + 0.35 * (1 - 2 / 6) + 0.4)
    exact = D.cross_cluster_concepts(bag, arts, sal, None, GapConfig(max_presence_ratio=2 / 6, **NO_METHODS)).collect()
    assert (0, "remote theme") in {(r.cluster, r.keyword) for r in exact}  # the bound is inclusive
    with pytest.raises(ValueError):
        D.cross_cluster_concepts(bag, arts.drop("cluster"), sal, None, GapConfig())


def test_type3_citations_are_those_of_the_other_clusters(spark, arts):
    bag = K.keyword_bag(arts, "cluster")
    sal = spark.createDataFrame([(k, 0.1) for k in ("local theme", "remote theme", "solo theme", "alpha topic")], "keyword string, tfidf double")
    got = {(r.cluster, r.keyword) for r in D.cross_cluster_concepts(bag, arts, sal, None, GapConfig(max_presence_ratio=0.4, min_citations=10, **NO_METHODS)).collect()}
    assert got == {(1, "local theme"), (1, "alpha topic")}


def test_type1_prefers_rare_and_far(spark, arts):
    bag = K.keyword_bag(arts, "cluster")
    space = spark.createDataFrame([(1, "remote theme", 2, (3, 1), 0.9, 0.1), (1, "solo theme", 1, (4, 1), 0.8, 0.2), (1, "three word theme", 1, (4, 2), 0.9, 0.9), (0, "alpha topic", 1, (1, 1), 0.3, 0.3)], "cluster int, keyword string, frequency long, first struct<row_id:long,pos:int>, distance double, centrality double")
    sal = spark.createDataFrame([("solo theme", 0.2)], "keyword string, tfidf double")
    freq = spark.createDataFrame([("solo theme", 1), ("alpha topic", 1)], "keyword string, global_frequency long")
    got = {r.keyword: r for r in D.emerging_concepts(space, bag, arts, sal, freq, None, GapConfig(**NO_METHODS)).collect()}
    assert set(got) == {"solo theme", "alpha topic"}
    assert got["solo theme"].score == pytest.approx(0.5) and got["solo theme"].metrics["distance_zscore"] == 0.0  # alone in its cluster: all parts are half


def test_periphery_includes_the_threshold(spark, arts):
    space = spark.createDataFrame([(0, f"k{i} w", 1, (i, 0), float(i), 0.0) for i in range(21)], "cluster int, keyword string, frequency long, first struct<row_id:long,pos:int>, distance double, centrality double")
    none = spark.createDataFrame([], "keyword string, tfidf double")
    got = D.peripheral_keywords(space, K.keyword_bag(arts), arts, none, None, GapConfig(**NO_METHODS)).collect()
    assert {r.keyword for r in got} == {"k19 w", "k20 w"} and all(r.metrics["tfidf"] == 0.001 for r in got)


def test_deduplication_labels_and_flat_table(spark, arts):
    sal = spark.createDataFrame([("remote theme", 0.1), ("solo theme", 0.1), ("alpha topic", 0.1)], "keyword string, tfidf double")
    gaps = D.cross_cluster_concepts(K.keyword_bag(arts, "cluster"), arts, sal, None, GapConfig(max_presence_ratio=0.4, **NO_METHODS))
    twice = gaps.unionByName(gaps.withColumn("cluster", F.col("cluster") + 5))
    assert D.deduplicate(twice).count() == gaps.count()
    assert {r.cluster for r in D.deduplicate(twice).collect()} <= {0, 1}
    flat = D.flattened(gaps)
    assert "metric_presence_ratio" in flat.columns and " | " in [r.article_titles for r in flat.collect() if r.keyword == "remote theme"][0]
    labels = {r.cluster: r.cluster_label for r in D.cluster_labels(K.keyword_bag(arts, "cluster"), None, K.spellings(arts)).collect()}
    assert labels[0] == "Shared Theme & Local theme"
    core = spark.createDataFrame([(k,) for k in ("remote theme", "solo theme", "three word theme", "shared theme")], "keyword string")
    assert {r.cluster: r.cluster_label for r in D.cluster_labels(K.keyword_bag(arts, "cluster"), core, None).collect()}[1] == "Cluster 1"


def test_display_keeps_members_apart(spark, arts):
    rows = spark.createDataFrame([("a x b x c", ["a x b", "c"])], "keyword string, members array<string>")
    spelling = spark.createDataFrame([("a x b", "A x B"), ("c", "c")], "keyword string, spelling string")
    assert K.display(rows, spelling).first().keyword_display == "A x B x C"


def test_ranking_orders_ties_by_row(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "row_id long, vector array<double>")
    assert [(r.row_id, r["rank"]) for r in C.rank_by_similarity(v, [1.0, 0.0]).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert [r.row_id for r in C.nearest(v, [1.0, 0.0], 2).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(Exception, match="dimensions"):
        C.rank_by_similarity(v, [1.0]).collect()


def blobs(spark, per=15, extra=0):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = [(0, 0), (8, 0), (0, 8)]
    return spark.createDataFrame([(c * per + i, [float(x) for x in np.array(centres[c]) + rng.normal(0, 0.5, 2)]) for c in range(3) for i in range(per)], "row_id long, vector array<double>")


def test_planted_clusters_are_found_inside_tasks_and_by_passes(spark):
    v = blobs(spark)
    for rows in (4096, 10):
        fitted = C.fit_kmeans(v, ClusteringConfig(n_clusters=3, task_rows=rows, distance_metric="euclidean"))
        groups = {}
        for r in fitted.assignment.collect():
            groups.setdefault(r.row_id // 15, set()).add(r.cluster)
            assert r.distance_from_centroid < 3
        assert [groups[i] for i in range(3)] == [{0}, {1}, {2}]  # numbered by the least row
        assert sorted(r.size for r in fitted.sizes.collect()) == [15, 15, 15]
    again = C.fit_kmeans(v.repartition(7), ClusteringConfig(n_clusters=3)).assignment
    assert {(r.row_id, r.cluster) for r in again.collect()} == {(r.row_id, r.cluster) for r in C.fit_kmeans(v, ClusteringConfig(n_clusters=3)).assignment.collect()}


def test_k_selection(spark):
    s = C.select_k(blobs(spark), ClusteringConfig(k_max=6))
    assert s.k == s.k_silhouette == 3 and s.rule == "silhouette" and s.wcss == sorted(s.wcss, reverse=True)
    assert C.select_k(blobs(spark), ClusteringConfig(k_max=6, k_selection="elbow")).k == 3
    assert C.select_k(blobs(spark), ClusteringConfig(n_clusters=99)).k == 45
    with pytest.raises(ValueError):
        C.select_k(blobs(spark).limit(1), ClusteringConfig())
    with pytest.raises(ValueError):
        C.select_k(blobs(spark), ClusteringConfig(k_selection="fixed"))


def test_elbow():
    assert C.elbow([2, 3, 4, 5, 6], [100, 30, 20, 15, 12]) == 3
    assert C.elbow([2, 3], [2, 1]) is None and C.elbow([2, 3, 4], [1, 1, 1]) is None


def test_quality_indices(spark):
    from gapspark.plans.pipelines import quality

    v = blobs(spark).withColumn("cluster", (F.col("row_id") / 15).cast("int"))
    found = quality(v, 3)
    assert found["silhouette"] == pytest.approx(C.silhouette(v).first()[0]) and found["silhouette"] > 0.8
    assert found["davies_bouldin"] == pytest.approx(C.davies_bouldin(v).first()[0])
    assert found["calinski_harabasz"] == pytest.approx(C.calinski_harabasz(v).first()[0])
    assert quality(v.withColumn("cluster", F.lit(0)), 1) == {}


def test_subclusters_of_small_spaces(spark):
    rows = [(0, f"k{i}", [float(i), 1.0], 0.1 * i) for i in range(3)] + [(1, f"m{i}", [float(i % 2) * 9, float(i)], 0.0) for i in range(9)]
    out = C.fit_subclusters(spark.createDataFrame(rows, "cluster int, keyword string, vector array<double>, centrality double"), ClusteringConfig(distance_metric="euclidean"))
    small = [r for r in out.collect() if r.cluster == 0]
    assert all(r.subcluster == 0 and r.distance == r.centrality for r in small)
    assert len({r.subcluster for r in out.where("cluster = 1").collect()}) == 3
    assert [C.default_subclusters(n) for n in (1, 2, 9, 17, 100)] == [1, 2, 3, 4, 5]


def test_config_checks():
    for bad in (dict(periphery_percentile=100), dict(max_gaps_per_cluster=0), dict(combination_similarity_range=(0.7, 0.2)), dict(gap_token_count=0), dict(min_citations=-1), dict(min_citations=5, max_citations=1), dict(citation_year_reference=0)):
        with pytest.raises(ValueError):
            GapConfig(**bad)
    for bad in (dict(k_min=1), dict(k_min=5, k_max=3), dict(n_clusters=1)):
        with pytest.raises(ValueError):
            ClusteringConfig(**bad)
    with pytest.raises(ValueError):
        EmergingWeights(0.5, 0.5, 0.5, 0.5)
    assert (GapConfig().core_domain_share, GapConfig().min_tfidf, GapConfig().max_gaps_per_cluster, GapConfig().max_keyword_frequency) == (0.5, 0.005, 3, 1)


def test_ngrams_of_rare_words_are_left_out_and_change_nothing(spark):
    """Words below the last place that counts are in no n-gram that does, so their n-grams need not be counted."""
    from gapspark.operators import tfidf as TF

    rows = [(i, [f"w{i % 3} w{i % 4}", f"w{i % 5} rare{i}", "w1 w2 w1"][: 1 + i % 3]) for i in range(60)]
    arts = spark.createDataFrame(rows, "row_id long, keywords_normalized array<string>")
    every = {r.term: (r.total, r.df) for r in TF.ngram_counts(arts, 1, 5).collect()}
    for most in (1, 3, 7, 20, 1000):
        best = dict(sorted(every.items(), key=lambda kv: (-kv[1][0], kv[0]))[:most])
        assert {r.term: (r.total, r.df) for r in TF.frequent_terms(arts, 1, 5, most).collect()} == best
    made = {r.term for r in TF._longer_counts(arts, 5, (), {(): {"w0", "w1", "w2"}}).collect()}
    assert made and all(w in ("w0", "w1", "w2") for term in made for w in term.split(" "))


def test_a_draw_puts_only_the_last_hash_cell_in_order(spark):
    """One frequency holds nearly all keywords; a window over it was one task."""
    import hashlib

    from gapspark.plans.studies import rarity_matched_draw

    pool = spark.createDataFrame([(f"k{i}", 1 + (i % 50 == 0)) for i in range(3000)], "keyword string, frequency long")
    chosen = pool.where("keyword like '%7'")
    got = {(r.rep, r.keyword) for r in rarity_matched_draw(pool, chosen, 2).collect()}
    for rep in (0, 1):
        own = sorted((k for k in (f"k{i}" for i in range(3000) if i % 50) if not k.endswith("7")), key=lambda k: hashlib.md5(f"42:{rep}:{k}".encode()).hexdigest())
        assert {k for r, k in got if r == rep} == set(own[:300])
    assert "_cell" in rarity_matched_draw(pool, chosen, 2)._jdf.queryExecution().analyzed().toString()
