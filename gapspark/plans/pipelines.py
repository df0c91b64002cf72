"""Mode A (keywords first) and Mode B (articles first)."""

from __future__ import annotations

import dataclasses
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.config import RunConfig
from gapspark.functions.text import token_count
from gapspark.functions.vectors import distance, mean_vectors
from gapspark.operators import clustering as C
from gapspark.operators import detectors as D
from gapspark.operators import keywords as K
from gapspark.operators.encoders import get_encoder
from gapspark.operators.tfidf import match_statistics, salience
from gapspark.plans.results import PipelineResult
from gapspark.sources.corpus import Corpus
from gapspark.sources.tables import materialized

LOW_SEPARATION = 0.10
#: A labeler gets (cluster, its articles, its member keywords) and returns a name.
Labeler = Callable[[int, DataFrame, list[str]], str]


@dataclass
class Prepared:
    """The truncated corpus and all that is counted on it."""

    corpus: Corpus
    frame: DataFrame
    bag: DataFrame
    n_articles: int
    salient: DataFrame
    frequencies: DataFrame  # keyword, global_frequency, first
    core: DataFrame
    spelling: DataFrame
    ranking: dict


def rank_corpus(corpus: Corpus, query: str, config: RunConfig, n: int | None = None) -> DataFrame:
    """row_id, query_distance, rank. Query and texts are encoded together, as a transductive encoder needs."""
    texts = corpus.frame.select(F.struct(F.lit(1).alias("kind"), "row_id").alias("row_id"), F.col("combined_text").alias("text"))
    asked = corpus.frame.sparkSession.range(1).select(F.struct(F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row_id")).alias("row_id"), F.lit(query).alias("text"))
    keyed = texts.unionByName(asked).select(F.when(F.col("row_id.kind") == 1, F.col("row_id.row_id")).otherwise(-1).alias("row_id"), "text")
    vectors = materialized(get_encoder(config.article_encoder).encode(keyed), "ranked")
    asked_vector = vectors.where("row_id = -1").first().vector
    rest = vectors.where("row_id <> -1")
    ranked = C.nearest(rest, asked_vector, n) if n else C.rank_by_similarity(rest, asked_vector)
    return ranked.select("row_id", "query_distance", "rank")


def prepare(corpus: Corpus, config: RunConfig) -> Prepared:
    """Rank, truncate, then count: TF-IDF, frequencies and core terms are those of the truncated corpus."""
    frame, n = corpus.frame, config.top_n_articles
    ranking: dict = {"ranked": False}
    if config.problem_description:
        ranked = rank_corpus(corpus, config.problem_description, config, n)
        frame = materialized(frame.join(ranked, "row_id").withColumnRenamed("row_id", "source_row_id").withColumn("row_id", F.col("rank")), "articles")
        low, high = frame.agg(F.min("query_distance"), F.max("query_distance")).first()
        ranking = {"ranked": True, "encoder": get_encoder(config.article_encoder).describe(), "min_distance": low, "cutoff_distance": high}
    else:
        frame = materialized(frame.orderBy("row_id").limit(n) if n else frame, "articles")
    analysis = corpus._with(frame)
    bag = K.keyword_bag(frame)
    n_articles = frame.count()
    frequencies = materialized(K.keyword_frequencies(bag).withColumnRenamed("frequency", "global_frequency"), "frequencies")
    core = K.core_terms(frequencies.withColumnRenamed("global_frequency", "frequency"), F.lit(n_articles), config.gaps.core_domain_share)
    return Prepared(analysis, frame, bag, n_articles, materialized(salience(frame), "salience"), frequencies, core, materialized(K.spellings(frame), "spelling"), ranking)


def encode_keywords(p: Prepared, config: RunConfig) -> DataFrame:
    """keyword, vector of every keyword, encoded once for all clusters."""
    texts = p.frequencies.select(F.col("keyword").alias("row_id"), F.col("keyword").alias("text"))
    return materialized(get_encoder(config.keyword_encoder).encode(texts).withColumnRenamed("row_id", "keyword"), "keyword_vectors")


def build_spaces(bag: DataFrame, vectors: DataFrame, metric: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope..., cluster, keyword, frequency, first, vector, centrality of bag(cluster, ...): each cluster's keywords as a space."""
    by = [*scope, "cluster"]
    rows = K.keyword_frequencies(bag, *by)
    rows = rows.join(vectors, [*K.shared(rows, vectors, "keyword", "vector"), "keyword"])
    centres = mean_vectors(rows.select(*by, "vector"), by)
    return rows.join(F.broadcast(centres), by).withColumn("centrality", distance(F.col("vector"), F.col("centroid"), metric)).drop("centroid")


def quality(points: DataFrame, k: int) -> dict:
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of points(row_id, cluster, vector), exact; empty for one cluster."""
    if k < 2 or points.count() <= k:
        return {}
    return {"silhouette": C.silhouette(points).first()[0]} | C.indices(points)


def separation_warning(found: dict, k: int, what: str) -> str | None:
    s = found.get("silhouette")
    if s is None or s >= LOW_SEPARATION:
        return None
    return f"LOW_CLUSTER_SEPARATION: the {k} {what} clusters have a silhouette of {s:.3f}, below {LOW_SEPARATION:.2f}; read them as a partition, not as themes"


def _warned(diagnostics: dict, *messages: str | None) -> None:
    diagnostics["warnings"] = [m for m in messages if m]
    for m in diagnostics["warnings"]:
        warnings.warn(m, UserWarning, stacklevel=3)


def _diagnostics(p: Prepared, clusters: C.Clusters, found: dict, config: RunConfig) -> dict:
    return {
        "n_clusters": clusters.centroids.count(), "cluster_quality": found, "k_selection": dataclasses.asdict(clusters.selection),
        "distance_metric": config.clustering.distance_metric, "core_domain_terms": sorted(r.keyword for r in p.core.collect()),  # fewer than 1/share records' worth
        "tfidf_match_statistics": {r.match_type: r.n for r in match_statistics(p.salient).collect()}, "corpus": p.corpus.summary().first().asDict(), "ranking": p.ranking,
    }


def _custom_labels(labeler: Labeler, clusters: list[int], articles, members) -> list[tuple[int, str]]:
    return [(c, labeler(c, articles(c), members(c))) for c in clusters]


def search_articles(frame: DataFrame, keyword_vectors: DataFrame, salient: DataFrame, frequencies: DataFrame, core: DataFrame, config: RunConfig, scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(bag, usable clusters, space, gaps of three types before deduplication) of clustered articles, for all runs of scope at once."""
    by = (*scope, "cluster")
    bag = materialized(K.keyword_bag(frame, *by), "bag")
    # clusters with fewer than three keyword occurrences are skipped, for all types
    usable = materialized(bag.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(*by), "usable")
    inside = bag.join(F.broadcast(usable), list(by), "left_semi")  # a row for each cluster of each run
    space = materialized(C.fit_subclusters(build_spaces(inside, keyword_vectors, config.clustering.distance_metric, scope), config.clustering, scope), "space")
    plain, g = space.drop("vector"), config.gaps
    found = (
        D.emerging_concepts(plain, bag, frame, salient, frequencies, core, g, scope)
        .unionByName(D.conceptual_combinations(plain, keyword_vectors, inside, frame, salient, g, scope))
        .unionByName(D.cross_cluster_concepts(bag, frame, salient, core, g, usable, scope))
    )
    return bag, usable, space, materialized(found, "gaps")


def articles_first(corpus: Corpus, config: RunConfig | None = None, labeler: Labeler | None = None, prepared: Prepared | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> PipelineResult:
    """Mode B: articles are clustered, and each cluster's keywords are searched for three types of gap.

    prepared and vectors (article vectors, keyword vectors) may be handed in by runs that share them.
    """
    config = config or RunConfig()
    p = prepared or prepare(corpus, config)
    article_vectors, keyword_vectors = vectors or (encode_articles(p, config), encode_keywords(p, config))
    clusters = C.fit_kmeans(article_vectors, config.clustering)
    frame = materialized(p.frame.join(clusters.assignment, "row_id"), "clustered")
    bag, usable, space, found = search_articles(frame, keyword_vectors, p.salient, p.frequencies, p.core, config)
    skipped = {r.cluster: "fewer than 3 keywords" for r in clusters.centroids.join(usable, "cluster", "left_anti").select("cluster").collect()}  # k rows
    g = config.gaps
    labels = D.cluster_labels(bag, p.core, p.spelling)
    if labeler:
        names = _custom_labels(labeler, [r.cluster for r in clusters.centroids.select("cluster").collect()], lambda c: frame.where(F.col("cluster") == c), lambda c: [])
        labels = frame.sparkSession.createDataFrame(names, "cluster int, cluster_label string")
    kept = D.deduplicate(found) if g.deduplicate_cross_cluster else found
    gaps = K.display(kept.join(F.broadcast(labels), "cluster", "left"), p.spelling)
    table = D.with_global_frequency(D.with_salience(space.drop("vector", "first"), p.salient), p.frequencies).join(p.core.select("keyword", F.lit(True).alias("is_core_domain")), "keyword", "left")
    table = table.withColumns({"is_core_domain": F.coalesce("is_core_domain", F.lit(False)), "n_tokens": token_count(F.col("keyword"))}).join(F.broadcast(labels), "cluster", "left").withColumnRenamed("cluster", "article_cluster")
    points = article_vectors.join(clusters.assignment.select("row_id", "cluster"), "row_id")
    q = quality(points, clusters.centroids.count())
    gaps = materialized(gaps, "gaps")
    told = _diagnostics(p, clusters, q, config) | {"gaps_before_deduplication": found.count(), "gaps_after_deduplication": gaps.count(), "skipped_clusters": skipped}
    _warned(told, separation_warning(q, told["n_clusters"], "article"))
    return PipelineResult("articles_first", config, frame, table, gaps, clusters.centroids, told, {"keywords": keyword_vectors, "articles": article_vectors})


def encode_articles(p: Prepared, config: RunConfig) -> DataFrame:
    return materialized(get_encoder(config.article_encoder).encode(p.frame.select("row_id", F.col("combined_text").alias("text"))), "article_vectors")


def default_ceiling(n_articles: int) -> int:
    """Mode A's ceiling of a keyword's records where none is set: one in fifty, half to even."""
    return max(1, round(n_articles / 50))


def keyword_space(frequencies: DataFrame, vectors: DataFrame, labels: DataFrame, metric: str, corpus: tuple[str, ...] = (), scope: tuple[str, ...] = ()) -> DataFrame:
    """Mode A's space: keywords with their cluster, distance and centrality; corpus names what frequencies and vectors belong to, scope the runs of labels."""
    keys = [*corpus, "keyword"]
    centre = F.broadcast(mean_vectors(vectors, list(corpus)))  # a vector for each corpus
    rows = frequencies.withColumnRenamed("global_frequency", "frequency").join(vectors, keys)
    rows = rows.join(centre, list(corpus)) if corpus else rows.join(centre)
    rows = rows.withColumn("centrality", distance(F.col("vector"), F.col("centroid"), metric)).drop("vector", "centroid")
    return materialized(rows.join(labels, keys), "space")


def keywords_first(corpus: Corpus, config: RunConfig | None = None, labeler: Labeler | None = None, prepared: Prepared | None = None, vectors: tuple | None = None) -> PipelineResult:
    """Mode A: the keywords are clustered, and those on the rim of their cluster are gaps."""
    config = config or RunConfig()
    p = prepared or prepare(corpus, config)
    if config.gaps.max_keyword_frequency is None:
        config = config.replace(gaps=dataclasses.replace(config.gaps, max_keyword_frequency=default_ceiling(p.n_articles)))
    if p.frequencies.limit(4).count() < 4:
        raise ValueError("Mode A needs four distinct keywords or more")
    keyword_vectors = vectors[1] if vectors else encode_keywords(p, config)
    metric = config.clustering.distance_metric
    clusters = C.fit_kmeans(keyword_vectors.withColumnRenamed("keyword", "row_id"), config.clustering)
    own = clusters.assignment.select(F.col("row_id").alias("keyword"), "cluster", F.col("distance_from_centroid").alias("distance"))
    space = keyword_space(p.frequencies, keyword_vectors, own, metric)
    found = D.peripheral_keywords(space, p.bag, p.frame, p.salient, p.core, config.gaps)
    labels = D.member_labels(space, p.core, p.spelling)
    if labeler:
        def members(c):
            return [r.keyword for r in space.where(F.col("cluster") == c).orderBy("first").select("keyword").collect()]  # what a labeler is given

        def articles(c):
            rows = p.bag.join(space.where(F.col("cluster") == c).select("keyword"), "keyword", "left_semi").select("row_id").distinct()
            return p.frame.join(rows, "row_id", "left_semi")

        names = _custom_labels(labeler, [r.cluster for r in clusters.centroids.select("cluster").collect()], articles, members)
        labels = p.frame.sparkSession.createDataFrame(names, "cluster int, cluster_label string")
    gaps = materialized(K.display(found.join(F.broadcast(labels), "cluster", "left"), p.spelling), "gaps")
    ordered = gaps.orderBy(F.desc("score"), F.desc(F.coalesce("citations", F.lit(-1.0))), "keyword") if config.use_citations else gaps.orderBy(F.desc("score"), "keyword")
    table = D.with_salience(space.drop("first"), p.salient).withColumn("global_frequency", F.col("frequency")).join(p.core.select("keyword", F.lit(True).alias("is_core_domain")), "keyword", "left")
    table = table.withColumns({"is_core_domain": F.coalesce("is_core_domain", F.lit(False)), "n_tokens": token_count(F.col("keyword"))}).join(F.broadcast(labels), "cluster", "left")
    points = keyword_vectors.join(own.select("keyword", "cluster"), "keyword").withColumnRenamed("keyword", "row_id")
    q = quality(points, clusters.centroids.count())
    told = _diagnostics(p, clusters, q, config) | {"max_keyword_frequency": config.gaps.max_keyword_frequency}
    _warned(told, separation_warning(q, told["n_clusters"], "keyword"))
    return PipelineResult("keywords_first", config, p.frame, table, ordered, clusters.centroids, told, {"keywords": keyword_vectors})


MODES = {"keywords_first": keywords_first, "articles_first": articles_first}


def run(corpus: Corpus, mode: str = "articles_first", config: RunConfig | None = None, labeler: Labeler | None = None) -> PipelineResult:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    return MODES[mode](corpus, config, labeler)
