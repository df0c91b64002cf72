"""The four detectors. Each handles all clusters at once: `cluster` is a key of every table, never a loop.

space      cluster, keyword, frequency, first, distance, centrality (frequency and first within the cluster)
bag        row_id, pos, keyword, cluster
articles   row_id, title, doi, year, citations, cluster
salient    keyword, tfidf        corpus_freq   keyword, global_frequency        core   keyword

All return GAP_COLUMNS. Ties in the score go to the keyword that appears first.

Several runs are worked on at once where `scope` names the columns that tell them apart: space, bag and articles then have these
columns too, and the gaps; salient, corpus_freq, core and spelling have as many of them as they depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.config import GapConfig
from gapspark.functions import scores
from gapspark.functions.quantiles import exact_quantiles
from gapspark.functions.text import PAIR_SEPARATOR, is_methodological, token_count
from gapspark.operators import keywords as K
from gapspark.operators.backoff import FLOOR
from gapspark.operators.pairs import best_pairs, related_pairs  # noqa: F401
from gapspark.sources.tables import materialized

EMERGING, COMBINATION, CROSS_CLUSTER, PERIPHERAL = "Emerging Concept", "Conceptual Combination", "Cross-Cluster Concept", "Peripheral Keyword"
GAP_COLUMNS = ["gap_type", "keyword", "cluster", "score", "frequency", "n_articles", "citations", "rationale", "article_titles", "article_dois", "members", "metrics"]
_METRICS = "map<string,double>"


def with_salience(rows: DataFrame, salient: DataFrame, keyword: str = "keyword", into: str = "tfidf") -> DataFrame:
    keys = K.shared(rows, salient, "keyword", "tfidf", "match_type")
    s = salient.select(*keys, F.col("keyword").alias(keyword), F.col("tfidf").alias(into))
    return rows.join(s, [*keys, keyword], "left").withColumn(into, F.coalesce(into, F.lit(FLOOR)))


def with_global_frequency(rows: DataFrame, corpus_freq: DataFrame) -> DataFrame:
    keys = [*K.shared(rows, corpus_freq, "keyword", "global_frequency", "first"), "keyword"]
    return rows.join(corpus_freq.select(*keys, "global_frequency"), keys, "left").withColumn("global_frequency", F.coalesce("global_frequency", F.lit(0)).cast("long"))


def top_k(rows: DataFrame, k: int, order: list[Column], *by: str) -> DataFrame:
    """The k first rows of each group; Spark cuts each partition's groups before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def _metrics(*names: str) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names])).cast(_METRICS)


def article_evidence(gaps: DataFrame, bag: DataFrame, articles: DataFrame, elsewhere: bool = False, most: int = 3, scoped: bool = True, scope: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """gaps with n_articles, citations, article_titles and article_dois of the records with the keyword.

    The records are those of the gap's cluster; with `elsewhere`, of all others; not `scoped`: of all clusters. Counts and
    citations are partial aggregates; of the records themselves each task passes on the first `most` of a gap, and only
    those meet titles, so no task holds a keyword's records. `few` says that the gaps are few enough to be broadcast; else, but with
    `elsewhere`, records are counted by keyword before gaps are met, and the bag may carry citations, so that it meets no articles.
    """
    none = F.expr("array()").cast("array<string>")
    told = lambda c: F.coalesce(F.transform("_l", lambda x: x[c]), none)
    if not few and not elsewhere:
        key, row = [*scope, "keyword", *(["cluster"] if scoped else [])], [*scope, "row_id"]
        hits = bag.select(*key, "row_id")
        facts = bag.select(*key, "citations") if "citations" in bag.columns else hits.join(articles.select(*row, "citations"), row)
        counts = facts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_articles"), F.max("citations").alias("citations"))
        first = top_k(hits, most, [F.col("row_id")], *key).join(gaps.select(*key), key, "left_semi").join(articles.select(*row, "title", "doi"), row)
        listed = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row_id", "title", "doi"))).alias("_l"))  # `most` records
        out = gaps.join(counts, key, "left").join(listed, key, "left")
        return out.withColumns({"n_articles": F.coalesce("n_articles", F.lit(0)).cast("long"), "article_titles": told("title"), "article_dois": told("doi")}).drop("_l")
    wanted = gaps.select(*scope, "keyword", F.col("cluster").alias("_c")).distinct()
    hits = bag.select(*scope, "row_id", "keyword", *(["cluster"] if scoped else [])).join(F.broadcast(wanted) if few else wanted, [*scope, "keyword"])
    if scoped:
        hits = hits.where(F.col("cluster") != F.col("_c") if elsewhere else F.col("cluster") == F.col("_c")).drop("cluster")
    key, row = [*scope, "keyword", "_c"], [*scope, "row_id"]
    counts = hits.join(articles.select(*row, "citations"), row).groupBy(*key).agg(F.count(F.lit(1)).alias("n_articles"), F.max("citations").alias("citations"))
    first = top_k(hits, most, [F.col("row_id")], *key).join(articles.select(*row, "title", "doi"), row)
    listed = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row_id", "title", "doi"))).alias("_l"))  # `most` records
    out = gaps.join(counts.withColumnRenamed("_c", "cluster"), [*scope, "keyword", "cluster"], "left").join(listed.withColumnRenamed("_c", "cluster"), [*scope, "keyword", "cluster"], "left")
    return out.withColumns({"n_articles": F.coalesce("n_articles", F.lit(0)).cast("long"), "article_titles": told("title"), "article_dois": told("doi")}).drop("_l")


def emerging_concepts(space: DataFrame, bag: DataFrame, articles: DataFrame, salient: DataFrame, corpus_freq: DataFrame, core: DataFrame | None, config: GapConfig, scope: tuple[str, ...] = ()) -> DataFrame:
    """Type 1: rare, peripheral, salient keywords of a cluster."""
    by = (*scope, "cluster")
    rows = K.candidates(space, config, core)
    if config.max_keyword_frequency is not None:
        rows = rows.where(F.col("frequency") <= config.max_keyword_frequency)
    if config.citation_filter_active:
        rows = K.citation_filtered(rows, K.citation_support(bag, articles, config, *by, scope=scope), config, *by)
    # scaled over the candidates of the cluster, before the best are taken; kept, since the scales are counted first
    rows = materialized(with_global_frequency(with_salience(rows, salient), corpus_freq), "candidates")
    rows = scores.scaled(rows, by, {"_d": "distance_zscore", "_m": "centrality", "_t": "tfidf", "_f": "global_frequency"}, {"distance_zscore": "distance"})
    rows = rows.withColumn("score", scores.emerging(F.col("_d"), F.col("_m"), F.col("_t"), 1 - F.col("_f"), config.emerging_weights)).drop("_d", "_m", "_t", "_f")
    rows = top_k(rows, config.max_gaps_per_cluster, [F.desc("score"), F.col("first")], *by)
    rows = rows.withColumnRenamed("distance", "distance_from_subcentroid")
    why = F.format_string("in %d record(s) of the cluster and %d of the corpus; distance z %.2f; tf-idf %.4f", F.col("frequency"), F.col("global_frequency"), F.col("distance_zscore"), F.col("tfidf"))
    gaps = rows.select(*scope, F.lit(EMERGING).alias("gap_type"), "keyword", "cluster", "score", "frequency", why.alias("rationale"), F.array("keyword").alias("members"),
                       _metrics("distance_from_subcentroid", "distance_zscore", "centrality", "tfidf", "global_frequency").alias("metrics"))
    gaps = materialized(gaps, "gaps")  # max_gaps_per_cluster rows for each cluster, read more than once
    return article_evidence(gaps, bag, articles, scope=scope, few=True).select(*scope, *GAP_COLUMNS)


def established(frequencies: DataFrame, config: GapConfig) -> DataFrame:
    """The keywords that Type 2 combines: candidates found two times or more in their cluster."""
    return K.candidates(frequencies, config).where("frequency >= 2")


def conceptual_combinations(space: DataFrame, vectors: DataFrame, bag: DataFrame, articles: DataFrame, salient: DataFrame, config: GapConfig, scope: tuple[str, ...] = ()) -> DataFrame:
    """Type 2: pairs of established keywords of a cluster that never occur together but are related.

    vectors is (keyword, vector). Pairs are those of the eligible keywords of one cluster: found two times or more there.
    """
    by = (*scope, "cluster")
    rows = established(space, config)
    if config.citation_filter_active:
        rows = K.citation_filtered(rows, K.citation_support(bag, articles, config, *by, scope=scope), config, *by)
    keys = [*K.shared(rows, vectors, "keyword", "vector"), "keyword"]
    rows = materialized(with_salience(rows, salient).join(vectors.select(*keys, "vector"), keys), "combination_rows")
    met = K.occurring_together(bag.join(rows.select(*by, "keyword"), [*by, "keyword"], "left_semi"), *by)
    pairs = best_pairs(rows, met, config, scope=scope)
    why = F.format_string("related (similarity %.2f) but never in one record; mean tf-idf %.4f", F.col("similarity"), F.col("mean_tfidf"))
    none = F.expr("array()").cast("array<string>")
    return pairs.select(
        *scope, F.lit(COMBINATION).alias("gap_type"), F.concat_ws(PAIR_SEPARATOR, "keyword_1", "keyword_2").alias("keyword"), "cluster", "score",
        (F.col("frequency_1") + F.col("frequency_2")).alias("frequency"), F.lit(0).cast("long").alias("n_articles"), F.lit(None).cast("double").alias("citations"), why.alias("rationale"),
        none.alias("article_titles"), none.alias("article_dois"), F.array("keyword_1", "keyword_2").alias("members"), _metrics("similarity", "frequency_1", "frequency_2", "mean_tfidf").alias("metrics"))


def cross_cluster_candidates(bag: DataFrame, articles: DataFrame, salient: DataFrame, core: DataFrame | None, config: GapConfig, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope..., cluster, keyword, frequency_other, presence_ratio, tfidf, first: Type 3 before scoring.

    A keyword is absent from cluster c if c is not among the clusters that have it, and then all of its records are
    elsewhere; so what is rare in the corpus is found first, and only that is laid against the clusters.
    """
    own = K.keyword_frequencies(bag, *scope, "cluster")
    met = lambda rows, few: rows.join(F.broadcast(few), list(scope)) if scope else rows.join(F.broadcast(few))
    n = articles.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_all"))  # a row for each run
    kept = own.groupBy(*scope, "keyword").agg(F.sum("frequency").alias("total"), F.min("first").alias("first"), F.collect_set("cluster").alias("in_clusters"))
    kept = kept.where(F.col("total") <= config.max_frequency_other_clusters).where(F.col("keyword") != "")
    if config.gap_token_count is not None:
        kept = kept.where(token_count(F.col("keyword")) == config.gap_token_count)
    if config.filter_methodological:
        kept = kept.where(~is_methodological(F.col("keyword"), config.methodological_patterns, config.methodological_tools))
    if config.extra_stop_keywords:
        kept = kept.where(~F.col("keyword").isin([" ".join(k.lower().split()) for k in config.extra_stop_keywords]))
    if core is not None:
        kept = K.without(kept, core)
    kept = met(kept, n).withColumn("presence_ratio", F.col("total") / F.col("n_all")).where(F.col("presence_ratio") <= config.max_presence_ratio)
    kept = with_salience(kept, salient).where(F.col("tfidf") >= config.min_tfidf)
    clusters = articles.groupBy(*scope).agg(F.sort_array(F.collect_set("cluster")).alias("clusters"))  # a row for each run, a number for each cluster
    absent = met(kept, clusters).withColumn("cluster", F.explode(F.array_except("clusters", "in_clusters")))
    out = absent.select(*scope, "cluster", "keyword", F.col("total").alias("frequency_other"), "presence_ratio", "tfidf", "first")
    if config.citation_filter_active:
        out = K.citation_filtered(out, _support_elsewhere(out, bag, articles, config, scope), config, *scope, "cluster")
    return out


def _support_elsewhere(rows: DataFrame, bag: DataFrame, articles: DataFrame, config: GapConfig, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope..., cluster, keyword, citations, velocity over the other clusters' records; ages count from their latest year."""
    by = [*scope, "cluster"]
    last = articles.groupBy(*by).agg(F.max("year").alias("y"))  # a row for each cluster
    others = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    if config.citation_year_reference is not None:
        ref = last.select(*by, F.lit(config.citation_year_reference).alias("ref"))
    elif config.reference_scope == "corpus":
        ref = last.select(*by, F.max("y").over(others).alias("ref"))
    else:  # the latest year of the other clusters, from the best two of all
        years = F.sort_array(F.collect_list(F.struct("y", "cluster")).over(others), asc=False)
        ref = last.select(*by, F.when(F.get(years, 0)["cluster"] == F.col("cluster"), F.get(years, 1)["y"]).otherwise(F.get(years, 0)["y"]).alias("ref"))
    facts = rows.select(*by, "keyword").join(bag.select(*scope, "row_id", "keyword").distinct(), [*scope, "keyword"]).join(articles.select(*scope, "row_id", "year", "citations"), [*scope, "row_id"]).join(F.broadcast(ref), by)
    rate = F.col("citations") / F.greatest(F.lit(1), F.col("ref") - F.col("year") + 1)
    return facts.groupBy(*by, "keyword").agg(F.max("citations").alias("citations"), F.max(rate).alias("velocity"))


def cross_cluster_concepts(bag: DataFrame, articles: DataFrame, salient: DataFrame, core: DataFrame | None, config: GapConfig, clusters: DataFrame | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """Type 3: concepts of other clusters that a cluster lacks. clusters(cluster) limits whose gaps are reported."""
    if "cluster" not in articles.columns:
        raise ValueError("cross-cluster detection needs a cluster column")
    by = (*scope, "cluster")
    rows = cross_cluster_candidates(bag, articles, salient, core, config, scope)
    if clusters is not None:
        rows = rows.join(clusters.select(*by), list(by), "left_semi")
    keys = K.shared(rows, salient, "keyword", "tfidf", "match_type")
    best = F.broadcast(salient.groupBy(*keys).agg(F.coalesce(F.max("tfidf"), F.lit(1.0)).alias("tfidf_max")))  # a row for each corpus
    rows = (rows.join(best, keys) if keys else rows.join(best)).withColumn("score", scores.cross_cluster(F.col("frequency_other"), F.col("presence_ratio"), F.col("tfidf"), F.col("tfidf_max"), config.cross_cluster_weights))
    rows = top_k(rows, config.max_gaps_per_cluster, [F.desc("score"), F.col("first")], *by).withColumn("frequency_other_clusters", F.col("frequency_other"))
    why = F.format_string("not in cluster %s; in %d record(s) elsewhere (%.1f%% of the corpus); tf-idf %.4f", F.col("cluster").cast("string"), F.col("frequency_other"), 100 * F.col("presence_ratio"), F.col("tfidf"))
    gaps = rows.select(*scope, F.lit(CROSS_CLUSTER).alias("gap_type"), "keyword", "cluster", "score", F.col("frequency_other").alias("frequency"), why.alias("rationale"), F.array("keyword").alias("members"),
                       _metrics("frequency_other_clusters", "presence_ratio", "tfidf").alias("metrics"))
    gaps = materialized(gaps, "gaps")  # max_gaps_per_cluster rows for each cluster, read more than once
    return article_evidence(gaps, bag, articles, elsewhere=True, scope=scope, few=True).select(*scope, *GAP_COLUMNS)


def periphery_thresholds(space: DataFrame, percentile: float, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope..., cluster, threshold: the exact percentile (linear between ranks) of all members' distances."""
    return exact_quantiles(space, [*scope, "cluster"], "distance", percentile / 100).withColumnRenamed("quantile", "threshold")


def peripheral_keywords(space: DataFrame, bag: DataFrame, articles: DataFrame, salient: DataFrame, core: DataFrame | None, config: GapConfig, scope: tuple[str, ...] = (), ceiling: Column | None = None) -> DataFrame:
    """Mode A: keywords at or beyond the percentile of their cluster's distances. bag needs no cluster.

    A ceiling, where it is given, stands for max_keyword_frequency.
    """
    rows = K.candidates(space, config, core)
    if ceiling is not None or config.max_keyword_frequency is not None:
        rows = rows.where(F.col("frequency") <= (config.max_keyword_frequency if ceiling is None else ceiling))
    if config.citation_filter_active:
        rows = K.citation_filtered(rows, K.citation_support(bag, articles, config, *scope, scope=scope), config, *scope)
    rows = rows.join(periphery_thresholds(space, config.periphery_percentile, scope), [*scope, "cluster"]).where("distance >= threshold")
    rows = with_salience(rows, salient).withColumns({"distance_from_centroid": F.col("distance"), "cluster_threshold": F.col("threshold"), "score": F.col("distance")})
    why = F.format_string("distance %.4f at or beyond the cluster's percentile %.4f; in %d record(s); tf-idf %.4f", F.col("distance"), F.col("threshold"), F.col("frequency"), F.col("tfidf"))
    gaps = rows.select(*scope, F.lit(PERIPHERAL).alias("gap_type"), "keyword", "cluster", "score", "frequency", why.alias("rationale"), F.array("keyword").alias("members"),
                       _metrics("distance_from_centroid", "cluster_threshold", "centrality", "tfidf").alias("metrics"))
    return article_evidence(gaps, bag, articles, scoped=False, scope=scope).select(*scope, *GAP_COLUMNS)


def deduplicate(gaps: DataFrame, *scope: str) -> DataFrame:
    """The best row of each type and keyword; ties go to the lowest cluster."""
    return top_k(gaps, 1, [F.desc("score"), F.col("cluster")], *scope, "gap_type", "keyword")


def flattened(gaps: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The gap table: a metric_ column for each metric, titles and non-blank DOIs joined by ` | `."""
    if names is None:
        names = sorted(r[0] for r in gaps.select(F.explode(F.map_keys("metrics"))).distinct().collect())  # a dozen names at most
    joined = lambda c: F.array_join(F.filter(c, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), " | ")
    out = gaps.withColumns({"article_titles": joined("article_titles"), "article_dois": joined("article_dois"), **{f"metric_{n}": F.col("metrics")[n] for n in names}})
    return out.drop("metrics").orderBy("gap_type", F.desc("score"), "cluster", "keyword")


def cluster_labels(bag: DataFrame, core: DataFrame | None, spelling: DataFrame | None, n_terms: int = 2, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope..., cluster, cluster_label of bag(cluster, ...): the most frequent keywords that are not core; ties by first appearance."""
    freq = K.keyword_frequencies(bag, *scope, "cluster")
    if core is not None:
        freq = K.without(freq, core)
    return _labelled(freq, [F.desc("frequency"), F.col("first")], spelling, n_terms, bag.select(*scope, "cluster").distinct())


def member_labels(space: DataFrame, core: DataFrame | None, spelling: DataFrame | None, n_terms: int = 2, scope: tuple[str, ...] = ()) -> DataFrame:
    """Mode A: the first members that are not core."""
    rows = space if core is None else K.without(space, core)
    return _labelled(rows, [F.col("first")], spelling, n_terms, space.select(*scope, "cluster").distinct())


def _labelled(rows: DataFrame, order: list[Column], spelling: DataFrame | None, n_terms: int, clusters: DataFrame) -> DataFrame:
    from gapspark.functions.text import capitalise

    by = clusters.columns
    place = rows.withColumn("p", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("p") <= n_terms)
    named = place.join(spelling, [*K.shared(place, spelling, "keyword", "spelling"), "keyword"], "left") if spelling is not None else place.withColumn("spelling", F.lit(None).cast("string"))
    joined = named.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("spelling", "keyword").alias("s")))), lambda x: x["s"]), " & ").alias("l"))
    return clusters.join(joined, by, "left").select(*by, F.coalesce(capitalise(F.col("l")), F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("cluster_label"))
