"""The data of each figure, as tables; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.operators import keywords as K
from gapspark.operators.clustering import KSelection, centroid_similarity
from gapspark.plans.results import PipelineResult
from gapspark.sources.tables import save_csv
from gapspark.validation.metrics import LABELS, label_rates, slug


def embed_2d(vectors: DataFrame, key: str = "row_id") -> DataFrame:
    """key, x, y: the first two principal components (there is no t-SNE)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = vectors.withColumn("_gs_v", array_to_vector("vector"))
    out = PCA(k=2, inputCol="_gs_v", outputCol="_gs_p").fit(ready).transform(ready).withColumn("_gs_p", vector_to_array("_gs_p"))
    return out.select(key, F.get("_gs_p", 0).alias("x"), F.get("_gs_p", 1).alias("y"))


def keyword_map(keywords: DataFrame, vectors: DataFrame, gaps: DataFrame) -> DataFrame:
    """keyword, x, y, cluster (the most usual), frequency (the greatest), is_gap."""
    cluster = next(c for c in ("article_cluster", "cluster") if c in keywords.columns)
    facts = keywords.groupBy("keyword").agg(F.mode(cluster, True).alias("cluster"), F.max("frequency").alias("frequency"))
    found = gaps.select(F.explode("members").alias("keyword")).distinct().withColumn("is_gap", F.lit(True))
    return embed_2d(vectors, "keyword").join(facts, "keyword").join(found, "keyword", "left").withColumn("is_gap", F.coalesce("is_gap", F.lit(False)))


def article_map(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    return embed_2d(vectors).join(articles.select("row_id", "cluster"), "row_id")


def network(bag: DataFrame, min_weight: int = 2) -> tuple[DataFrame, DataFrame]:
    """Edges (left, right, weight) and nodes (keyword, degree) of the co-occurrence network."""
    edges = K.cooccurrence(bag, min_weight=min_weight)
    nodes = edges.select(F.explode(F.array("left", "right")).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("degree"))
    return edges, nodes


def gap_summary(gaps: DataFrame, n: int = 12) -> tuple[DataFrame, DataFrame]:
    return gaps.groupBy("gap_type").agg(F.count(F.lit(1)).alias("n")), gaps.orderBy(F.desc("score"), "gap_type", "keyword").limit(n).select("gap_type", "keyword", "score")


def year_distribution(articles: DataFrame) -> DataFrame:
    return articles.where("year is not null").groupBy("cluster", "year").agg(F.count(F.lit(1)).alias("n"))


def selection_curve(spark, selection: KSelection) -> DataFrame:
    return selection.to_frame(spark)


def validation_bars(judgements: DataFrame) -> DataFrame:
    """keyword_set, label, rate."""
    rates = label_rates(judgements, "keyword_set")
    return rates.select("keyword_set", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"rate_{slug(x)}").alias("rate")) for x in LABELS])).alias("x")).select("keyword_set", "x.label", "x.rate")


def figure_data(result: PipelineResult, vectors: DataFrame | None = None, judgements: DataFrame | None = None, article_vectors: DataFrame | None = None, include: Sequence[str] | None = None) -> dict:
    """Every figure that the result has data for (or those in `include`); the others are named under `skipped` with the reason."""
    selection = result.diagnostics.get("k_selection") or {}
    made = {
        "gap_summary": (True, "", lambda: gap_summary(result.gaps)),
        "network": ("keywords_normalized" in result.articles.columns, "no keywords", lambda: network(K.keyword_bag(result.articles))),
        "centroids": (result.centroids is not None, "no clusters", lambda: centroid_similarity(result.centroids)),
        "years": ({"year", "cluster"} <= set(result.articles.columns), "no clustered articles with years", lambda: year_distribution(result.articles)),
        "keyword_map": (vectors is not None, "no keyword vectors", lambda: keyword_map(result.keywords, vectors, result.gaps)),
        "article_map": (article_vectors is not None and "cluster" in result.articles.columns, "no article vectors or clusters", lambda: article_map(result.articles, article_vectors)),
        "k_selection": (len(selection.get("k_range", [])) > 1, "the number of clusters was given", lambda: selection_curve(result.gaps.sparkSession, KSelection(**selection))),
        "validation": (judgements is not None, "no judgements", lambda: validation_bars(judgements)),
    }
    unknown = sorted(set(include or ()) - set(made))
    if unknown:
        raise ValueError(f"unknown figures {', '.join(unknown)}; known: {', '.join(made)}")
    out: dict = {}
    skipped: dict[str, str] = {}
    for name, (there, reason, make) in made.items():
        if include and name not in include:
            continue
        if there:
            out[name] = make()
        else:
            skipped[name] = reason
    out["skipped"] = skipped
    return out


def save_figure_data(data: dict, folder: str, prefix: str = "fig") -> dict[str, str]:
    """The tables as CSV, parts of a figure numbered; `skipped` is passed on as one line."""
    out: dict[str, str] = {}
    for name, tables in data.items():
        if name == "skipped":
            if tables:
                out["skipped"] = "; ".join(f"{k}: {v}" for k, v in tables.items())
        elif isinstance(tables, tuple):
            for i, t in enumerate(tables, 1):
                out[f"{name}_{i}"] = save_csv(t, f"{folder.rstrip('/')}/{prefix}_{name}_{i}.csv")
        else:
            out[name] = save_csv(tables, f"{folder.rstrip('/')}/{prefix}_{name}.csv")
    return out
