"""What a run returns: lazy tables and a dictionary of diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.config import RunConfig
from gapspark.sources.tables import save_csv, save_json


@dataclass
class PipelineResult:
    mode: str
    config: RunConfig
    articles: DataFrame
    keywords: DataFrame
    gaps: DataFrame
    centroids: DataFrame | None = None
    diagnostics: dict = field(default_factory=dict)
    vectors: dict[str, DataFrame] = field(default_factory=dict)  # keywords: keyword, vector; articles: row_id, vector
    unmatched: DataFrame | None = None  # keyword, external_rank of a foreign ranking's keywords that the corpus lacks

    @property
    def gap_type_counts(self) -> DataFrame:
        return self.gaps.groupBy("gap_type").agg(F.count(F.lit(1)).alias("n"))

    def top_gaps(self, n: int = 10) -> DataFrame:
        return self.gaps.orderBy(F.desc("score"), "gap_type", "cluster", "keyword").limit(n)

    @property
    def centroid_similarity(self) -> DataFrame | None:
        from gapspark.operators.clustering import centroid_similarity

        return None if self.centroids is None else centroid_similarity(self.centroids)

    def summary(self) -> dict:
        return {"mode": self.mode, "n_gaps": self.gaps.count(), "gap_types": {r.gap_type: r.n for r in self.gap_type_counts.collect()}, **self.diagnostics}

    def save(self, folder: str, prefix: str | None = None) -> dict[str, str]:
        from gapspark.operators.detectors import flattened

        base = f"{folder.rstrip('/')}/{prefix or self.mode}"
        spark = self.gaps.sparkSession
        out = {
            "gaps": save_csv(flattened(self.gaps), f"{base}_gaps.csv"),
            "keywords": save_csv(self.keywords, f"{base}_keywords.csv"),
            "articles": save_csv(self.articles, f"{base}_articles.csv"),
            "config": save_json(spark, self.config.to_dict(), f"{base}_run_config.json"),
            "summary": save_json(spark, self.summary(), f"{base}_summary.json"),
        }
        if self.centroids is not None:
            out["centroid_similarity"] = save_csv(self.centroid_similarity, f"{base}_centroid_similarity.csv")
        return out
