"""Everything that can be set, as dataclasses that check themselves and can be written as JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

# Phrases and tool names that mark a keyword as methodological.
METHOD_PHRASES = (
    "equation model", "factor analysis", "regression", "anova", "manova", "ancova",
    "mediation", "moderation", "path analysis", "multilevel model", "hierarchical model",
    "survey method", "questionnaire", "experiment", "quasi-experiment",
    "case study", "interview", "focus group", "content analysis", "thematic analysis",
    "grounded theory", "literature review", "meta-analysis", "bibliometric",
    "longitudinal", "cross-sectional", "panel data", "cronbach", "composite reliability",
    "convergent validity", "discriminant validity", "measurement model",
    "sample size", "sampling method", "likert scale", "semantic differential",
    "conceptual framework", "research agenda", "future research", "systematic review",
    "qualitative", "quantitative", "mixed method", "configurational",
    "fuzzy set", "fuzzy-set", "necessary condition", "feature selection",
    "structural equation", "multi-group", "robustness check", "instrumental variable",
    "difference-in-differences", "propensity score", "text mining", "topic model",
)
METHOD_TOOLS = ("sem", "pls", "cfa", "efa", "hlm", "tam", "spss", "amos", "lisrel", "mplus", "smartpls", "stata", "nvivo")


def _sum_to_one(weights) -> None:
    total = sum(dataclasses.astuple(weights))
    if abs(total - 1) > 1e-9:
        raise ValueError(f"{type(weights).__name__} must sum to 1, not {total}")


@dataclass(frozen=True)
class EmergingWeights:
    distance: float = 0.25
    centrality: float = 0.15
    tfidf: float = 0.30
    rarity: float = 0.30
    __post_init__ = _sum_to_one


@dataclass(frozen=True)
class CombinationWeights:
    similarity: float = 0.40
    frequency: float = 0.30
    tfidf: float = 0.30
    __post_init__ = _sum_to_one


@dataclass(frozen=True)
class CrossClusterWeights:
    frequency: float = 0.25
    specificity: float = 0.35
    tfidf: float = 0.40
    __post_init__ = _sum_to_one


@dataclass
class GapConfig:
    """What makes a keyword a candidate, and how candidates are scored."""

    periphery_percentile: float = 95.0
    max_gaps_per_cluster: int = 3
    min_tfidf: float = 0.005
    max_keyword_frequency: int | None = 1  # None: in Mode A max(1, n/50), half to even; in Mode B no ceiling
    gap_token_count: int | None = 2
    core_domain_share: float = 0.50
    max_presence_ratio: float = 0.10
    max_frequency_other_clusters: int = 3
    combination_similarity_range: tuple[float, float] = (0.25, 0.65)
    combination_similarity_optimum: float = 0.45
    deduplicate_cross_cluster: bool = True
    min_citations: int | None = None
    max_citations: int | None = None
    min_citations_per_year: float | None = None
    citation_year_reference: int | None = None
    keep_uncited_candidates: bool = True
    filter_methodological: bool = True
    extra_stop_keywords: tuple[str, ...] = ()
    methodological_patterns: tuple[str, ...] = METHOD_PHRASES
    methodological_tools: tuple[str, ...] = METHOD_TOOLS
    emerging_weights: EmergingWeights = field(default_factory=EmergingWeights)
    combination_weights: CombinationWeights = field(default_factory=CombinationWeights)
    cross_cluster_weights: CrossClusterWeights = field(default_factory=CrossClusterWeights)
    reference_scope: str = "cluster"  # or "corpus": whose latest year ages the citations

    def __post_init__(self) -> None:
        low, high = self.combination_similarity_range
        wrong = {
            "periphery_percentile must be between 0 and 100": not 0 < self.periphery_percentile < 100,
            "max_gaps_per_cluster must be 1 or more": self.max_gaps_per_cluster < 1,
            "combination_similarity_range must be 0 <= low < high <= 1": not 0 <= low < high <= 1,
            "gap_token_count must be 1 or more, or None": self.gap_token_count is not None and self.gap_token_count < 1,
            "citation bounds must be 0 or more": any(x is not None and x < 0 for x in (self.min_citations, self.max_citations, self.min_citations_per_year)),
            "min_citations must not exceed max_citations": None not in (self.min_citations, self.max_citations) and self.min_citations > self.max_citations,
            "citation_year_reference must be 1 or more": self.citation_year_reference is not None and self.citation_year_reference < 1,
            "reference_scope must be cluster or corpus": self.reference_scope not in ("cluster", "corpus"),
        }
        for message, holds in wrong.items():
            if holds:
                raise ValueError(message)

    @property
    def citation_filter_active(self) -> bool:
        return any(x is not None for x in (self.min_citations, self.max_citations, self.min_citations_per_year))


@dataclass
class ClusteringConfig:
    n_clusters: int | None = None
    k_selection: str = "auto"  # auto, elbow, silhouette, fixed
    k_min: int = 2
    k_max: int = 10
    silhouette_floor: float = 0.25
    n_init: int = 10
    random_state: int = 42
    distance_metric: str = "cosine"  # or euclidean
    n_keyword_subclusters: int | None = None
    init: str = "k-means||"  # or random: the first rows in order of MD5
    task_rows: int = 4096  # sets of up to so many rows are clustered inside a task; moves work, not results

    def __post_init__(self) -> None:
        if self.k_min < 2 or self.k_max < self.k_min:
            raise ValueError("2 <= k_min <= k_max must hold")
        if self.n_clusters is not None and self.n_clusters < 2:
            raise ValueError("n_clusters must be 2 or more, or None")
        if self.init not in ("k-means||", "random"):
            raise ValueError(f"unknown init {self.init!r}")
        if self.k_selection not in ("auto", "elbow", "silhouette", "fixed"):
            raise ValueError(f"unknown k_selection {self.k_selection!r}")
        if self.distance_metric not in ("cosine", "euclidean"):
            raise ValueError(f"unknown distance_metric {self.distance_metric!r}")


@dataclass
class EncoderConfig:
    name: str = "tfidf-svd"
    model: str | None = None
    api_key_env: str | None = None  # the name of an environment variable, never a key
    batch_size: int = 96
    normalize: bool = True
    dimensions: int | None = None
    extra: dict = field(default_factory=dict)


def _told(value):
    """A JSON value; secrets are left out and bulky payloads summarised."""
    if isinstance(value, dict):
        if len(value) > 50:
            return f"<{len(value)} entries>"
        return {str(k): "<hidden>" if any(s in str(k).lower() for s in ("key", "token", "secret", "password")) and not str(k).endswith("_env") else _told(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return f"<{len(value)} items>" if len(value) > 200 else [_told(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) or value is None else f"<{type(value).__name__}>"


@dataclass
class RunConfig:
    top_n_articles: int | None = 50
    problem_description: str | None = None
    article_encoder: EncoderConfig = field(default_factory=EncoderConfig)
    keyword_encoder: EncoderConfig = field(default_factory=EncoderConfig)
    clustering: ClusteringConfig = field(default_factory=ClusteringConfig)
    gaps: GapConfig = field(default_factory=GapConfig)
    use_citations: bool = True

    def __post_init__(self) -> None:
        if self.top_n_articles is not None and self.top_n_articles < 1:
            raise ValueError("top_n_articles must be 1 or more, or None")

    @property
    def random_state(self) -> int:
        return self.clustering.random_state

    def to_dict(self) -> dict:
        out = dataclasses.asdict(self)
        for side in ("article_encoder", "keyword_encoder"):
            out[side]["extra"] = _told(out[side]["extra"])
        return out

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)

    def replace(self, **changes) -> RunConfig:
        return dataclasses.replace(self, **changes)

    def seeded(self, seed: int) -> RunConfig:
        return self.replace(clustering=dataclasses.replace(self.clustering, random_state=seed))
