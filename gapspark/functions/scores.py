"""Scores of candidates (equations 7, 9 and 10) and the scalings they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.config import CombinationWeights, CrossClusterWeights, EmergingWeights


def minmax(x: Column, *by: str) -> Column:
    """(x - min) / (max - min) over the rows alike in `by`; 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.5))


def zscore(x: Column, *by: str) -> Column:
    """With the population's standard deviation; 0 where all are equal."""
    w = Window.partitionBy(*by)
    spread = F.stddev_pop(x).over(w)
    return F.when(spread > 0, (x - F.avg(x).over(w)) / spread).otherwise(F.lit(0.0))


def scaled(rows: DataFrame, by: tuple[str, ...], minmaxed: dict[str, str], zscored: dict[str, str] | None = None) -> DataFrame:
    """rows with scaled columns: minmaxed and zscored are {new column: column}; a column may be both, its z-score then min-maxed.

    Mean, spread, least and greatest of each group come from one partial aggregate, so that no task holds a group. A z-score
    rises with its column, so its own least and greatest follow from the column's.
    """
    zscored = zscored or {}
    plain = {c for c in [*minmaxed.values(), *zscored.values()] if c not in zscored}
    stats = [a for c in sorted(plain) for a in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))] + [a for c in sorted(set(zscored.values())) for a in (F.avg(c).alias(f"_mean_{c}"), F.stddev_pop(c).alias(f"_spread_{c}"))]
    groups = rows.groupBy(*by).agg(*stats)
    out = rows.join(groups, list(by)) if by else rows.join(F.broadcast(groups))
    z = lambda c, x: F.when(F.col(f"_spread_{c}") > 0, (x - F.col(f"_mean_{c}")) / F.col(f"_spread_{c}")).otherwise(F.lit(0.0))
    out = out.withColumns({into: z(c, F.col(c)) for into, c in zscored.items()})

    def between(c: str) -> Column:
        low, high = (z(zscored[c], F.col(f"_{end}_{zscored[c]}")) if c in zscored else F.col(f"_{end}_{c}") for end in ("lo", "hi"))
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.5))

    out = out.withColumns({into: between(c) for into, c in minmaxed.items()})
    return out.drop(*[c for c in out.columns if c.startswith(("_lo_", "_hi_", "_mean_", "_spread_"))])


def emerging(distance: Column, centrality: Column, tfidf: Column, rarity: Column, w: EmergingWeights) -> Column:
    return w.distance * distance + w.centrality * centrality + w.tfidf * tfidf + w.rarity * rarity


def combination(similarity: Column, f1: Column, f2: Column, tfidf: Column, w: CombinationWeights, optimum: float) -> Column:
    near = 1 - 2 * F.abs(similarity - optimum)
    return w.similarity * near + w.frequency * F.least((f1 + f2) / 10.0, F.lit(1.0)) + w.tfidf * F.least(10 * tfidf, F.lit(1.0))


def cross_cluster(frequency: Column, presence: Column, tfidf: Column, tfidf_max: Column, w: CrossClusterWeights) -> Column:
    salient = F.when(tfidf_max > 0, F.least(tfidf / tfidf_max, F.lit(1.0))).otherwise(F.lit(0.0))
    return w.frequency * F.least(frequency / 5.0, F.lit(1.0)) + w.specificity * (1 - presence) + w.tfidf * salient
