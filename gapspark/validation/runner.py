"""Annotation studies: who is compared with whom, who judges, and the report."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.functions.order import numbered
from gapspark.plans.results import PipelineResult
from gapspark.sources.tables import materialized, save_csv, save_json
from gapspark.validation import metrics as M
from gapspark.validation.annotators import Annotator
from gapspark.validation.protocol import annotations_frame


def expand_members(gaps: DataFrame) -> DataFrame:
    """keyword, ord: the distinct members of the gaps, in order of score."""
    ranked = numbered(gaps.select("members", "score", "gap_type", "cluster", "keyword"), [F.desc("score"), "gap_type", "cluster", "keyword"], "g")
    each = ranked.select("g", F.posexplode("members").alias("p", "keyword"))
    return each.groupBy("keyword").agg(F.min(F.struct("g", "p")).alias("ord"))


def control_split(selected: DataFrame, frequencies: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """keyword_set (SELECTED, CONTROL), keyword: the control set is disjoint from the selected one.

    frequencies(keyword, frequency, first) is the pool. With `most`, a control sample of that size by hash order; it is
    listed by corpus frequency, ties by first appearance. An empty control set is an error when the rows are read.
    """
    chosen = selected.select("keyword").distinct()
    rest = frequencies.join(chosen, "keyword", "left_anti")
    if most is not None:
        rest = rest.orderBy(F.xxhash64(F.lit(seed), "keyword"), "keyword").limit(most)
    rest = materialized(rest.select("keyword", "frequency", "first"), "control")  # read by the check, by the ranges of its order, and by the order
    if rest.isEmpty():
        raise ValueError("no keyword is left for a control set that is disjoint from the selected one")
    listed = numbered(rest, [F.desc("frequency"), "first"], "ord")
    return chosen.select(F.lit("SELECTED").alias("keyword_set"), "keyword", F.lit(0).cast("long").alias("ord")).unionByName(listed.select(F.lit("CONTROL").alias("keyword_set"), "keyword", "ord"))


def nested_split(selected: DataFrame, frequencies: DataFrame) -> DataFrame:
    """SELECTED and ALL, which contains it: tests between nested sets are suppressed, so prefer control_split."""
    warnings.warn("nested sets cannot be tested against each other; use control_split", DeprecationWarning, stacklevel=2)
    return selected.select(F.lit("SELECTED").alias("keyword_set"), "keyword").distinct().unionByName(frequencies.select(F.lit("ALL").alias("keyword_set"), "keyword").distinct())


@dataclass
class ValidationReport:
    judgements: DataFrame
    failures: dict[str, str] = field(default_factory=dict)
    left: str = "SELECTED"
    right: str = "CONTROL"

    @property
    def consensus(self) -> DataFrame:
        return M.keyword_consensus(self.judgements)

    @property
    def agreement(self) -> DataFrame:
        return M.pairwise_agreement(self.judgements)

    @property
    def annotators(self) -> list[str]:
        return [r.annotator for r in self.judgements.select("annotator").distinct().orderBy("annotator").collect()]

    @property
    def comparison(self) -> dict:
        rows = self.judgements.where(F.col("keyword_set").isin(self.left, self.right))
        return M.with_p_values(M.compare_sets(self.judgements, self.left, self.right), M.tie_sum(rows).first()[0] or 0.0)

    def unanimous_gaps(self) -> DataFrame:
        return self.consensus.where((F.col("keyword_set") == "SELECTED") & (F.col("gap_share") == 1.0)).select("keyword")

    def summary(self) -> dict:
        own = self.judgements.where(F.col("keyword_set") == self.left)
        return {
            "annotators": self.annotators, "failures": self.failures, "comparison": self.comparison,
            "sets": {r.keyword_set: r.asDict() for r in M.label_rates(self.judgements, "keyword_set").collect()}, "novelty": {r.keyword_set: r.asDict() for r in M.novelty_statistics(self.judgements, "keyword_set").collect()},
            "fleiss_kappa": M.fleiss_kappa(own).first()[0], "krippendorff_alpha": M.krippendorff_alpha(own).first()[0], "unanimous_gaps": [r.keyword for r in self.unanimous_gaps().collect()],
        }

    def save(self, folder: str, prefix: str = "validation") -> dict[str, str]:
        base = f"{folder.rstrip('/')}/{prefix}"
        return {
            "annotations": save_csv(self.judgements, f"{base}_annotations.csv"), "consensus": save_csv(self.consensus, f"{base}_consensus.csv"),
            "agreement": save_csv(self.agreement, f"{base}_agreement.csv"), "summary": save_json(self.judgements.sparkSession, self.summary(), f"{base}_summary.json"),
        }


def missing_judgements(wanted: DataFrame, stored: DataFrame, annotator: str) -> DataFrame:
    """keyword_set, keyword that the annotator has not judged yet."""
    return wanted.select("keyword_set", "keyword").join(stored.where(F.col("annotator") == annotator).select("keyword_set", "keyword"), ["keyword_set", "keyword"], "left_anti")


def validate_gaps(result: PipelineResult, frequencies: DataFrame, annotators: Sequence[Annotator], domain: str, sets: DataFrame | None = None, stored: DataFrame | None = None, problem: str | None = None, most: int | None = None, nested: bool = False) -> ValidationReport:
    """Judge the selected keywords and a control set. What is stored is not asked again; an annotator that fails is noted."""
    spark = result.gaps.sparkSession
    if sets is None:
        chosen = expand_members(result.gaps)
        sets = nested_split(chosen, frequencies) if nested else control_split(chosen, frequencies, most)
    new, failures = [], {}
    for a in annotators:
        wanted = sets.select("keyword_set", "keyword") if stored is None else missing_judgements(sets, stored, a.name)
        try:
            for name, keys in ((n, [r.keyword for r in wanted.where(F.col("keyword_set") == n).orderBy("keyword").collect()]) for n in ("SELECTED", "ALL" if nested else "CONTROL")):  # a study's keywords
                new += a.annotate(keys, name, domain, problem)
        except Exception as e:
            failures[a.name] = str(e)
    if not new and stored is None:
        raise RuntimeError(f"every annotator failed: {failures}")
    judged = annotations_frame(spark, new)
    if stored is not None:
        judged = stored.select(*judged.columns).unionByName(judged)
    return ValidationReport(judged, failures, right="ALL" if nested else "CONTROL")
