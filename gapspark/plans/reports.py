"""Flat tables for reports: sheets of results, arms of a study, audits of foreign lists, sensitivity to size and seed."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gapspark.config import RunConfig
from gapspark.functions.text import token_count
from gapspark.operators.detectors import flattened
from gapspark.plans.consensus import pairwise_jaccard, stability
from gapspark.plans.pipelines import MODES, encode_articles, encode_keywords, prepare
from gapspark.plans.results import PipelineResult
from gapspark.plans.studies import extreme_k
from gapspark.sources.corpus import Corpus
from gapspark.sources.external import load_external_ranking
from gapspark.sources.tables import materialized
from gapspark.validation import metrics as M


# Sheets

def gap_sheet(result: PipelineResult) -> DataFrame:
    """The gaps, flat, by type and falling score."""
    return flattened(result.gaps).orderBy("gap_type", F.desc("score"), "cluster", "keyword")


def corpus_sheet(corpora: Mapping[str, Corpus]) -> DataFrame:
    """One row a corpus: sizes, years, citations, records whose abstract is longer than 40 characters, keywords a record."""
    parts = []
    for name, corpus in corpora.items():
        parts.append(corpus.frame.agg(
            F.lit(name).alias("corpus"), F.lit(corpus.source_path).alias("file"), F.count(F.lit(1)).alias("n_records"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.percentile("year", F.lit(0.5)).alias("median_year"),
            F.percentile("citations", F.lit(0.5)).alias("median_citations"), F.round(F.avg("citations"), 2).alias("mean_citations"), F.count_if(F.length("abstract") > 40).alias("n_with_abstract"),
            F.round(F.avg(F.size("keywords_normalized")), 2).alias("mean_keywords_per_record")))
    return reduce(DataFrame.unionByName, parts)


def _row(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Facts that are on the driver already, one row each; what is nested becomes JSON."""
    plain = [{k: json.dumps(v, default=str) if isinstance(v, (dict, list, tuple)) else v for k, v in r.items()} for r in rows]
    names = list(dict.fromkeys(k for r in plain for k in r))

    def kind(k: str) -> str:
        values = [r[k] for r in plain if r.get(k) is not None]
        if values and all(isinstance(v, bool) for v in values):
            return "boolean"
        if values and all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            return "long"
        return "double" if values and all(isinstance(v, (int, float)) for v in values) else "string"

    kinds = {k: kind(k) for k in names}
    cast = {"double": float, "long": int, "boolean": bool, "string": str}
    data = [tuple(None if r.get(k) is None else cast[kinds[k]](r[k]) for k in names) for r in plain]
    return spark.createDataFrame(data, ", ".join(f"`{k}` {kinds[k]}" for k in names))


def diagnostics_sheet(spark: SparkSession, results: Mapping[str, Sequence[PipelineResult]]) -> DataFrame:
    """One row for each corpus and run."""
    rows = []
    for name, runs in results.items():
        for r in runs:
            d, quality, chosen = r.diagnostics, r.diagnostics.get("cluster_quality", {}), r.diagnostics.get("k_selection") or {}
            rows.append({
                "corpus": name, "mode": r.mode, "n_articles": r.articles.count(), "n_keywords": r.keywords.select("keyword").distinct().count(), "k": d.get("n_clusters"), "k_rule": chosen.get("rule"), "k_elbow": chosen.get("k_elbow"),
                "k_silhouette": chosen.get("k_silhouette"), **{q: quality.get(q) for q in ("silhouette", "davies_bouldin", "calinski_harabasz")}, "n_candidates": r.gaps.count(), "gap_types": {x.gap_type: x.n for x in r.gap_type_counts.collect()},
                "frequency_threshold": d.get("max_keyword_frequency"), "n_core_domain_terms": len(d.get("core_domain_terms", [])), "core_domain_terms": ", ".join(d.get("core_domain_terms", [])),
                "gaps_before_dedup": d.get("gaps_before_deduplication"), "gaps_after_dedup": d.get("gaps_after_deduplication"), "tfidf_match_types": d.get("tfidf_match_statistics"), "article_encoder": d.get("ranking")})
    return _row(spark, rows)


def validation_sheet(spark: SparkSession, reports: Mapping[tuple[str, str], object], held_out: Sequence[str] = ()) -> DataFrame:
    """One row for each (corpus, mode) of ValidationReports, with the leave-out check if annotators are held out."""
    rows = []
    for (corpus, mode), report in reports.items():
        c, s = report.comparison, report.summary()
        left_out = leave_out_concordance(report.judgements, held_out) if held_out else {}
        rows.append({
            "corpus": corpus, "mode": mode, "n_candidates": c["n_left"], "n_control": c["n_right"], "annotators": len(s["annotators"]), "n_judgements": report.judgements.count(), "gap_rate_candidates": c["gap_rate_left"],
            "gap_rate_control": c["gap_rate_right"], "gap_rate_delta_pp": c["gap_rate_difference_pp"], "novelty_candidates": c["mean_novelty_left"], "novelty_control": c["mean_novelty_right"], "novelty_change_pct": c["novelty_difference_percent"],
            "welch_t": c["welch_t"], "welch_p": c["welch_p"], "mannwhitney_p": c["mann_whitney_p"], "cohens_d": c["cohens_d"], "fleiss_kappa": s["fleiss_kappa"], "krippendorff_alpha": s["krippendorff_alpha"],
            "leaveout_spearman_rho": left_out.get("spearman"), "leaveout_spearman_p": left_out.get("spearman_p"), "leaveout_label_agreement": left_out.get("label_agreement"), "annotator_failures": s["failures"]})
    return _row(spark, rows)


# Arms and checks of a study

def load_arm(spark: SparkSession, folder: str, mode: str, suffix: str = "validation_annotations_disjoint") -> DataFrame | None:
    """keyword_set, keyword, gap_share, novelty, frequency, n_tokens of a saved study; None if it has no annotations.

    Frequency is the corpus's where the keyword table has one, and null for keywords that the table lacks.
    """
    read = lambda name: spark.read.options(header=True, multiLine=True, escape='"', inferSchema=True).csv(f"{folder.rstrip('/')}/{mode}_{name}.csv")
    try:
        judged = read(suffix)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    table = read("keywords")
    frequency = "global_frequency" if "global_frequency" in table.columns else "frequency"
    tokens = F.max("n_tokens") if "n_tokens" in table.columns else F.first(token_count(F.col("keyword")))
    facts = table.groupBy("keyword").agg(F.max(frequency).cast("long").alias("frequency"), tokens.cast("int").alias("n_tokens"))
    return M.keyword_level(judged).join(facts, "keyword", "left")


def leave_out_concordance(judgements: DataFrame, held_out: Sequence[str], keyword_set: str = "SELECTED") -> dict:
    """The held-out annotators against the rest of the panel on one set: a check between models, not a study with people."""
    own = judgements.where(F.col("keyword_set") == keyword_set)
    held, rest = own.where(F.col("annotator").isin(list(held_out))), own.where(~F.col("annotator").isin(list(held_out)))
    names = [[r.annotator for r in x.select("annotator").distinct().orderBy("annotator").collect()] for x in (held, rest)]
    if not all(names):
        return {"error": "not enough annotators to leave some out"}
    found = M.expert_concordance(held, rest).first().asDict()
    return found | {"spearman_p": M.spearman_p(found["spearman"], found["n_keywords"]), "held_out_annotators": names[0], "panel_annotators": names[1], "note": "model against model; not a study with human experts"}


def external_audit(spark: SparkSession, corpus: Corpus, judgements: DataFrame, own: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row: how a plain rarity list does as a foreign ranking on the study's judgements, beside the own candidates.

    keywords(keyword, global_frequency, n_tokens): the list has as many of the rarest keywords of two or more tokens as there
    are own candidates, scored 1 / (1 + frequency). Rates are over judged keywords, each counted once.
    """
    pool = keywords.where("n_tokens >= 2").groupBy("keyword").agg(F.max("global_frequency").alias("frequency"))
    chosen = own.select(F.lower("keyword").alias("keyword")).distinct()
    k = chosen.count()
    listed = extreme_k(pool.withColumn("first", F.col("keyword")), k).select("keyword", (1 / (1 + F.col("frequency"))).alias("score"))
    external = load_external_ranking(spark, listed, corpus, name="rarity")
    foreign = external.gaps.select(F.lower("keyword").alias("keyword")).distinct()
    level = M.keyword_level(judgements.withColumn("keyword_set", F.lit("all"))).withColumn("key", F.lower("keyword"))
    marked = level.join(foreign.select(F.col("keyword").alias("key"), F.lit(True).alias("in_list")), "key", "left").join(chosen.select(F.col("keyword").alias("key"), F.lit(True).alias("in_own")), "key", "left")
    there, mine = F.col("in_list").isNotNull(), F.col("in_own").isNotNull()
    rates = marked.agg(
        F.count_if(there).alias("n_scored"), (100 * F.avg(F.when(there, F.col("gap_share")))).alias("external_gap_rate"), F.avg(F.when(there, F.col("novelty"))).alias("external_novelty"), (100 * F.avg(F.when(~there, F.col("gap_share")))).alias("control_gap_rate"),
        (100 * F.avg(F.when(mine, F.col("gap_share")))).alias("package_gap_rate"), F.avg(F.when(mine, F.col("novelty"))).alias("package_novelty"))
    n = foreign.agg(F.count(F.lit(1)).alias("k_loaded")).join(foreign.join(chosen, "keyword").agg(F.count(F.lit(1)).alias("both")))
    union = F.lit(k) + F.col("k_loaded") - F.col("both")
    return rates.join(n).select(F.lit(k).cast("long").alias("k_requested"), "k_loaded", F.lit(external.mode).alias("mode_of_result"), *rates.columns, F.when(union > 0, F.col("both") / union).alias("overlap_with_package"))


# Sensitivity

def sensitivity(corpora: Mapping[str, Corpus], config: RunConfig, sizes: Sequence[int], seeds: Sequence[int] = (42, 43, 44, 45, 46), modes: Sequence[str] = ("articles_first", "keywords_first"), reference: int = 50) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row for each corpus, mode and size (with the overlap with the reference size's candidates), and a row for
    each corpus and mode about the overlaps of its seeds at the reference size. Texts are encoded once for each size."""
    spark = next(iter(corpora.values())).frame.sparkSession
    size_rows, seed_rows = [], []
    for name, corpus in corpora.items():
        shared = {}
        for n in dict.fromkeys([*sizes, reference]):
            sized = config.replace(top_n_articles=n)
            p = prepare(corpus, sized)
            shared[n] = sized, p, (encode_articles(p, sized) if "articles_first" in modes else None, encode_keywords(p, sized))
        for mode in modes:
            runs, facts = [], []
            for n in sizes:
                sized, p, vectors = shared[n]
                r = MODES[mode](corpus, sized, None, p, vectors)
                runs.append(r.gaps.select(F.lit(n).alias("run_id"), "keyword"))
                counts = {x.gap_type: x.n for x in r.gap_type_counts.collect()}
                facts.append({"corpus": name, "mode": mode, "n_articles": n, "k": r.diagnostics["n_clusters"], "n_keywords_in_space": r.keywords.select("keyword").distinct().count(), "n_gaps": sum(counts.values()),
                              **{f"n_{t.lower().replace(' ', '_').replace('-', '_')}": c for t, c in counts.items()}, "silhouette": r.diagnostics["cluster_quality"].get("silhouette")})
            found = materialized(reduce(DataFrame.unionByName, runs).distinct(), "sizes")
            listed = {r.run_id: r.candidates for r in found.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("keyword")), " | ").alias("candidates")).collect()}  # a row for each size
            grid = spark.createDataFrame([(n, n) for n in sizes], "run_id int, size int")
            near = {frozenset((r.left, r.right)): r.jaccard for r in pairwise_jaccard(found, grid).collect()} if reference in sizes else {}
            size_rows += [f | {"candidates": listed.get(f["n_articles"], ""), "jaccard_vs_reference": 1.0 if f["n_articles"] == reference else near.get(frozenset((f["n_articles"], reference)))} for f in facts]
            sized, p, vectors = shared[reference]
            seeded = [MODES[mode](corpus, sized.seeded(s), None, p, vectors).gaps.select(F.lit(s).alias("run_id"), "keyword") for s in seeds]
            sets = materialized(reduce(DataFrame.unionByName, seeded).distinct(), "seeds")
            t = stability(sets, spark.createDataFrame([(s, reference) for s in seeds], "run_id int, size int")).first()
            seed_rows.append({"corpus": name, "mode": mode, "n_seeds": len(seeds), "mean_pairwise_jaccard": t.mean_jaccard, "min_pairwise_jaccard": t.min_jaccard, "max_pairwise_jaccard": t.max_jaccard, "mean_n_gaps": t.mean_candidates_per_run})
    return _row(spark, size_rows), _row(spark, seed_rows)
