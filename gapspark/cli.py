"""Command line: version, encoders, run, external."""

from __future__ import annotations

import argparse
import json
import sys

from gapspark.config import ClusteringConfig, EncoderConfig, GapConfig, RunConfig

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gapspark", description="Under-explored topics in a bibliographic corpus.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version", help="print the version")
    sub.add_parser("encoders", help="list the encoders")
    r = sub.add_parser("run", help="search a corpus for gaps")
    r.add_argument("csv")
    r.add_argument("--outdir", default="results")
    r.add_argument("--mode", choices=("articles_first", "keywords_first"), default="articles_first")
    r.add_argument("--top-n", type=int, default=50)
    r.add_argument("--problem")
    r.add_argument("--problem-file")
    r.add_argument("--encoder", default="tfidf-svd")
    r.add_argument("--model")
    r.add_argument("--api-key-env")
    r.add_argument("--clusters", type=int)
    r.add_argument("--percentile", type=float, default=95.0)
    r.add_argument("--max-gaps", type=int, default=3)
    r.add_argument("--min-tfidf", type=float, default=0.005)
    r.add_argument("--max-frequency", type=int, default=1)
    r.add_argument("--proportional", action="store_true", help="frequency ceiling of n/50 (keywords_first) or none (articles_first)")
    r.add_argument("--tokens", type=int, default=2, help="0 for any number")
    r.add_argument("--min-citations", type=int)
    r.add_argument("--max-citations", type=int)
    r.add_argument("--min-citations-per-year", type=float)
    r.add_argument("--citation-year", type=int)
    r.add_argument("--drop-uncited", action="store_true")
    r.add_argument("--seed", type=int, default=42)
    r.add_argument("--figures", action="store_true", help="save the data of the figures too")
    e = sub.add_parser("external", help="read a ranking made elsewhere")
    e.add_argument("ranking")
    e.add_argument("--corpus")
    e.add_argument("--outdir", default="results")
    e.add_argument("--keyword-column")
    e.add_argument("--score-column")
    e.add_argument("--top-n", type=int)
    e.add_argument("--name", default="external")
    return p


def build_config(a: argparse.Namespace) -> RunConfig:
    problem = a.problem
    if a.problem_file:
        with open(a.problem_file, encoding="utf-8") as f:
            problem = f.read().strip()
    encoder = EncoderConfig(a.encoder, a.model, a.api_key_env)
    gaps = GapConfig(
        periphery_percentile=a.percentile, max_gaps_per_cluster=a.max_gaps, min_tfidf=a.min_tfidf, max_keyword_frequency=None if a.proportional else a.max_frequency, gap_token_count=a.tokens or None,
        min_citations=a.min_citations, max_citations=a.max_citations, min_citations_per_year=a.min_citations_per_year, citation_year_reference=a.citation_year, keep_uncited_candidates=not a.drop_uncited)
    return RunConfig(a.top_n, problem, encoder, encoder, ClusteringConfig(n_clusters=a.clusters, random_state=a.seed), gaps)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "encoders":
        from gapspark.operators.encoders import available_encoders

        print("\n".join(available_encoders()))
        return 0
    from pyspark.sql import SparkSession

    from gapspark.plans.pipelines import run
    from gapspark.sources.corpus import load_csv
    from gapspark.sources.external import load_external_ranking

    spark = spark or SparkSession.builder.appName("gapspark").getOrCreate()
    if a.command == "run":
        result = run(load_csv(spark, a.csv), a.mode, build_config(a))
    else:
        corpus = load_csv(spark, a.corpus) if a.corpus else None
        result = load_external_ranking(spark, a.ranking, corpus, keyword_column=a.keyword_column, score_column=a.score_column, top_n=a.top_n, name=a.name)
    paths = result.save(a.outdir, result.mode.replace(":", "_"))
    if getattr(a, "figures", False):
        from gapspark.plans.figures import figure_data, save_figure_data

        paths["figures"] = save_figure_data(figure_data(result, result.vectors.get("keywords"), article_vectors=result.vectors.get("articles")), a.outdir)
    print(json.dumps(paths, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
