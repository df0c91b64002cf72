"""Rankings made by other tools, in the shape of a run's result."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.config import RunConfig
from gapspark.functions.order import numbered, running
from gapspark.functions.text import normalize_keyword, token_count
from gapspark.operators import detectors as D
from gapspark.operators import keywords as K
from gapspark.plans.results import PipelineResult
from gapspark.sources.corpus import Corpus, with_row_ids
from gapspark.sources.tables import materialized

EXTERNAL = "External Candidate"
# Accepted headers, in order of priority; also as whole words of a longer header.
KEYWORD_ALIASES = ("keyword", "term", "label", "item", "candidate", "name")
SCORE_ALIASES = ("score", "weight", "relevance", "value", "novelty", "strength")
RANK_ALIASES = ("rank", "position", "order", "place")
TYPE_ALIASES = ("gap_type", "type", "category", "class")


def resolve_header(columns: Sequence[str], aliases: Sequence[str], explicit: str | None = None) -> str | None:
    """The explicit column, else a header equal to an alias, else one that has an alias as a whole word."""
    if explicit is not None:
        if explicit not in columns:
            raise ValueError(f"no column {explicit!r}; the columns are {', '.join(columns)}")
        return explicit
    named = {c.strip().lower(): c for c in reversed(columns)}
    for a in aliases:
        if a in named:
            return named[a]
    for a in aliases:
        for c in columns:
            if a in re.split(r"[^0-9a-z]+", c.lower()):
                return c
    return None


def read_ranking(spark: SparkSession, source) -> DataFrame:
    """A DataFrame, a sequence of keywords, or a file: CSV, TSV, Parquet, or a workbook where openpyxl is installed."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        return spark.createDataFrame([(i, str(k)) for i, k in enumerate(source)], "row_id long, keyword string")
    kind = source.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xlsm", "xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(source))
    if kind == "parquet":
        return spark.read.parquet(source)
    if kind in ("csv", "tsv", "tab", "txt"):
        return spark.read.options(header=True, multiLine=True, escape='"', sep="\t" if kind in ("tsv", "tab") else ",").csv(source)
    raise ValueError(f"cannot read a .{kind} file as a ranking")


def ordered_ranking(frame: DataFrame, keyword: str, score: str | None, rank: str | None, gap_type: str | None, top_n: int | None = None, normalize: bool = True) -> DataFrame:
    """keyword, score, gap_type, external_rank, n_rows: rank ascending, else score descending, else file order.

    Blank keywords go first, then the top_n are taken and numbered (external_rank, from 1), then repeated keywords keep their
    first place. The score is the file's; in a file without scores it falls from 1 by equal steps over what is left.
    """
    trimmed = F.trim(F.col(f"`{keyword}`").cast("string"))
    number = lambda c: F.trim(F.col(f"`{c}`").cast("string")).try_cast("double")
    kind = F.trim(F.col(f"`{gap_type}`").cast("string")) if gap_type else F.lit(None).cast("string")
    rows = frame.select(
        "row_id", (normalize_keyword(trimmed) if normalize else trimmed).alias("keyword"), (number(score) if score else F.lit(None).cast("double")).alias("score"),
        (number(rank) if rank else F.lit(None).cast("double")).alias("_rank"), F.coalesce(F.when(kind != "", kind), F.lit(EXTERNAL)).alias("gap_type"))
    rows = rows.where(F.coalesce("keyword", F.lit("")) != "")
    order = [F.asc_nulls_last("_rank"), "row_id"] if rank else [F.desc_nulls_last("score"), "row_id"] if score else ["row_id"]
    if top_n:
        rows = rows.orderBy(*order).limit(top_n)
    placed = numbered(rows, order, "external_rank")
    first = placed.groupBy("keyword").agg(F.min_by(F.struct("score", "gap_type", "external_rank"), "external_rank").alias("x"), F.count(F.lit(1)).alias("n_rows")).select("keyword", "x.*", "n_rows")
    if score:
        return first
    n = first.agg(F.count(F.lit(1)).alias("_n"))
    return running(first, ["external_rank"], "_at").join(F.broadcast(n)).withColumn("score", 1 - F.col("_at") / F.col("_n")).drop("_at", "_n")


#: Unmatched keywords that the diagnostics of a foreign ranking name.
TOLD = 1000


def with_corpus_evidence(ranking: DataFrame, corpus: Corpus, most: int = 5) -> DataFrame:
    """ranking with frequency, n_articles, citations and the first titles of the corpus; unmatched keywords have 0 and null."""
    bag = corpus.bag
    keyed = ranking.withColumn("cluster", F.lit(-1))
    out = D.article_evidence(keyed, bag, corpus.frame, most=most, scoped=False)
    freq = K.keyword_frequencies(bag).select("keyword", "frequency")
    return out.join(freq, "keyword", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)).cast("long"))


def unmatched(ranking: DataFrame, corpus: Corpus) -> DataFrame:
    return ranking.select("keyword").join(corpus.bag.select("keyword"), "keyword", "left_anti")


def load_external_ranking(spark: SparkSession, source, corpus: Corpus | None = None, *, keyword_column: str | None = None, score_column: str | None = None, rank_column: str | None = None, type_column: str | None = None, top_n: int | None = None, config: RunConfig | None = None, name: str = "external", normalize: bool = True) -> PipelineResult:
    """A foreign ranking as a result whose gaps have cluster -1 and, given a corpus, its evidence."""
    frame = read_ranking(spark, source)
    headers = [c for c in frame.columns if c != "row_id"]
    frame = frame if "row_id" in frame.columns else with_row_ids(frame)
    keyword = resolve_header(headers, KEYWORD_ALIASES, keyword_column)
    if keyword is None:
        if len(headers) != 1:
            raise ValueError(f"no keyword column among {', '.join(headers)}")
        keyword = headers[0]
    score, rank, kind = (resolve_header([h for h in headers if h != keyword], a, x) for a, x in ((SCORE_ALIASES, score_column), (RANK_ALIASES, rank_column), (TYPE_ALIASES, type_column)))
    ranking = materialized(ordered_ranking(frame, keyword, score, rank, kind, top_n, normalize), "ranking")
    told = ranking.agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows")).first()
    if not told.n:
        raise ValueError("the ranking has no keywords")
    none = F.expr("array()").cast("array<string>")
    if corpus is None:
        rows = ranking.withColumns({"cluster": F.lit(-1), "frequency": F.lit(0).cast("long"), "n_articles": F.lit(0).cast("long"), "citations": F.lit(None).cast("double"), "article_titles": none, "article_dois": none})
        missing, places = [], None
    else:
        rows = with_corpus_evidence(ranking, corpus)
        places = unmatched(ranking, corpus).join(ranking.select("keyword", "external_rank"), "keyword").orderBy("external_rank")
        missing = [r.keyword for r in places.select("keyword").limit(TOLD).collect()]  # the first in the ranking's order; the result has them all
    rows = rows.withColumns({"members": F.array("keyword"), "rationale": F.format_string(f"place %d of the list {name}", F.col("external_rank")), "metrics": F.create_map(F.lit("external_rank"), F.col("external_rank").cast("double"))})
    gaps = rows.select(*D.GAP_COLUMNS, F.col("keyword").alias("keyword_display"), F.lit(name).alias("cluster_label")).orderBy("gap_type", F.desc("score"), F.col("metrics")["external_rank"])
    keywords = ranking.select("keyword", token_count(F.col("keyword")).alias("n_tokens")) if corpus is None else K.keyword_frequencies(corpus.bag).select("keyword", "frequency", F.lit(-1).alias("cluster"))
    facts = {
        "name": name, "source": source if isinstance(source, str) else type(source).__name__, "rows_read": told.rows, "candidates": told.n, "duplicates_dropped": told.rows - told.n, "keyword_column": keyword,
        "score_column": score, "rank_column": rank, "type_column": kind, "normalized": normalize, "corpus_attached": corpus is not None, "unmatched_in_corpus": missing, "n_unmatched": places.count() if places is not None else 0,
    }
    return PipelineResult("external", config or RunConfig(), corpus.frame if corpus else ranking.limit(0), keywords, gaps, None, {"external": facts}, unmatched=places)
