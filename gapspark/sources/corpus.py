"""Bibliographic exports as one canonical table.

Order decides results (first appearances, ties), so every record gets a row_id in file order at load.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapspark.functions import text as T
from gapspark.operators import keywords as K

# Accepted headers of each field, in order of priority. Database-assigned keywords (ID, Keywords Plus) are
# left out on purpose: only the authors' own keywords count.
COLUMN_ALIASES = {
    "title": ("title", "document title", "article title", "ti", "dc:title"),
    "abstract": ("abstract", "ab", "dc:description"),
    "author_keywords": ("author keywords", "authkeywords", "keywords", "author_keywords", "de", "author-keywords"),
    "year": ("year", "publication year", "py", "prism:coverdate", "cover date"),
    "citations": (
        "cited by", "citations", "times cited", "tc", "citedby-count", "cited-by", "citation count",
        "times cited, all databases", "times cited, wos core", "times cited, web of science core collection",
    ),
    "doi": ("doi", "di", "prism:doi"),
    "authors": ("authors", "author full names", "af", "au", "dc:creator"),
    "source": ("source title", "journal", "so", "prism:publicationname", "publication name"),
    "eid": ("eid", "scopus id", "uid", "ut", "ut (unique wos id)", "ut (unique id)", "wos id", "accession number"),
}
REQUIRED = ("title", "author_keywords")


def resolve_columns(columns: Sequence[str], column_map: Mapping[str, str] | None = None) -> dict[str, str]:
    """Canonical name -> the frame's header. An explicit mapping comes first; of headers that are alike the last counts."""
    by_name = {c.strip().lower(): c for c in columns}
    out: dict[str, str] = {}
    for name, header in (column_map or {}).items():
        if header in columns:
            out[name] = header
        elif header.strip().lower() in by_name:
            out[name] = by_name[header.strip().lower()]
        else:
            raise ValueError(f"column_map names {header!r}, which is not a column")
    for name, aliases in COLUMN_ALIASES.items():
        if name not in out:
            found = next((by_name[a] for a in aliases if a in by_name), None)
            if found is not None:
                out[name] = found
    missing = [c for c in REQUIRED if c not in out]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}; the columns are {', '.join(columns)}")
    return out


@dataclass
class Corpus:
    """Records: row_id, title, abstract, combined_text, doi, authors, source, eid, author_keywords, keywords_normalized, year, citations."""

    frame: DataFrame
    source_path: str | None = None
    column_map: dict[str, str] = field(default_factory=dict)
    dropped_empty_text: int = 0
    dropped_empty_keywords: int = 0

    @property
    def bag(self) -> DataFrame:
        return K.keyword_bag(self.frame)

    @property
    def n_articles(self) -> int:
        return self.frame.count()

    def __len__(self) -> int:
        return self.n_articles

    def _with(self, frame: DataFrame) -> Corpus:
        return Corpus(frame, self.source_path, self.column_map, self.dropped_empty_text, self.dropped_empty_keywords)

    def head(self, n: int) -> Corpus:
        return self._with(self.frame.orderBy("row_id").limit(n))

    def subset(self, condition: Column | str) -> Corpus:
        return self._with(self.frame.where(condition))

    def unique_keywords(self) -> DataFrame:
        return K.unique_keywords(self.bag)

    def spelling(self) -> DataFrame:
        return K.spellings(self.frame)

    def summary(self) -> DataFrame:
        return corpus_summary(self.frame, self.dropped_empty_text, self.dropped_empty_keywords)


def corpus_summary(articles: DataFrame, dropped_text: int = 0, dropped_keywords: int = 0) -> DataFrame:
    """One row about the corpus. The distinct keywords are counted exactly, from one aggregation by keyword."""
    whole = articles.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.avg(F.size("keywords_normalized")).alias("mean_keywords"),
        F.count_if(F.size("keywords_normalized") == 0).alias("without_keywords"),
        F.coalesce(F.bool_or(F.trim("abstract") != ""), F.lit(False)).alias("has_abstracts"),
        F.coalesce(F.bool_or(F.col("citations").isNotNull()), F.lit(False)).alias("has_citations"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
    )
    unique = articles.select(F.explode("keywords_normalized").alias("k")).where("k <> ''").agg(F.countDistinct("k").alias("unique_keywords"))
    return whole.join(F.broadcast(unique)).withColumns({"dropped_empty_text": F.lit(dropped_text).cast("long"), "dropped_empty_keywords": F.lit(dropped_keywords).cast("long")})


def with_row_ids(frame: DataFrame) -> DataFrame:
    """row_id ascends in the order in which Spark reads the files, without a shuffle; it need not be gapless."""
    return frame.withColumn("row_id", F.monotonically_increasing_id())


def canonical(frame: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The canonical table before records are dropped, as one projection."""
    c = lambda name: F.col(f"`{columns[name]}`") if name in columns else F.lit(None).cast("string")
    raw = c("author_keywords")
    is_list = "author_keywords" in columns and frame.schema[columns["author_keywords"]].dataType.typeName() == "array"
    split = F.coalesce(raw, F.expr("array()").cast("array<string>")) if is_list else T.split_author_keywords(raw)
    return frame.select(
        "row_id", T.known(c("title")).alias("title"), T.known(c("abstract")).alias("abstract"), *[T.known(c(n)).alias(n) for n in ("doi", "authors", "source", "eid")],
        split.alias("author_keywords"), T.coerce_year(c("year")).alias("year"), T.coerce_number(c("citations")).alias("citations"),
    ).withColumns({"combined_text": T.combined_text(F.col("title"), F.col("abstract")), "keywords_normalized": T.normalized_keywords(F.col("author_keywords"))})


def from_dataframe(frame: DataFrame, column_map: Mapping[str, str] | None = None, require_keywords: bool = True, source_path: str | None = None) -> Corpus:
    """Any frame as a corpus: records without text go, then, if keywords are required, those without keywords."""
    headers = [c for c in frame.columns if c != "row_id"]
    columns = resolve_columns(headers, column_map)
    numbered = frame if "row_id" in frame.columns else with_row_ids(frame)
    rows = canonical(numbered, columns)
    has_text, has_keywords = F.col("combined_text") != "", F.size("keywords_normalized") > 0
    counts = rows.agg(F.count_if(~has_text).alias("t"), F.count_if(has_text & ~has_keywords).alias("k")).first()
    kept = rows.where(has_text & has_keywords) if require_keywords else rows.where(has_text)
    return Corpus(kept, source_path, columns, counts["t"], counts["k"] if require_keywords else 0)


def load_csv(spark: SparkSession, path: str, column_map: Mapping[str, str] | None = None, require_keywords: bool = True, **options) -> Corpus:
    """A CSV or tab-delimited export; options go to the reader (sep, encoding, ...)."""
    given = {"header": True, "multiLine": True, "escape": '"', "quote": '"', **options}
    return from_dataframe(spark.read.options(**given).csv(path), column_map, require_keywords, path)


def load_parquet(spark: SparkSession, path: str, column_map: Mapping[str, str] | None = None, require_keywords: bool = True) -> Corpus:
    return from_dataframe(spark.read.parquet(path), column_map, require_keywords, path)


def load_json(spark: SparkSession, path: str, column_map: Mapping[str, str] | None = None, require_keywords: bool = True, **options) -> Corpus:
    return from_dataframe(spark.read.options(**options).json(path), column_map, require_keywords, path)
