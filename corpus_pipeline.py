"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Stages take every document their predecessor kept, nulls,
repeated rows and empty texts included; an empty table stays one. Columns beyond those of documents are not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.llm import decontaminate, pieces, quality, secrets, simhash
from gapspark.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts fail the rules; repeated rows stay or go together; an empty table stays one.
    """
    return quality.kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8 or more.

    Of each class the row of least doc_id stays (null ids last; of repeated rows one). Null and empty texts are one class.
    """
    return simhash.one_of_each(docs.select(*COLUMNS), words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with the benchmark.

    Null and empty texts and repeated rows stay; an empty benchmark contaminates nothing.
    """
    return decontaminate.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars made to fit.

    Null texts stay null; repeated rows stay.
    """
    return secrets.redacted(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document; null texts have no ids."""
    out = pieces.encoded(docs, pieces.model_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: The near-duplicate and quality stages are iterative and the last stage runs a tokenizer library; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "_"))
    return docs
