"""Sheets for human experts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.functions.order import numbered
from gapspark.sources.external import resolve_header
from gapspark.sources.tables import save_csv, save_parquet
from gapspark.validation import metrics as M
from gapspark.validation.protocol import RUBRIC


def build_expert_sheet(keywords: DataFrame, seed: int = 42) -> DataFrame:
    """item, keyword and empty columns to fill in: distinct keywords in a hash order that does not depend on partitioning."""
    distinct = keywords.select("keyword").distinct()
    shuffled = numbered(distinct.withColumn("_h", F.xxhash64(F.lit(seed), "keyword")), ["_h", "keyword"], "item")
    return shuffled.select("item", "keyword", F.lit(None).cast("double").alias("novelty"), F.lit(None).cast("string").alias("label"), F.lit("").alias("comment")).orderBy("item")


def rubric(spark: SparkSession, problem: str | None = None) -> DataFrame:
    """line, text: the problem, if there is one, and the rubric, as experts are given it."""
    lines = ([f"Problem: {problem}"] if problem else []) + RUBRIC.splitlines()
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


def write_expert_sheet(sheet: DataFrame, path: str, experts: Sequence[str], problem: str | None = None) -> str:
    """One partition for each expert; the rubric is written beside the sheet, at path_rubric."""
    save_csv(rubric(sheet.sparkSession, problem).coalesce(1), f"{path.rstrip('/')}_rubric")
    return save_parquet(sheet.withColumn("expert", F.explode(F.array(*[F.lit(e) for e in experts]))), path, "expert")


def clean_expert_sheet(rows: DataFrame, expert: str | None = None) -> DataFrame:
    """annotator, keyword, label, novelty: blanks go, novelty must be 1 to 10, unknown labels become null."""
    label = F.upper(F.trim(F.translate(F.col("label"), "_", " ")))
    novelty = F.trim(F.col("novelty").cast("string")).try_cast("double")
    out = rows.select((F.lit(expert) if expert is not None else F.col("expert")).alias("annotator"), F.trim("keyword").alias("keyword"), F.when(label.isin(*M.LABELS), label).alias("label"), novelty.alias("novelty"))
    return out.where((F.coalesce("keyword", F.lit("")) != "") & F.col("novelty").between(1, 10))


def load_expert_sheet(spark: SparkSession, path: str, expert: str | None = None) -> DataFrame:
    """A CSV, a folder of write_expert_sheet, or a workbook with a tab for each expert (where openpyxl is installed)."""
    if path.endswith((".xlsx", ".xlsm")):
        import pandas as pd

        tabs = pd.read_excel(path, sheet_name=None)
        frame = spark.createDataFrame(pd.concat([t.assign(expert=name) for name, t in tabs.items() if "keyword" in [str(c).lower() for c in t.columns]]))
    elif path.endswith((".csv", ".tsv")):
        frame = spark.read.options(header=True, sep="\t" if path.endswith("tsv") else ",", multiLine=True, escape='"').csv(path)
    else:
        frame = spark.read.parquet(path)
    named = {k: resolve_header(frame.columns, (k,)) for k in ("keyword", "novelty", "label")}
    missing = [k for k, v in named.items() if v is None]
    if missing:
        raise ValueError(f"the sheet lacks {', '.join(missing)}")
    rows = frame.select(*[F.col(f"`{v}`").alias(k) for k, v in named.items()], *([F.col("expert")] if "expert" in frame.columns and expert is None else [F.lit(expert or "expert").alias("expert")]))
    return clean_expert_sheet(rows)


def expert_report(experts: DataFrame, panel: DataFrame, keyword_set: str = "SELECTED") -> DataFrame:
    """The concordance of experts with the panel on one set."""
    return M.expert_concordance(experts.withColumn("keyword_set", F.lit(keyword_set)), panel.where(F.col("keyword_set") == keyword_set))
