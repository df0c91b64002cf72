"""Written tables: how results that many later steps read are kept, and how results are saved."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _test_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='gapspark-')}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster that is an error, because executors
    would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _test_folder()
    return folder.rstrip("/")


def materialized(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/gapspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by ` | `, maps and structs as JSON, so the table can be CSV."""
    out = []
    for c, kind in df.dtypes:
        if kind == "array<string>":
            out.append(F.array_join(c, " | ").alias(c))
        elif kind.startswith(("array", "map", "struct")):
            out.append(F.to_json(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def save_csv(df: DataFrame, path: str) -> str:
    """A report as one CSV file with a header (reports are small; use save_parquet for data)."""
    flat(df).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    return path


def save_parquet(df: DataFrame, path: str, *partition_by: str) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def save_json(spark: SparkSession, value: dict, path: str) -> str:
    spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
