"""What the training-data operators share: reading tables, written tables, word tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case A-Z to lower case and nothing else; safe on UTF-8 because ASCII bytes never occur inside longer sequences.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _test_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='gapspark-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster that is an error, because executors
    would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local") or "local-cluster" in spark.conf.get("spark.master", ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _test_dir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gapspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gapspark_path = path
    return out


def packed_rows(df: DataFrame) -> DataFrame:
    """df as one struct column `doc`, so that no name of an operator's own can clash with a column of df."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def unpacked_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("doc").getField(c).alias(c) for c in columns])


def dropped(df: DataFrame) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    path = getattr(df, "_gapspark_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
