"""Places in an order over all rows of a table, without a window that brings all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapspark.sources.tables import materialized


def running(df: DataFrame, order: list, into: str = "before", size: str | None = None) -> DataFrame:
    """df with `into`: the number of rows before each row in the order, or the sum of their `size`.

    The rows are dealt by ranges of the order and kept as a table, so that ranges are the same whenever it is read; what is
    broadcast is one number for each of its partitions. The order must be total, or places among equals are arbitrary.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = materialized(dealt.withColumns({"_gs_part": F.spark_partition_id(), "_gs_at": F.monotonically_increasing_id()}), "ordered")
    amount = F.lit(1) if size is None else F.col(size)
    totals = kept.groupBy("_gs_part").agg(F.sum(amount).alias("_gs_sum"))
    bases = totals.select("_gs_part", (F.sum("_gs_sum").over(Window.orderBy("_gs_part")) - F.col("_gs_sum")).alias("_gs_base"))
    if size is None:
        inside = F.col("_gs_at").bitwiseAND((1 << 33) - 1)  # the row's number in its partition
    else:
        inside = F.sum(amount).over(Window.partitionBy("_gs_part").orderBy("_gs_at")) - amount
    out = kept.withColumn("_gs_inside", inside).join(F.broadcast(bases), "_gs_part")
    return out.withColumn(into, F.col("_gs_base") + F.col("_gs_inside")).drop("_gs_part", "_gs_at", "_gs_base", "_gs_inside")


def numbered(df: DataFrame, order: list, into: str) -> DataFrame:
    """df with `into`: each row's place from 1."""
    return running(df, order, into).withColumn(into, (F.col(into) + 1).cast("long"))


def with_average_rank(df: DataFrame, value: str, into: str) -> DataFrame:
    """df with `into`: the rank of the value from 1, ties sharing their mean rank. Only distinct values are put in order."""
    counts = df.groupBy(F.col(value).alias("_gs_value")).agg(F.count(F.lit(1)).alias("_gs_n"))
    placed = running(counts, ["_gs_value"], "_gs_before", "_gs_n").select("_gs_value", (F.col("_gs_before") + (F.col("_gs_n") + 1) / 2.0).alias(into))
    return df.join(placed, F.col(value).eqNullSafe(F.col("_gs_value"))).drop("_gs_value")
