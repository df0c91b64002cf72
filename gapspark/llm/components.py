"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import dropped, written


def _linked_to_least(directed: DataFrame, keep) -> DataFrame:
    """Each neighbour v of u that keep admits, linked to the least of u and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    least = written(least, "least")  # both sides of the join are tables then, so that Spark may split a hot node
    return directed.join(least, directed["u"] == least["k"]).where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the least node that can be reached.

    Every round is one written table: no lineage grows, nothing reaches the driver but a count and a checksum.
    Hot nodes are aggregated before the shuffle, and the join back on them is one that Spark may split.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = written(edges.where("u <> v").select(u, v).distinct(), "edges")
    before = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(step, "edges")
        state = _state(new)
        dropped(now)
        now = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
