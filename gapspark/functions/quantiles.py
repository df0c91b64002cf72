"""Exact quantiles by refined histograms: counts below probes, narrowed until the two neighbours of a rank are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Probes between two bounds in one pass.
PROBES = 1024


def exact_quantiles(rows: DataFrame, by: list[str], column: str, share: float) -> DataFrame:
    """by..., quantile: the quantile of the column in each group, linear between the two ranks around it; nulls do not count.

    A group's quantile lies between its values of rank floor(h) and floor(h) + 1, h = share * (n - 1). Each pass counts, in
    a partial aggregate, how many values fall between probes that cut the bounds in equal parts, and the bounds of either rank
    become the least and greatest value between its probes; both bounds occur, so every pass leaves fewer distinct values or the value
    itself. No buffer holds a group's values. What stands between passes is a row for each group and rank.
    """
    from gapspark.sources.tables import materialized

    x = F.col(column).cast("double")
    kept = materialized(rows.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], x.alias("_x")).where("_x is not null"), "quantile_values")
    keys = [f"_g{i}" for i in range(len(by))]
    ends = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    h = F.lit(share) * (F.col("n") - 1)
    ranks = ends.withColumn("part", h - F.floor(h)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(h), F.least(F.floor(h) + 1, F.col("n") - 1)))))
    # below: values less than lo; a rank's value is in [lo, hi]
    now = materialized(ranks.withColumn("below", F.lit(0).cast("long")), "quantile_bounds")
    while not now.where("lo < hi").isEmpty():
        open_now = now.where("lo < hi")
        few = open_now.select(*[F.col(k).alias(f"{k}_") for k in keys], "rank", "lo", "hi", "below")
        met = kept.join(few, [kept[k].eqNullSafe(F.col(f"{k}_")) for k in keys]).where("_x >= lo and _x <= hi")
        cell = F.when(F.col("_x") >= F.col("hi"), PROBES).otherwise(F.least(F.lit(PROBES - 1), F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PROBES))).cast("int")
        cells = met.groupBy(*keys, "rank", "below", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("_x").alias("a"), F.max("_x").alias("b"))
        listed = cells.groupBy(*keys, "rank", "below").agg(F.array_sort(F.collect_list(F.struct("cell", "c", "a", "b"))).alias("s"))  # PROBES + 1 cells
        step = F.aggregate(
            "s", F.struct(F.col("below").alias("below"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")),
            lambda acc, c: F.when(acc["lo"].isNotNull(), acc).when(F.col("rank") < acc["below"] + c["c"], F.struct(acc["below"].alias("below"), c["a"].alias("lo"), c["b"].alias("hi"))).otherwise(F.struct((acc["below"] + c["c"]).alias("below"), acc["lo"].alias("lo"), acc["hi"].alias("hi"))))
        found = listed.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("rank").alias("rank_"), step.alias("t"))
        joined = now.join(found, [*[now[k].eqNullSafe(F.col(f"{k}_")) for k in keys], now["rank"] == F.col("rank_")], "left")
        now = materialized(joined.select(*keys, "n", F.coalesce("t.lo", "lo").alias("lo"), F.coalesce("t.hi", "hi").alias("hi"), "part", "rank", F.coalesce("t.below", "below").alias("below")), "quantile_bounds")
    two = now.groupBy(*keys).agg(F.min_by("lo", "rank").alias("_a"), F.max_by("lo", "rank").alias("_b"), F.first("part").alias("_p"))
    return two.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_p")).alias("quantile"))
