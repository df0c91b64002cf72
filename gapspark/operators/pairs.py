"""Pairs of related keywords of a cluster, by blocks whose bounds tell which of them need not be compared.

rows       scope..., cluster, keyword, first, frequency, tfidf, vector      `by` names scope and cluster

A cluster's rows are laid to the nearest of a few pivots, which are rows drawn by hash, and cut into blocks there. The angles of a
block's rows to its pivot are at most its radius, so the angle of any pair of two blocks is that of the pivots give or take both
radii (the triangle inequality on the sphere). That bounds the similarity of the pairs of two blocks, and with the blocks' greatest
frequency and salience it bounds their score. Bounds only ever leave out what cannot count: results are those of all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.config import GapConfig
from gapspark.functions import scores
from gapspark.sources.tables import materialized

#: Most pivots of a cluster (larger cells are cut by salience and hash instead), bands of salience, and rows of a task that lays rows to pivots.
PIVOTS, BANDS, PART = 64, 4, 8192
#: What rounding may take from an angle (the arc cosine loses half the digits near 1) and from a score.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 2e-9


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def placed(rows: DataFrame, by: list[str], merit: Column, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """rows with pivot, angle and block (by..., pivot, block name a block of about `block` rows), and the pivots (by..., pivot, axis).

    A vector without length has no angle; it counts as a right one to everything, as its similarity of 0 says, and all bounds
    hold for it. Ties go to the lower pivot. No task holds more than about PART rows or PIVOTS pivots of a cluster.
    """
    kept = materialized(rows.select(*by, "keyword", "first", "frequency", "tfidf", "vector"), "pair_rows")
    n = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))  # a row for each cluster
    lucky = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("keyword"), "keyword"))
    drawn = kept.select(*by, "keyword", "vector").withColumn("_r", lucky).where(F.col("_r") <= PIVOTS).join(F.broadcast(n), by)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    axis = F.when(length > 0, F.transform("vector", lambda x: x / length)).otherwise(F.col("vector"))
    pivots = materialized(drawn.where(F.col("_r") <= F.ceil(F.col("_n") / F.lit(block))).select(*by, (F.col("_r") - 1).alias("pivot"), axis.alias("axis"), "_n"), "pair_pivots")

    parts = F.ceil(F.col("_n") / F.lit(PART)).cast("int")
    left = kept.join(F.broadcast(n), by).withColumn("_part", F.pmod(F.xxhash64("keyword", F.lit("part")), parts).cast("int")).drop("_n")
    right = pivots.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")

    def lay(rows: pd.DataFrame, axes: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"keyword": [], "_p": [], "angle": []}).assign(**{c: [] for c in by})
        axes = axes.sort_values("pivot")
        sim = unit(np.array(rows["vector"].tolist(), float)) @ np.array(axes["axis"].tolist(), float).T
        at = sim.argmax(1)
        out = {"keyword": rows["keyword"], "_p": axes["pivot"].to_numpy()[at], "angle": np.arccos(sim[np.arange(len(at)), at].clip(-1, 1))}
        return pd.DataFrame({**{c: rows[c] for c in by}, **out})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    laid = left.select(*by, "_part", "keyword", "vector").groupBy(*by, "_part").cogroup(right.groupBy(*by, "_part")).applyInPandas(lay, f"{kinds}, keyword string, _p int, angle double")
    cell = kept.join(laid, [*by, "keyword"])
    # small clusters stay one block; others are told apart by what a keyword adds to a score, then by hash
    band = F.when(F.col("_n") > block, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999), merit)) * BANDS)).otherwise(0).cast("int")
    cell = materialized(cell.join(F.broadcast(n), by).withColumn("_band", band).drop("_n"), "pair_cells")
    # a row for each pivot and band of a cluster
    cuts = cell.groupBy(*by, "_p", "_band").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_cuts"))
    cut = cell.join(F.broadcast(cuts), [*by, "_p", "_band"]).withColumn("block", F.col("_band") + BANDS * F.pmod(F.xxhash64("keyword"), F.col("_cuts")).cast("int"))
    return cut.withColumnRenamed("_p", "pivot").drop("_band", "_cuts"), pivots.drop("_n")


def block_pairs(cells: DataFrame, pivots: DataFrame, by: list[str], config: GapConfig) -> DataFrame:
    """by..., pair, i, j, low, high, bound, possible: every pair of blocks of a cluster, i and j naming them as pivot and block.

    low and high bound the similarity of its pairs, bound their score; it is possible unless all pairs lie outside the window or
    have too little salience together.
    """
    size = cells.groupBy(*by, "pivot", "block").agg(
        F.max("angle").alias("radius"), F.max("tfidf").alias("t"), F.min("tfidf").alias("t0"), F.max("frequency").alias("f"), F.min("frequency").alias("f0"))
    axes = pivots.select(*by, F.col("pivot").alias("_a"), F.col("axis").alias("_x")).join(pivots.select(*by, F.col("pivot").alias("_b"), F.col("axis").alias("_y")), by).where("_a <= _b")
    dot = F.aggregate(F.zip_with("_x", "_y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    between = axes.select(*by, "_a", "_b", F.when(F.col("_a") == F.col("_b"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))).alias("theta"))
    side = lambda k: size.select(*by, F.struct("pivot", "block").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("radius", "t", "t0", "f", "f0")])
    two = side("i").join(side("j"), by).where("i <= j").withColumns({"_a": F.col("i.pivot"), "_b": F.col("j.pivot")}).join(between, [*by, "_a", "_b"])
    reach = F.col("radius_i") + F.col("radius_j") + ANGLE_SLACK
    high, low = F.cos(F.greatest(F.lit(0.0), F.col("theta") - reach)), F.cos(F.least(F.lit(float(np.pi)), F.col("theta") + reach))
    two = two.withColumns({"low": low, "high": high})
    (least, most), w, best = config.combination_similarity_range, config.combination_weights, config.combination_similarity_optimum
    mean = lambda c: (F.col(f"{c}_i") + F.col(f"{c}_j")) / 2
    possible = (F.col("high") > least) & (F.col("low") < most) & (mean("t") >= config.min_tfidf - SCORE_SLACK)
    # within the window the nearest similarity to the optimum is best, or the farthest where the weight is below 0
    a, b = F.greatest(F.col("low"), F.lit(float(least))), F.least(F.col("high"), F.lit(float(most)))
    near = F.greatest(a, F.least(b, F.lit(float(best)))) if w.similarity >= 0 else F.when(F.abs(a - best) > F.abs(b - best), a).otherwise(b)
    f, t = ("f" if w.frequency >= 0 else "f0"), ("t" if w.tfidf >= 0 else "t0")
    bound = scores.combination(near, F.col(f"{f}_i"), F.col(f"{f}_j"), mean(t), w, best) + SCORE_SLACK
    return two.select(*by, F.concat_ws(":", "i.pivot", "i.block", "j.pivot", "j.block").alias("pair"), "i", "j", "low", "high", bound.alias("bound"), possible.alias("possible"))


def compared(cells: DataFrame, chosen: DataFrame, by: list[str], config: GapConfig) -> DataFrame:
    """by..., similarity, mean_tfidf, keyword_, frequency_ and first_ 1 and 2: pairs of the chosen pairs of blocks inside the window.

    chosen is by..., pair, i, j, floor; pairs that score less than floor (where it is not null) stay out. One group is two blocks and
    one matrix product.
    """
    (low, high), least, w, best = config.combination_similarity_range, config.min_tfidf, config.combination_weights, config.combination_similarity_optimum
    first = cells.schema["first"].dataType
    rows = cells.select(*by, F.struct("pivot", "block").alias("_at"), "keyword", F.col("first.row_id").alias("r"), F.col("first.pos").alias("p"), "frequency", "tfidf", "vector")
    both = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    dealt = rows.join(chosen.select(*by, "pair", "floor", F.posexplode(both).alias("_side", "_at")), [*by, "_at"])
    kinds = {c: cells.schema[c].dataType.simpleString() for c in (*by, "frequency")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "p"]).reset_index(drop=True)
        x, t, f, side = unit(np.array(pdf["vector"].tolist(), float)), pdf["tfidf"].to_numpy(float), pdf["frequency"].to_numpy(float), pdf["_side"].to_numpy()
        here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = len(there) == 0
        there = here if same else there
        sim = x[here] @ x[there].T
        mean = (t[here][:, None] + t[there][None, :]) / 2
        keep = (sim > low) & (sim < high) & (mean >= least)
        if same:
            keep = np.triu(keep, 1)
        floor = pdf["floor"].iloc[0]
        if pd.notna(floor):
            score = w.similarity * (1 - 2 * np.abs(sim - best)) + w.frequency * np.minimum((f[here][:, None] + f[there][None, :]) / 10, 1) + w.tfidf * np.minimum(10 * mean, 1)
            keep &= score >= floor - SCORE_SLACK
        at, to = np.nonzero(keep)
        similarity, mean = sim[at, to], mean[at, to]
        a, b = here[at], there[to]
        a, b = np.minimum(a, b), np.maximum(a, b)  # rows are in order of appearance
        out = {**{c: pdf[c].iloc[:1].repeat(len(a)).to_numpy() for c in by}, "similarity": similarity, "mean_tfidf": mean}
        for k, rows in ((1, a), (2, b)):
            out |= {f"{name}_{k}": pdf[name].to_numpy()[rows] for name in ("keyword", "r", "p", "frequency")}
        return pd.DataFrame(out)

    sides = ", ".join(f"keyword_{k} string, r_{k} {first['row_id'].dataType.simpleString()}, p_{k} {first['pos'].dataType.simpleString()}, frequency_{k} {kinds['frequency']}" for k in (1, 2))
    found = dealt.groupBy(*by, "pair").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + f", similarity double, mean_tfidf double, {sides}")
    return found.withColumns({f"first_{k}": F.struct(F.col(f"r_{k}").alias("row_id"), F.col(f"p_{k}").alias("pos")) for k in (1, 2)}).drop("r_1", "p_1", "r_2", "p_2")


def _merit(config: GapConfig) -> Column:
    """A keyword's own share of a score, from 0 to 1: what frequency and salience can add."""
    w = config.combination_weights
    total = max(abs(w.frequency) + abs(w.tfidf), 1e-9)
    return (w.frequency * F.least(F.col("frequency") / 5.0, F.lit(1.0)) + w.tfidf * F.least(10 * F.col("tfidf"), F.lit(1.0))) / total


def related_pairs(rows: DataFrame, config: GapConfig, block: int = 1024, scope: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a cluster inside the similarity window, first before second; pairs of blocks outside it are not compared."""
    by = [*scope, "cluster"]
    cells, pivots = placed(rows, by, _merit(config), block)
    chosen = block_pairs(cells, pivots, by, config).where("possible").select(*by, "pair", "i", "j", F.lit(None).cast("double").alias("floor"))
    return compared(cells, chosen, by, config)


def _near(config: GapConfig) -> float:
    """The similarity inside the window that scores best."""
    (low, high), best = config.combination_similarity_range, config.combination_similarity_optimum
    return max(low, min(high, best)) if config.combination_weights.similarity >= 0 else max((low, high), key=lambda x: abs(x - best))


def _extremes(rows: DataFrame, by: list[str], config: GapConfig) -> DataFrame:
    """by..., _f, _t, _most: the frequency and salience of a partner that no other of the rows outdoes; a row for each cluster."""
    w = config.combination_weights
    least, most = lambda c: F.min(c), lambda c: F.max(c)
    return rows.groupBy(*by).agg((most if w.frequency >= 0 else least)("frequency").alias("_f"), (most if w.tfidf >= 0 else least)("tfidf").alias("_t"), F.max("tfidf").alias("_most"))


def reaching(rows: DataFrame, partners: DataFrame, floors: DataFrame, by: list[str], config: GapConfig) -> DataFrame:
    """The rows that a pair with one of the partners may lift to their cluster's floor; all of them where there is no floor."""
    bound = scores.combination(F.lit(_near(config)), F.col("frequency"), F.col("_f"), (F.col("tfidf") + F.col("_t")) / 2, config.combination_weights, config.combination_similarity_optimum)
    met = rows.join(F.broadcast(_extremes(partners, by, config)), by).join(floors, by, "left")
    keep = F.coalesce(bound + SCORE_SLACK >= F.col("floor"), F.lit(True)) & ((F.col("tfidf") + F.col("_most")) / 2 >= config.min_tfidf - SCORE_SLACK)
    return met.where(keep).drop("_f", "_t", "_most", "floor")


def best_pairs(rows: DataFrame, met: DataFrame, config: GapConfig, block: int = 1024, scope: tuple[str, ...] = (), wave: int = 16, log: list | None = None) -> DataFrame:
    """The max_gaps_per_cluster best pairs of each cluster, with their score, that are not in met (by..., left, right).

    A cluster's head is the block of rows whose frequency and salience can add most. Pairs inside the head are compared first and set a
    floor; then the head meets the other rows, each as far as the best partner opposite may lift it to the floor. What a keyword adds is no
    less alone than in a pair, so a pair outside the head reaches the floor only if floor and head leave room for it. For such pairs
    pairs of blocks are compared in waves, best bound first, each wave four times the one before, and those whose bound is below
    the floor are never multiplied. So a cluster is done once its gaps are certain. Scores that agree to 9 places are ties, which go to
    the first seen. A log gets the number of block pairs of each wave, and of all; the head counts as a block.
    """
    by = [*scope, "cluster"]
    w, none = config.combination_weights, F.lit(None).cast("double")
    own = max(w.frequency, 0) * F.least(F.col("frequency") / 10.0, F.lit(1.0)) + max(w.tfidf, 0) * F.least(5 * F.col("tfidf"), F.lit(1.0))
    kept = materialized(rows.select(*by, "keyword", "first", "frequency", "tfidf", "vector"), "pair_rows")
    met = materialized(met.select(*by, "left", "right"), "pair_met")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_own"), "keyword"))
    head = materialized(kept.withColumn("_own", own).withColumn("_r", place).where(F.col("_r") <= block).drop("_r", "_own"), "pair_head")
    tail = kept.join(F.broadcast(head.select(*by, "keyword")), [*by, "keyword"], "left_anti")
    best, counts = None, []

    def compare(cells: DataFrame, chosen: DataFrame) -> DataFrame:
        """Takes up what the chosen pairs of blocks have; returns the floors."""
        nonlocal best
        if log is not None:
            counts.append(chosen.count())
        found = compared(cells, chosen, by, config).withColumns({"left": F.least("keyword_1", "keyword_2"), "right": F.greatest("keyword_1", "keyword_2")}).join(met, [*by, "left", "right"], "left_anti").drop("left", "right")
        found = found.withColumn("score", scores.combination(F.col("similarity"), F.col("frequency_1"), F.col("frequency_2"), F.col("mean_tfidf"), w, config.combination_similarity_optimum))
        found = found if best is None else found.unionByName(best)
        top = found.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "first_1", "first_2"))).where(F.col("_r") <= config.max_gaps_per_cluster).drop("_r")
        best = materialized(top, "pair_best")  # a few rows for each cluster
        full = best.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
        return F.broadcast(full.where(F.col("n") >= config.max_gaps_per_cluster).select(*by, (F.col("floor") - SCORE_SLACK).alias("floor")))

    at = lambda k: F.struct(F.lit(-1).alias("pivot"), k.cast("int").alias("block"))
    inner = head.select(*by).distinct().select(*by, F.lit("head").alias("pair"), at(F.lit(0)).alias("i"), at(F.lit(0)).alias("j"), none.alias("floor"))
    floors = compare(head.withColumns({"pivot": F.lit(-1), "block": F.lit(0)}), inner)
    # the head meets the others in parts of a few blocks
    rest = materialized(reaching(tail, head, floors, by, config), "pair_tail")
    if not rest.isEmpty():
        parts = rest.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * block)).cast("int").alias("_parts"))  # a row for each cluster
        dealt = rest.join(F.broadcast(parts), by).withColumn("block", (1 + F.pmod(F.xxhash64("keyword", F.lit("part")), F.col("_parts"))).cast("int")).drop("_parts")
        cells = dealt.unionByName(reaching(head, rest, floors, by, config).withColumn("block", F.lit(0))).withColumn("pivot", F.lit(-1))
        outer = parts.withColumn("_k", F.explode(F.sequence(F.lit(1), "_parts"))).join(floors, by, "left")
        floors = compare(cells, outer.select(*by, F.concat(F.lit("head:"), F.col("_k")).alias("pair"), at(F.lit(0)).alias("i"), at(F.col("_k")).alias("j"), "floor"))
    # pairs without the head
    rest = materialized(reaching(tail, tail, floors, by, config), "pair_tail")
    if not rest.isEmpty():
        cells, pivots = placed(rest, by, _merit(config), block)
        # places by bound; a cluster's pairs of blocks are about (rows / block) squared, halved
        ordered = materialized(block_pairs(cells, pivots, by, config).where("possible").withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("bound"), "pair"))), "pair_order")
        done, last = 0, ordered.agg(F.max("place")).first()[0] or 0
        while done < last:
            left = ordered.where(F.col("place") > done).join(floors, by, "left").where("floor is null or bound >= floor")
            if left.isEmpty():
                break
            floors = compare(cells, left.where(F.col("place") <= done + wave))
            done, wave = done + wave, 4 * wave
    if log is not None:
        log.append({"waves": counts, "compared": sum(counts), "all": block_pairs(*placed(kept, by, _merit(config), block), by, config).count()})
    return best
