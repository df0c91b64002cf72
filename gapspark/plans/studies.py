"""Studies of rankings and arms: overlaps, baselines, resampling, ablations and sweeps.

Random draws are orders by the MD5 of (seed, replicate, key): they repeat on any partitioning and need no driver loop.
"""

from __future__ import annotations

import math
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.functions import tails
from gapspark.functions.order import numbered, running
from gapspark.functions.scores import emerging
from gapspark.config import EmergingWeights
from gapspark.sources.tables import materialized
from gapspark.plans.inversions import discordant_pairs, tau
from gapspark.validation.metrics import krippendorff_alpha


def hashed(seed: int, *parts) -> Column:
    """The MD5 of the seed and the parts: an order that any engine with MD5 repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def drawn(n: Column, seed: int, *parts) -> Column:
    """A position from 0 to n - 1 by the first 52 bits of that hash."""
    return F.pmod(F.conv(F.substring(hashed(seed, *parts), 1, 13), 16, 10).cast("long"), n)


def ranked(gaps: DataFrame, *by: str) -> DataFrame:
    """by..., keyword, rank: distinct keywords by their best score (ties: by keyword)."""
    best = gaps.groupBy(*by, "keyword").agg(F.max("score").alias("score"))
    return best.select(*by, "keyword", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "keyword")).alias("rank"))


def rank_biased_overlap(a: DataFrame, b: DataFrame, p: float = 0.9) -> DataFrame:
    """One row: extrapolated RBO (Webber et al., 2010) of rankings a and b (keyword, rank), to the shorter one's depth.

    A keyword that both lists have by depth e adds 1/d to the agreement of every depth d from there on, so each adds its own
    share of the sum and nothing runs over depths. Weights p^d fall so fast that a share has a few hundred terms.
    """
    la, lb = a.select("keyword", F.col("rank").alias("ra")), b.select("keyword", F.col("rank").alias("rb"))
    size = a.agg(F.max("rank").alias("n")).join(F.broadcast(b.agg(F.max("rank").alias("m")))).select(F.least("n", "m").cast("long").alias("k"))  # one row
    far = math.ceil(math.log(1e-18) / math.log(p))
    both = la.join(lb, "keyword").select(F.greatest("ra", "rb").cast("long").alias("e")).join(F.broadcast(size)).where("e <= k")
    share = F.aggregate(F.sequence("e", F.least("k", F.col("e") + far)), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d) / d)
    told = both.agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("xk"))
    return told.join(F.broadcast(size)).select((F.col("xk") / F.col("k") * F.pow(F.lit(p), F.col("k")) + (1 - p) / p * F.col("s")).alias("rbo"))


def kendall_tau(a: DataFrame, b: DataFrame, block: int = 20_000) -> DataFrame:
    """One row: tau of the shared keywords (ranks without ties) and how many there are; see discordant_pairs."""
    both = a.select("keyword", F.col("rank").alias("ra")).join(b.select("keyword", F.col("rank").alias("rb")), "keyword")
    return discordant_pairs(both, [], block).select(tau(F.col("n"), F.col("discordant")).alias("tau"), F.col("n").alias("n_shared"))


def top_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row: how many of the first k keywords the lists share, and whether the first is the same."""
    both = a.where(F.col("rank") <= k).select("keyword", F.col("rank").alias("ra")).join(b.where(F.col("rank") <= k).select("keyword", F.col("rank").alias("rb")), "keyword")
    return both.agg(F.count(F.lit(1)).alias("overlap"), F.coalesce(F.bool_or((F.col("ra") == 1) & (F.col("rb") == 1)), F.lit(False)).alias("same_first"))


def eligible_pool(frequencies: DataFrame, config, core: DataFrame | None, selected: DataFrame) -> DataFrame:
    """Keywords that pass the filters but were not selected."""
    from gapspark.operators.keywords import candidates

    rows = candidates(frequencies, config, core)
    if config.max_keyword_frequency is not None:
        rows = rows.where(F.col("frequency") <= config.max_keyword_frequency)
    return rows.join(selected.select("keyword"), "keyword", "left_anti")


def disjoint_arms(judgements: DataFrame, selected: DataFrame) -> DataFrame:
    """judgements with keyword_set SELECTED or CONTROL by membership, each keyword in one arm."""
    mine = judgements.drop("keyword_set").join(selected.select("keyword").distinct().withColumn("keyword_set", F.lit("SELECTED")), "keyword", "left")
    return mine.withColumn("keyword_set", F.coalesce("keyword_set", F.lit("CONTROL")))


def three_arms(judgements: DataFrame, selected: DataFrame, eligible: DataFrame) -> DataFrame:
    """SELECTED; ELIGIBLE (passes the filters, not selected); REST: the effect of filters apart from that of ranking."""
    arms = selected.select("keyword").distinct().withColumn("arm", F.lit("SELECTED")).unionByName(eligible.select("keyword").distinct().join(selected.select("keyword"), "keyword", "left_anti").withColumn("arm", F.lit("ELIGIBLE")))
    return judgements.join(arms, "keyword", "left").withColumn("arm", F.coalesce("arm", F.lit("REST")))


def extreme_k(frequencies: DataFrame, k: int, rarest: bool = True) -> DataFrame:
    """The k rarest (or commonest) keywords; ties by first appearance."""
    return frequencies.orderBy(F.asc("frequency") if rarest else F.desc("frequency"), "first").limit(k)


def random_draw(pool: DataFrame, k: int, reps: int, seed: int = 42) -> DataFrame:
    """rep, keyword: k keywords for each replicate, by hash order; the pool is judged keywords, the draws are spread by rep."""
    reps_of = pool.sparkSession.range(reps).withColumnRenamed("id", "rep")
    each = pool.select("keyword").distinct().join(F.broadcast(reps_of))  # pool x reps, as resampling is
    place = F.row_number().over(Window.partitionBy("rep").orderBy(hashed(seed, "rep", "keyword"), "keyword"))
    return each.withColumn("p", place).where(F.col("p") <= k).select("rep", "keyword")


def rarity_matched_draw(pool: DataFrame, selected: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """rep, keyword: for each frequency as many keywords of pool(keyword, frequency) as selected(keyword, frequency) has."""
    quota = selected.groupBy("frequency").agg(F.count(F.lit(1)).alias("quota"))
    rest = materialized(pool.join(selected.select("keyword"), "keyword", "left_anti").join(F.broadcast(quota), "frequency"), "draw_pool")  # a row for each frequency
    h = hashed(seed, "rep", "keyword")
    each = rest.join(F.broadcast(pool.sparkSession.range(reps).withColumnRenamed("id", "rep"))).withColumn("_cell", F.substring(h, 1, 4))
    # keywords before the hash cell in which a quota is filled are drawn, and only those in that cell are put in order
    cells = each.groupBy("rep", "frequency", "quota", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("rep", "frequency").orderBy("_cell"))
    last = cells.withColumn("_before", upto - F.col("_n")).where(F.col("_before") < F.col("quota")).groupBy("rep", "frequency").agg(F.max(F.struct("_cell", "_before")).alias("_last"))
    near = each.join(F.broadcast(last), ["rep", "frequency"])
    sure = near.where(F.col("_cell") < F.col("_last._cell"))
    place = F.row_number().over(Window.partitionBy("rep", "frequency").orderBy(h, "keyword"))
    filled = near.where(F.col("_cell") == F.col("_last._cell")).withColumn("p", place).where(F.col("p") <= F.col("quota") - F.col("_last._before"))
    return sure.select("rep", "keyword", "frequency").unionByName(filled.select("rep", "keyword", "frequency"))


def drawn_arms(draws: DataFrame, level: DataFrame) -> DataFrame:
    """rep, n, gap_rate, novelty of draws(rep, keyword) judged by level(keyword, gap_share, novelty): the arms of a random control."""
    return draws.join(level.select("keyword", "gap_share", "novelty"), "keyword").groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.avg("gap_share").alias("gap_rate"), F.avg("novelty").alias("novelty"))


def against_draws(selected: DataFrame, arms: DataFrame, tail: float = 0.025) -> DataFrame:
    """One row: the selected keywords' GAP rate and novelty beside the arms' mean and interval, and the share of arms that reach them."""
    own = selected.agg(F.avg("gap_share").alias("gap_rate"), F.avg("novelty").alias("novelty"))
    each = arms.select(*[F.col(c).alias(f"arm_{c}") for c in ("gap_rate", "novelty")]).join(F.broadcast(own))
    return each.groupBy("gap_rate", "novelty").agg(*[x for c in ("gap_rate", "novelty") for x in (
        F.avg(f"arm_{c}").alias(f"mean_{c}"), F.percentile(f"arm_{c}", F.lit(tail)).alias(f"low_{c}"), F.percentile(f"arm_{c}", F.lit(1 - tail)).alias(f"high_{c}"), F.avg((F.col(f"arm_{c}") >= F.col(c)).cast("double")).alias(f"reach_{c}"))])


def bootstrap_mean_difference(values: DataFrame, reps: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: difference of means of values(is_left, x) with a percentile interval.

    Draw j of a replicate takes the value at a position that follows from an MD5 hash.
    """
    values = values.select("is_left", F.col("x").cast("double").alias("x")).where("x is not null")
    sizes = values.groupBy("is_left").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    pos = numbered(values, [F.desc("is_left"), "x"], "i")
    first = pos.groupBy("is_left").agg(F.min("i").alias("first"))
    pos = pos.join(F.broadcast(first), "is_left").select("is_left", "x", (F.col("i") - F.col("first")).alias("i"))
    draws = sizes.join(F.broadcast(values.sparkSession.range(reps).withColumnRenamed("id", "rep"))).select("is_left", "n", "rep", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("j"))
    draws = draws.withColumn("i", drawn(F.col("n"), seed, "rep", F.col("is_left").cast("int"), "j"))
    means = draws.join(pos, ["is_left", "i"]).groupBy("rep").agg((F.avg(F.when(F.col("is_left"), F.col("x"))) - F.avg(F.when(~F.col("is_left"), F.col("x")))).alias("d"))
    point = sizes.agg((F.max(F.when(F.col("is_left"), F.col("m"))) - F.max(F.when(~F.col("is_left"), F.col("m")))).alias("difference"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high")).join(F.broadcast(point))


def cluster_bootstrap(values: DataFrame, reps: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """As above for values(cluster, is_left, x), resampling whole clusters by their sums."""
    sums = values.groupBy("cluster").agg(*[f(F.when(F.col("is_left") == w, F.col("x"))).alias(f"{n}{k}") for n, f in (("s", F.sum), ("n", F.count)) for k, w in (("l", True), ("r", False))])
    sums = running(sums, ["cluster"], "i")
    size = sums.agg(F.count(F.lit(1)).alias("k"))
    draws = values.sparkSession.range(reps).withColumnRenamed("id", "rep").join(F.broadcast(size)).select("rep", "k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("j"))
    draws = draws.withColumn("i", drawn(F.col("k"), seed, "rep", "j"))
    d = draws.join(sums, "i").groupBy("rep").agg((F.sum("sl") / F.sum("nl") - F.sum("sr") / F.sum("nr")).alias("d"))
    tail = (1 - level) / 2
    return d.agg(F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(0.5)).alias("median"), F.percentile("d", F.lit(1 - tail)).alias("high"))


def bootstrap_alpha(judgements: DataFrame, reps: int = 400, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row (low, high, n_defined): a percentile interval of the ordinal alpha over resampled keywords.

    The replicate is a key of one plan; a keyword drawn twice counts as two units.
    """
    keys = running(judgements.select("keyword").distinct(), ["keyword"], "i")
    size = keys.agg(F.count(F.lit(1)).alias("k"))
    draws = judgements.sparkSession.range(reps).withColumnRenamed("id", "rep").join(F.broadcast(size)).select("rep", "k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("j"))
    draws = draws.select("rep", "j", drawn(F.col("k"), seed, "rep", "j").alias("i")).join(keys, "i")
    sample = draws.join(judgements, "keyword").withColumn("keyword", F.concat_ws("#", "keyword", "j"))
    alphas = krippendorff_alpha(sample, "rep").where("alpha is not null")
    tail = (1 - level) / 2
    return alphas.agg(F.percentile("alpha", F.lit(tail)).alias("low"), F.percentile("alpha", F.lit(1 - tail)).alias("high"), F.count(F.lit(1)).alias("n_defined"))


def without(component: str, weights: EmergingWeights = EmergingWeights()) -> EmergingWeights:
    """The weights without one component, the others scaled to a sum of 1."""
    kept = {k: 0.0 if k == component else v for k, v in asdict(weights).items()}
    return EmergingWeights(**{k: v / sum(kept.values()) for k, v in kept.items()})


COMPONENTS = tuple(asdict(EmergingWeights()))
WEIGHT_VARIANTS = {"default": EmergingWeights(), "equal": EmergingWeights(0.25, 0.25, 0.25, 0.25)} | {f"no_{c}": without(c) for c in COMPONENTS}


def ablated(candidates: DataFrame, variants: dict[str, EmergingWeights] = WEIGHT_VARIANTS) -> DataFrame:
    """variant, cluster, keyword, score, rank of candidates(cluster, keyword, distance, centrality, tfidf, rarity), scaled in the cluster.

    A component that does not vary counts 0 here, unlike in the detector.
    """
    names = ("distance", "centrality", "tfidf", "rarity")
    ends = candidates.groupBy("cluster").agg(*[f(c).alias(f"_{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))

    parts = {c: scaled(c) for c in names}
    rows = candidates.join(ends, "cluster").select("cluster", "keyword", *[v.alias(k) for k, v in parts.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), emerging(*[F.col(k) for k in parts], v).alias("score")) for n, v in variants.items()])).alias("v")
    out = rows.select("cluster", "keyword", each).select("v.variant", "cluster", "keyword", "v.score")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("variant", "cluster").orderBy(F.desc("score"), "keyword")))


def ablation_report(ranks: DataFrame, reference: str = "default", k: int = 5, p: float = 0.9, by: str = "cluster") -> DataFrame:
    """by, variant, n_candidates, kendall_tau, rbo, top_overlap (of the first k, as a share of k), same_first, against the reference.

    A variant ranks the same candidates, so ranks are compared where they are: an overlap at depth d is a candidate whose two
    ranks are d or less. Tau needs three candidates. The RBO is the sum over the depths of the list, not extrapolated.
    """
    ref = ranks.where(F.col("variant") == reference).select(by, "keyword", F.col("rank").alias("ref"))
    both = ranks.where(F.col("variant") != reference).join(ref, [by, "keyword"])
    group = [by, "variant"]
    facts = both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_candidates"), (F.count_if((F.col("rank") <= k) & (F.col("ref") <= k)) / k).alias("top_overlap"), F.coalesce(F.bool_or((F.col("rank") == 1) & (F.col("ref") == 1)), F.lit(False)).alias("same_first"))
    told = discordant_pairs(both.select(*group, F.col("ref").alias("ra"), F.col("rank").alias("rb")), group).select(*group, tau(F.col("n"), F.col("discordant")).alias("tau"))
    # a candidate that both lists have by depth e adds to every depth from there on, until weights are nothing
    far = math.ceil(math.log(1e-18) / math.log(p))
    depth = F.greatest("rank", "ref").cast("long")
    share = F.aggregate(F.sequence("depth", F.least("n_candidates", F.col("depth") + far)), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1) / d)
    rbo = both.select(*group, depth.alias("depth")).join(facts.select(*group, "n_candidates"), group).groupBy(*group).agg(((1 - p) * F.sum(share)).alias("rbo"))
    out = facts.join(told, group, "left").join(rbo, group)
    return out.select(*group, "n_candidates", F.when(F.col("n_candidates") >= 3, F.col("tau")).alias("kendall_tau"), "rbo", "top_overlap", "same_first")


def ablation_aggregate(report: DataFrame) -> DataFrame:
    """variant with the least and greatest tau, RBO and overlap of the first ones over all lists."""
    return report.groupBy("variant").agg(*[f(c).alias(f"{c}_{n}") for c in ("kendall_tau", "rbo", "top_overlap") for n, f in (("min", F.min), ("max", F.max))])


def ceiling_sweep(candidates: DataFrame, ceilings: list[int], reference: int = 1) -> DataFrame:
    """ceiling, n, shared, jaccard: candidates(keyword, frequency) under each ceiling against the reference ceiling."""
    each = candidates.select("keyword", "frequency").distinct().withColumn("ceiling", F.explode(F.array(*[F.lit(c) for c in ceilings]))).withColumns({"a": F.col("frequency") <= F.col("ceiling"), "b": F.col("frequency") <= reference})
    out = each.groupBy("ceiling").agg(F.count_if("a").alias("n"), F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") | F.col("b")).alias("u"))
    return out.select("ceiling", "n", "shared", F.when(F.col("u") > 0, F.col("shared") / F.col("u")).alias("jaccard"))


def blind_aware_shift(blind: DataFrame, aware: DataFrame) -> DataFrame:
    """One row: pairs of the same annotator, set and keyword judged without and with corpus evidence."""
    keys = ["annotator", "keyword_set", "keyword"]
    both = blind.select(*keys, F.col("label").alias("l0"), F.col("novelty").alias("n0")).join(aware.select(*keys, F.col("label").alias("l1"), F.col("novelty").alias("n1")), keys)
    return both.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("n1") - F.col("n0")).alias("mean_shift"), F.avg((F.col("l0") != F.col("l1")).cast("double")).alias("label_changed"),
        F.count_if((F.col("l0") != "GAP") & (F.col("l1") == "GAP")).alias("to_gap"), F.count_if((F.col("l0") == "GAP") & (F.col("l1") != "GAP")).alias("from_gap"))


def construct_validity(selected: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row: overlap of the selected keywords with as many rarest ones, shares of singletons and of several tokens, median frequency."""
    from gapspark.functions.text import token_count

    k = selected.select("keyword").distinct().count()
    rare = extreme_k(frequencies, k).select("keyword").withColumn("rare", F.lit(1))
    rows = selected.select("keyword").distinct().join(frequencies.select("keyword", "frequency"), "keyword").join(rare, "keyword", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("rare", F.lit(0)).cast("double")).alias("overlap_rarest"), F.avg((F.col("frequency") == 1).cast("double")).alias("singletons"), F.avg((token_count(F.col("keyword")) > 1).cast("double")).alias("multi_token"), F.percentile("frequency", F.lit(0.5)).alias("median_frequency"))


def corpus_evidence(keywords: DataFrame, bag: DataFrame, articles: DataFrame, most: int = 5) -> DataFrame:
    """keyword, n_articles, titles: what a corpus-aware prompt shows."""
    from gapspark.operators.detectors import article_evidence

    return article_evidence(keywords.select("keyword", F.lit(-1).alias("cluster")).distinct(), bag, articles, most=most, scoped=False).select("keyword", "n_articles", F.col("article_titles").alias("titles"))


def canonical_names(rows: DataFrame, aliases: dict[str, str], column: str = "keyword") -> DataFrame:
    """rows with the column's aliases replaced by their canonical names."""
    if not aliases:
        return rows
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return rows.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def human_model_pilot(humans: DataFrame, model: DataFrame) -> DataFrame:
    """keyword, n_raters, means, deviation, GAP share, majority and the model's judgement: humans(annotator, keyword, label, novelty)."""
    from gapspark.validation.metrics import keyword_consensus

    h = keyword_consensus(humans.withColumn("keyword_set", F.lit("PILOT")))
    return h.select("keyword", F.col("n_annotators").alias("n_raters"), "mean_novelty", "std_novelty", "gap_share", "majority_label").join(model.select("keyword", F.col("novelty").alias("model_novelty"), F.col("label").alias("model_label")), "keyword", "left")


def equivalence_test(mean_difference: float, standard_error: float, df: float, margin: float) -> float:
    """The larger one-sided p of the two tests that the difference lies within the margin."""
    return max(tails.t_upper((mean_difference + margin) / standard_error, df), 1 - tails.t_upper((mean_difference - margin) / standard_error, df))


def minimal_detectable_effect(n1: int, n2: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """The standardised difference that a two-sided t test of these sizes finds with that power."""
    df = n1 + n2 - 2
    return (tails.t_quantile(1 - alpha / 2, df) + tails.t_quantile(power, df)) * (1 / n1 + 1 / n2) ** 0.5


def replayed(stored: DataFrame, keyword_set: str, annotator: str | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Stored judgements of one set; with `extra`, what the annotator had not judged is filled in from it."""
    own = stored.where(F.col("keyword_set") == keyword_set)
    if extra is None:
        return own
    new = extra.where((F.col("annotator") == annotator) & (F.col("keyword_set") == keyword_set)).join(own.where(F.col("annotator") == annotator).select("keyword"), "keyword", "left_anti")
    return own.unionByName(new.select(*own.columns))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
