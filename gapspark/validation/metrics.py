"""Rates, agreement and comparisons of judgements(annotator, keyword_set, keyword, label, novelty). Undefined values are null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.functions import tails
from gapspark.functions.order import numbered, with_average_rank

# The labels a judgement may have, in order.
LABELS = ("GAP", "EXPLORED", "LOW IMPORTANCE", "METHOD", "NOISE")


def slug(label: str) -> str:
    return label.lower().replace(" ", "_")


def label_rates(judgements: DataFrame, *by: str) -> DataFrame:
    rates = [F.coalesce(F.avg((F.col("label") == x).cast("double")), F.lit(0.0)).alias(f"rate_{slug(x)}") for x in LABELS]
    return judgements.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *rates)


def novelty_statistics(judgements: DataFrame, *by: str) -> DataFrame:
    """mean, sample deviation (0 for one value), median, quartiles, shares of 5 and 8 or more, n."""
    x = F.col("novelty")
    return judgements.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(F.lit(0.0)).alias("std"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.75)).alias("q75"),
        F.avg((x >= 5).cast("double")).alias("share_5"), F.avg((x >= 8).cast("double")).alias("share_8"), F.count(x).alias("n"))


def _label_order(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), c)


def keyword_consensus(judgements: DataFrame) -> DataFrame:
    """One row for each set and keyword; of labels named equally often the first of LABELS is the majority."""
    keys = ["keyword_set", "keyword"]
    counts = judgements.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), _label_order(F.col("label"))))).where("r = 1").select(*keys, F.col("label").alias("majority_label"))
    out = judgements.groupBy(*keys).agg(
        F.countDistinct("annotator").alias("n_annotators"), F.count_if(F.col("label") == "GAP").alias("gap_votes"), F.avg((F.col("label") == "GAP").cast("double")).alias("gap_share"),
        (F.countDistinct("label") == 1).alias("unanimous"), F.avg("novelty").alias("mean_novelty"), F.when(F.count("novelty") > 1, F.stddev_samp("novelty")).otherwise(F.lit(0.0)).alias("std_novelty"))
    return out.join(best, keys).orderBy("keyword_set", F.desc("gap_share"), F.desc("mean_novelty"), "keyword")


def label_matrix(judgements: DataFrame) -> DataFrame:
    """keyword and a count for each label: one pass, the columns fixed."""
    return judgements.groupBy("keyword").agg(*[F.count_if(F.col("label") == x).alias(slug(x)) for x in LABELS])


def fleiss_kappa(judgements: DataFrame) -> DataFrame:
    """kappa, n_keywords, n_raters over the keywords with the most usual number of ratings (ties: the larger)."""
    counts = label_matrix(judgements)
    cols = [slug(x) for x in LABELS]
    total = sum((F.col(c) for c in cols), F.lit(0))
    counts = counts.withColumn("m", total)
    usual = counts.groupBy("m").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("m")).limit(1).select(F.col("m").alias("m0"))
    rows = counts.join(F.broadcast(usual), F.col("m") == F.col("m0"))
    agree = (sum((F.col(c) * F.col(c) for c in cols), F.lit(0)) - F.col("m")) / (F.col("m") * (F.col("m") - 1))
    s = rows.agg(F.avg(F.when(F.col("m") > 1, agree)).alias("p"), F.count(F.lit(1)).alias("n_keywords"), F.first("m").alias("n_raters"), *[F.sum(c).alias(c) for c in cols])
    whole = sum((F.col(c) for c in cols), F.lit(0))
    pe = sum((F.pow(F.col(c) / whole, 2) for c in cols), F.lit(0.0))
    return s.withColumn("pe", pe).select(F.when(F.col("pe") < 1, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"), "n_keywords", "n_raters")


def krippendorff_alpha(judgements: DataFrame, *by: str) -> DataFrame:
    """by..., alpha, n_values: the novelty scores by the ordinal metric (Krippendorff, 2011); units with one value count nothing.

    Coincidences come from the values' counts in each unit, so a unit's pairs are never laid out one by one.
    """
    keys = [*by] or ["_all"]
    rows = judgements if by else judgements.withColumn("_all", F.lit(0))
    unit = rows.where("novelty is not null").groupBy(*keys, "keyword", F.col("novelty").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    unit = unit.withColumn("m", F.sum("c").over(Window.partitionBy(*keys, "keyword"))).where("m > 1")
    totals = unit.groupBy(*keys, "v").agg(F.sum("c").alias("n"))  # one row a value of the scale
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = totals.withColumn("at", below + F.col("n") / 2)
    a = unit.join(placed.select(*keys, "v", "at"), [*keys, "v"])
    b = a.select(*keys, "keyword", F.col("c").alias("c2"), F.col("at").alias("at2"))
    # the ordinal distance of two values is the squared number of values between their mid places
    observed = a.join(b, [*keys, "keyword"]).groupBy(*keys).agg(F.sum(F.col("c") * F.col("c2") / (F.col("m") - 1) * F.pow(F.col("at") - F.col("at2"), 2)).alias("o"))
    other = placed.select(*keys, F.col("n").alias("n2"), F.col("at").alias("at2"))
    expected = placed.join(other, keys).groupBy(*keys).agg(F.sum(F.col("n") * F.col("n2") * F.pow(F.col("at") - F.col("at2"), 2)).alias("e"))
    size = totals.groupBy(*keys).agg(F.sum("n").alias("n"))
    return observed.join(expected, keys).join(size, keys).select(*by, F.when(F.col("e") > 0, 1 - (F.col("n") - 1) * F.col("o") / F.col("e")).alias("alpha"), F.col("n").alias("n_values"))


def average_rank(value: str, *by: str) -> Column:
    """Ranks from 1 within `by`, ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def pairwise_agreement(judgements: DataFrame) -> DataFrame:
    """annotator_a, annotator_b, n_keywords, label_agreement, novelty_spearman and its p, over (set, keyword) that both judged.

    The correlation needs more than two keywords.
    """
    one = judgements.groupBy("annotator", "keyword_set", "keyword").agg(F.min_by("label", _label_order(F.col("label"))).alias("label"), F.avg("novelty").alias("novelty"))
    a, b = (one.select("keyword_set", "keyword", *[F.col(c).alias(f"{c}_{s}") for c in ("annotator", "label", "novelty")]) for s in "ab")
    both = a.join(b, ["keyword_set", "keyword"]).where("annotator_a < annotator_b")
    key = ["annotator_a", "annotator_b"]
    ranked = both.withColumns({"ra": average_rank("novelty_a", *key), "rb": average_rank("novelty_b", *key)})
    n = F.count(F.lit(1))
    out = ranked.groupBy(*key).agg(n.alias("n_keywords"), F.avg((F.col("label_a") == F.col("label_b")).cast("double")).alias("label_agreement"), F.when(n > 2, safe_corr("ra", "rb")).alias("novelty_spearman"))

    @F.pandas_udf("double")
    def p_of(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([spearman_p(None if pd.isna(r) else r, int(m)) for r, m in zip(rho, n)], dtype="float64")

    return out.withColumn("novelty_p_value", F.nullif(p_of("novelty_spearman", "n_keywords"), F.lit(float("nan"))))  # a row for each pair of annotators


def safe_corr(a: str, b: str) -> Column:
    """Pearson's r; null where a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return with_average_rank(with_average_rank(pairs, a, "_a"), b, "_b").agg(F.count(F.lit(1)).alias("n"), safe_corr("_a", "_b").alias("rho"))


def spearman_p(rho: float | None, n: int) -> float | None:
    """By Student's t, for more than two pairs."""
    if rho is None or n <= 2:
        return None
    return 0.0 if abs(rho) >= 1 else tails.t_two_sided(rho * ((n - 2) / (1 - rho * rho)) ** 0.5, n - 2)


def compare_sets(judgements: DataFrame, left: str, right: str) -> DataFrame:
    """One row: rates and novelty of two sets, their differences, Welch's t and degrees of freedom, Cohen's d, Mann-Whitney U.

    If the sets share a keyword the tests are null and n_shared_keywords says so: the arms are not independent.
    """
    rows = judgements.where(F.col("keyword_set").isin(left, right)).withColumn("l", F.col("keyword_set") == left)
    per = rows.groupBy("keyword").agg(F.bool_or("l").alias("a"), F.bool_or(~F.col("l")).alias("b")).agg(F.count_if(F.col("a") & F.col("b")).alias("n_shared_keywords"))
    side = lambda x, which: F.when(F.col("l") == which, x)
    # rank sums come from the counts of the distinct values, of which a scale has few
    values = rows.where("novelty is not null").groupBy("novelty").agg(F.count(F.lit(1)).alias("n"), F.count_if("l").alias("nl"))
    placed = values.withColumn("at", F.sum("n").over(Window.orderBy("novelty")) - F.col("n") + (F.col("n") + 1) / 2.0)
    ranks = placed.agg(F.sum(F.col("nl") * F.col("at")).alias("rank_sum"))
    s = rows.agg(
        *[f(side(F.col("novelty"), w)).alias(f"{name}_{k}") for name, f in (("n", F.count), ("mean_novelty", F.avg), ("var", F.var_samp)) for k, w in (("left", True), ("right", False))],
        *[F.coalesce(F.avg(side((F.col("label") == "GAP").cast("double"), w)), F.lit(0.0)).alias(f"gap_rate_{k}") for k, w in (("left", True), ("right", False))])
    s = s.join(F.broadcast(per)).join(F.broadcast(ranks))
    ok = F.col("n_shared_keywords") == 0
    nl, nr, vl, vr = (F.col(c) for c in ("n_left", "n_right", "var_left", "var_right"))
    diff = F.col("mean_novelty_left") - F.col("mean_novelty_right")
    se2 = vl / nl + vr / nr
    return s.select(
        "n_left", "n_right", "n_shared_keywords", "gap_rate_left", "gap_rate_right", (100 * (F.col("gap_rate_left") - F.col("gap_rate_right"))).alias("gap_rate_difference_pp"), "mean_novelty_left", "mean_novelty_right",
        F.when(F.col("mean_novelty_right") != 0, 100 * diff / F.col("mean_novelty_right")).alias("novelty_difference_percent"),
        F.when(ok & (se2 > 0), diff / F.sqrt(se2)).alias("welch_t"), F.when(ok & (se2 > 0), se2 * se2 / (F.pow(vl / nl, 2) / (nl - 1) + F.pow(vr / nr, 2) / (nr - 1))).alias("welch_df"),
        F.when(ok & (vl + vr > 0), diff / F.sqrt((vl + vr) / 2)).alias("cohens_d"), F.when(ok, F.col("rank_sum") - nl * (nl + 1) / 2).alias("mann_whitney_u"))


def tie_sum(judgements: DataFrame) -> DataFrame:
    """The sum of t^3 - t over the groups of equal novelty."""
    return judgements.groupBy("novelty").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("tie_sum"))


def with_p_values(comparison: DataFrame, ties: float = 0.0) -> dict:
    """A comparison's row as a dictionary, with p-values."""
    r = comparison.first().asDict()
    r["welch_p"] = None if r["welch_t"] is None else tails.t_two_sided(r["welch_t"], r["welch_df"])
    r["mann_whitney_p"] = None if r["mann_whitney_u"] is None else tails.mann_whitney_p(r["mann_whitney_u"], r["n_left"], r["n_right"], ties)
    return r


def permutation_mean_difference(values: DataFrame, reps: int = 20_000, seed: int = 42, slack: float = 1e-12) -> DataFrame:
    """One row: difference of means of values(is_left, x) and the two-sided add-one p over shuffles.

    Each shuffle is an MD5 order of the pooled values, which repeats on any partitioning and in any engine that has MD5.
    Shuffles are groups of rows that Spark deals to tasks; no list of values is held whole.
    """
    pool = values.select("is_left", F.col("x").cast("double").alias("x")).where("x is not null")
    pool = numbered(pool, [F.desc("is_left"), "x"], "i")
    stats = pool.agg(F.count_if("is_left").alias("nl"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("is_left"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("is_left"), F.col("x"))).alias("b"), F.sum("x").alias("s"))
    each = pool.join(F.broadcast(values.sparkSession.range(reps).withColumnRenamed("id", "rep")))  # pool x reps, as resampling is
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "rep", "i"))))
    left = each.select("rep", "x", place.alias("p")).join(F.broadcast(stats)).groupBy("rep").agg(F.sum(F.when(F.col("p") <= F.col("nl"), F.col("x")).otherwise(0.0)).alias("left"))
    moved = left.join(F.broadcast(stats)).select((F.col("left") / F.col("nl") - (F.col("s") - F.col("left")) / (F.col("n") - F.col("nl"))).alias("d"), (F.col("a") - F.col("b")).alias("difference"))
    return moved.groupBy("difference").agg(F.count_if(F.abs("d") >= F.abs("difference") - slack).alias("k")).select("difference", ((F.col("k") + 1) / (reps + 1)).alias("p_value"))


def expert_concordance(experts: DataFrame, panel: DataFrame) -> DataFrame:
    """One row over the keywords that both judged: Spearman of mean novelty, agreement of majority labels, GAP shares, dispersion."""
    e, m = keyword_consensus(experts), keyword_consensus(panel)
    e = e.groupBy("keyword").agg(F.avg("mean_novelty").alias("en"), F.first("majority_label").alias("el"), F.avg("gap_share").alias("eg"), F.avg("std_novelty").alias("es"))
    m = m.groupBy("keyword").agg(F.avg("mean_novelty").alias("mn"), F.first("majority_label").alias("ml"), F.avg("gap_share").alias("mg"), F.avg("std_novelty").alias("ms"))
    both = with_average_rank(with_average_rank(e.join(m, "keyword"), "en", "re"), "mn", "rm")
    n = F.count(F.lit(1))
    checked = F.when(n < 3, F.raise_error(F.lit("a concordance needs three shared keywords or more")).cast("double")).otherwise(safe_corr("re", "rm"))
    return both.agg(n.alias("n_keywords"), checked.alias("spearman"), F.avg((F.col("el") == F.col("ml")).cast("double")).alias("label_agreement"), F.avg("eg").alias("expert_gap_share"), F.avg("mg").alias("panel_gap_share"), F.avg("es").alias("expert_dispersion"), F.avg("ms").alias("panel_dispersion"))


def keyword_level(judgements: DataFrame, *by: str) -> DataFrame:
    """Mean of is_gap and novelty for each keyword (and set)."""
    return judgements.groupBy(*(by or ("keyword_set",)), "keyword").agg(F.avg((F.col("label") == "GAP").cast("double")).alias("gap_share"), F.avg("novelty").alias("novelty"))
