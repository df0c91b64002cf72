"""Frequencies, spellings, core terms and citation support of keywords. `bag` is (row_id, pos, keyword) and what is carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.config import GapConfig
from gapspark.functions.order import running
from gapspark.functions.text import is_methodological, normalize_keyword, token_count


def keyword_bag(articles: DataFrame, *carry: str) -> DataFrame:
    """One row for each keyword of each record; pos is its place in the record."""
    return articles.select("row_id", *carry, F.posexplode("keywords_normalized").alias("pos", "keyword")).where("keyword <> ''")


def keyword_frequencies(bag: DataFrame, *by: str) -> DataFrame:
    """by..., keyword, frequency (records, not occurrences) and first, the place of the first appearance."""
    # a record lists a keyword once, because its list is distinct, so rows are records
    return bag.groupBy(*by, "keyword").agg(F.count(F.lit(1)).alias("frequency"), F.min(F.struct("row_id", "pos")).alias("first"))


def shared(rows: DataFrame, other: DataFrame, *own: str) -> list[str]:
    """The columns of `other`, besides its own, that name the run or corpus a row belongs to, as far as rows have them."""
    return [c for c in other.columns if c not in own and c in rows.columns]


def unique_keywords(bag: DataFrame) -> DataFrame:
    """keyword and kw_ord, from 0 in order of first appearance."""
    first = bag.groupBy("keyword").agg(F.min(F.struct("row_id", "pos")).alias("first"))
    return running(first, ["first"], "kw_ord").select("keyword", F.col("kw_ord").cast("long").alias("kw_ord"))


def spellings(articles: DataFrame, *by: str) -> DataFrame:
    """by..., keyword, spelling: the most frequent source spelling of each keyword; ties go to the one seen first."""
    raw = articles.select(*by, "row_id", F.posexplode("author_keywords").alias("pos", "spelling"))
    raw = raw.withColumn("keyword", normalize_keyword(F.col("spelling"))).where("keyword <> ''")
    counted = raw.groupBy(*by, "keyword", "spelling").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "pos")).alias("first"))
    return counted.groupBy(*by, "keyword").agg(F.min_by("spelling", F.struct(-F.col("n"), "first")).alias("spelling"))


def core_terms(frequencies: DataFrame, n_articles: Column, share: float, *by: str) -> DataFrame:
    """Keywords in more than `share` of the records."""
    return frequencies.where(F.col("frequency") > n_articles * share).select(*by, "keyword", "frequency")


def candidate_mask(keyword: Column, config: GapConfig) -> Column:
    """All of the candidate test but the core terms, which are an anti-join."""
    keep = keyword != ""
    if config.gap_token_count is not None:
        keep = keep & (token_count(keyword) == config.gap_token_count)
    if config.filter_methodological:
        keep = keep & ~is_methodological(keyword, config.methodological_patterns, config.methodological_tools)
    if config.extra_stop_keywords:
        keep = keep & ~keyword.isin([" ".join(k.lower().split()) for k in config.extra_stop_keywords])
    return keep


def candidates(frequencies: DataFrame, config: GapConfig, core: DataFrame | None = None) -> DataFrame:
    out = frequencies.where(candidate_mask(F.col("keyword"), config))
    return out if core is None else without(out, core)


def without(rows: DataFrame, core: DataFrame) -> DataFrame:
    """rows whose keyword is no core term."""
    keys = [*shared(rows, core, "keyword", "frequency"), "keyword"]
    return rows.join(core.select(*keys), keys, "left_anti")


def frequency_ceiling(n_articles: Column) -> Column:
    """max(1, n/50), half to even."""
    return F.greatest(F.lit(1), F.bround(n_articles / F.lit(50.0), 0).cast("int"))


def citation_support(bag: DataFrame, articles: DataFrame, config: GapConfig, *by: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """by..., keyword, citations, velocity: the best record's citations, and the best citations per year.

    The age of a record counts from the reference year, which is the configured one or the latest of the rows alike
    in `by` (with reference_scope 'corpus': of all rows alike in `scope`, which is part of `by` and names the run). Unknown values give null, never 0.
    """
    rows = bag.select(*by, "row_id", "keyword").distinct().join(articles.select(*scope, "row_id", "year", "citations"), [*scope, "row_id"])
    if config.citation_year_reference is not None:
        rows = rows.withColumn("ref", F.lit(config.citation_year_reference))
    elif config.reference_scope == "corpus" or set(by) == set(scope):
        last = F.broadcast(articles.groupBy(*scope).agg(F.max("year").alias("ref")))  # a row for each run
        rows = rows.join(last, list(scope)) if scope else rows.join(last)
    else:
        last = articles.groupBy(*by).agg(F.max("year").alias("ref"))
        rows = rows.join(last, list(by))
    age = F.greatest(F.lit(1), F.col("ref") - F.col("year") + 1)
    return rows.groupBy(*by, "keyword").agg(F.max("citations").alias("citations"), F.max(F.when(F.col("year").isNotNull(), F.col("citations") / age)).alias("velocity"))


def passes_citation_filter(citations: Column, velocity: Column, config: GapConfig) -> Column:
    """Inclusive bounds; an unknown value passes if keep_uncited_candidates says so."""
    keep = F.lit(True)
    unknown = F.lit(config.keep_uncited_candidates)
    if config.min_citations is not None:
        keep = keep & F.coalesce(citations >= config.min_citations, unknown)
    if config.max_citations is not None:
        keep = keep & F.coalesce(citations <= config.max_citations, unknown)
    if config.min_citations_per_year is not None:
        keep = keep & F.coalesce(velocity >= config.min_citations_per_year, unknown)
    return keep


def citation_filtered(rows: DataFrame, support: DataFrame, config: GapConfig, *by: str) -> DataFrame:
    """rows(by..., keyword) that pass; without any bound nothing is joined."""
    if not config.citation_filter_active:
        return rows
    joined = rows.join(support.withColumnsRenamed({"citations": "_cit", "velocity": "_vel"}), [*by, "keyword"], "left")
    return joined.where(passes_citation_filter(F.col("_cit"), F.col("_vel"), config)).drop("_cit", "_vel")


def cooccurrence(bag: DataFrame, *by: str, min_weight: int = 1) -> DataFrame:
    """by..., left, right, weight: records that have both keywords, left before right."""
    a = bag.select(*by, "row_id", F.col("keyword").alias("left")).distinct()
    b = bag.select(*by, "row_id", F.col("keyword").alias("right")).distinct()
    pairs = a.join(b, [*by, "row_id"]).where("left < right")  # as many as a record's keywords give
    return pairs.groupBy(*by, "left", "right").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)


def occurring_together(bag: DataFrame, *by: str) -> DataFrame:
    """by..., left, right: what keywords a record has both of, left before right; a row for each such record.

    A record's keywords come together once, so that the bag is not joined to itself.
    """
    lists = bag.groupBy(*by, "row_id").agg(F.array_sort(F.collect_set("keyword")).alias("_k")).where(F.size("_k") > 1)
    left = lists.select(*by, "_k", F.posexplode("_k").alias("_i", "left"))
    return left.select(*by, "left", F.explode(F.slice("_k", F.col("_i") + 2, F.size("_k"))).alias("right"))


def display(keywords: DataFrame, spelling: DataFrame, members: str = "members", into: str = "keyword_display", often: int = 10_000) -> DataFrame:
    """keywords with `into`: the source spellings of the members, capitalised, joined by the pair separator.

    A member of more than `often` keywords is told by broadcast (there is at most one for each `often` members), since a join by
    member would bring all of its keywords to one task.
    """
    from gapspark.functions.text import PAIR_SEPARATOR, capitalise
    from gapspark.sources.tables import materialized

    keyed = keywords.withColumn("_gs_id", F.xxhash64(*[F.col(c) for c, t in keywords.dtypes if not t.startswith("map")], F.lit(1)))
    scope = shared(keywords, spelling, "keyword", "spelling")
    keys = [*scope, "keyword"]
    each = materialized(keyed.select("_gs_id", *scope, F.posexplode(members).alias("pos", "keyword")), "members")
    hot = materialized(each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select(*keys, F.lit(True).alias("_gs_hot")), "often")
    told = hot.join(F.broadcast(spelling.join(F.broadcast(hot.select(*keys)), keys)), keys, "left")
    met = each.join(F.broadcast(hot), keys, "left").where(F.col("_gs_hot").isNull()).drop("_gs_hot").join(spelling, keys, "left")
    met = met.unionByName(each.join(F.broadcast(told), keys).drop("_gs_hot"))
    named = met.select("_gs_id", F.struct("pos", capitalise(F.coalesce("spelling", "keyword")).alias("s")).alias("x"))
    # a set, since repeated rows have one id
    shown = named.groupBy("_gs_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["s"]), PAIR_SEPARATOR).alias(into))
    return keyed.join(shown, "_gs_id", "left").drop("_gs_id")
