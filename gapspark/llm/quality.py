"""Quality rules: base counts, and robust multivariate outliers by minimum covariance determinant. DataFrame functions only.

Each document gets its counts (words, characters, symbols, repeated lines, words in repeated 8-word windows). Documents
that pass the base rules are described by four transformed statistics. For every language and source the minimum
covariance determinant estimate is sought: the centre and scatter of the `share` of documents whose scatter has the least
determinant. As it is usual for this estimate, a few deterministic starts (scales along the axes, tanh correlations, spatial
signs, the half nearest the medians; after Hubert, Rousseeuw and Verdonck, 2012) are each improved by concentration steps,
which never raise the determinant but for rounding in quantiles; the start of least determinant goes on until the
determinant settles. Documents farther than the chi-square quantile `level` are rejected. Groups of fewer than `least`
documents are put together by language, then all together; if even that is too few, nothing is rejected by distance.

The estimates see all documents. Rows are joined to the estimates by group and a salt, a group's state in aggregation is a few
sums and one quantile sketch, so rows of a hot group stay where they are. A statistic that hardly varies in a group (most
texts have no symbols) gets a floor under its spread, which keeps scatters regular and ordinary documents inside.

Windows are compared by 64-bit hash. Null and empty texts have no words and fail the base rules. Null langs and sources
are groups of their own; null ids and repeated rows are kept. Only doc_id, text, lang and source are read.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import dropped, packed_rows, table, unpacked_rows, written

WINDOW = 8
SALTS = 16
#: The statistics and the least spread of each: log of mean word length, log of symbols per 100 characters, shares of
#: repeated lines and of repeated words.
FLOORS = {"s1": 0.08, "s2": 0.3, "s3": 0.15, "s4": 0.12}
NAMES = list(FLOORS)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
_BLANKS = " \t\n\x0b\x0c\r"


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; all other columns stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.withColumns({
        "_gs_w": F.when(text.rlike("[^\\x20\\x09-\\x0D]"), F.split(F.btrim(text, F.lit(_BLANKS)), "[\\x20\\x09-\\x0D]+", -1)).otherwise(F.expr("array()").cast("array<string>")),
        "_gs_l": lines,
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
    })
    two = one.withColumns({
        "n_words": F.size("_gs_w").cast("long"),
        "word_chars": F.length(F.array_join("_gs_w", "")).cast("long"),
        "n_lines": F.size("_gs_l").cast("long"),
        "n_dup_lines": (F.size("_gs_l") - F.size(F.array_distinct("_gs_l"))).cast("long"),
        "_gs_h": F.transform("_gs_w", lambda w: F.xxhash64(w)),
    }).drop("_gs_w", "_gs_l")
    # the windows' hashes; the lambda names _gs_h several times, so the optimizer does not compute it inside the lambda
    window = lambda i: F.xxhash64(*[F.get(F.col("_gs_h"), i + k) for k in range(WINDOW)])
    three = two.withColumn("_gs_v", F.when(F.size("_gs_h") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_gs_h") - WINDOW), window)))
    pairs = F.array_sort(F.transform("_gs_v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    four = three.withColumn("_gs_s", F.when(F.size(F.array_distinct("_gs_v")) < F.size("_gs_v"), pairs)).drop("_gs_h", "_gs_v")
    same = lambda e, k: (F.get("_gs_s", k - 1)["v"] == e["v"]) | (F.get("_gs_s", k + 1)["v"] == e["v"])
    again = F.transform(F.filter("_gs_s", lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"].cast("long"))
    covered = F.aggregate(
        F.array_sort(again),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return four.withColumn("n_repeat_words", F.when(F.col("_gs_s").isNull(), F.lit(0).cast("bigint")).otherwise(covered)).drop("_gs_s")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _statistics() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "s1": F.log(chars / words),
        "s2": F.log1p(100 * F.col("n_symbols") / chars),
        "s3": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "s4": F.col("n_repeat_words") / words,
    }


def chi2_quantile(level: float, dof: int) -> float:
    """The quantile of the chi-square distribution with an even number of degrees of freedom."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, dof) < level else (lo, mid)
    return (lo + hi) / 2


def chi2_below(x: float, dof: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _distance(m: Column, f: Column) -> Column:
    """Squared Mahalanobis distance of s1.. from the centre m by the Cholesky factor f (forward substitution)."""
    z: list[Column] = []
    for i, s in enumerate(NAMES):
        inner = reduce(lambda a, b: a + b, [F.get(f, F.lit(PAIRS.index((i, j)))) * z[j] for j in range(i)], F.lit(0.0))
        z.append((F.col(s) - F.get(m, F.lit(i)) - inner) / F.get(f, F.lit(PAIRS.index((i, i)))))
    return _sum(x * x for x in z)


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _factored(moments: DataFrame) -> DataFrame:
    """moments(g, start, m_i, c_i_j, ...) with the centre m, the Cholesky factor f of the scatter c, and log_det."""
    out = moments
    for i, j in PAIRS:
        inner = reduce(lambda a, b: a - b, [F.col(f"f_{i}_{k}") * F.col(f"f_{j}_{k}") for k in range(j)], F.col(f"c_{i}_{j}"))
        out = out.withColumn(f"f_{i}_{j}", F.sqrt(F.greatest(inner, F.lit(1e-12))) if i == j else inner / F.col(f"f_{j}_{j}"))
    m, f = F.array(*[f"m_{i}" for i in range(len(NAMES))]), F.array(*[f"f_{i}_{j}" for i, j in PAIRS])
    return out.select("g", "start", m.alias("m"), f.alias("f"), (2 * _sum(F.log(f"f_{i}_{i}") for i in range(len(NAMES)))).alias("log_det"), *[c for c in ("was",) if c in moments.columns])


def _salted(rows: DataFrame, groups: DataFrame, how: str = "inner", keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """rows(salt, keys, ...) joined to groups(keys, ...), which stands once for each salt, so no key's rows meet in one task."""
    held = groups.select(*[F.col(k).alias(f"on_{k}") for k in keys], *[c for c in groups.columns if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("on_salt"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"on_{k}")) for k in keys], F.col("salt") == F.col("on_salt"))
    return rows.join(held, on, how).drop("on_salt", *[f"on_{k}" for k in keys])


def grouped(stats: DataFrame, least: int) -> DataFrame:
    """stats with its group g: language and source, or the language, or all, whichever has enough rows first (else null)."""
    key = lambda *c: F.to_json(F.struct(*[F.col(x) for x in c]), {"ignoreNullFields": "false"})
    sizes = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, "sizes")
    small = sizes.where(F.col("n") < least)
    by_lang = small.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    n_rest = by_lang.where(F.col("n_lang") < least).agg(F.coalesce(F.sum("n_lang"), F.lit(0))).first()[0]
    named = sizes.join(by_lang.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    g = F.when(F.col("n") >= least, key("lang", "source")).when(F.col("n_lang") >= least, key("lang")).otherwise(F.lit("rest") if n_rest >= least else F.lit(None))
    return _salted(stats, named.select("lang", "source", g.alias("g")), keys=("lang", "source"))


def _starts(stats: DataFrame) -> DataFrame:
    """(g, start, m, f, log_det): the starts of each group of stats(g, salt, s1..)."""
    every = range(len(NAMES))
    median = lambda x: F.percentile_approx(x, F.lit(0.5), F.lit(10_000))
    medians = written(stats.groupBy("g").agg(*[median(s).alias(f"m_{i}") for i, s in enumerate(NAMES)]), "medians")
    apart = [median(F.abs(F.col(s) - F.col(f"m_{i}"))) for i, s in enumerate(NAMES)]
    axes = _salted(stats, medians).groupBy("g").agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in every], *[F.sqrt(F.pow(1.4826 * apart[i], 2) + FLOORS[NAMES[i]] ** 2).alias(f"e_{i}") for i in every])
    axes = written(axes, "axes")
    z = _salted(stats, axes).withColumns({f"z_{i}": (F.col(s) - F.col(f"m_{i}")) / F.col(f"e_{i}") for i, s in enumerate(NAMES)})
    z = z.withColumn("norm", _sum(F.col(f"z_{i}") * F.col(f"z_{i}") for i in every))
    shapes = z.groupBy("g").agg(
        median("norm").alias("half"),
        *[F.covar_pop(F.tanh(f"z_{i}"), F.tanh(f"z_{j}")).alias(f"t_{i}_{j}") for i, j in PAIRS],
        *[F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.greatest("norm", F.lit(1e-12))).alias(f"u_{i}_{j}") for i, j in PAIRS],
    )
    shapes = written(shapes.join(axes, "g"), "shapes")
    core = _salted(z, shapes.select("g", "half")).where("norm <= half").groupBy("g").agg(
        *[F.avg(s).alias(f"m_{i}") for i, s in enumerate(NAMES)],
        *[(F.covar_pop(NAMES[i], NAMES[j]) + (FLOORS[NAMES[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS],
    )
    of_axes = lambda shape: [(F.col(f"e_{i}") * F.col(f"e_{j}") * shape(i, j)).alias(f"c_{i}_{j}") for i, j in PAIRS]
    tanh = lambda i, j: F.lit(1.0) if i == j else F.coalesce(0.99 * F.try_divide(F.col(f"t_{i}_{j}"), F.sqrt(F.col(f"t_{i}_{i}") * F.col(f"t_{j}_{j}"))), F.lit(0.0))
    centre = [f"m_{i}" for i in every]
    kinds = [lambda i, j: F.lit(float(i == j)), tanh, lambda i, j: F.col(f"u_{i}_{j}") + (0.01 if i == j else 0.0)]
    tables = [shapes.select("g", F.lit(k).alias("start"), *centre, *of_axes(kind)) for k, kind in enumerate(kinds)]
    tables.append(core.withColumn("start", F.lit(len(kinds))))
    return written(_factored(reduce(DataFrame.unionByName, tables)), "scatter")


def _concentrated(stats: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """One concentration step of each start: centre and scatter of the share of rows nearest by the estimate so far."""
    p = len(NAMES)
    consistent = share / chi2_below(chi2_quantile(share, p), p + 2)

    def measured(estimates: DataFrame, *more: str) -> DataFrame:
        held = estimates.groupBy("g").agg(F.collect_list(F.struct("start", "m", "f", "log_det", *more)).alias("x"))
        each = _salted(stats, held).select("g", *NAMES, F.explode("x").alias("x"))
        return each.select("g", *NAMES, "x.start", "x.log_det", *[f"x.{c}" for c in more], _distance(F.col("x.m"), F.col("x.f")).alias("d"))

    cuts = measured(now).groupBy("g", "start").agg(F.percentile_approx("d", F.lit(share), F.lit(10_000)).alias("cut"))
    cuts = written(now.join(cuts, ["g", "start"]), "cuts")
    moments = measured(cuts, "cut").where("d <= cut").groupBy("g", "start").agg(
        *[F.avg(s).alias(f"m_{i}") for i, s in enumerate(NAMES)],
        *[(consistent * F.covar_pop(NAMES[i], NAMES[j]) + (FLOORS[NAMES[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS],
        F.first("log_det").alias("was"),
    )
    out = written(_factored(moments), "scatter")
    dropped(cuts)
    return out


def estimates(stats: DataFrame, share: float = 0.75, first_steps: int = 2, settled: float = 1e-3, most_steps: int = 30) -> DataFrame:
    """(g, start, m, f, log_det) of each group g of stats(g, salt, s1..): the estimate of least determinant that is found.

    All starts take `first_steps`, the best goes on until no group's log determinant moves by more than `settled`.
    """
    now = _starts(stats)
    for _ in range(first_steps):
        now = _concentrated(stats, now, share)
    best = F.min_by(F.struct("start", "m", "f", "log_det"), F.struct("log_det", "start")).alias("x")
    now = written(now.groupBy("g").agg(best).select("g", "x.*"), "scatter")
    for _ in range(most_steps):
        new = _concentrated(stats, now, share)
        dropped(now)
        now = new
        if (now.agg(F.max(F.abs(F.col("log_det") - F.col("was")))).first()[0] or 0.0) <= settled:
            break
    return now


def assessed(docs: DataFrame, level: float = 1 - 1e-6, share: float = 0.75, least: int = 50) -> DataFrame:
    """(doc_id, counts, base_failed, distance, kept) of every row of docs(doc_id, text, lang, source)."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    counted = with_counts(rows).drop("text").withColumn("base_failed", base_failed())
    stats = written(counted.withColumns(_statistics()).withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int")), "counts")
    passed = written(grouped(stats.where(~F.col("base_failed")), least), "statistics")
    now = estimates(passed.where("g is not null").select("g", "salt", *NAMES), share)
    far = chi2_quantile(level, len(NAMES))
    told = _salted(passed, now.select("g", "m", "f"), "left").withColumn("distance", _distance(F.col("m"), F.col("f")))
    told = told.withColumn("kept", F.coalesce(F.col("distance") <= far, F.lit(True)))
    failed = stats.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    return told.select(*columns).unionByName(failed.select(*columns))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """docs that assessed() keeps, with all their columns; a verdict belongs to a doc_id, text, lang and source."""
    content = F.xxhash64(F.col("doc.text").cast("string"), F.col("doc.lang").cast("string"), F.lit("/"), F.col("doc.source").cast("string"))
    rows = packed_rows(docs)
    inner = rows.select(F.struct("doc.doc_id", content.alias("c")).alias("doc_id"), "doc.text", "doc.lang", "doc.source")
    kept = assessed(inner, **options).where("kept").select(F.col("doc_id.doc_id").alias("i"), F.col("doc_id.c").alias("c")).hint("merge")
    return unpacked_rows(rows.join(kept, F.col("doc.doc_id").eqNullSafe(F.col("i")) & (content == F.col("c")), "left_semi"), docs.columns)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_failed, kept of every document.

    Null and empty texts have no words and fail; null ids, langs and sources and repeated rows are kept, null langs and sources
    as groups of their own. An empty table gives no rows.
    """
    out = assessed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
