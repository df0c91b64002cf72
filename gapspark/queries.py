"""One query for each operator that the tables can show, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapspark import views as V
from gapspark.config import ClusteringConfig, CombinationWeights, CrossClusterWeights, EmergingWeights, EncoderConfig, GapConfig, RunConfig
from gapspark.functions import scores, text as T
from gapspark.functions.vectors import distance, l2_normalize, mean_vectors
from gapspark.operators import clustering as C
from gapspark.operators import detectors as D
from gapspark.operators import keywords as K
from gapspark.operators import tfidf as TF
from gapspark.plans import consensus, figures, pipelines, studies
from gapspark.sources.corpus import Corpus, corpus_summary, from_dataframe
from gapspark.sources.external import ordered_ranking
from gapspark.sources.tables import materialized
from gapspark.validation import experts, metrics as M, replies as R, runner

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def r6(c, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def _art(spark: SparkSession, sf: str, kept: bool = False) -> DataFrame:
    """The baskets; kept as a written table where a query reads them many times."""
    out = V.articles(spark, sf)
    return materialized(out, "articles") if kept else out


def _freq(arts: DataFrame) -> DataFrame:
    return K.keyword_frequencies(V.bag(arts)).withColumnRenamed("frequency", "global_frequency")


def _salient(arts: DataFrame) -> DataFrame:
    return materialized(TF.salience(arts).withColumn("tfidf", F.round("tfidf", 9)), "salience")


# Column functions

@query("normalize_keyword", r"select p_partkey, trim(regexp_replace(lower('  ' || p_name || chr(160) || chr(9) || upper(p_type) || ' '), '[\s\x{00A0}]+', ' ', 'g')) as keyword from part")
def normalize_keyword(spark, sf):
    raw = F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t"), F.upper("p_type"), F.lit(" "))
    return V.table(spark, sf, "part").select("p_partkey", T.normalize_keyword(raw).alias("keyword"))


@query("split_keywords", "select p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_brand || '; ' || p_type || '| ;;' || p_name || ' ;', '|', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '#') as keywords from part")
def split_keywords(spark, sf):
    raw = F.concat(F.col("p_brand"), F.lit("; "), F.col("p_type"), F.lit("| ;;"), F.col("p_name"), F.lit(" ;"))
    return V.table(spark, sf, "part").select("p_partkey", F.array_join(T.split_author_keywords(raw), "#").alias("keywords"))


@query("token_count", "select c_custkey, cast(len(list_filter(string_split(trim(replace(c_mktsegment, 'E', ' ')), ' '), lambda x: x <> '')) as int) as n from customer")
def token_count(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", T.token_count(F.trim(F.replace("c_mktsegment", F.lit("E"), F.lit(" ")))).cast("int").alias("n"))


@query("coerce_year", "select o_orderkey, try_cast(nullif(regexp_extract('c' || o_orderpriority || ' ' || cast(year(o_orderdate) as varchar) || '-x', '([0-9]{4})', 1), '') as int) as year from orders")
def coerce_year(spark, sf):
    raw = F.concat(F.lit("c"), F.col("o_orderpriority"), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit("-x"))
    return V.table(spark, sf, "orders").select("o_orderkey", T.coerce_year(raw).alias("year"))


@query("coerce_citations", "select o_orderkey, try_cast(case when o_orderstatus = 'F' then 'n/a' else ' ' || cast(floor(o_totalprice) as bigint) || ' ' end as double) as citations from orders")
def coerce_citations(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.concat(F.lit(" "), F.floor("o_totalprice").cast("string"), F.lit(" ")))
    return V.table(spark, sf, "orders").select("o_orderkey", T.coerce_number(raw).alias("citations"))


@query("combined_text", "select doc_id, sha256(trim(trim(source) || ' ' || trim(text))) as digest from documents")
def combined_text(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(T.combined_text(F.col("source"), F.col("text")), 256).alias("digest"))


_PHRASES, _TOOLS = ("promo", "red widget deluxe", "ball"), ("small bolt",)


@query("methodological_mask", "select p_partkey, k in ('small bolt') or contains(k, 'promo') or contains('promo', k) or contains(k, 'red widget deluxe') or contains('red widget deluxe', k) or contains(k, 'ball') or contains('ball', k) as methodological from (select p_partkey, case when p_size % 2 = 0 then lower(p_name) else lower(p_type) end as k from part)")
def methodological_mask(spark, sf):
    k = F.when(F.col("p_size") % 2 == 0, F.lower("p_name")).otherwise(F.lower("p_type"))
    return V.table(spark, sf, "part").select("p_partkey", T.is_methodological(k, _PHRASES, _TOOLS).alias("methodological"))


@query("candidate_mask", f"with {V.ARTICLES} select keyword, len(string_split(keyword, ' ')) = 2 and not contains(keyword, 'promo') and keyword not in ('p1 s1', 'brand-1 small') as candidate from freq")
def candidate_mask(spark, sf):
    config = GapConfig(methodological_patterns=("promo",), methodological_tools=(), extra_stop_keywords=("P1  S1", "brand-1 small"))
    return _freq(_art(spark, sf)).select("keyword", K.candidate_mask(F.col("keyword"), config).alias("candidate"))


@query("scalings", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when max(l_quantity) over w > min(l_quantity) over w then (l_quantity - min(l_quantity) over w) / (max(l_quantity) over w - min(l_quantity) over w) else 0.5 end, 6) as minmax, round(case when stddev_pop(l_quantity) over w > 0 then (l_quantity - avg(l_quantity) over w) / stddev_pop(l_quantity) over w else 0.0 end, 6) as zscore from lineitem window w as (partition by l_suppkey)")
def scalings(spark, sf):
    out = scores.scaled(V.table(spark, sf, "lineitem"), ("l_suppkey",), {"minmax": "l_quantity"}, {"zscore": "l_quantity"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("minmax", "minmax"), r6("zscore", "zscore"))


@query("gap_scores", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.25e0 * l_discount + 0.15e0 * l_tax + 0.3e0 * (l_quantity / 50) + 0.3e0 * (1 - l_discount), 6) as emerging, round(0.4e0 * (1 - 2 * abs(l_quantity / 50 - 0.45e0)) + 0.3e0 * least((l_linenumber + l_suppkey % 7) / 10.0e0, 1.0e0) + 0.3e0 * least(10 * l_discount, 1.0e0), 6) as combination, round(0.25e0 * least(l_linenumber / 5.0e0, 1.0e0) + 0.35e0 * (1 - l_discount) + 0.4e0 * case when l_tax > 0 then least(l_discount / l_tax, 1.0e0) else 0.0e0 end, 6) as cross_cluster from lineitem")
def gap_scores(spark, sf):
    q, d, t, n = F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(scores.emerging(d, t, q, 1 - d, EmergingWeights()), "emerging"),
        r6(scores.combination(q, n, F.col("l_suppkey") % 7, d, CombinationWeights(), 0.45), "combination"), r6(scores.cross_cluster(n, d, d, t, CrossClusterWeights()), "cross_cluster"))


@query("capitalise", "select s_suppkey, upper(substr(lower(s_name), 1, 1)) || substr(lower(s_name), 2) as shown from supplier")
def capitalise(spark, sf):
    return V.table(spark, sf, "supplier").select("s_suppkey", T.capitalise(F.lower("s_name")).alias("shown"))


# Corpus

@query("canonical_corpus", "select c_custkey as row_id, trim(c_name || ' ' || c_mktsegment) as combined_text, lower(c_mktsegment) || '#' || lower(c_name) as keywords, cast(c_nationkey + 1990 as int) as year, c_acctbal as citations from customer")
def canonical_corpus(spark, sf):
    c = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_name").alias("Article Title"), F.col("c_mktsegment").alias("AB"), F.concat_ws(" | ", F.upper("c_mktsegment"), F.col("c_name"), F.lit(" "), F.lower("c_mktsegment")).alias("Author Keywords"),
        F.lit("not used").alias("Keywords Plus"), F.concat(F.lit("c."), (F.col("c_nationkey") + 1990).cast("string")).alias("PY"), F.col("c_acctbal").cast("string").alias("Times Cited"))
    return from_dataframe(c).frame.select("row_id", "combined_text", F.array_join("keywords_normalized", "#").alias("keywords"), "year", "citations")


@query("corpus_summary", f"with {V.ARTICLES}, n as (select art.row_id, year, citations, count(keyword) as k from art left join bag using (row_id) group by all) select count(*) as n_articles, round(avg(k), 6) as mean_keywords, count(*) filter (k = 0) as without_keywords, min(year) as year_min, max(year) as year_max, bool_or(citations is not null) as has_citations, (select count(*) from freq) as unique_keywords from n")
def summary(spark, sf):
    s = corpus_summary(_art(spark, sf).withColumn("abstract", F.lit("")))
    return s.select("n_articles", r6("mean_keywords", "mean_keywords"), "without_keywords", F.col("year_min").cast("long").alias("year_min"), F.col("year_max").cast("long").alias("year_max"), "has_citations", "unique_keywords")


@query("corpus_head", "select o_orderkey as row_id from orders order by 1 limit 20")
def corpus_head(spark, sf):
    return Corpus(_art(spark, sf)).head(20).frame.select("row_id")


@query("unique_keywords", f"with {V.ARTICLES} select keyword, row_number() over (order by first) - 1 as kw_ord from freq")
def unique_keywords(spark, sf):
    return K.unique_keywords(V.bag(_art(spark, sf)))


@query("spelling", f"with {V.ARTICLES} select keyword, raw as spelling from (select keyword, raw, row_number() over (partition by keyword order by count(*) desc, min(row_id * 1000 + pos)) as r from kwpos group by keyword, raw) where r = 1")
def spelling(spark, sf):
    return K.spellings(_art(spark, sf))


@query("display_keyword", f"with {V.ARTICLES}, sp as (select keyword, raw as spelling from (select keyword, raw, row_number() over (partition by keyword order by count(*) desc, min(row_id * 1000 + pos)) as r from kwpos group by keyword, raw) where r = 1) select keyword, upper(substr(spelling, 1, 1)) || substr(spelling, 2) || ' x Z z' as keyword_display from sp")
def display_keyword(spark, sf):
    a = _art(spark, sf, True)
    rows = materialized(_freq(a).select("keyword", F.array("keyword", F.lit("z z")).alias("members")), "rows")
    return K.display(rows, materialized(K.spellings(a), "spelling")).select("keyword", "keyword_display")


# Frequencies and citation support

@query("doc_frequency", f"with {V.ARTICLES} select keyword, global_frequency as frequency from freq")
def doc_frequency(spark, sf):
    return K.keyword_frequencies(V.bag(_art(spark, sf))).select("keyword", "frequency")


@query("core_terms", f"with {V.ARTICLES} select keyword, global_frequency as frequency from freq where global_frequency > (select count(*) from art) * 0.003")
def core_terms(spark, sf):
    a = _art(spark, sf)
    n = a.count()
    return K.core_terms(K.keyword_frequencies(V.bag(a)), F.lit(n), 0.003)


@query("keyword_citations", f"with {V.ARTICLES}, ref as (select cluster, max(year) as y from art group by cluster) select b.cluster, keyword, max(citations) as citations, round(max(citations / greatest(1, y - year + 1)), 6) as velocity from bag b join art using (row_id) join ref on ref.cluster = b.cluster group by b.cluster, keyword")
def keyword_citations(spark, sf):
    a = _art(spark, sf)
    return K.citation_support(V.bag(a), a, GapConfig(), "cluster").select("cluster", "keyword", "citations", r6("velocity", "velocity"))


@query("citation_filter", f"with {V.ARTICLES}, ref as (select max(year) as y from art), s as (select keyword, max(citations) as c, max(citations / greatest(1, y - year + 1)) as v from bag join art using (row_id), ref group by keyword) select keyword, global_frequency from freq join s using (keyword) where c >= 50 and c <= 300 and v >= 10.5")
def citation_filter(spark, sf):
    a = _art(spark, sf)
    config = GapConfig(min_citations=50, max_citations=300, min_citations_per_year=10.5)
    return K.citation_filtered(_freq(a), K.citation_support(V.bag(a), a, config), config).select("keyword", "global_frequency")


@query("proportional_threshold", "select c, n, cast(greatest(1, case when n % 50 = 25 then (n // 50) + (n // 50) % 2 else round(n / 50.0e0) end) as int) as ceiling from (select o_custkey as c, count(*) * 5 as n from orders group by 1)")
def proportional_threshold(spark, sf):
    n = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg((F.count(F.lit(1)) * 5).alias("n"))
    return n.select("c", "n", K.frequency_ceiling(F.col("n")).alias("ceiling"))


@query("cooccurrence_edges", f"with {V.ARTICLES} select a.keyword as \"left\", b.keyword as \"right\", count(*) as weight from bag a join bag b on a.row_id = b.row_id and a.keyword < b.keyword group by 1, 2 having count(*) >= 2")
def cooccurrence_edges(spark, sf):
    return figures.network(V.bag(_art(spark, sf)), 2)[0]


@query("year_distribution", f"with {V.ARTICLES} select cluster, year, count(*) as n from art group by 1, 2")
def year_distribution(spark, sf):
    return figures.year_distribution(_art(spark, sf)).withColumn("year", F.col("year").cast("long"))


# TF-IDF

_TERMS = """
toks as (select row_id, list(t order by pos, i) as t from (select row_id, pos, i, regexp_extract_all(keyword, '[\\w\\-]+')[i] as t from (select row_id, pos, keyword, unnest(range(1, len(regexp_extract_all(keyword, '[\\w\\-]+')) + 1)) as i from bag)) group by row_id),
grams as (select row_id, array_to_string(t[i:i + n - 1], ' ') as term, count(*) as tf from (select row_id, t, n, unnest(range(1, len(t) - n + 2)) as i from (select row_id, t, unnest(range({low}, {high} + 1)) as n from toks) where len(t) >= n) group by 1, 2),
nd as (select count(distinct row_id) as n from bag),
terms as (select term, sum(tf) as total, count(*) as df from grams group by term order by total desc, term limit 10000),
w as (select row_id, g.term, tf * (ln((1 + n) / (1.0e0 + df)) + 1) as w from grams g join terms using (term), nd),
l as (select row_id, sqrt(sum(w * w)) as l from w group by row_id),
voc as (select term, sum(w / l) / any_value(n) as score from w join l using (row_id), nd group by term)
"""
_MATCH = """
m as (select k.keyword, k.keyword = v.term as e, contains(k.keyword, v.term) or contains(v.term, k.keyword) as c,
    len(list_distinct(string_split(k.keyword, ' '))) > 1 and len(list_intersect(list_distinct(string_split(k.keyword, ' ')), string_split(v.term, ' '))) * 2 >= len(list_distinct(string_split(k.keyword, ' '))) as o, score from {keys} k, voc v),
sal as (select keyword, coalesce(max(score) filter (e), max(score) filter (c), max(score) filter (o), 0.001e0) as tfidf,
    case when bool_or(e) then 'exact' when bool_or(c) then 'contains' when bool_or(o) then 'overlap' else 'fallback' end as match_type from m group by keyword)
"""
#: The same for all keywords: those without an exact term meet the vocabulary by substrings (either way), and by tokens.
_PAIR_SAL = """
ex as (select f.keyword, v.score from freq f left join voc v on v.term = f.keyword),
rest as (select keyword from ex where score is null),
tl as (select min(length(term)) as lo, max(length(term)) as hi from voc),
kl as (select min(length(keyword)) as lo, max(length(keyword)) as hi from rest),
inside as (select keyword, substr(keyword, a, n) as s from (select keyword, a, unnest(range(lo, least(hi, length(keyword) - a + 1) + 1)) as n from (select keyword, unnest(range(1, length(keyword) + 1)) as a from rest), tl)),
around as (select substr(term, a, n) as s, max(score) as score from (select term, score, a, unnest(range(lo, least(hi, length(term) - a + 1) + 1)) as n from (select term, score, unnest(range(1, length(term) + 1)) as a from voc), kl) group by 1),
con as (select keyword, max(c) as c from (select keyword, score as c from inside join voc on s = term union all select keyword, score from rest join around on s = keyword) group by 1),
tok as (select tok, max(score) as s from (select score, unnest(string_split(term, ' ')) as tok from voc) group by tok),
ov as (select keyword, max(s) as o from (select keyword, unnest(string_split(keyword, ' ')) as tok from rest) join tok using (tok) group by 1),
sal as (select ex.keyword, round(coalesce(score, c, o, 0.001e0), 9) as tfidf, case when score is not null then 'exact' when c is not null then 'contains' when o is not null then 'overlap' else 'fallback' end as match_type
  from ex left join con using (keyword) left join ov using (keyword))
"""
_PAIRS = f"{V.ARTICLES}, {_TERMS.format(low=1, high=5)}, {_PAIR_SAL}"


@query("tfidf_vocabulary", f"with {V.ARTICLES}, {_TERMS.format(low=1, high=5)} select count(*) as n, round(sum(score), 6) as total, round(max(score), 6) as best from voc")
def tfidf_vocabulary(spark, sf):
    return TF.vocabulary(_art(spark, sf, True)).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score"), "total"), r6(F.max("score"), "best"))


@query("tfidf_salience", f"with {_PAIRS} select keyword, round(tfidf, 6) as tfidf, match_type from sal")
def tfidf_salience(spark, sf):
    return TF.salience(_art(spark, sf, True)).select("keyword", r6(F.round("tfidf", 9), "tfidf"), "match_type")


_PROBES = "probes as (select distinct replace(lower(p_brand), '#', '-') || ' ' || lower(p_name) as keyword from part union select 'p' || p_partkey from part union select lower(p_type) || ' s' || (p_partkey % 50) from part union select 'unheard ' || p_size from part)"


@query("tfidf_backoff", f"with {V.ARTICLES}, {_TERMS.format(low=1, high=2)}, {_PROBES}, {_MATCH.format(keys='probes')} select keyword, round(tfidf, 6) as tfidf, match_type from sal")
def tfidf_backoff(spark, sf):
    p = V.table(spark, sf, "part")
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    number = F.col("p_partkey").cast("string")
    probes = [F.concat_ws(" ", brand, F.lower("p_name")), F.concat(F.lit("p"), number), F.concat(F.lower("p_type"), F.lit(" s"), (F.col("p_partkey") % 50).cast("string")), F.concat(F.lit("unheard "), F.col("p_size").cast("string"))]
    asked = p.select(F.explode(F.array(*probes)).alias("keyword")).distinct()
    return TF.matched_salience(asked, materialized(TF.vocabulary(_art(spark, sf, True), 1, 2), "vocabulary")).select("keyword", r6("tfidf", "tfidf"), "match_type")


@query("tfidf_match_stats", f"with {_PAIRS} select match_type, count(*) as n from sal group by 1")
def tfidf_match_stats(spark, sf):
    return TF.match_statistics(TF.salience(_art(spark, sf, True)))


# Vectors

@query("l2_normalize", f"with {V.VECTORS} select row_id, round(v[1] / n, 6) as a, round(v[64] / n, 6) as b from (select row_id, list_transform(vector, lambda x: x * 3) as v, sqrt(list_sum(list_transform(vector, lambda x: 9 * x * x))) as n from vec)")
def l2(spark, sf):
    v = l2_normalize(F.transform("vector", lambda x: x * 3))
    return V.vectors(spark, sf).select("row_id", r6(F.get(v, 0), "a"), r6(F.get(v, 63), "b"))


_RANKED = f"with {V.VECTORS}, q as (select vector as q from vec where row_id = 0), d as (select row_id, round(1 - list_cosine_similarity(vector, q), 6) as query_distance, row_number() over (order by 1 - list_cosine_similarity(vector, q), row_id) as rank from vec, q)"


@query("rank_by_similarity", f"{_RANKED} select * from d where row_id <> 0")
def rank_by_similarity(spark, sf):
    v = V.vectors(spark, sf)
    q = v.where("row_id = 0").first().vector
    return C.rank_by_similarity(v, q).where("row_id <> 0").select("row_id", r6("query_distance", "query_distance"), "rank")


@query("top_n_articles", f"{_RANKED} select row_id, rank from d where rank <= 50")
def top_n_articles(spark, sf):
    v = V.vectors(spark, sf)
    return C.nearest(v, v.where("row_id = 0").first().vector, 50).select("row_id", "rank")


_CENTRES = f"{V.VECTORS}, dims as (select row_id, cluster, unnest(range(1, 65)) as d, unnest(vector) as x from vec), cd as (select cluster, d, avg(x) as x from dims group by 1, 2), cen as (select cluster, list(x order by d) as c from cd group by 1), gd as (select d, avg(x) as x from dims group by 1), g as (select list(x order by d) as g from gd)"


@query("centroids", f"with {_CENTRES} select cluster, round(c[1], 6) as first, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) as norm from cen")
def centroids(spark, sf):
    from gapspark.functions.vectors import norm

    return mean_vectors(V.vectors(spark, sf), ["cluster"]).select("cluster", r6(F.get("centroid", 0), "first"), r6(norm(F.col("centroid")), "norm"))


@query("centrality", f"with {_CENTRES} select row_id, round(1 - list_cosine_similarity(vector, g), 6) as centrality from vec, g")
def centrality(spark, sf):
    v = V.vectors(spark, sf)
    return v.join(F.broadcast(mean_vectors(v, []))).select("row_id", r6(distance(F.col("vector"), F.col("centroid"), "cosine"), "centrality"))


@query("centroid_similarity", f"with {_CENTRES} select a.cluster as \"left\", b.cluster as \"right\", round(list_cosine_similarity(a.c, b.c), 6) as similarity from cen a, cen b")
def centroid_similarity(spark, sf):
    return C.centroid_similarity(mean_vectors(V.vectors(spark, sf), ["cluster"])).select("left", "right", r6("similarity", "similarity"))


_DIST = f"{_CENTRES}, dist as (select row_id, v.cluster, list_distance(vector, c) as distance from vec v join cen on v.cluster = cen.cluster), th as (select cluster, quantile_cont(distance, 0.95) as threshold from dist group by 1)"


def _dist(spark, sf):
    v = V.vectors(spark, sf)
    return v.join(F.broadcast(mean_vectors(v, ["cluster"])), "cluster").select("row_id", "cluster", distance(F.col("vector"), F.col("centroid"), "euclidean").alias("distance"))


@query("periphery_threshold", f"with {_DIST} select cluster, round(threshold, 6) as threshold from th")
def periphery_threshold(spark, sf):
    return D.periphery_thresholds(_dist(spark, sf), 95.0).select("cluster", r6("threshold", "threshold"))


@query("peripheral_keywords", f"with {V.ARTICLES}, {V.VECTORS}, {V.KEYWORD_VECTORS}, sp as (select keyword, cast(first // 1000 % 7 as int) as cluster, round(abs(vector[1]), 9) as distance, global_frequency from freq join kv using (keyword)), th as (select cluster, quantile_cont(distance, 0.99) as t from sp group by 1), ev as (select keyword, count(*) as n_articles, max(citations) as citations from bag join art using (row_id) group by 1) select keyword, sp.cluster, round(distance, 6) as score, n_articles, citations from sp join th on sp.cluster = th.cluster join ev using (keyword) where distance >= t and global_frequency <= 2")
def peripheral_keywords(spark, sf):
    a = _art(spark, sf, True)
    f = V.measured(spark, sf, K.keyword_frequencies(V.bag(a)))
    space = materialized(f.select("keyword", "frequency", "first", (F.col("first.row_id") % 7).cast("int").alias("cluster"), "distance", F.lit(0.0).alias("centrality")), "space")
    config = GapConfig(periphery_percentile=99.0, max_keyword_frequency=2, methodological_patterns=(), methodological_tools=())
    none = spark.createDataFrame([], "keyword string, tfidf double")
    return D.peripheral_keywords(space, V.bag(a).drop("cluster"), a, none, None, config).select("keyword", "cluster", r6("score", "score"), "n_articles", "citations")


@query("silhouette", f"with {V.VECTORS}, d as (select a.row_id as i, a.cluster as ci, b.cluster as cj, avg(list_distance(a.vector, b.vector)) as d from vec a join vec b on a.row_id <> b.row_id group by 1, 2, 3), e as (select i, max(d) filter (ci = cj) as a, min(d) filter (ci <> cj) as b from d group by i) select round(avg(case when a is null then 0 when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end), 6) as silhouette from e")
def silhouette(spark, sf):
    return C.silhouette(V.vectors(spark, sf)).select(r6("silhouette", "silhouette"))


@query("davies_bouldin", f"with {_CENTRES}, s as (select cen.cluster, c, avg(list_distance(vector, c)) as s from vec v join cen on v.cluster = cen.cluster group by 1, 2), r as (select a.cluster, max((a.s + b.s) / list_distance(a.c, b.c)) as r from s a join s b on a.cluster <> b.cluster group by 1) select round(avg(r), 6) as davies_bouldin from r")
def davies_bouldin(spark, sf):
    return C.davies_bouldin(V.vectors(spark, sf)).select(r6("davies_bouldin", "davies_bouldin"))


@query("calinski_harabasz", f"with {_CENTRES}, p as (select cen.cluster, sum(list_distance(vector, c) ** 2) as w, count(*) as n, any_value(list_distance(c, g) ** 2) as b from vec v join cen on v.cluster = cen.cluster, g group by 1) select round((sum(n * b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) as calinski_harabasz from p")
def calinski_harabasz(spark, sf):
    return C.calinski_harabasz(V.vectors(spark, sf)).select(r6("calinski_harabasz", "calinski_harabasz"))


def _lloyd_sql(steps: int) -> str:
    out = f"with {V.VECTORS}, c0 as (select row_number() over (order by row_id) - 1 as cluster, vector as c from (select * from vec order by row_id limit 4)), "
    for s in range(steps + 1):
        out += f"a{s} as (select row_id, any_value(vector) as vector, arg_min(cluster, struct_pack(d := list_sum(list_transform(list_zip(vector, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := cluster)) as cluster from (select v.row_id, v.vector, c{s}.cluster, c{s}.c from vec v, c{s}) group by row_id), "
        out += f"c{s + 1} as (select cluster, list(x order by d) as c from (select cluster, d, avg(x) as x from (select cluster, unnest(range(1, 65)) as d, unnest(vector) as x from a{s}) group by 1, 2) group by 1), "
    return out + f"z as (select 1) select row_id, cast(cluster as int) as cluster from a{steps}"


@query("kmeans_lloyd_steps", _lloyd_sql(3))
def kmeans_lloyd_steps(spark, sf):
    v = V.vectors(spark, sf).select("row_id", "vector")
    start = v.orderBy("row_id").limit(4).withColumn("cluster", (F.row_number().over(Window.orderBy("row_id")) - 1).cast("int"))
    return C.lloyd_steps(v, start.select("cluster", F.col("vector").alias("centroid")), 3).select("row_id", F.col("cluster").cast("int").alias("cluster"))


#: Lloyd steps of every (k, start) until the centres stand, from the first rows by MD5; the best start of each k; its labels by first appearance.
_KMEANS = f"""with recursive {V.VECTORS},
pt as materialized (select row_id, vector from vec),
bound as (select 1e-4 * avg(v) as bound from (select var_pop(x) as v from (select unnest(vector) as x, generate_subscripts(vector, 1) as d from pt) group by d)),
h as (select start, row_id, vector, row_number() over (partition by start order by md5('42:' || start || ':' || row_id), row_id) as p from pt, (select unnest(range(10)) as start)),
st(step, k, start, done, c) as (
  select 0, k, start, false, list(vector order by p) from h, (select unnest(range({{low}}, {{high}} + 1)) as k) where p <= k group by k, start
  union all
  select step + 1, k, start, list_sum([list_sum([(q[1] - q[2]) * (q[1] - q[2]) for q in list_zip(z[1], z[2])]) for z in list_zip(c, nc)]) <= bound, nc
  from (
    select step, k, start, any_value(c) as c, list(coalesce(m, c[j]) order by j) as nc
    from (select *, unnest(range(1, k + 1)) as j from st where not done)
    left join (
      select k, start, j, list(x order by d) as m from (
        select k, start, j, d, avg(x) as x from (
          select k, start, list_position(dist, list_min(dist)) as j, unnest(vector) as x, generate_subscripts(vector, 1) as d
          from (select k, start, vector, [list_sum([(q[1] - q[2]) * (q[1] - q[2]) for q in list_zip(vector, e)]) for e in c] as dist from st, pt where not done))
        group by 1, 2, 3, 4) group by 1, 2, 3) using (k, start, j)
    group by step, k, start), bound),
fin as materialized (select k, start, arg_max(c, step) as c from st group by k, start),
lab as materialized (
  select k, start, row_id, vector, list_position(dist, list_min(dist)) as j, list_min(dist) as d, c
  from (select k, start, row_id, vector, c, [list_sum([(q[1] - q[2]) * (q[1] - q[2]) for q in list_zip(vector, e)]) for e in c] as dist from fin, pt)),
best as (select k, arg_min(start, struct_pack(c := cost, s := start)) as start, arg_min(cost, struct_pack(c := cost, s := start)) as cost from (select k, start, cast(printf('%.10e', sum(d)) as double) as cost from lab group by k, start) group by k),
own as materialized (select lab.* from lab join best using (k, start)),
num as (select k, j, row_number() over (partition by k order by min(row_id)) - 1 as cluster from own group by k, j)"""


@query("kmeans_full", f"{_KMEANS.format(low=5, high=5)} select row_id, cast(cluster as int) as cluster, round(1 - list_cosine_similarity(vector, c[own.j]), 6) as distance from own join num on own.k = num.k and own.j = num.j")
def kmeans_full(spark, sf):
    fitted = C.fit_kmeans(V.vectors(spark, sf).select("row_id", "vector"), ClusteringConfig(n_clusters=5, init="random"))
    return fitted.assignment.select("row_id", "cluster", r6("distance_from_centroid", "distance"))


@query("select_k", f"""{_KMEANS.format(low=2, high=10)},
d as (select a.k, a.row_id as i, a.j as ci, b.j as cj, avg(list_distance(a.vector, b.vector)) as d from own a join own b on a.k = b.k and a.row_id <> b.row_id group by 1, 2, 3, 4),
e as (select k, i, max(d) filter (ci = cj) as a, min(d) filter (ci <> cj) as b from d group by 1, 2)
select cast(k as int) as k, round(any_value(cost), 6) as wcss, round(avg(case when a is null then 0 when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end), 6) as silhouette from e join best using (k) group by k""")
def select_k(spark, sf):
    chosen = C.select_k(V.vectors(spark, sf).select("row_id", "vector"), ClusteringConfig(init="random"))
    return chosen.to_frame(spark).select("k", r6("wcss", "wcss"), r6("silhouette", "silhouette"))


@query("tfidf_svd")
def tfidf_svd(spark, sf):
    from gapspark.operators.encoders import get_encoder

    return get_encoder(EncoderConfig(dimensions=16)).encode(V.table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text"))


@query("embedding_cache", "select distinct p_type || ' ' || p_brand as text from part where p_type || ' ' || p_brand not in (select p_type || ' ' || p_brand from part where p_size > 40)")
def embedding_cache(spark, sf):
    from gapspark.operators.encoders import missing_texts

    p = V.table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("text"), "p_size")
    return missing_texts(p, p.where("p_size > 40").select("text"))


# Detectors

_CORE = "core as (select keyword from freq where global_frequency > (select count(*) from art) * 0.004)"
_BASE = f"{_PAIRS}, {V.VECTORS}, {V.KEYWORD_VECTORS}, {V.SPACES}, {_CORE}"


def _core(a: DataFrame) -> DataFrame:
    return K.core_terms(K.keyword_frequencies(V.bag(a)), F.lit(a.count()), 0.004)


_PLAIN = dict(methodological_patterns=("promo",), methodological_tools=())


@query("type1_emerging", f"""with {_BASE},
c as (select s.*, tfidf, global_frequency from space s join sal using (keyword) join freq using (keyword) where s.frequency <= 1 and not contains(s.keyword, 'promo') and s.keyword not in (select keyword from core)),
z as (select *, case when stddev_pop(distance) over w > 0 then (distance - avg(distance) over w) / stddev_pop(distance) over w else 0 end as zs from c window w as (partition by cluster)),
n as (select *, case when max(zs) over w > min(zs) over w then (zs - min(zs) over w) / (max(zs) over w - min(zs) over w) else 0.5 end as a, case when max(centrality) over w > min(centrality) over w then (centrality - min(centrality) over w) / (max(centrality) over w - min(centrality) over w) else 0.5 end as b,
  case when max(tfidf) over w > min(tfidf) over w then (tfidf - min(tfidf) over w) / (max(tfidf) over w - min(tfidf) over w) else 0.5 end as t, 1 - case when max(global_frequency) over w > min(global_frequency) over w then (global_frequency - min(global_frequency) over w) / (max(global_frequency) over w - min(global_frequency) over w) else 0.5 end as r from z window w as (partition by cluster)),
k as (select *, 0.25e0 * a + 0.15e0 * b + 0.3e0 * t + 0.3e0 * r as score from n),
o as (select *, row_number() over (partition by cluster order by score desc, first) as p from k)
select o.cluster, o.keyword, round(score, 6) as score, count(*) as n_articles, max(citations) as citations, string_agg(title, '|' order by art.row_id) as titles from o join bag b on b.keyword = o.keyword and b.cluster = o.cluster join art on art.row_id = b.row_id where p <= 3 group by 1, 2, 3""")
def type1_emerging(spark, sf):
    a = _art(spark, sf, True)
    g = D.emerging_concepts(V.spaces(spark, sf, a), V.bag(a), a, _salient(a), _freq(a), _core(a), GapConfig(**_PLAIN))
    return g.select("cluster", "keyword", r6("score", "score"), "n_articles", "citations", F.array_join("article_titles", "|").alias("titles"))


@query("type2_combinations", f"""with {_BASE},
e as (select s.*, tfidf, vector from space s join sal using (keyword) join kv on kv.keyword = s.keyword where frequency >= 2 and not contains(s.keyword, 'promo')),
p as (select a.cluster, a.keyword as k1, b.keyword as k2, a.first as f1, b.first as f2, a.frequency + b.frequency as fs, (a.tfidf + b.tfidf) / 2 as t, list_cosine_similarity(a.vector, b.vector) as sim from e a join e b on a.cluster = b.cluster and a.first < b.first),
q as (select * from p where sim > 0.25 and sim < 0.65 and not exists (select 1 from bag x join bag y on x.row_id = y.row_id where x.cluster = p.cluster and x.keyword = p.k1 and y.keyword = p.k2)),
k as (select *, 0.4e0 * (1 - 2 * abs(sim - 0.45e0)) + 0.3e0 * least(fs / 10.0e0, 1.0e0) + 0.3e0 * least(10 * t, 1.0e0) as score from q),
o as (select *, row_number() over (partition by cluster order by round(score, 9) desc, f1, f2) as r from k)
select cluster, k1 || ' x ' || k2 as keyword, round(score, 6) as score, fs as frequency from o where r <= 3""")
def type2_combinations(spark, sf):
    a, config = _art(spark, sf, True), GapConfig(min_tfidf=0.0, **_PLAIN)
    space = materialized(D.established(K.keyword_frequencies(V.bag(a), "cluster"), config), "established")  # most keywords are found once
    salient = TF.matched_salience(space.select("keyword").distinct(), TF.vocabulary(a)).withColumn("tfidf", F.round("tfidf", 9))
    g = D.conceptual_combinations(space, V.keyword_vectors(spark, sf, space), V.bag(a), a, salient, config)
    return g.select("cluster", "keyword", r6("score", "score"), "frequency")


_T3 = f"""with {_PAIRS}, {_CORE},
cl as (select distinct cluster from art),
x as (select keyword, sum(frequency) as total, min(first) as first, list(cluster) as ins from cfreq group by keyword having sum(frequency) <= 3),
c as (select cl.cluster, x.keyword, total, first, total / (select count(*) from art) as pr, tfidf from x join cl on not list_contains(ins, cl.cluster) join sal using (keyword) where not contains(x.keyword, 'promo') and x.keyword not in (select keyword from core) and tfidf >= 0.000001),
k as (select *, 0.25e0 * least(total / 5.0e0, 1.0e0) + 0.35e0 * (1 - pr) + 0.4e0 * least(tfidf / (select max(tfidf) from sal), 1.0e0) as score from c),
o as (select *, row_number() over (partition by cluster order by score desc, first) as p from k),
t3 as (select o.cluster, o.keyword, round(score, 6) as score, cast(total as bigint) as frequency, count(*) as n_articles, max(citations) as citations from o join bag b on b.keyword = o.keyword and b.cluster <> o.cluster join art on art.row_id = b.row_id where p <= 3 group by 1, 2, 3, 4)"""


def _type3(spark, sf):
    a = _art(spark, sf, True)
    return D.cross_cluster_concepts(V.bag(a), a, _salient(a), _core(a), GapConfig(min_tfidf=0.000001, **_PLAIN))


@query("type3_cross_cluster", f"{_T3} select * from t3")
def type3_cross_cluster(spark, sf):
    return _type3(spark, sf).select("cluster", "keyword", r6("score", "score"), "frequency", "n_articles", "citations")


@query("deduplicate_gaps", f"{_T3} select keyword, cluster, score from (select *, row_number() over (partition by keyword order by score desc, cluster) as d from t3) where d = 1")
def deduplicate_gaps(spark, sf):
    return D.deduplicate(_type3(spark, sf)).select("keyword", "cluster", r6("score", "score"))


@query("gap_type_counts", f"{_T3} select 'Cross-Cluster Concept' as gap_type, count(*) as n from t3")
def gap_type_counts(spark, sf):
    return figures.gap_summary(_type3(spark, sf))[0]


@query("article_evidence", f"with {V.ARTICLES} select keyword, count(*) as n_articles, max(citations) as citations, array_to_string((list(title order by row_id))[1:3], '|') as titles from bag join art using (row_id) group by keyword")
def article_evidence(spark, sf):
    a = materialized(_art(spark, sf).select("row_id", "title", "doi", "citations", "keywords_normalized"), "articles")
    rows = _freq(a.withColumn("cluster", F.lit(-1))).select("keyword", F.lit(-1).alias("cluster"))
    return D.article_evidence(rows, K.keyword_bag(a, "citations"), a, scoped=False).select("keyword", "n_articles", "citations", F.array_join("article_titles", "|").alias("titles"))


@query("cluster_label_b", f"with {V.ARTICLES}, {_CORE}, t as (select cluster, keyword, row_number() over (partition by cluster order by frequency desc, first) as p from cfreq where keyword not in (select keyword from core)), l as (select cluster, string_agg(keyword, ' & ' order by p) as l from t where p <= 2 group by 1) select cluster, upper(substr(l, 1, 1)) || substr(l, 2) as cluster_label from l")
def cluster_label_b(spark, sf):
    a = _art(spark, sf, True)
    return D.cluster_labels(V.bag(a), _core(a), None)


@query("cluster_label_a", f"with {V.ARTICLES}, {_CORE}, t as (select first // 1000 % 7 as cluster, keyword, row_number() over (partition by first // 1000 % 7 order by first) as p from freq where keyword not in (select keyword from core)), l as (select cluster, string_agg(keyword, ' & ' order by p) as l from t where p <= 2 group by 1) select cast(cluster as int) as cluster, upper(substr(l, 1, 1)) || substr(l, 2) as cluster_label from l")
def cluster_label_a(spark, sf):
    a = _art(spark, sf, True)
    space = K.keyword_frequencies(V.bag(a)).withColumn("cluster", (F.col("first.row_id") % 7).cast("int"))
    return D.member_labels(space, _core(a), None)


def _small_corpus(spark, sf) -> Corpus:
    docs = V.table(spark, sf, "benchmark")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 3)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 2).cast("int")), lambda i: F.concat_ws(" ", F.get(words, 2 * i), F.get(words, 2 * i + 1)))
    kws = F.filter(pairs, lambda x: x != "")  # all words of the text, two by two
    frame = docs.select(F.col("item_id").alias("row_id"), F.concat_ws(" ", F.lit("item"), F.col("item_id").cast("string")).alias("title"), F.col("text").alias("abstract"), F.array_join(kws, "; ").alias("author_keywords"), (F.col("item_id") % 20 + 2000).cast("string").alias("year"), F.col("item_id").cast("string").alias("citations"))
    return from_dataframe(frame)


@query("mode_b")
def mode_b(spark, sf):
    config = RunConfig(None, None, EncoderConfig(dimensions=16), EncoderConfig(dimensions=16), ClusteringConfig(n_clusters=3), GapConfig(min_tfidf=0.0))
    return pipelines.articles_first(_small_corpus(spark, sf), config).gaps.select("gap_type", "keyword", "cluster", r6("score", "score"), "n_articles")


@query("mode_a")
def mode_a(spark, sf):
    config = RunConfig(50, "the main thing", EncoderConfig(dimensions=16), EncoderConfig(dimensions=16), ClusteringConfig(n_clusters=3), GapConfig(periphery_percentile=90.0))
    return pipelines.keywords_first(_small_corpus(spark, sf), config).gaps.select("gap_type", "keyword", "cluster", r6("score", "score"), "n_articles")


# Consensus: a run is (seed, size) = (year, cluster) and finds each record's keywords of brand and type

_RUNS = f"{V.ARTICLES}, runs as (select distinct art.year * 10 + bag.cluster as run_id, year as seed, bag.cluster as size, 'Emerging Concept' as gap_type, keyword, length(keyword) / 10.0e0 as score, global_frequency as frequency, 'label ' || bag.cluster as cluster_label from bag join art using (row_id) join freq using (keyword)), grid as (select distinct run_id, size from runs)"


def _runs(spark, sf):
    # one deal by keyword: its records are counted, and its runs, years and clusters, are few
    b = K.keyword_bag(_art(spark, sf), "cluster", "year").groupBy("keyword").agg(F.count(F.lit(1)).alias("global_frequency"), F.collect_set(F.struct("year", "cluster")).alias("x"))
    b = b.select("keyword", "global_frequency", F.inline("x"))
    return b.select((F.col("year") * 10 + F.col("cluster")).alias("run_id"), F.col("year").alias("seed"), F.col("cluster").alias("size"), F.lit(D.EMERGING).alias("gap_type"), "keyword", (F.length("keyword") / 10.0).alias("score"), F.col("global_frequency").alias("frequency"), F.concat(F.lit("label "), F.col("cluster").cast("string")).alias("cluster_label"))


@query("consensus_pool", f"with {_RUNS} select keyword, count(distinct run_id) as n_runs_found, count(distinct seed) as n_seeds_found, count(distinct size) as n_sizes_found, round(avg(score), 6) as mean_score, round(avg(frequency), 6) as mean_frequency, array_to_string(list_sort(list_distinct(list(cluster_label))), ' | ') as cluster_labels, round(count(distinct run_id) / 30.0e0, 6) as support from runs group by keyword having count(distinct run_id) / 30.0e0 >= 0.02")
def consensus_pool(spark, sf):
    return consensus.pooled(_runs(spark, sf), 30, 0.02).select("keyword", "n_runs_found", "n_seeds_found", "n_sizes_found", r6("mean_score", "mean_score"), r6("mean_frequency", "mean_frequency"), "cluster_labels", r6("support", "support"))


@query("consensus_stability", f"with {_RUNS}, n as (select run_id, size, count(distinct keyword) as n from runs group by 1, 2), p as (select a.run_id as l, b.run_id as r, a.size = b.size as same, a.n as na, b.n as nb from n a join n b on a.run_id < b.run_id), i as (select x.run_id as l, y.run_id as r, count(*) as i from (select distinct run_id, keyword from runs) x join (select distinct run_id, keyword from runs) y on x.keyword = y.keyword and x.run_id < y.run_id group by 1, 2), jj as (select same, coalesce(i, 0) / (na + nb - coalesce(i, 0)) as j from p left join i using (l, r)) select round(avg(j), 6) as mean_jaccard, round(min(j), 6) as min_jaccard, round(max(j), 6) as max_jaccard, round(avg(j) filter (same), 6) as mean_jaccard_same_size, round(avg(j) filter (not same), 6) as mean_jaccard_across_sizes, (select round(avg(n), 6) from n) as mean_candidates_per_run from jj")
def consensus_stability(spark, sf):
    runs = materialized(_runs(spark, sf).select("run_id", "size", "keyword"), "runs")
    s = consensus.stability(runs, runs.select("run_id", "size").distinct())
    return s.select(*[r6(c, c) for c in s.columns])


# Judgements

def _j(spark, sf):
    return V.judgements(spark, sf)


@query("label_rates", f"with {V.JUDGEMENTS} select keyword_set, count(*) as n, round(avg((label = 'GAP')::int), 6) as rate_gap, round(avg((label = 'EXPLORED')::int), 6) as rate_explored, round(avg((label = 'LOW IMPORTANCE')::int), 6) as rate_low_importance, round(avg((label = 'METHOD')::int), 6) as rate_method, round(avg((label = 'NOISE')::int), 6) as rate_noise from j group by 1")
def label_rates(spark, sf):
    t = M.label_rates(_j(spark, sf), "keyword_set")
    return t.select("keyword_set", "n", *[r6(c, c) for c in t.columns if c.startswith("rate_")])


@query("mean_novelty", f"with {V.JUDGEMENTS} select keyword_set, round(avg(novelty), 6) as mean, round(stddev_samp(novelty), 6) as std, median(novelty) as median, quantile_cont(novelty, 0.25) as q25, quantile_cont(novelty, 0.75) as q75, round(avg((novelty >= 5)::int), 6) as share_5, round(avg((novelty >= 8)::int), 6) as share_8, count(*) as n from j group by 1")
def mean_novelty(spark, sf):
    t = M.novelty_statistics(_j(spark, sf), "keyword_set")
    return t.select("keyword_set", *[r6(c, c) if c in ("mean", "std", "share_5", "share_8") else F.col(c) for c in t.columns if c != "keyword_set"])


_ORD = "list_position(['GAP', 'EXPLORED', 'LOW IMPORTANCE', 'METHOD', 'NOISE'], label)"
_CONS = f"cons as (select keyword_set, keyword, count(distinct annotator) as n_annotators, count(*) filter (label = 'GAP') as gap_votes, avg((label = 'GAP')::int) as gap_share, count(distinct label) = 1 as unanimous, avg(novelty) as mean_novelty, case when count(*) > 1 then stddev_samp(novelty) else 0 end as std_novelty from j group by 1, 2), maj as (select keyword_set, keyword, label as majority_label from (select keyword_set, keyword, label, row_number() over (partition by keyword_set, keyword order by count(*) desc, {_ORD}) as r from j group by 1, 2, 3) where r = 1)"


@query("keyword_consensus", f"with {V.JUDGEMENTS}, {_CONS} select keyword_set, keyword, n_annotators, gap_votes, round(gap_share, 6) as gap_share, unanimous, round(mean_novelty, 6) as mean_novelty, round(std_novelty, 6) as std_novelty, majority_label from cons join maj using (keyword_set, keyword)")
def keyword_consensus(spark, sf):
    t = M.keyword_consensus(_j(spark, sf))
    return t.select(*[r6(c, c) if c in ("gap_share", "mean_novelty", "std_novelty") else F.col(c) for c in t.columns])


_MATRIX = "m as (select keyword, count(*) filter (label = 'GAP') as gap, count(*) filter (label = 'EXPLORED') as explored, count(*) filter (label = 'LOW IMPORTANCE') as low_importance, count(*) filter (label = 'METHOD') as method, count(*) filter (label = 'NOISE') as noise from j group by 1)"


@query("label_matrix", f"with {V.JUDGEMENTS}, {_MATRIX} select * from m")
def label_matrix(spark, sf):
    return M.label_matrix(_j(spark, sf))


@query("fleiss_kappa", f"with {V.JUDGEMENTS}, {_MATRIX}, t as (select *, gap + explored + low_importance + method + noise as n from m), u as (select n from t group by n order by count(*) desc, n desc limit 1), k as (select * from t where n = (select n from u)), s as (select avg((gap*gap + explored*explored + low_importance*low_importance + method*method + noise*noise - n) / (n * (n - 1.0e0))) as p, count(*) as c, any_value(n) as n, sum(gap) as a, sum(explored) as b, sum(low_importance) as d, sum(method) as e, sum(noise) as f, sum(n) as w from k), x as (select *, (a*a + b*b + d*d + e*e + f*f) / (w * w) as pe from s) select round((p - pe) / (1 - pe), 6) as kappa, c as n_keywords, n as n_raters from x")
def fleiss_kappa(spark, sf):
    return M.fleiss_kappa(_j(spark, sf)).select(r6("kappa", "kappa"), "n_keywords", F.col("n_raters").cast("long").alias("n_raters"))


@query("krippendorff_alpha", f"with {V.JUDGEMENTS}, ju as (select keyword, novelty as v, count(*) over (partition by keyword) as m from j), u as (select * from ju where m > 1), t as (select v, count(*) as n from u group by v), pairs as (select a.v as a, b.v as b, sum(1.0e0 / (a.m - 1)) as o from (select *, row_number() over () as i from u) a join (select *, row_number() over () as i from u) b on a.keyword = b.keyword and a.i <> b.i group by 1, 2), dd as (select x.v as a, y.v as b, x.n as na, y.n as nb, ((select sum(n) from t where v between least(x.v, y.v) and greatest(x.v, y.v)) - (x.n + y.n) / 2.0e0) ** 2 as d from t x, t y) select round(1 - (select sum(n) - 1 from t) * (select sum(o * d) from pairs join dd using (a, b)) / (select sum(na * nb * d) from dd where a <> b), 6) as alpha, cast((select sum(n) from t) as bigint) as n_values")
def krippendorff_alpha(spark, sf):
    return M.krippendorff_alpha(_j(spark, sf)).select(r6("alpha", "alpha"), "n_values")


@query("pairwise_agreement", f"with {V.JUDGEMENTS}, b as (select x.annotator as a, y.annotator as b, x.label as la, y.label as lb, x.novelty as na, y.novelty as nb from j x join j y on x.keyword = y.keyword and x.annotator < y.annotator), r as (select *, rank() over (partition by a, b order by na) + (count(*) over (partition by a, b, na) - 1) / 2.0e0 as ra, rank() over (partition by a, b order by nb) + (count(*) over (partition by a, b, nb) - 1) / 2.0e0 as rb from b) select a as annotator_a, b as annotator_b, count(*) as n_keywords, round(avg((la = lb)::int), 6) as label_agreement, round(corr(ra, rb), 6) as novelty_spearman, round(1 - abs(corr(ra, rb)) * list_sum(list_transform(range(0, (count(*) - 2) // 2), lambda k: exp(lgamma(k + 0.5e0) - lgamma(k + 1.0e0)) / sqrt(pi()) * (1 - corr(ra, rb) ** 2) ** k)), 6) as novelty_p_value from r group by 1, 2")
def pairwise_agreement(spark, sf):
    t = M.pairwise_agreement(_j(spark, sf))
    return t.select("annotator_a", "annotator_b", "n_keywords", r6("label_agreement", "label_agreement"), r6("novelty_spearman", "novelty_spearman"), r6("novelty_p_value", "novelty_p_value"))


@query("compare_sets", f"with {V.JUDGEMENTS}, r as (select *, rank() over (order by novelty) + (count(*) over (partition by novelty) - 1) / 2.0e0 as r from j), s as (select count(*) filter (keyword_set = 'SELECTED') as n1, count(*) filter (keyword_set = 'CONTROL') as n2, avg((label = 'GAP')::int) filter (keyword_set = 'SELECTED') as g1, avg((label = 'GAP')::int) filter (keyword_set = 'CONTROL') as g2, avg(novelty) filter (keyword_set = 'SELECTED') as m1, avg(novelty) filter (keyword_set = 'CONTROL') as m2, var_samp(novelty) filter (keyword_set = 'SELECTED') as v1, var_samp(novelty) filter (keyword_set = 'CONTROL') as v2, sum(r) filter (keyword_set = 'SELECTED') as rs from r) select n1 as n_left, n2 as n_right, cast(0 as bigint) as n_shared_keywords, round(g1, 6) as gap_rate_left, round(g2, 6) as gap_rate_right, round(100 * (g1 - g2), 6) as gap_rate_difference_pp, round(m1, 6) as mean_novelty_left, round(m2, 6) as mean_novelty_right, round(100 * (m1 - m2) / m2, 6) as novelty_difference_percent, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as welch_t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) as welch_df, round((m1 - m2) / sqrt((v1 + v2) / 2), 6) as cohens_d, round(rs - n1 * (n1 + 1) / 2.0e0, 6) as mann_whitney_u from s")
def compare_sets(spark, sf):
    t = M.compare_sets(_j(spark, sf), "SELECTED", "CONTROL")
    return t.select(*[F.col(c) if c.startswith("n_") else r6(c, c) for c in t.columns])


@query("keyword_level", f"with {V.JUDGEMENTS} select keyword_set, keyword, round(avg((label = 'GAP')::int), 6) as gap_share, round(avg(novelty), 6) as novelty from j group by 1, 2")
def keyword_level(spark, sf):
    return M.keyword_level(_j(spark, sf)).select("keyword_set", "keyword", r6("gap_share", "gap_share"), r6("novelty", "novelty"))


@query("expert_concordance", f"with {V.JUDGEMENTS}, je as (select * from j where annotator in ('a0', 'a1')), jp as (select * from j where annotator not in ('a0', 'a1')), {_CONS.replace('from j ', 'from je ').replace('cons as', 'ce as').replace('maj as', 'me as')}, {_CONS.replace('from j ', 'from jp ').replace('cons as', 'cp as').replace('maj as', 'mp as')}, b as (select ce.mean_novelty as en, cp.mean_novelty as pn, me.majority_label = mp.majority_label as same, ce.gap_share as eg, cp.gap_share as pg, ce.std_novelty as es, cp.std_novelty as ps from ce join me using (keyword_set, keyword) join cp using (keyword_set, keyword) join mp using (keyword_set, keyword)), r as (select *, rank() over (order by en) + (count(*) over (partition by en) - 1) / 2.0e0 as re, rank() over (order by pn) + (count(*) over (partition by pn) - 1) / 2.0e0 as rp from b) select count(*) as n_keywords, round(corr(re, rp), 6) as spearman, round(avg(same::int), 6) as label_agreement, round(avg(eg), 6) as expert_gap_share, round(avg(pg), 6) as panel_gap_share, round(avg(es), 6) as expert_dispersion, round(avg(ps), 6) as panel_dispersion from r")
def expert_concordance(spark, sf):
    j = _j(spark, sf)
    t = M.expert_concordance(j.where(F.col("annotator").isin("a0", "a1")), j.where(~F.col("annotator").isin("a0", "a1")))
    return t.select("n_keywords", *[r6(c, c) for c in t.columns if c != "n_keywords"])


@query("expert_sheet", "select 'x' as annotator, c_name as keyword, case when c_mktsegment = 'MACHINERY' then 'METHOD' when c_mktsegment = 'BUILDING' then 'LOW IMPORTANCE' end as label, cast(c_nationkey as double) as novelty from customer where c_nationkey between 1 and 10")
def expert_sheet(spark, sf):
    raw = V.table(spark, sf, "customer").select(F.col("c_name").alias("keyword"), F.when(F.col("c_mktsegment") == "MACHINERY", " method").when(F.col("c_mktsegment") == "BUILDING", "low_importance").otherwise(F.col("c_mktsegment")).alias("label"), F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("novelty"))
    return experts.clean_expert_sheet(raw, "x")


@query("control_split", f"with {V.ARTICLES} select case when keyword like 'brand%' then 'SELECTED' else 'CONTROL' end as keyword_set, keyword from freq")
def control_split(spark, sf):
    f = K.keyword_frequencies(V.bag(_art(spark, sf)))
    return runner.control_split(f.where("keyword like 'brand%'"), f).select("keyword_set", "keyword")


_LEVEL = "lv as (select keyword_set = 'SELECTED' as l, avg(novelty) as x from j group by keyword_set, keyword)"


@query("permutation_test", f"with {V.JUDGEMENTS}, {_LEVEL}, pool as (select l, x, row_number() over (order by l desc, x) as i from lv), st as (select count(*) filter (l) as nl, count(*) as n, sum(x) as s, avg(x) filter (l) - avg(x) filter (not l) as d from pool), e as (select rep, x, row_number() over (partition by rep order by md5('42:' || rep || ':' || i)) as p from pool, range(20000) t(rep)), lf as (select rep, sum(x) filter (p <= nl) as lt from e, st group by rep), mv as (select lt / nl - (s - lt) / (n - nl) as m, d from lf, st) select round(any_value(d), 6) as difference, round((count(*) filter (abs(m) >= abs(d) - 1e-12) + 1) / 20001.0e0, 6) as p_value from mv")
def permutation_test(spark, sf):
    v = M.keyword_level(_j(spark, sf)).select((F.col("keyword_set") == "SELECTED").alias("is_left"), F.col("novelty").alias("x"))
    return M.permutation_mean_difference(v).select(r6("difference", "difference"), r6("p_value", "p_value"))


@query("validation_bars", f"with {V.JUDGEMENTS} select keyword_set, l as label, round(avg((label = l)::int), 6) as rate from j, (select unnest(['GAP', 'EXPLORED', 'LOW IMPORTANCE', 'METHOD', 'NOISE']) as l) group by 1, 2")
def validation_bars(spark, sf):
    return figures.validation_bars(_j(spark, sf)).select("keyword_set", "label", r6("rate", "rate"))


@query("stored_replay", f"with {V.JUDGEMENTS} select * from j where keyword_set = 'SELECTED'")
def stored_replay(spark, sf):
    j = _j(spark, sf)
    return studies.replayed(j.where("annotator <> 'a1'"), "SELECTED", "a1", j)


@query("reply_judgements", rf"""with {V.REPLIES},
b as (select *, regexp_extract(reply, '\{{.*\}}', 0, 's') as body from replies),
l as (select annotator, asked, case when json_valid(body) then json_extract(body, '$.annotations[*]') else cast(list_filter(list_transform(regexp_extract_all(reply, '\{{[^{{}}]*\}}'), lambda x: regexp_replace(x, ',\s*\}}', '}}')), lambda x: json_valid(x)) as json[]) end as es from b),
e as (select annotator, asked, i, es[i] as e from (select *, unnest(range(1, len(es) + 1)) as i from l)),
k as (select annotator, asked, i, lower(trim(e->>'keyword')) as keyword, replace(upper(e->>'label'), '_', ' ') as label, least(10.0, greatest(1.0, cast(e->>'novelty' as double))) as novelty, coalesce(e->>'rationale', '') as rationale from e),
g as (select annotator, keyword, arg_min({{'label': label, 'novelty': novelty, 'rationale': rationale}}, asked * 2 + i) as x from k where label <> 'UNSURE' and keyword in (select 'kw ' || (event_id % 40) from events) group by 1, 2)
select annotator, keyword, x.label as label, cast(x.novelty as double) as novelty, x.rationale as rationale from g""")
def reply_judgements(spark, sf):
    keywords = V.table(spark, sf, "events").select(F.lit("SELECTED").alias("keyword_set"), F.concat(F.lit("kw "), (F.col("event_id") % 40).cast("string")).alias("keyword")).distinct()
    return R.judgements(V.replies(spark, sf), keywords).drop("keyword_set")


# External rankings and studies

@query("external_ranking", "with k as (select lower(p_name) as keyword, p_retailprice as s, row_number() over (order by p_retailprice desc, p_partkey) as place from part) select keyword, arg_min(s, place) as score, min(place) as external_rank, count(*) as n_rows from k group by keyword")
def external_ranking(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.upper("p_name").alias("Term"), F.col("p_retailprice").cast("string").alias("Total link strength"))
    return ordered_ranking(p, "Term", "Total link strength", None, None).select("keyword", "score", "external_rank", "n_rows")


@query("external_ranks_alone", "with k as (select lower(p_name) as keyword, p_size as r, row_number() over (order by p_size, p_partkey) as place from part), d as (select keyword, min(place) as external_rank from k group by keyword) select keyword, external_rank, round(1 - (row_number() over (order by external_rank) - 1) / (select count(*) from d), 6) as score from d")
def external_ranks_alone(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.upper("p_name").alias("Term"), F.col("p_size").alias("Rank"))
    return ordered_ranking(p, "Term", None, "Rank", None).select("keyword", "external_rank", r6("score", "score"))


@query("external_unmatched", f"with {V.ARTICLES} select distinct keyword from (select 'p' || ps.i || ' s1' as keyword from (select p_partkey as i from part) ps) where keyword not in (select keyword from freq)")
def external_unmatched(spark, sf):
    from gapspark.sources.external import unmatched

    listed = V.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(" s1")).alias("keyword"))
    return unmatched(listed, Corpus(_art(spark, sf)))


_LISTS = "la as (select c_name as keyword, row_number() over (order by c_acctbal desc, c_name) as rank from customer), lb as (select c_name as keyword, row_number() over (order by c_acctbal + c_nationkey * 100 desc, c_name) as rank from customer)"


def _lists(spark, sf):
    c = V.table(spark, sf, "customer")
    return studies.ranked(c.select(F.col("c_name").alias("keyword"), F.col("c_acctbal").alias("score"))), studies.ranked(c.select(F.col("c_name").alias("keyword"), (F.col("c_acctbal") + F.col("c_nationkey") * 100).alias("score")))


@query("rbo", f"with {_LISTS}, d as (select greatest(la.rank, lb.rank) as d from la join lb using (keyword)), n as (select count(*) as k from la), x as (select i, (select count(*) from d where d <= i) as x from (select unnest(range(1, (select k from n) + 1)) as i)) select round((select x / k * 0.9e0 ** k from x, n where i = k) + 0.1e0 / 0.9e0 * (select sum(x / i * 0.9e0 ** i) from x), 6) as rbo")
def rbo(spark, sf):
    return studies.rank_biased_overlap(*_lists(spark, sf)).select(r6("rbo", "rbo"))


@query("kendall_shared", f"with {_LISTS}, b as (select la.rank as a, lb.rank as b from la join lb using (keyword)) select round(avg(sign(y.b - x.b)), 6) as tau, (select count(*) from b) as n_shared from b x join b y on x.a < y.a")
def kendall_shared(spark, sf):
    return studies.kendall_tau(*_lists(spark, sf)).select(r6("tau", "tau"), "n_shared")


@query("top_overlap", f"with {_LISTS} select count(*) as overlap, coalesce(bool_or(la.rank = 1 and lb.rank = 1), false) as same_first from la join lb using (keyword) where la.rank <= 10 and lb.rank <= 10")
def top_overlap(spark, sf):
    return studies.top_overlap(*_lists(spark, sf), 10)


_WEIGHTS = "v as (select * from (values ('default', 0.25e0, 0.15e0, 0.3e0, 0.3e0), ('equal', 0.25e0, 0.25e0, 0.25e0, 0.25e0), ('no_distance', 0e0, 0.15e0 / 0.75e0, 0.3e0 / 0.75e0, 0.3e0 / 0.75e0), ('no_centrality', 0.25e0 / 0.85e0, 0e0, 0.3e0 / 0.85e0, 0.3e0 / 0.85e0), ('no_tfidf', 0.25e0 / 0.7e0, 0.15e0 / 0.7e0, 0e0, 0.3e0 / 0.7e0), ('no_rarity', 0.25e0 / 0.7e0, 0.15e0 / 0.7e0, 0.3e0 / 0.7e0, 0e0)) t(variant, wd, wc, wt, wr))"
_SCALED = ", ".join(f"case when max({c}) over w > min({c}) over w then ({c} - min({c}) over w) / (max({c}) over w - min({c}) over w) else 0 end as {c}" for c in ("distance", "centrality", "tfidf", "rarity"))
_ABL = f"""{_WEIGHTS},
b as (select s_nationkey % 5 as cluster, s_name as keyword, s_acctbal as distance, s_suppkey as centrality, s_suppkey * 37 % 101 as tfidf, s_suppkey * 11 % 17 as rarity from supplier),
n as (select cluster, keyword, {_SCALED} from b window w as (partition by cluster)),
s as (select variant, cluster, keyword, round(wd * distance + wc * centrality + wt * tfidf + wr * rarity, 9) as score from n, v),
r as (select variant, cluster, keyword, row_number() over (partition by variant, cluster order by score desc, keyword) as rank from s),
m as (select r.variant, r.cluster, r.rank as a, d.rank as b from r join r d on d.variant = 'default' and d.cluster = r.cluster and d.keyword = r.keyword where r.variant <> 'default'),
f as (select variant, cluster, count(*) as n_candidates, count(*) filter (a <= 5 and b <= 5) / 5 as top_overlap, bool_or(a = 1 and b = 1) as same_first from m group by 1, 2),
t as (select x.variant, x.cluster, avg(sign(y.a - x.a)) as tau from m x join m y on x.variant = y.variant and x.cluster = y.cluster and x.b < y.b group by 1, 2),
o as (select f.variant, f.cluster, sum(0.1e0 * 0.9e0 ** (d - 1) * (select count(*) from m where m.variant = f.variant and m.cluster = f.cluster and m.a <= d and m.b <= d) / d) as rbo from (select variant, cluster, unnest(range(1, n_candidates + 1)) as d from f) f group by 1, 2),
report as (select f.cluster, f.variant, n_candidates, tau as kendall_tau, rbo, top_overlap, same_first from f join t using (variant, cluster) join o using (variant, cluster))"""


def _ablation(spark, sf):
    s = V.table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("cluster"), F.col("s_name").alias("keyword"), F.col("s_acctbal").alias("distance"), F.col("s_suppkey").alias("centrality"), (F.col("s_suppkey") * 37 % 101).alias("tfidf"), (F.col("s_suppkey") * 11 % 17).alias("rarity"))
    return studies.ablation_report(materialized(studies.ablated(s), "ablation"))


@query("weight_ablation", f"with {_ABL} select cluster, variant, n_candidates, round(kendall_tau, 6) as kendall_tau, round(rbo, 6) as rbo, round(top_overlap, 6) as top_overlap, same_first from report")
def weight_ablation(spark, sf):
    return _ablation(spark, sf).select("cluster", "variant", "n_candidates", r6("kendall_tau", "kendall_tau"), r6("rbo", "rbo"), r6("top_overlap", "top_overlap"), "same_first")


@query("ablation_aggregate", f"with {_ABL} select variant, round(min(kendall_tau), 6) as kendall_tau_min, round(max(kendall_tau), 6) as kendall_tau_max, round(min(rbo), 6) as rbo_min, round(max(rbo), 6) as rbo_max, round(min(top_overlap), 6) as top_overlap_min, round(max(top_overlap), 6) as top_overlap_max from report group by variant")
def ablation_aggregate(spark, sf):
    t = studies.ablation_aggregate(_ablation(spark, sf))
    return t.select("variant", *[r6(c, c) for c in t.columns if c != "variant"])


@query("ceiling_sweep", f"with {V.ARTICLES} select c as ceiling, count(*) filter (global_frequency <= c) as n, count(*) filter (global_frequency <= c and global_frequency <= 2) as shared, round(count(*) filter (global_frequency <= c and global_frequency <= 2) / count(*) filter (global_frequency <= c or global_frequency <= 2), 6) as jaccard from freq, (select unnest([1, 2, 3, 5, 10]) as c) group by 1")
def ceiling_sweep(spark, sf):
    f = K.keyword_frequencies(V.bag(_art(spark, sf)))
    return studies.ceiling_sweep(f, [1, 2, 3, 5, 10], 2).select("ceiling", "n", "shared", r6("jaccard", "jaccard"))


@query("rarest_k", f"with {V.ARTICLES} select keyword from freq order by global_frequency, first limit 25")
def rarest_k(spark, sf):
    return studies.extreme_k(K.keyword_frequencies(V.bag(_art(spark, sf))), 25).select("keyword")


@query("three_arms", f"with {V.JUDGEMENTS}, {_CONS}, g as (select keyword from cons where gap_votes >= 2), e as (select keyword from cons where gap_votes = 1) select case when keyword in (select keyword from g) then 'SELECTED' when keyword in (select keyword from e) then 'ELIGIBLE' else 'REST' end as arm, count(*) as n, round(avg(novelty), 6) as novelty from j group by 1")
def three_arms(spark, sf):
    j = _j(spark, sf)
    c = M.keyword_consensus(j)
    arms = studies.three_arms(j, c.where("gap_votes >= 2"), c.where("gap_votes >= 1"))
    return arms.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("novelty"), "novelty"))


@query("blind_aware_shift", f"with {V.JUDGEMENTS}, x as (select *, case when novelty > 5 then 'GAP' else label end as l1, least(10, novelty + length(keyword) % 3) as n1 from j) select count(*) as n_pairs, round(avg(n1 - novelty), 6) as mean_shift, round(avg((label <> l1)::int), 6) as label_changed, count(*) filter (label <> 'GAP' and l1 = 'GAP') as to_gap, count(*) filter (label = 'GAP' and l1 <> 'GAP') as from_gap from x")
def blind_aware_shift(spark, sf):
    j = _j(spark, sf)
    aware = j.select("annotator", "keyword_set", "keyword", F.when(F.col("novelty") > 5, "GAP").otherwise(F.col("label")).alias("label"), F.least(F.lit(10.0), F.col("novelty") + F.length("keyword") % 3).alias("novelty"))
    t = studies.blind_aware_shift(j, aware)
    return t.select("n_pairs", r6("mean_shift", "mean_shift"), r6("label_changed", "label_changed"), "to_gap", "from_gap")


@query("corpus_evidence", f"with {V.ARTICLES} select keyword, count(*) as n_articles, array_to_string((list(title order by row_id))[1:5], '|') as titles from bag join art using (row_id) group by 1")
def corpus_evidence(spark, sf):
    a = materialized(_art(spark, sf).select("row_id", "title", "doi", "citations", "keywords_normalized"), "articles")
    b = K.keyword_bag(a, "citations")
    return studies.corpus_evidence(b, b, a).select("keyword", "n_articles", F.array_join("titles", "|").alias("titles"))


@query("construct_validity", f"with {V.ARTICLES}, sel as (select keyword from freq where keyword like '% s7'), rare as (select keyword from freq order by global_frequency, first limit (select count(*) from sel)) select count(*) as n, round(avg((keyword in (select keyword from rare))::int), 6) as overlap_rarest, round(avg((global_frequency = 1)::int), 6) as singletons, 1.0e0 as multi_token, median(global_frequency) as median_frequency from sel join freq using (keyword)")
def construct_validity(spark, sf):
    f = materialized(K.keyword_frequencies(V.bag(_art(spark, sf))), "frequencies")  # a row for each keyword, read four times
    t = studies.construct_validity(f.where("keyword like '% s7'").select("keyword"), f)
    return t.select("n", r6("overlap_rarest", "overlap_rarest"), r6("singletons", "singletons"), "multi_token", "median_frequency")


_DRAW = "(('0x' || substr(md5('42:' || {parts}), 1, 13))::bigint % {n})"


@query("bootstrap_ci", f"with {V.JUDGEMENTS}, {_LEVEL}, pos as (select l, x, row_number() over (partition by l order by x) - 1 as i from lv), sz as (select l, count(*) as n, avg(x) as m from pos group by l), dr as (select rep, l, {_DRAW.format(parts="rep || ':' || l::int || ':' || jj", n='n')} as i from (select rep, l, n, unnest(range(1, n + 1)) as jj from sz, range(2000) t(rep))), mn as (select rep, avg(x) filter (dr.l) - avg(x) filter (not dr.l) as d from dr join pos on dr.l = pos.l and dr.i = pos.i group by rep) select round(quantile_cont(d, 0.025), 6) as low, round(quantile_cont(d, 0.975), 6) as high, round((select max(m) filter (l) - max(m) filter (not l) from sz), 6) as difference from mn")
def bootstrap_ci(spark, sf):
    v = M.keyword_level(_j(spark, sf)).select((F.col("keyword_set") == "SELECTED").alias("is_left"), F.col("novelty").alias("x"))
    t = studies.bootstrap_mean_difference(v)
    return t.select(*[r6(c, c) for c in t.columns])


@query("bootstrap_alpha", f"with {V.JUDGEMENTS}, ks as (select keyword, row_number() over (order by keyword) - 1 as i, count(*) over () as k from (select distinct keyword from j)), dr as (select rep, jj, {_DRAW.format(parts="rep || ':' || jj", n='k')} as i from (select rep, k, unnest(range(1, k + 1)) as jj from (select any_value(k) as k from ks), range(400) t(rep))), sm as (select rep, jj, novelty as v from dr join ks using (i) join j using (keyword)), u as (select rep, jj, v, count(*) as c, sum(count(*)) over (partition by rep, jj) as m from sm group by rep, jj, v qualify m > 1), t as (select rep, v, sum(c) as n, sum(sum(c)) over (partition by rep order by v) - sum(c) / 2.0e0 as at from u group by rep, v), a as (select u.*, t.at from u join t using (rep, v)), ob as (select x.rep, sum(x.c * y.c / (x.m - 1) * (x.at - y.at) ** 2) as o from a x join a y on x.rep = y.rep and x.jj = y.jj group by x.rep), ep as (select x.rep, sum(x.n * y.n * (x.at - y.at) ** 2) as e from t x join t y on x.rep = y.rep group by x.rep), al as (select 1 - (n - 1) * o / e as alpha from ob join ep using (rep) join (select rep, sum(n) as n from t group by rep) using (rep) where e > 0) select round(quantile_cont(alpha, 0.025), 6) as low, round(quantile_cont(alpha, 0.975), 6) as high, count(*) as n_defined from al")
def bootstrap_alpha(spark, sf):
    return studies.bootstrap_alpha(_j(spark, sf)).select(r6("low", "low"), r6("high", "high"), "n_defined")


@query("rarity_matched_draw", f"with {V.ARTICLES}, sel as (select * from freq where keyword like '% s7'), qu as (select global_frequency, count(*) as q from sel group by 1), e as (select rep, keyword, global_frequency as frequency, q, row_number() over (partition by rep, global_frequency order by md5('42:' || rep || ':' || keyword), keyword) as p from freq join qu using (global_frequency), range(3) t(rep) where keyword not in (select keyword from sel)) select rep, keyword, frequency from e where p <= q")
def rarity_matched_draw(spark, sf):
    f = K.keyword_frequencies(V.bag(_art(spark, sf))).select("keyword", "frequency")
    return studies.rarity_matched_draw(f, f.where("keyword like '% s7'"), 3)

