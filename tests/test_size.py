"""What decides whether a step holds at size: how often rows are shuffled, and that no task gets all rows of a frequent value."""

from pyspark.sql import functions as F

from gapspark import views as V
from gapspark.operators import detectors as D
from gapspark.operators import keywords as K
from gapspark.plans import consensus, studies


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def runs(spark):
    rows = [(r, r // 2, r % 2, "t", f"k{k}", float(k), k, f"c{r}") for r in range(6) for k in range(30) if k % (r + 1) == 0]
    return spark.createDataFrame(rows, "run_id int, seed int, size int, gap_type string, keyword string, score double, frequency int, cluster_label string")


def test_pooling_does_not_multiply_rows(spark):
    out = consensus.pooled(runs(spark), 6)
    assert "Expand" not in plan(out)
    found = {r.keyword: (r.n_runs_found, r.n_seeds_found, r.n_sizes_found) for r in out.collect()}
    assert found["k12"] == (5, 3, 2) and found["k7"] == (1, 1, 1) and dict(out.dtypes)["n_runs_found"] == "bigint"


def test_intersections_of_runs_need_no_pairs_of_rows(spark):
    sets = runs(spark).select("run_id", "keyword").unionByName(spark.createDataFrame([(0, None), (1, None)], "run_id int, keyword string"))
    grid = spark.createDataFrame([(r, r % 2) for r in range(7)], "run_id int, size int")
    j = consensus.pairwise_jaccard(sets, grid)
    assert "keyword" not in plan(j)
    own = {r: {k for k in range(30) if k % (r + 1) == 0} for r in range(6)} | {6: set()}
    n = {r: len(s) + (r < 2) for r, s in own.items()}
    for x in j.collect():
        both = len(own[x.left] & own[x.right])
        assert x.jaccard == both / (n[x.left] + n[x.right] - both), x
    s = consensus.stability(sets, grid).first()
    assert s.mean_candidates_per_run == sum(map(len, own.values())) / 7


def test_evidence_counts_before_gaps_are_met(spark):
    articles = spark.createDataFrame([(i, f"t{i}", f"d{i}", float(i), ["a", f"b{i % 3}"]) for i in range(9)], "row_id long, title string, doi string, citations double, keywords_normalized array<string>")
    bag = K.keyword_bag(articles, "citations")
    gaps = spark.createDataFrame([("a", -1), ("b1", -1), ("none", -1)], "keyword string, cluster int")
    out = D.article_evidence(gaps, bag, articles, scoped=False)
    assert plan(out).count("Join") == 4  # counts, titles, and titles of wanted gaps; citations come with the bag
    got = {r.keyword: (r.n_articles, r.citations, r.article_titles) for r in out.collect()}
    assert got == {"a": (9, 8.0, ["t0", "t1", "t2"]), "b1": (3, 7.0, ["t1", "t4", "t7"]), "none": (0, None, [])}
    assert {r.keyword: r.n_articles for r in studies.corpus_evidence(gaps, bag, articles).collect()} == {"a": 9, "b1": 3, "none": 0}


def test_a_member_of_many_keywords_is_told_by_broadcast(spark):
    rows = spark.createDataFrame([(f"k{i}", [f"k{i}", "z z", "y"]) for i in range(40)] + [("k1", ["k1", "z z", "y"])], "keyword string, members array<string>")
    spelling = spark.createDataFrame([(f"k{i}", f"K{i}x") for i in range(40)] + [("y", "yY")], "keyword string, spelling string")
    out = K.display(rows, spelling, often=10).collect()
    assert len(out) == 41 and all(r.keyword_display == f"K{r.keyword[1:]}x x Z z x YY" for r in out)


def test_keywords_of_numbers_are_made_after_the_shuffle(spark, tmp_path):
    spark.sql("select 7L l_orderkey, id l_partkey, id + 2 l_suppkey, cast(id as int) l_linenumber from range(1, 4)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select id p_partkey, concat('Brand#', id) p_brand, 'TIN' p_type from range(5)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select 7L o_orderkey, date'2020-01-01' o_orderdate, 1500.0 o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    out = V.articles(spark, str(tmp_path)).select("author_keywords")
    assert out.first()[0] == ["BRAND-1 TIN", "p2 s4", "p3 s5"]
    inner = plan(out)
    assert "concat(p" not in inner[inner.index("Join Inner"):]  # below the records
