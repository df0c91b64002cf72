"""Type 2 at size: work follows the keywords, not pairs of their blocks."""

import numpy as np

from gapspark import queries as Q
from gapspark.config import GapConfig
from gapspark.operators import keywords as K
from gapspark.operators import pairs as P
from gapspark.operators import tfidf as TF
from test_pairs import SCHEMA, brute


def rare_and_few_frequent(n):
    """n rare keywords and five frequent ones, directions at random."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n + 5, 8))
    return [(0, f"k{i}", (i, 0), 12 if i >= n else 2 + i % 2, float(0.001 + 0.002 * rng.random()), x[i].tolist()) for i in range(n + 5)]


def test_compared_blocks_follow_the_rows(spark):
    config, none = GapConfig(min_tfidf=0.0001), spark.createDataFrame([], "cluster int, left string, right string")
    for n in (200, 600):
        rows, log = rare_and_few_frequent(n), []
        got = {(r.keyword_1, r.keyword_2, round(r.score, 6)) for r in P.best_pairs(spark.createDataFrame(rows, SCHEMA), none, config, block=20, log=log).collect()}
        assert got == {(p[3], p[4], round(-p[0], 6)) for p in brute(rows, set(), config)[0][: config.max_gaps_per_cluster]}
        # the head with itself and with parts of four blocks; the rare ones cannot reach the floor without it
        assert log[0]["compared"] <= 2 + n // 80


def test_keywords_of_a_record_are_paired_once(spark):
    bag = spark.createDataFrame([(0, 1, "b"), (0, 1, "a"), (0, 1, "c"), (0, 2, "a"), (1, 3, "a"), (1, 3, "b")], "cluster int, row_id long, keyword string")
    got = sorted(tuple(r) for r in K.occurring_together(bag, "cluster").collect())
    assert got == [(0, "a", "b"), (0, "a", "c"), (0, "b", "c"), (1, "a", "b")]


def test_a_tree_of_terms_finds_what_slices_find():
    import pyarrow as pa

    rng, terms = np.random.default_rng(5), ["a", "b", "a b", "b a b", "c d e", "d e"]  # not every beginning of a term is one
    lists = [[str(w) for w in rng.choice(list("abcdez"), rng.integers(1, 12))] for _ in range(50)]
    record, term = TF._Prefixes(terms).found(pa.array(lists))
    got = sorted(zip(record.tolist(), (terms[i] for i in term)))
    assert got == sorted((r, g) for r, t in enumerate(lists) for k in (1, 2, 3) for i in range(len(t) - k + 1) if (g := " ".join(t[i : i + k])) in terms)


def test_vocabularies_read_the_words_of_records_once(spark, monkeypatch):
    arts = spark.createDataFrame([(r % 2, [f"w{r % 3} w{r % 4}", f"w{r % 5}"]) for r in range(40)] + [(0, [])], "size int, keywords_normalized array<string>")
    made, kept = [], TF.tokens
    monkeypatch.setattr(TF, "tokens", lambda *a: made.append(a) or kept(*a))
    both = {(r.size, r.term): r.score for r in TF.vocabulary(arts, 1, 3, 6, ("size",)).collect()}
    assert len(made) == 1 and len(both) == 12
    for size in (0, 1):
        own = {r.term: r.score for r in TF.vocabulary(arts.where(f"size = {size}"), 1, 3, 6).collect()}
        assert {t for s, t in both if s == size} == set(own) and all(abs(both[size, t] - x) < 1e-12 for t, x in own.items())


def test_keywords_of_little_salience_are_paired_too(spark, tmp_path):
    import duckdb

    # of 15,000 records two have each of two related keywords, so both are far less salient than 0.0001; the others' keyword is no candidate
    spark.sql("select 3 * id + if(id < 4, 0, 1) o_orderkey, date'2020-01-01' o_orderdate, 1500.0 o_totalprice from range(15000)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select 3 * id + if(id < 4, 0, 1) l_orderkey, case when id < 2 then 3L when id < 4 then 4L else 1L end l_partkey, if(id < 2, 5L, 7L) l_suppkey, if(id < 4, 2, 1) l_linenumber from range(15000)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select id p_partkey, concat('Brand#', id) p_brand, 'PROMO' p_type from range(5)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select cast(id as int) vec_id, 0 label, case id when 98 then array(1.0f, 0.0f) else array(0.5f, 1.0f) end embedding from range(200)").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem", "part", "embeddings"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in Q.type2_combinations(spark, str(tmp_path)).collect()]
    assert got == con.execute(Q.ORACLES["type2_combinations"]).fetchall()
    assert [r[:2] for r in got] == [(0, "p3 s5 x p4 s7")] and got[0][3] == 4
