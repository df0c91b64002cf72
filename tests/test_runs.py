"""Sources, whole runs, studies and validation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gapspark import cli
from gapspark.config import ClusteringConfig, EncoderConfig, GapConfig, RunConfig
from gapspark.functions import tails
from gapspark.operators import encoders as E, keywords as K
from gapspark.plans import consensus, figures, pipelines, studies
from gapspark.sources import corpus as S, external as X
from gapspark.streaming.frequencies import run_once, stream_keyword_frequencies
from gapspark.validation import annotators as A, experts, metrics as M, protocol as P, runner as R

THEMES = [("digital", "market"), ("green", "energy"), ("social", "network")]


@pytest.fixture(scope="module")
def export(spark):
    rng = random.Random(7)
    rows = []
    for t, (a, b) in enumerate(THEMES):
        for i in range(20):
            kws = [f"{a} {b}", f"{a} policy"][: 1 + i % 2] + [f"{a} {x}" for x in rng.sample(["alpha", "beta", "gamma"], 1)]
            if i in (7, 13):
                kws.append(f"{b} rare{i}")
            if i % 6 == 0:
                kws.append("factor analysis")
            rows.append((f"{a} study {i} on {b}", f"We study {a} {b} and {a} policy in {b} design number {i}", "; ".join(k.title() for k in kws), str(2000 + i), str(i * 3), f"10.1/{t}.{i}"))
    return spark.createDataFrame(rows, "Title string, Abstract string, `Author Keywords` string, Year string, `Cited by` string, DOI string").coalesce(1)


@pytest.fixture(scope="module")
def corpus(export):
    return S.from_dataframe(export)


CONFIG = RunConfig(60, None, EncoderConfig(dimensions=16), EncoderConfig(dimensions=16), ClusteringConfig(n_clusters=3, n_init=3), GapConfig())


def test_header_resolution():
    assert S.resolve_columns(["TI", "DE", "ID", "PY", "Keywords Plus"]) == {"title": "TI", "author_keywords": "DE", "year": "PY"}
    assert S.resolve_columns(["Title", "Keywords", "Author Keywords"])["author_keywords"] == "Author Keywords"
    assert S.resolve_columns(["Title", "title ", "DE"])["title"] == "title "
    assert S.resolve_columns(["x", "DE"], {"title": "X"})["title"] == "x"
    for columns, mapping in ((["Title"], None), (["Title", "ID"], None), (["Title", "DE"], {"year": "nope"})):
        with pytest.raises(ValueError):
            S.resolve_columns(columns, mapping)


def test_records_without_text_or_keywords_are_counted_and_dropped(spark):
    frame = spark.createDataFrame([("a", "x; y", "1"), ("", "z", "2"), ("nan", "z", "3"), ("b", "; |", "n/a"), ("c", None, None)], "Title string, DE string, TC string")
    c = S.from_dataframe(frame)
    assert (len(c), c.dropped_empty_text, c.dropped_empty_keywords) == (1, 2, 2)
    assert len(S.from_dataframe(frame, require_keywords=False)) == 3
    assert len(S.from_dataframe(frame.limit(0))) == 0


def test_flavours_of_one_export(spark, export, tmp_path):
    path = f"{tmp_path}/c.csv"
    export.write.option("header", True).option("escape", '"').csv(path)
    tab = export.select(F.col("Title").alias("TI"), F.col("Abstract").alias("AB"), F.col("Author Keywords").alias("DE"), F.lit("no").alias("ID"), F.col("Year").alias("PY"), F.col("Cited by").alias("TC"))
    tab.write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/c.tsv")
    keys = lambda c: sorted((r.title, tuple(r.keywords_normalized), r.year, r.citations) for r in c.frame.collect())
    assert keys(S.load_csv(spark, path)) == keys(S.load_csv(spark, f"{tmp_path}/c.tsv", sep="\t")) == keys(S.from_dataframe(export))


def test_corpus_surface(corpus):
    s = corpus.summary().first()
    assert s.n_articles == 60 and s.has_abstracts and s.has_citations and (s.year_min, s.year_max) == (2000, 2019)
    assert len(corpus.head(5)) == 5 and len(corpus.subset("year > 2010")) == 27
    assert corpus.unique_keywords().orderBy("kw_ord").first().keyword == "digital market"


def test_mode_b_finds_the_planted_gaps(corpus, tmp_path, spark):
    r = pipelines.run(corpus, "articles_first", CONFIG)
    found = {x.keyword for x in r.gaps.where("gap_type = 'Emerging Concept'").collect()}
    assert {"market rare7", "energy rare13", "network rare7"} <= found
    assert "factor analysis" not in {k for x in r.gaps.collect() for k in x.members}
    assert r.diagnostics["n_clusters"] == 3 and r.diagnostics["cluster_quality"]["silhouette"] > 0.1
    assert {x.cluster_label.split(" & ")[0] for x in r.gaps.collect()} == {"Digital Market", "Green Energy", "Social Network"}
    assert {"gap_type", "keyword_display", "metrics"} <= set(r.gaps.columns)
    paths = r.save(str(tmp_path), "b")
    assert spark.read.option("header", True).csv(paths["gaps"]).count() == r.gaps.count()
    assert json.loads(spark.read.text(paths["summary"]).first().value)["mode"] == "articles_first"
    data = figures.figure_data(r)
    assert {"network", "centroids", "years", "gap_summary"} <= set(data) and set(data["skipped"]) == {"keyword_map", "article_map", "k_selection", "validation"}
    named = pipelines.run(corpus, "articles_first", CONFIG, lambda c, articles, members: f"theme {c}")
    assert {x.cluster_label for x in named.gaps.collect()} <= {"theme 0", "theme 1", "theme 2"}


def test_mode_b_does_not_depend_on_partitioning(export, corpus):
    rows = lambda r: sorted((x.gap_type, x.keyword, x.cluster, round(x.score, 9)) for x in r.gaps.collect())
    other = S.from_dataframe(S.with_row_ids(export.coalesce(1)).repartition(9))
    assert rows(pipelines.articles_first(corpus, CONFIG)) == rows(pipelines.articles_first(other, CONFIG))


def test_mode_a_ranks_and_truncates(corpus):
    config = CONFIG.replace(top_n_articles=20, problem_description="green energy policy", gaps=GapConfig(max_keyword_frequency=None, periphery_percentile=80.0))
    r = pipelines.run(corpus, "keywords_first", config)
    assert r.articles.count() == 20 and r.diagnostics["max_keyword_frequency"] == 1
    assert r.articles.where("title like 'green%'").count() >= 15
    assert {x.gap_type for x in r.gaps.collect()} <= {"Peripheral Keyword"}
    with pytest.raises(ValueError):
        pipelines.run(corpus, "backwards")
    with pytest.raises(ValueError):
        pipelines.keywords_first(corpus.head(1), CONFIG)


def test_consensus(corpus):
    q = consensus.consensus_gaps(corpus, "articles_first", CONFIG, seeds=(1, 2, 2))
    s = q.summary()
    assert q.grid.count() == 2 and s["n_pooled"] >= s["n_unanimous"] and 0 <= s["mean_jaccard"] <= 1
    assert q.at_support(1.0).count() == s["n_unanimous"] and "keyword_display" in q.gaps.columns
    with pytest.raises(ValueError):
        consensus.consensus_gaps(corpus, seeds=(1,))


def test_encoders(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "digital market"), (2, "digital markets"), (3, "green energy"), (4, None)], "row_id long, text string")
    v = {r.row_id: r.vector for r in E.get_encoder(EncoderConfig(dimensions=3)).encode(texts).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert len(v) == 4 and dot(v[1], v[2]) > 0.4 > abs(dot(v[1], v[3])) and set(v[4]) == {0.0}
    known = spark.createDataFrame([("digital market", [3.0, 4.0])], "text string, vector array<double>")
    pre = E.get_encoder(EncoderConfig("precomputed", extra={"vectors": known}))
    assert pre.encode(texts.where("row_id = 1")).first().vector == [0.6, 0.8]
    with pytest.raises(Exception, match="no vector"):
        pre.encode(texts).collect()
    assert {r.text for r in E.missing_texts(texts.where("text is not null"), known).collect()} == {"digital markets", "green energy"}
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(RuntimeError, match="OPENAI_API_KEY"):
        E.OpenAIEncoder(EncoderConfig("openai")).encode_texts(["a"], None)
    monkeypatch.setenv("OPENAI_API_KEY", "test-only")
    calls = []
    reply = lambda url, headers, body: calls.append(body) or {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]}
    assert E.OpenAIEncoder(EncoderConfig("openai", batch_size=2)).encode_texts(["a", "bb", "ccc"], reply) == [[1.0], [2.0], [3.0]] and len(calls) == 2
    E.register_encoder("mine", lambda c: pre)
    assert "mine" in E.available_encoders()
    with pytest.raises(ValueError):
        E.get_encoder(EncoderConfig("unknown"))
    with pytest.raises(ValueError):
        list(E.batched([1], 0))


def test_config_hides_secrets():
    c = RunConfig(article_encoder=EncoderConfig(extra={"api_key": "sk", "vectors": object(), "dims": 3}))
    told = json.loads(c.to_json())["article_encoder"]["extra"]
    assert told == {"api_key": "<hidden>", "vectors": "<object>", "dims": 3}
    with pytest.raises(ValueError):
        RunConfig(top_n_articles=0)


def test_external_ranking(spark, corpus):
    frame = spark.createDataFrame([(0, "Digital Market", "5"), (1, "unheard of", "9"), (2, "digital  market", "7"), (3, " ", "99")], "row_id long, Term string, `Total link strength` string")
    r = X.load_external_ranking(spark, frame, corpus, name="maps")
    got = {x.keyword: x for x in r.gaps.collect()}
    assert list(x.keyword for x in r.gaps.orderBy(F.desc("score")).collect()) == ["unheard of", "digital market"]
    assert got["digital market"].score == 7.0 and got["digital market"].metrics == {"external_rank": 2.0} and got["digital market"].n_articles == 20 and got["digital market"].cluster == -1 and len(got["digital market"].article_titles) == 5
    told = r.diagnostics["external"]
    assert told["unmatched_in_corpus"] == ["unheard of"] and (told["rows_read"], told["candidates"], told["duplicates_dropped"]) == (3, 2, 1) and r.mode == "external" and got["unheard of"].gap_type == X.EXTERNAL
    assert [x.keyword for x in X.load_external_ranking(spark, ["B b", "a a", "b b"]).gaps.collect()] == ["b b", "a a"]
    plain = X.load_external_ranking(spark, ["alpha", "ALPHA", "beta", "gamma"])
    assert [round(x.score, 4) for x in plain.gaps.collect()] == [1.0, 0.6667, 0.3333] and [x.metrics["external_rank"] for x in plain.gaps.collect()] == [1.0, 3.0, 4.0]
    assert [x.keyword for x in X.load_external_ranking(spark, ["nan", "none"]).gaps.collect()] == ["nan", "none"]
    both = spark.createDataFrame([("c", "3", "0.5", ""), ("a", "1", "", "Emerging"), ("b", "2", "0.9", None)], "keyword string, rank string, score string, type string")
    rows = {x.keyword: x for x in X.load_external_ranking(spark, both).gaps.collect()}
    assert {k: (v.score, v.metrics["external_rank"], v.gap_type) for k, v in rows.items()} == {"a": (None, 1.0, "Emerging"), "b": (0.9, 2.0, X.EXTERNAL), "c": (0.5, 3.0, X.EXTERNAL)}
    assert [x.keyword for x in X.load_external_ranking(spark, both, top_n=2).gaps.orderBy("keyword").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        X.load_external_ranking(spark, frame, keyword_column="nope")
    with pytest.raises(ValueError):
        X.read_ranking(spark, "list.pdf")
    assert X.resolve_header(["Total link strength", "x"], X.SCORE_ALIASES) == "Total link strength"


REPLY = '```json\n{"annotations": [{"keyword": "Alpha", "label": "gap", "novelty": 8, "rationale": "r"}, {"keyword": "beta", "label": "low_importance"}, {"keyword": "other", "label": "GAP"}, {"keyword": "gamma", "label": "SURE"}]}\n```'


def test_replies_are_read_and_salvaged():
    got = {a.keyword: (a.label, a.novelty) for a in P.parse_reply(REPLY, ["alpha", "beta", "gamma"], "m", "S")}
    assert got == {"alpha": ("GAP", 8.0), "beta": ("LOW IMPORTANCE", 1.0)}
    broken = 'Sure: {"keyword": "alpha", "label": "NOISE", "novelty": 2,} and {"keyword": "beta", "label": "METHOD"} {"keyword": '
    assert {a.keyword: a.label for a in P.parse_reply(broken, ["alpha", "beta"], "m", "S")} == {"alpha": "NOISE", "beta": "METHOD"}
    assert P.parse_reply("no json", ["alpha"], "m", "S") == []
    assert P.parse_reply('{"results": [{"keyword": "alpha", "label": "GAP", "novelty": 99}]}', ["alpha"], "m", "S")[0].novelty == 10
    for bad in (dict(label="MAYBE", novelty=5), dict(label="GAP", novelty=0)):
        with pytest.raises(ValueError):
            P.Annotation("a", "S", "k", **bad)
    prompt = P.build_prompt(["a b"], "farming", "why", {"a b": (2, ["T"])})
    assert "1. a b (in 2 record(s): T)" in prompt and "farming" in prompt


def test_annotators_ask_again_once_and_back_off(monkeypatch):
    asked = []
    a = A.CallableAnnotator("x", lambda p: asked.append(p) or '{"annotations": [{"keyword": "alpha", "label": "GAP"}]}', batch_size=2)
    assert [x.keyword for x in a.annotate(["alpha", "beta"], "S", "d")] == ["alpha"] and len(asked) == 2
    monkeypatch.setenv("ANTHROPIC_API_KEY", "test-only")

    class Busy(Exception):
        code = 429

    replies = iter([Busy(), {"content": [{"text": "hi"}]}])

    def transport(*_):
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    assert A.ChatAnnotator("anthropic", transport=transport, wait=0).reply("p") == "hi"
    with pytest.raises(ValueError):
        A.get_annotator("nobody")
    assert "openai" in A.available_providers()


def judgement(spark, rows):
    return spark.createDataFrame(rows, "annotator string, keyword_set string, keyword string, label string, novelty double")


def test_metrics_by_hand(spark):
    j = judgement(spark, [("a", "S", "x", "GAP", 8.0), ("b", "S", "x", "GAP", 6.0), ("a", "S", "y", "NOISE", 2.0), ("b", "S", "y", "METHOD", 2.0)])
    r = M.label_rates(j).first()
    assert (r.rate_gap, r.rate_noise, r.rate_explored) == (0.5, 0.25, 0.0)
    c = {x.keyword: x for x in M.keyword_consensus(j).collect()}
    assert c["x"].unanimous and c["x"].gap_share == 1.0 and c["y"].majority_label == "METHOD"
    # P = (1 + 0) / 2, Pe = .25 + .0625 + .0625
    assert M.fleiss_kappa(j).first().kappa == pytest.approx((0.5 - 0.375) / 0.625)
    p = M.pairwise_agreement(j).first()
    assert (p.n_keywords, p.label_agreement, p.novelty_spearman, p.novelty_p_value) == (2, 0.5, None, None)
    four = judgement(spark, [("a", "S", k, "GAP", float(x)) for k, x in zip("wxyz", (1, 2, 3, 4))] + [("b", "S", k, "GAP", float(x)) for k, x in zip("wxyz", (2, 1, 3, 4))])
    p = M.pairwise_agreement(four).first()
    assert p.novelty_spearman == pytest.approx(0.8) and p.novelty_p_value == pytest.approx(0.2)
    assert M.novelty_statistics(j.limit(1)).first()["std"] == 0.0


def test_alpha_of_perfect_and_of_no_variation(spark):
    perfect = judgement(spark, [(a, "S", f"k{i}", "GAP", float(1 + i)) for a in "ab" for i in range(4)])
    assert M.krippendorff_alpha(perfect).first().alpha == pytest.approx(1.0)
    flat = judgement(spark, [(a, "S", f"k{i}", "GAP", 5.0) for a in "ab" for i in range(4)])
    assert M.krippendorff_alpha(flat).first().alpha is None
    r = studies.bootstrap_alpha(perfect, 20).first()
    assert r.low == r.high == pytest.approx(1.0) and 15 <= r.n_defined <= 20
    mixed = judgement(spark, [(a, "S", f"k{i}", "GAP", float(1 + (i * (2 if a == "a" else 3)) % 7)) for a in "ab" for i in range(12)])
    r = studies.bootstrap_alpha(mixed, 50).first()
    assert r.low < M.krippendorff_alpha(mixed).first().alpha < r.high
    both = mixed.withColumn("g", F.lit("x")).unionByName(perfect.withColumn("g", F.lit("y")))
    by = {r.g: r.alpha for r in M.krippendorff_alpha(both, "g").collect()}
    assert by["y"] == pytest.approx(1.0) and by["x"] == pytest.approx(M.krippendorff_alpha(mixed).first().alpha)


def test_comparisons(spark):
    rows = [("a", "SELECTED", f"s{i}", "GAP" if i < 3 else "NOISE", 6.0 + i) for i in range(4)] + [("a", "CONTROL", f"c{i}", "GAP" if i < 1 else "NOISE", 1.0 + i) for i in range(4)]
    d = M.with_p_values(M.compare_sets(judgement(spark, rows), "SELECTED", "CONTROL"))
    assert d["gap_rate_difference_pp"] == 50.0 and d["mann_whitney_u"] == 16.0 and d["mann_whitney_p"] == pytest.approx(2 / 70)
    assert d["welch_t"] == pytest.approx(5 / (2 * (5 / 3) / 4) ** 0.5) and d["welch_df"] == pytest.approx(6.0) and 0 < d["welch_p"] < 0.01
    nested = judgement(spark, rows + [("a", "CONTROL", "s0", "GAP", 6.0)])
    n = M.compare_sets(nested, "SELECTED", "CONTROL").first()
    assert n.n_shared_keywords == 1 and n.welch_t is None and n.mann_whitney_u is None
    v = spark.createDataFrame([(True, 5.0 + i) for i in range(5)] + [(False, float(i)) for i in range(5)], "is_left boolean, x double")
    p = M.permutation_mean_difference(v, 500).first()
    assert p.difference == 5.0 and 1 / 501 <= p.p_value < 0.05
    b = studies.bootstrap_mean_difference(v, 300).first()
    assert b.low < 5.0 < b.high and b.difference == 5.0


def test_tails():
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and tails.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert studies.equivalence_test(0.0, 0.1, 50, 0.5) < 0.001 < studies.equivalence_test(0.5, 0.1, 50, 0.5)
    assert studies.minimal_detectable_effect(64, 64) == pytest.approx(0.5, abs=0.01)


def test_control_sets_are_disjoint(spark, corpus):
    f = K.keyword_frequencies(corpus.bag)
    chosen = f.where("keyword like 'digital%'")
    s = R.control_split(chosen, f, most=5)
    sets = {}
    for r in s.collect():
        sets.setdefault(r.keyword_set, set()).add(r.keyword)
    assert not sets["SELECTED"] & sets["CONTROL"] and len(sets["CONTROL"]) == 5
    with pytest.raises(ValueError):
        R.control_split(f, f)
    with pytest.warns(DeprecationWarning):
        assert R.nested_split(chosen, f).where("keyword_set = 'ALL'").count() == f.count()


def test_validation_study(spark, corpus, tmp_path):
    result = pipelines.articles_first(corpus, CONFIG)
    reply = lambda p: json.dumps({"annotations": [{"keyword": line.split(". ", 1)[1], "label": "GAP" if "rare" in line else "EXPLORED", "novelty": 9 if "rare" in line else 3} for line in p.splitlines() if line[:1].isdigit()]})

    def fails(_):
        raise RuntimeError("no answer")

    report = R.validate_gaps(result, K.keyword_frequencies(corpus.bag), [A.CallableAnnotator("one", reply), A.CallableAnnotator("two", reply), A.CallableAnnotator("bad", fails)], "d")
    s = report.summary()
    assert s["failures"] == {"bad": "no answer"} and s["annotators"] == ["one", "two"] and s["comparison"]["n_shared_keywords"] == 0
    assert s["sets"]["SELECTED"]["rate_gap"] > s["sets"]["CONTROL"]["rate_gap"] and s["unanimous_gaps"]
    assert set(report.save(str(tmp_path))) == {"annotations", "consensus", "agreement", "summary"}
    again = R.validate_gaps(result, K.keyword_frequencies(corpus.bag), [A.CallableAnnotator("one", fails), A.CallableAnnotator("two", fails)], "d", stored=report.judgements)
    assert again.judgements.count() == report.judgements.count() and again.failures == {}  # all was stored, so nothing is asked


def test_expert_sheets(spark, tmp_path):
    sheet = experts.build_expert_sheet(spark.createDataFrame([("a b",), ("c d",), ("a b",)], "keyword string"))
    assert sheet.count() == 2 and sheet.collect() == experts.build_expert_sheet(spark.createDataFrame([("c d",), ("a b",)], "keyword string").repartition(3)).collect()
    path = experts.write_expert_sheet(sheet.withColumns({"novelty": F.lit(7.0), "label": F.lit("gap")}), f"{tmp_path}/sheet", ["e1", "e2"])
    back = experts.load_expert_sheet(spark, path)
    assert {(r.annotator, r.keyword, r.label, r.novelty) for r in back.collect()} == {(e, k, "GAP", 7.0) for e in ("e1", "e2") for k in ("a b", "c d")}
    panel = judgement(spark, [("m", "SELECTED", k, "GAP", 7.0) for k in ("a b", "c d")])
    with pytest.raises(Exception, match="three shared"):
        experts.expert_report(back, panel).collect()


def test_studies(spark):
    g = lambda ks: studies.ranked(spark.createDataFrame([(k, 1.0 - i / 10) for i, k in enumerate(ks)], "keyword string, score double"))
    a, b = g("abcde"), g("abced")
    assert studies.kendall_tau(a, b).first().tau == pytest.approx(0.8) and studies.rank_biased_overlap(a, a).first().rbo == pytest.approx(1.0)
    rng = random.Random(1)
    left, right = list(range(1, 301)), rng.sample(range(1, 301), 300)
    lists = [spark.createDataFrame([(f"k{i}", int(r)) for i, r in enumerate(x)], "keyword string, rank int") for x in (left, right)]
    exact = sum(1 if (right[j] > right[i]) else -1 for i in range(300) for j in range(i + 1, 300)) / (300 * 299 / 2)
    for block in (37, 300):
        assert studies.kendall_tau(*lists, block=block).first().tau == pytest.approx(exact)
    assert studies.rank_biased_overlap(a, g("vwxyz")).first().rbo == 0.0 and studies.top_overlap(a, b, 2).first().overlap == 2
    pool = spark.createDataFrame([(f"p{i}", 1 + i % 2) for i in range(20)], "keyword string, frequency int")
    chosen = pool.where("keyword in ('p0', 'p2', 'p1')")
    draw = studies.rarity_matched_draw(pool, chosen, 4)
    assert {r["count"] for r in draw.groupBy("rep").count().collect()} == {3} and draw.where("keyword in ('p0', 'p1', 'p2')").count() == 0
    assert {(r.rep, r.frequency): r["count"] for r in draw.groupBy("rep", "frequency").count().collect()}[0, 1] == 2
    assert studies.canonical_names(pool.limit(1), {"p0": "zero"}).first().keyword == "zero"
    assert {r["count"] for r in studies.random_draw(pool, 5, 3).groupBy("rep").count().collect()} == {5}


def test_stream_frequencies(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("2024-01-01 10:00:00", "A b; c"), ("2024-01-01 11:00:00", "a  B; A b"), ("2024-01-09 00:00:00", "late")], "ts string, author_keywords string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, author_keywords string").parquet(src)
    run_once(stream_keyword_frequencies(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {(r.keyword, r.frequency) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a b", 2), ("c", 1)}


def test_command_line(spark, export, tmp_path, capsys):
    path = f"{tmp_path}/c.csv"
    export.write.option("header", True).option("escape", '"').csv(path)
    assert cli.main(["version"]) == 0 and cli.main(["encoders"]) == 0
    assert cli.main(["external", path, "--keyword-column", "Author Keywords", "--outdir", f"{tmp_path}/x"], spark) == 0
    assert "gaps" in capsys.readouterr().out
    config = cli.build_config(cli.parser().parse_args(["run", "x.csv", "--tokens", "0", "--proportional", "--seed", "7", "--drop-uncited"]))
    assert config.gaps.gap_token_count is None and config.gaps.max_keyword_frequency is None and config.random_state == 7 and not config.gaps.keep_uncited_candidates


def test_registered_queries_have_the_contracts_form():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


def test_registered_mode_b_takes_the_whole_table(spark, tmp_path, monkeypatch):
    from gapspark import queries

    spark.createDataFrame([(i, f"some words about item{chr(97 + i % 26)} and other things beside these") for i in range(60)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    met = []

    class Seen(Exception):
        pass

    def caught(corpus, config):
        met.append(pipelines.prepare(corpus, config).n_articles)
        raise Seen

    pipelines = queries.pipelines
    monkeypatch.setattr(pipelines, "articles_first", caught)
    with pytest.raises(Seen):
        queries.mode_b(spark, str(tmp_path))
    assert met == [60]


def test_all_unmatched_keywords_are_told(spark, corpus):
    listed = [f"unheard {i}" for i in range(130)]
    assert X.load_external_ranking(spark, listed, corpus).diagnostics["external"]["unmatched_in_corpus"] == listed


def test_places_in_an_order_over_all_rows(spark):
    from gapspark.functions.order import numbered, running, with_average_rank

    rows = spark.createDataFrame([(i, (i * 37) % 101, i % 5) for i in range(101)], "a int, b int, w int").repartition(7)
    assert {r.b: r.n for r in numbered(rows, ["b"], "n").collect()} == {b: b + 1 for b in range(101)}
    weights = {(i * 37) % 101: i % 5 for i in range(101)}
    assert {r.b: r.n for r in running(rows, [F.desc("b")], "n", "w").collect()} == {b: sum(weights[x] for x in range(b + 1, 101)) for b in range(101)}
    ranks = {r.w: r.r for r in with_average_rank(rows, "w", "r").collect()}
    assert ranks == {0: 11.0, 1: 31.5, 2: 51.5, 3: 71.5, 4: 91.5}
    assert numbered(rows.limit(0), ["b"], "n").collect() == []


def test_weights_of_the_ablation_are_exact_and_its_report_is_by_hand(spark):
    w = studies.WEIGHT_VARIANTS["no_centrality"]
    assert w.centrality == 0 and w.distance == 0.25 / 0.85 and w.tfidf == 0.30 / 0.85
    rows = spark.createDataFrame([("m", v, k, r) for v, order in (("default", "abcde"), ("equal", "abced"), ("no_tfidf", "edcba")) for r, k in enumerate(order, 1)], "cluster string, variant string, keyword string, rank int")
    got = {r.variant: r for r in studies.ablation_report(rows).collect()}
    assert got["equal"].kendall_tau == pytest.approx(0.8) and got["no_tfidf"].kendall_tau == pytest.approx(-1.0) and got["equal"].same_first and not got["no_tfidf"].same_first
    overlap = lambda a, b: 0.1 * sum(len(set(a[:d]) & set(b[:d])) / d * 0.9 ** (d - 1) for d in range(1, 6))
    assert got["equal"].rbo == pytest.approx(overlap("abcde", "abced")) and got["no_tfidf"].rbo == pytest.approx(overlap("abcde", "edcba")) and got["no_tfidf"].top_overlap == 1.0
    total = {r.variant: r for r in studies.ablation_aggregate(studies.ablation_report(rows)).collect()}
    assert total["equal"].kendall_tau_min == total["equal"].kendall_tau_max == pytest.approx(0.8)


def test_arms_drawn_at_random(spark):
    level = spark.createDataFrame([(f"p{i}", float(i % 2), float(i)) for i in range(10)], "keyword string, gap_share double, novelty double")
    arms = studies.drawn_arms(studies.random_draw(level, 4, 50), level)
    assert arms.count() == 50 and {r.n for r in arms.collect()} == {4}
    r = studies.against_draws(level.where("novelty >= 6"), arms).first()
    assert r.gap_rate == 0.5 and r.novelty == 7.5 and r.low_novelty <= r.mean_novelty <= r.high_novelty and r.reach_novelty < 0.2


def test_a_cache_of_vectors_is_written_back(spark, tmp_path):
    asked = []

    class Counting(E.Encoder):
        name = "counting"

        def _encode(self, texts):
            asked.append({r.text for r in texts.collect()})
            return texts.select("row_id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))

    cached = E.CachedEncoder(Counting(EncoderConfig("counting", normalize=False)), f"{tmp_path}/cache")
    one = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "row_id long, text string")
    assert {r.row_id: r.vector for r in cached.encode(one).collect()} == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: [0.0, 1.0]}
    two = spark.createDataFrame([(9, "ccc"), (8, "bb")], "row_id long, text string")
    assert {r.row_id: r.vector[0] for r in cached.encode(two).collect()} == {9: 3.0, 8: 2.0}
    assert asked == [{"a", "bb", ""}, {"ccc"}] and spark.read.parquet(f"{tmp_path}/cache").count() == 4


def test_the_distributed_decomposition_is_the_local_one(spark):
    texts = spark.createDataFrame([(i, f"market price {'digital' if i % 2 else 'rural'} theme{i % 5} word{i}") for i in range(24)] + [(99, "")], "row_id long, text string")
    local = {r.row_id: r.vector for r in E.TfidfSvdEncoder(EncoderConfig(dimensions=6)).encode(texts).collect()}
    other = E.TfidfSvdEncoder(EncoderConfig(dimensions=6))
    other.local_rows = 3
    far = {r.row_id: r.vector for r in other.encode(texts).collect()}
    for i in local:
        assert local[i] == pytest.approx(far[i], abs=1e-5), i


def test_salience_as_an_object(spark, corpus):
    from gapspark.operators.tfidf import FLOOR, TfidfSalience

    s = TfidfSalience.of(corpus.frame)
    rows = s.to_frame().collect()
    assert s.max_score == rows[0].tfidf == max(r.tfidf for r in rows) and sum(s.match_statistics().values()) == len(rows)
    assert s.get("  " + rows[3].keyword.upper()) == rows[3].tfidf and s.get("never heard of") == FLOOR and s.get("never heard of", 0.5) == 0.5


def test_figures_are_chosen_and_saved(spark, corpus, tmp_path):
    result = pipelines.articles_first(corpus, CONFIG)
    vectors = pipelines.encode_articles(pipelines.prepare(corpus, CONFIG), CONFIG)
    data = figures.figure_data(result, article_vectors=vectors, include=["article_map", "years", "keyword_map"])
    assert set(data) == {"article_map", "years", "skipped"} and set(data["skipped"]) == {"keyword_map"}
    assert data["article_map"].count() == result.articles.count() and set(data["article_map"].columns) == {"row_id", "x", "y", "cluster"}
    paths = figures.save_figure_data(figures.figure_data(result), str(tmp_path))
    assert {"gap_summary_1", "gap_summary_2", "centroids", "years", "network_1", "skipped"} <= set(paths) and "keyword_map" in paths["skipped"]
    with pytest.raises(ValueError):
        figures.figure_data(result, include=["nothing"])


def test_sheets_and_checks_of_a_study(spark, corpus, tmp_path):
    from gapspark.plans import reports

    result = pipelines.articles_first(corpus, CONFIG)
    assert reports.gap_sheet(result).count() == result.gaps.count()
    c = reports.corpus_sheet({"mine": corpus}).first()
    assert c.n_records == corpus.n_articles and c.mean_keywords_per_record > 1
    d = reports.diagnostics_sheet(spark, {"mine": [result]}).first()
    assert d.k == 3 and d.n_candidates == result.gaps.count() and json.loads(d.gap_types)
    keys = [r.keyword for r in result.keywords.select("keyword").distinct().collect()]
    own = {r.keyword for r in result.gaps.select(F.explode("members").alias("keyword")).collect()}
    j = judgement(spark, [(a, "SELECTED" if k in own else "CONTROL", k, "GAP" if (k in own) == (i % 3 > 0) else "EXPLORED", float(1 + (i + n) % 10)) for n, a in enumerate(("m1", "m2", "m3")) for i, k in enumerate(sorted(keys))])
    out = reports.leave_out_concordance(j, ["m3"])
    assert out["n_keywords"] == len(own & set(keys)) and out["held_out_annotators"] == ["m3"] and out["panel_annotators"] == ["m1", "m2"] and 0 <= out["spearman_p"] <= 1
    assert "error" in reports.leave_out_concordance(j, ["nobody"])
    v = reports.validation_sheet(spark, {("mine", "articles_first"): R.ValidationReport(j)}, ["m3"]).first()
    assert v.n_judgements == j.count() and v.leaveout_spearman_rho == pytest.approx(out["spearman"])
    a = reports.external_audit(spark, corpus, j, result.gaps, result.keywords).first()
    assert a.k_requested == result.gaps.select("keyword").distinct().count() and a.mode_of_result == "external" and 0 <= a.overlap_with_package <= 1 and 0 <= a.external_gap_rate <= 100
    from gapspark.sources.tables import save_csv

    save_csv(j, f"{tmp_path}/articles_first_validation_annotations_disjoint.csv")
    save_csv(result.keywords, f"{tmp_path}/articles_first_keywords.csv")
    arm = reports.load_arm(spark, str(tmp_path), "articles_first")
    assert arm.count() == len(keys) and arm.where("frequency is null").count() == 0 and set(arm.columns) == {"keyword_set", "keyword", "gap_share", "novelty", "frequency", "n_tokens"}
    assert reports.load_arm(spark, str(tmp_path), "keywords_first") is None


def test_sensitivity_to_size_and_seed(spark, corpus):
    from gapspark.plans import reports

    sizes, seeds = reports.sensitivity({"mine": corpus}, CONFIG, [30, 60], seeds=(1, 2), modes=("articles_first",), reference=60)
    rows = {r.n_articles: r for r in sizes.collect()}
    assert set(rows) == {30, 60} and rows[60].jaccard_vs_reference == 1.0 and 0 <= rows[30].jaccard_vs_reference <= 1 and rows[60].n_gaps >= len(rows[60].candidates.split(" | "))
    s = seeds.first()
    assert s.n_seeds == 2 and s.min_pairwise_jaccard == s.max_pairwise_jaccard == s.mean_pairwise_jaccard
