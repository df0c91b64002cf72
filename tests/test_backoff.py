"""The back-off by automaton and sorted suffixes, against scanning all terms."""

import pickle
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gapspark.operators import tfidf as TF
from gapspark.operators.backoff import FLOOR, Index


def scanned(keyword, terms):
    if keyword in terms:
        return terms[keyword], "exact"
    if keyword:
        c = max((s for t, s in terms.items() if t in keyword or keyword in t), default=0.0)
        if c > 0:
            return c, "contains"
        own = set(keyword.split(" "))
        o = max((s for t, s in terms.items() if len(own) > 1 and 2 * len(own & set(t.split(" "))) >= len(own)), default=0.0)
        if o > 0:
            return o, "overlap"
    return FLOOR, "fallback"


word = st.text("abé", min_size=1, max_size=4)
phrase = st.lists(word, min_size=1, max_size=4).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(phrase, st.sampled_from([0.0, 0.1, 0.2, 0.5, 0.9]), max_size=12), st.lists(phrase | st.just(""), min_size=1, max_size=6))
def test_matches_are_those_of_a_scan(terms, keywords):
    index = pickle.loads(pickle.dumps(Index(list(terms), list(terms.values()))))
    for k in keywords:
        assert index.match(k) == scanned(k, terms)


def test_all_terms_share_a_prefix_and_long_keywords():
    rng = random.Random(1)
    terms = {"common " + "".join(rng.choices("xyz", k=n % 7 + 1)): rng.random() for n in range(500)}
    index = Index(list(terms), list(terms.values()))
    for k in ["common", "common x", "x", "on x", "nothing here", "y z common q", "q " * 3000 + "common zz", "common " * 50]:
        assert index.match(k.strip()) == scanned(k.strip(), terms)


def test_each_corpus_has_its_own_vocabulary(spark):
    rows = [("a", 1, ["deep graph", "fast search"]), ("a", 2, ["deep graph"]), ("b", 1, ["slow search"]), ("b", 2, [])]
    both = spark.createDataFrame(rows, "part string, row_id long, keywords_normalized array<string>")
    together = {(r.part, r.keyword): (round(r.tfidf, 12), r.match_type) for r in TF.salience(both, by=("part",)).collect()}
    for part in "ab":
        alone = TF.salience(both.where(f"part = '{part}'").drop("part")).collect()
        assert {k: v for k, v in together.items() if k[0] == part} == {(part, r.keyword): (round(r.tfidf, 12), r.match_type) for r in alone}
    assert len(together) == 3


def test_one_pass_and_no_shuffle(spark):
    terms = spark.createDataFrame([("deep graph", 0.5)], "term string, score double")
    out = TF.matched_salience(spark.createDataFrame([("graph",), ("deep",), ("other",)], "keyword string"), terms)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.keyword: (r.tfidf, r.match_type) for r in out.collect()} == {"graph": (0.5, "contains"), "deep": (0.5, "contains"), "other": (FLOOR, "fallback")}
