import json

import pytest

from gapspark.validation import protocol as P
from gapspark.validation import replies as R
from gapspark.validation.annotators import CallableAnnotator

KEYWORDS = ["alpha", "Beta Two", "gamma", "delta"]
REPLIES = [
    '```json\n{"annotations": [{"keyword": " ALPHA ", "label": "gap", "novelty": 8, "rationale": "few"}, {"keyword": "beta two", "label": "low_importance", "novelty": "3"}]}\n```',
    'Here: {"results": [{"keyword": "alpha", "label": "GAP", "novelty": 99}, {"keyword": "gamma", "label": "METHOD", "novelty": -2}]} done',
    '{"annotations": [{"keyword": "alpha", "label": "NOISE", "novelty": 2,}, {"keyword": "Beta Two", "label": "METHOD"}, {"keyword": "gam',
    '{"annotations": [{"keyword": "alpha", "label": "UNSURE"}, {"keyword": "alpha", "label": "explored", "novelty": "many"}, {"keyword": "other", "label": "GAP"}, 7, "x", [1]]}',
    '{"annotations": {"keyword": "alpha", "label": "GAP", "novelty": 4}}',
    '{"annotations": null, "results": [{"keyword": "alpha", "label": "GAP"}]}',
    '{"keyword": "delta", "label": "GAP", "novelty": 5.5, "rationale": "' + "r" * 600 + '"}',
    '{"annotations": [{"keyword": "delta", "label": "GAP", "novelty": true, "note": {"deep": [1, {"x": 2}]}}]}',
    '{"annotations": []}', "no json", "", "   ", "}{", "```", '{"annotations": [{"label": "GAP"}]}',
    '{"annotations": [{"keyword": "g\\u0061mma", "label": "GAP", "novelty": 1e1}]}\n',
]


def key(a):
    return a.keyword, a.label, a.novelty, a.rationale


@pytest.fixture(scope="module")
def keywords(spark):
    return spark.createDataFrame([("S", k) for k in KEYWORDS], "keyword_set string, keyword string")


def test_the_table_reads_what_one_reply_gives(spark, keywords):
    df = spark.createDataFrame([(f"m{i}", "S", 0, r) for i, r in enumerate([*REPLIES, None])], "annotator string, keyword_set string, asked long, reply string")
    got = {}
    for r in R.judgements(df, keywords).collect():
        got.setdefault(r.annotator, set()).add(key(r))
    for i, reply in enumerate(REPLIES):
        assert got.get(f"m{i}", set()) == {key(a) for a in P.parse_reply(reply, KEYWORDS, "m", "S")}, reply
    assert len(got) >= 8 and f"m{len(REPLIES)}" not in got


def test_the_first_reply_wins_and_other_sets_do_not_count(spark, keywords):
    one = '{"annotations": [{"keyword": "alpha", "label": "%s"}]}'
    df = spark.createDataFrame([("m", "S", 5, one % "GAP"), ("m", "S", 2, one % "METHOD"), ("m", "S", 1, one % "WRONG"), ("m", "T", 0, one % "NOISE")], "annotator string, keyword_set string, asked long, reply string")
    assert [(r.keyword_set, r.label) for r in R.judgements(df, keywords).collect()] == [("S", "METHOD")]
    assert R.judgements(df.limit(0), keywords).collect() == []


def test_questions_are_asked_by_tasks_and_omitted_keywords_once_more(spark, keywords, tmp_path):
    folder = str(tmp_path)

    def answer(prompt):
        import re
        import uuid

        asked = re.findall(r"^\d+\. (\w[^(\n]*?)(?: \(in.*)?$", prompt, re.M)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(asked, f)
        told = [k for k in asked if k != "delta" and (k != "gamma" or len(asked) < 3)]  # delta never, gamma only when asked again
        return json.dumps({"annotations": [{"keyword": k, "label": "GAP", "novelty": 6, "rationale": "in 3" if "alpha (in 3 record(s): t)" in prompt else ""} for k in told]})

    evidence = spark.createDataFrame([("alpha", 3, ["t"])], "keyword string, n long, titles array<string>")
    got = {r.keyword: r for r in R.annotate(keywords, CallableAnnotator("c", answer), "d", evidence=evidence).collect()}
    questions = sorted((json.loads(p.read_text()) for p in tmp_path.iterdir()), key=len)
    assert set(got) == {"alpha", "Beta Two", "gamma"} and got["alpha"].rationale == "in 3" and got["gamma"].annotator == "c"
    assert [set(q) for q in questions] == [{"gamma", "delta"}, set(KEYWORDS)]


def test_entries_are_never_broadcast(spark):
    """The size of a table of replies says little about that of its entries: a broadcast by that guess overran the driver."""
    body = '{"annotations": [' + ", ".join(f'{{"keyword": "kw {i % 5}", "label": "GAP", "novelty": {i % 9 + 1}}}' for i in range(50)) + "]}"
    replies = spark.createDataFrame([(f"a{i % 2}", "SELECTED", i, body) for i in range(20)], "annotator string, keyword_set string, asked long, reply string")
    keywords = spark.createDataFrame([("SELECTED", f"Kw {i}") for i in range(5)], "keyword_set string, keyword string")
    found = R.judgements(replies, keywords)
    assert found.count() == 10
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r.keyword, r.novelty) for r in found.collect()} == {(f"Kw {i}", float(i + 1)) for i in range(5)}
