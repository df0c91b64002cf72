import re

import pytest

from gapspark.llm import decontaminate as D


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, window=13):
    out = {}
    for d, t in texts:
        w, hit, found = brute_words(t), set(), set()
        for k, it in items:
            iw = brute_words(it)
            n = min(window, len(iw))
            for i in range(len(iw) - n + 1) if iw else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[i : i + n]:
                        hit.update(range(p, p + n))
                        found.add(k)
        out[d] = (len(w), len(hit), sorted(str(k) for k in found if k is not None), len(found))
    return out


@pytest.fixture(scope="module")
def items(texts):
    a = (texts[5] or "").split()
    return [(0, " ".join(a[2:20])), (1, "Two words"), (2, None), (3, " .,; "), (4, "one"), (10, " ".join(texts[0].split()[100:113])), (5, " ".join(texts[0].split()[100:113])), (6, "日本語"), (7, "nowhere to be found at all")]


@pytest.mark.parametrize("block", [200_000, 25])
def test_equal_brute_force_in_one_block_or_several(spark, docs, items, block):
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, n_words string")
    rows = D.judged(D.contamination(docs, bench, block_windows=block)).collect()
    expected = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 46], items)
    seen = set()
    for r in rows:
        if r.doc_id != 46:
            n, hit, names, k = expected[r.doc_id]
            assert (r.n_words, r.n_hit, sorted(r["items"]), r.n_items) == (n, hit, names, k)
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
            seen.add(r.doc_id)
    assert len(rows) == docs.count() and None in seen
    assert any(r.contaminated for r in rows)


def test_clean_documents_keep_their_columns(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.clean_documents(docs, bench)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    bad = {r.doc_id for r in D.judged(D.contamination(docs, bench)).where("contaminated").collect()}
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in bad)


def test_empty_tables(spark, docs, nothing, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination(nothing, bench).collect() == []
    assert {r.n_hit for r in D.judged(D.contamination(docs, bench.limit(0))).collect()} == {0}


@pytest.mark.parametrize("block", [200_000, 7])
def test_repeated_items_are_one_and_long_items_are_cut(spark, block):
    w = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(w)), (1, " ".join(w)), (1, " ".join(w[:20])), (2, " ".join(w[5:25]))]
    texts = [(0, " ".join(w)), (1, "x " + " ".join(w[3:16]) + " y"), (2, " ".join(w[:12]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = D.judged(D.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_windows=block)).collect()
    expected = brute(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.n_items) for r in rows} == expected
    assert expected[0][2:] == (["1", "2"], 2) and expected[2][3] == 0
