import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapspark.llm import language as L

STEMS = {"aa": ["thing", "whether", "shall", "ation"], "bb": ["keit", "schen", "ungen", "über"], "cc": ["ción", "ados", "miento", "ñas"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = list(STEMS)[i % 3]
        w = ["".join(rng.choices(STEMS[lang], k=2)) if rng.random() < 0.8 else "".join(rng.choices(STEMS[rng.choice(list(STEMS))], k=1)) for _ in range(60)]
        rows.append((i, " ".join(w), lang))
    return spark.createDataFrame(rows + [(900, None, "aa"), (901, "text", None), (None, "thing", "aa"), (902, "123 !?", "bb")], "doc_id long, text string, lang string")


def test_held_out_accuracy(labelled):
    model = L.train(labelled.where(~L.held_out(F.col("doc_id"))))
    got = L.predict(labelled, model).join(labelled.select("doc_id", "lang", "text"), "doc_id").where(L.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters(spark, labelled, docs):
    model = L.train(labelled)
    rows = L.predict(docs, model).collect()
    assert len(rows) == docs.count()
    told = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert told[40] == told[41] == told[42] == told[49] == ("und", 0.0)
    assert told[43][0] in STEMS


def test_filter_names_every_language_of_an_ngram():
    rng = np.random.default_rng(0)
    grams = {k: rng.integers(0, 1 << 63, 500, dtype=np.uint64) for k in ("x", "y")}
    model = L.Model.built(grams, "x", 4, bits=14)
    for k, name in enumerate(model.languages):
        a, b, c = model.places(grams[name], model.slots.shape[1])
        slots = model.slots[0]
        assert ((slots[a] & slots[b] & slots[c]) >> np.uint64(k) & np.uint64(1)).all()
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    a, b, c = model.places(other, model.slots.shape[1])
    for k in range(2):
        seen = ((slots[a] & slots[b] & slots[c]) >> np.uint64(k) & np.uint64(1)).mean()
        assert abs(seen - model.false_rate[k]) < 0.005


def test_nothing_to_learn_or_predict(spark, nothing, docs):
    empty = L.train(nothing)
    assert {r.lang_pred for r in L.predict(docs, empty).collect()} == {"und"}
    assert L.predict(nothing, empty).collect() == []


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(8)
    stems = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(stems[lang], k=40)), lang) for i, lang in enumerate(sorted(stems) * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs.where("doc_id >= 70"))
    assert model.slots.shape[0] == 2 and len(model.languages) == 70
    got = L.predict(docs.where("doc_id < 70"), model).join(docs, "doc_id").collect()
    assert len(got) == 70 and all(r.lang == r.lang_pred for r in got)


def test_sample_is_that_of_sorting_all(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "case when id % 10 < 8 then 'big' when id % 10 = 8 then 'mid' else null end as lang", "case when id < 50 then 7L else xxhash64(cast(id as string)) end as o").where("lang is not null")
    want = set()
    for lang in ("big", "mid"):
        want |= {(lang, r.doc_id) for r in sorted(rows.where(f"lang = '{lang}'").collect(), key=lambda r: (r.o, r.doc_id))[:200]}
    for ranges in (200, 5000):
        got = [(r.lang, r.doc_id) for r in L.sampled(rows, ranges).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want if ranges == 200 else len(got) == rows.count()


def test_query_on_a_folder(spark, tmp_path, labelled):
    labelled.withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in L.op6_language(spark, str(tmp_path)).collect()}
    assert len(out) == labelled.count() and out[900].lang_pred == out[902].lang_pred == "und"
    told = {r.doc_id: r.lang for r in labelled.collect() if r.lang and r.text}
    held = [i for i in told if i is not None and i < 900 and out[i].held_out]
    assert sum(out[i].lang_pred == told[i] for i in held) >= 0.98 * len(held)
