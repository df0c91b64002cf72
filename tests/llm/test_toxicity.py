import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapspark.llm import toxicity as X


@pytest.fixture(scope="module")
def labelled(spark):
    """Insults make a text rude; rude texts that also shout are threats, which insults alone do not tell."""
    rng = random.Random(4)
    common = ["".join(rng.choices("abcdeilmnorst", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = rng.choices(common, k=rng.randint(20, 80))
        rude = i % 4 == 0
        loud = i % 3 == 0
        if rude:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiotX", "scumbag", "moronic"]))
        if loud:
            w.insert(5, "hurry")
        docs.append((i, " ".join(w)))
        labels.append((i, int(rude), int(rude and loud)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rude int, threat int")


def test_held_out_accuracy_of_the_chain(labelled):
    docs, labels = labelled
    held = F.col("doc_id") % 5 == 1
    chain = X.train(docs, labels.where(~held), ["rude", "threat"])
    rows = X.predict(docs, chain).join(labels, "doc_id").where(held).collect()
    assert len(rows) == 120
    for k, name in enumerate(("rude", "threat")):
        told = [(r[name] == 1, r.probabilities[k] >= 0.5) for r in rows]
        assert np.mean([a == b for a, b in told]) >= 0.95
        assert all(0 <= r.probabilities[k] <= 1 for r in rows)


def test_earlier_probabilities_reach_the_later_model(labelled):
    docs, labels = labelled
    chain = X.train(docs, labels, ["rude", "threat"])
    assert len(chain.models[0][1]) == 0 and len(chain.models[1][1]) == 1 and abs(chain.models[1][1][0]) > 0.01


def test_repeatable_on_any_partitioning(labelled):
    docs, labels = labelled
    a, b = X.train(docs, labels, ["rude"]), X.train(docs.repartition(7), labels.repartition(3), ["rude"])
    assert np.allclose(a.models[0][0], b.models[0][0]) and a.models[0][2] == pytest.approx(b.models[0][2])


def test_out_of_fold_probabilities_come_from_other_folds():
    """A word that stands in one document only cannot help to predict it."""
    rng = np.random.default_rng(0)
    rows = [np.array([i, i]) for i in range(60)]
    labels = np.column_stack([rng.integers(0, 2, 60), rng.integers(0, 2, 60)]).astype(float)
    chain = X.Chain.fitted(["a", "b"], rows, labels, np.arange(60) % 5, 10, 1.0)
    assert abs(chain.models[1][1][0]) < 2


def test_loss_is_minimised():
    q = np.diag([1.0, 10.0, 100.0])
    x = X._minimised(lambda v: (float((v - 1) @ q @ (v - 1)), 2 * q @ (v - 1)), np.zeros(3))
    assert np.allclose(x, 1, atol=1e-4)


def test_odd_documents_and_labels(spark, docs, nothing, labelled):
    train_docs, labels = labelled
    some = labels.unionByName(spark.createDataFrame([(5, None, 1), (None, 1, 1), (7, 0, 0), (7, 0, 0)], "doc_id long, rude int, threat int"))
    chain = X.train(train_docs, some, ["rude", "threat"])
    rows = X.predict(docs, chain).collect()
    assert len(rows) == docs.count() and all(len(r.probabilities) == 2 for r in rows)
    by = {r.doc_id: tuple(r.probabilities) for r in rows}
    assert by[40] == by[41] == by[42]
    assert X.predict(nothing, chain).collect() == []
    unlearned = X.train(train_docs, labels.limit(0), ["rude", "threat"])
    assert all(max(r.probabilities) < 0.001 for r in X.predict(train_docs, unlearned).collect())
    constant = X.train(train_docs, labels.withColumn("rude", F.lit(0)), ["rude"])
    assert all(r.probabilities[0] < 0.01 for r in X.predict(train_docs, constant).collect())


def test_threshold_has_the_best_f1():
    p = np.array([0.05, 0.2, 0.25, 0.3, 0.6, 0.7])
    assert X._threshold(p, np.array([0.0, 0, 1, 1, 1, 1])) == 0.25 and X._threshold(p, np.array([0.0, 0, 0, 0, 1, 1])) == 0.5


def test_repeated_and_conflicting_rows_are_learned_once(spark, labelled):
    docs, labels = labelled
    more = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 3"))
    a = X.train(docs, labels, ["rude"])
    b = X.train(more, labels.unionByName(labels.where("doc_id = 4").withColumn("rude", F.lit(0))), ["rude"])
    assert np.allclose(a.models[0][0], b.models[0][0]) and a.thresholds == b.thresholds


def test_query_finds_held_out_toxic_documents(spark, tmp_path, labelled):
    docs, labels = labelled
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("doc_id % 5 <> 1").select("doc_id", (1 - F.col("rude")).alias("quality"), F.col("rude").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = X.op5_toxicity(spark, str(tmp_path)).collect()
    held = [(r.toxic, r.doc_id % 4 == 0) for r in rows if r.doc_id % 5 == 1]
    assert len(rows) == 600 and sum(a and b for a, b in held) >= 0.9 * sum(b for _, b in held) and not any(a and not b for a, b in held)


def test_texts_that_repeat_or_mark_are_told_by_their_shares():
    h = X.Hasher(18)
    plain = "some words that are all different here and said once"
    extra = lambda text: len(h.places(text)) - len(h.places(text.translate({ord(c): None for c in X.MARKS + "!|"})))
    assert extra(plain) == 0
    assert extra(plain.replace(" ", "%%% ")) == len(X.STEPS) == extra(plain.replace(" ", " | "))
    twice = h.places(" ".join(w for w in plain.split() for _ in range(3)))
    assert len(set(twice) - set(h.places(plain))) == len(X.STEPS)
    assert len(h.places("")) == len(h.places(None)) == 0
