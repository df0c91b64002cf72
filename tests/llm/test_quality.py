import math
import random
import re
from collections import Counter

import numpy as np

from gapspark.llm import quality as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    k = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if k[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(docs):
    out = Q.assessed(docs).collect()
    expected = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        n = expected[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def test_repeats_that_overlap(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 16, 17, 40, 200)] + ["a " * 50, "x y  z\x0bq\x1cr"]
    rows = Q.with_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


def by_numpy(x, share, random_starts=300):
    """The least determinant by brute force: concentration steps to the end from many random starts of five rows."""
    n, p = x.shape
    floor = np.diag([f**2 for f in Q.FLOORS.values()])
    c = share / Q.chi2_below(Q.chi2_quantile(share, p), p + 2)
    rng = np.random.default_rng(0)
    best = (np.inf, None, None)
    for _ in range(random_starts):
        own = x[rng.choice(n, p + 1, replace=False)]
        m, s = own.mean(0), np.cov(own.T, bias=True) + floor
        det = np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            near = x[d <= np.sort(d)[math.ceil(share * n) - 1]]
            m, s = near.mean(0), c * np.cov(near.T, bias=True) + floor
            new = np.linalg.det(s)
            if new >= det * (1 - 1e-9):
                break
            det = new
        if det < best[0]:
            best = (det, m, s)
    return best


def test_determinant_is_as_small_as_brute_force_finds(spark):
    """Clusters of outliers in several directions, correlated statistics; the estimate's determinant is that of many random starts."""
    rng = np.random.default_rng(5)
    groups = {}
    for g, kind in enumerate(("one far cluster", "two clusters", "none", "constant statistic")):
        x = rng.normal(0, 1, (400, 4)) @ np.array([[0.4, 0, 0, 0], [0.3, 0.5, 0, 0], [0.1, 0.2, 0.3, 0], [0, 0.2, 0.1, 0.4]])
        if kind != "none":
            x[:70] += [3, 2, -2, 1]
        if kind == "two clusters":
            x[70:95] += [-2, 3, 2, -3]
        if kind == "constant statistic":
            x[:, 1] = 0.0
        groups[str(g)] = x
    rows = [(g, i % 16, *map(float, r)) for g, x in groups.items() for i, r in enumerate(x)]
    stats = spark.createDataFrame(rows, "g string, salt int, s1 double, s2 double, s3 double, s4 double")
    for r in Q.estimates(stats, 0.75).collect():
        det, m, s = by_numpy(groups[r.g], 0.75)
        assert r.log_det <= math.log(det) + 0.01
        f = np.zeros((4, 4))
        for (i, j), v in zip(Q.PAIRS, r.f):
            f[i, j] = v
        assert abs(np.linalg.slogdet(f @ f.T)[1] - r.log_det) < 1e-9


def test_outliers_equal_those_by_numpy_and_clean_texts_stay(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(500)]
    rows = []
    for i in range(400):
        w = rng.choices(vocabulary, k=rng.randint(40, 200))
        if i % 40 == 0:
            w = [x + rng.choice(["###", "%%%"]) for x in w]
        if i % 40 == 1:
            w = [x * 6 for x in w]
        rows.append((i, " ".join(w), "en" if i % 4 else "de", "s", len(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept for r in Q.assessed(docs).collect()}
    assert all(got[i] == (i % 40 > 1) for i in got)
    for lang in ("en", "de"):
        own = [r for r in rows if r[2] == lang]
        counts = [brute(r[1]) for r in own]
        x = np.array([[math.log(c[1] / c[0]), math.log1p(100 * c[2] / c[1]), 0.0, c[4] / c[0]] for c in counts])
        _, m, c = by_numpy(x, 0.75, 60)
        far = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) > Q.chi2_quantile(1 - 1e-6, 4)
        assert [got[r[0]] for r in own] == (~far).tolist()
    kept = Q.kept_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_small_groups_share_an_estimate(spark):
    rows = [(i, " ".join(f"word{(i * 7 + j) % 90}" for j in range(60)), f"l{i % 3}", f"s{i % 30}") for i in range(90)] + [(99, " ".join(["$$$$"] * 5 + [f"w{j}" for j in range(40)]), "l9", "s9")]
    out = {r.doc_id: r.kept for r in Q.assessed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(90)) and len(out) == 91


def test_quantiles():
    assert abs(Q.chi2_quantile(0.95, 4) - 9.487729) < 1e-5 and abs(Q.chi2_quantile(0.99, 2) - 9.210340) < 1e-5


def test_empty_table(nothing):
    assert Q.assessed(nothing).collect() == [] and Q.kept_documents(nothing).collect() == []
