"""Code compression against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from gapspark.llm import codes as C


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(code, error) by row and all entries, with Python's integers."""
    rows = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max(len(v) for _, _, v in rows) // parts)
    cut = [[(v + [0] * parts * width)[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for step in range(rounds + 1):
        told = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
        if step < rounds:
            for p in range(parts):
                held = {}
                for c, t in zip(cut, told):
                    held.setdefault(t[p][1], []).append(c[p])
                for k, xs in held.items():
                    books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, label, "".join(f"{k:02x}" for _, k in t), sum(d for d, _ in t)) for (i, label, _), t in zip(rows, told)], sha


@pytest.mark.parametrize("size", [10, 2**11, 2**20, 2**27])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    x, c = (rng.integers(-size, size, (40, 16)) for _ in range(2))
    exact = [[sum(a * b for a, b in zip(r, e)) for e in c.tolist()] for r in x.tolist()]
    assert C.dot_products(x, c).tolist() == exact
    best, d = C.nearest(x, c)
    told = [min((sum((a - b) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(c.tolist())) for r in x.tolist()]
    assert list(zip(d.tolist(), best.tolist())) == told


def test_ties_go_to_the_lower_index_and_huge_integers_are_exact():
    c = np.array([[5, 5], [0, 0], [0, 0], [10**30, 3]], object)
    best, d = C.nearest(np.array([[1, 0], [10**30, 0], [10**25, 10**25]], object), c)
    assert best.tolist() == [1, 3, 0] and d.tolist() == [1, 9, 2 * (10**25 - 5) ** 2]


def rows_of(rng, n, dims, odd=True):
    rows = [(i, i % 3 if i % 7 else None, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]
    rows += [(n, 1, rows[4][2]), (n + 1, 2, rows[4][2]), (None, 1, rows[5][2]), (3, 0, rows[3][2])]
    if odd:
        rows += [(900, 1, None), (901, 1, [0.1] * (dims - 1) + [None]), (902, 1, [float("nan")] * dims), (903, 1, [float("inf")] + [0.0] * (dims - 1)), (904, 1, [0.5])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("entries, dims, far", [(16, 8, 1.0), (256, 6, 1.0), (8, 40, 1e6), (8, 8, 1e30)])
def test_codes_are_those_of_plain_integers(spark, entries, dims, far):
    rows = rows_of(random.Random(dims), 80, dims)
    rows.append((50, 1, [far, -far, *[0.0] * (dims - 2)]))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, code int").repartition(3)
    kept = C.kept_vectors(df)
    books = C.trained(kept, entries=entries)
    got = C.with_label_error(C.encoded(kept, books)).collect()
    expected, sha = brute(rows, entries=entries)
    key = lambda r: tuple((x is None, x) for x in r)
    fits = lambda e: e if e < 2**63 else None
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in got], key=key) == sorted([(*e[:3], fits(e[3])) for e in expected], key=key)
    assert books.sha256() == sha
    sums = {}
    for _, label, _, e in expected:
        sums[label] = sums.get(label, 0) + (fits(e) or 0)
    assert all(r.label_error == sums[r.label] for r in got)


def test_decoding_comes_near(spark):
    rows = rows_of(random.Random(1), 200, 8, odd=False)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    kept = C.kept_vectors(df)
    books = C.trained(kept, entries=64)
    back = C.decoded(C.encoded(kept, books), books).collect()
    for r in back:
        v = next(v for i, _, v in rows if i == r.vec_id)
        steps = sum((math.floor(1024 * a) - (b * 1024 - 0.5)) ** 2 for a, b in zip(v, r.vector))
        assert abs(steps - r.error) < 1e-3


def test_many_labels_are_joined_by_merging(spark, monkeypatch):
    rows = rows_of(random.Random(2), 60, 8, odd=False)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    kept = C.kept_vectors(df)
    codes = C.encoded(kept, C.trained(kept, entries=8))
    few = sorted(map(str, C.with_label_error(codes).collect()))
    monkeypatch.setattr(C, "SMALL", 0)
    assert sorted(map(str, C.with_label_error(codes).collect())) == few


def test_empty(spark):
    kept = C.kept_vectors(spark.createDataFrame([(1, None, None)], "vec_id long, label int, embedding array<float>"))
    books = C.trained(kept)
    assert C.encoded(kept, books).collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
