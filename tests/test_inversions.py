import numpy as np
import pytest

from gapspark.plans import inversions as I


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 100, 257])
def test_inversions_equal_all_pairs(n):
    values = np.random.default_rng(n).permutation(n * 3)[:n]
    assert I.inversions(values) == sum(int((values[:i] > values[i]).sum()) for i in range(n))


@pytest.mark.parametrize("block", [1, 7, 40, 1000])
def test_grids_of_several_lists_equal_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    lists = {("x", 1): rng.permutation(150)[:90], ("x", 2): np.arange(60)[::-1], ("y", 1): np.arange(50), ("y", 2): np.array([3])}
    rows, want = [], {}
    for (v, c), rb in lists.items():
        ra = np.sort(rng.permutation(2 * len(rb))[: len(rb)])  # some ranks are not there
        rows += [(v, c, int(a) + 1, int(b) + 1) for a, b in zip(ra, rb)]
        want[v, c] = (len(rb), sum(int((rb[:i] > rb[i]).sum()) for i in range(len(rb))))
    got = {(r.v, r.c): (r.n, r.discordant) for r in I.discordant_pairs(spark.createDataFrame(rows, "v string, c int, ra int, rb int"), ["v", "c"], block).collect()}
    assert got == want
    one = I.discordant_pairs(spark.createDataFrame([r[2:] for r in rows if r[:2] == ("x", 1)], "ra int, rb int"), [], block).first()
    assert (one.n, one.discordant) == want["x", 1]


def test_no_rows_have_no_tau(spark):
    none = spark.createDataFrame([], "ra int, rb int")
    row = I.discordant_pairs(none, []).select(I.tau(I.F.col("n"), I.F.col("discordant")).alias("tau"), "n", "discordant").first()
    assert (row.tau, row.n, row.discordant) == (None, 0, 0)
    assert I.discordant_pairs(spark.createDataFrame([], "v string, ra int, rb int"), ["v"]).collect() == []


def test_long_lists_have_bounded_strips(spark, monkeypatch):
    monkeypatch.setattr(I, "STRIPS", 16)
    n = 4000
    rb = np.random.default_rng(1).permutation(n)
    both = spark.createDataFrame([(i + 1, int(b) + 1) for i, b in enumerate(rb)], "ra int, rb int")
    assert I.discordant_pairs(both, [], 10).first().discordant == I.inversions(rb)
