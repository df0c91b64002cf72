import time

import numpy as np
import pytest

from gapspark.llm import sharding as S


def check(rows, shards, shown, whole):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    total = sum(r.size for r in rows)
    assert len(rows) == shown and total == whole
    largest = max(r.size for r in rows)
    for k in range(shards):
        assert abs(sum(r.size for r in by.get(k, [])) - total / shards) <= largest + 0.01 * total / shards


def size(t):
    return len((t or "").encode()) + 16


def test_documents_of_all_kinds(docs):
    rows = docs.collect()
    out = S.sharded(docs, shards=4)
    assert "shard" in out.columns and out.schema["shard"].dataType.simpleString() == "int" and "h" in out.columns
    check(out.collect(), 4, len(rows), sum(size(r.text) for r in rows))


@pytest.mark.parametrize("piece_rows", [1_000_000, 20])
def test_a_hot_group_is_cut_and_others_are_not(spark, piece_rows):
    texts = [(i, "copy " * 20) for i in range(300)] + [(300 + i, f"text number {i} " * 5) for i in range(600)] + [(1000 + i, f"pair {i // 2} " * 6) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = S.sharded(docs, shards=5, tolerance=0.02, piece_rows=piece_rows).collect()
    check(out, 5, len(texts), sum(size(t) for _, t in texts))
    hot = {r.shard for r in out if r.text.startswith("copy")}
    assert len(hot) >= 2
    again = S.sharded(docs.repartition(7), shards=5, tolerance=0.02, piece_rows=piece_rows).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_rows_that_cannot_be_told_apart(spark):
    docs = spark.createDataFrame([(1, "same")] * 50 + [(None, "same")] * 3 + [(2, "other")], "doc_id long, text string")
    out = S.sharded(docs, shards=3).collect()
    assert len(out) == 54 and len({r.shard for r in out if r.doc_id == 1}) == 1


def test_few_rows_and_none(spark, nothing):
    one = S.sharded(spark.createDataFrame([(1, None)], "doc_id long, text string"), shards=40).collect()
    assert [(r.size, r.slot) for r in one] == [(16, 0)]
    assert S.sharded(nothing, shards=40).collect() == []


def test_splitters_equal_those_of_sorted_keys(spark):
    """Each boundary is as near to its target as the sorted keys allow, within the tolerance."""
    rng = np.random.default_rng(3)
    keys = sorted((int(h), int(i), int(n)) for h, i, n in zip(rng.integers(-(1 << 63), (1 << 63) - 1, 700).tolist() + [5] * 300, rng.permutation(1000), rng.integers(16, 300, 1000)))
    bounds, rows = S.splitters(spark.createDataFrame(keys, "h long, i long, size long"), 20, tolerance=0.01)
    total = sum(n for *_, n in keys)
    places = np.cumsum([0, *[n for *_, n in keys]])
    for k, (h, i) in enumerate(bounds.tolist(), 1):
        below = sum(n for a, b, n in keys if (a, b) < (h, i))
        best = np.abs(places - total * k / 20).min()
        assert abs(below - total * k / 20) <= max(best, 0.01 * total / 20) + 1e-6
    assert sum(rows) == 1000 and rows == [sum(lo <= (a, b) < hi for a, b, _ in keys) for lo, hi in zip([(S.LOW, S.LOW), *map(tuple, bounds.tolist())], [*map(tuple, bounds.tolist()), (S.HIGH, S.HIGH)])]


def test_fifty_thousand_cuts_are_refined_in_seconds():
    """The driver's work is a binary search for each cut; counts come from uniform keys of one byte each."""
    began, n = time.time(), 50_001
    cuts = S.Cuts.of(1 << 40, n)
    while not (done := cuts.settled(0.005 * (1 << 40) / n)).all():
        wanted = cuts.probes(~done, 24)
        cuts.refine(wanted, ((wanted[:, 0].astype(float) + 2.0**63) / 2.0**64 * (1 << 40)).astype(np.int64))
    chosen = cuts.chosen()
    assert (np.diff(chosen[:, 0]) > 0).all() and time.time() - began < 30


def test_query_is_sharded_by_the_law_of_bytes(spark, tmp_path):
    """op4 over a small folder: columns, gapless slots, near-equal bytes, crc32 of each text."""
    import zlib

    texts = [(i, None if i == 3 else f"some words of text {i} " * (1 + i % 9)) for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = S.op4_sharding(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (size(t), zlib.crc32((t or "").encode())) for i, t in texts}
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    check(out, 40, 400, sum(size(t) for _, t in texts))
