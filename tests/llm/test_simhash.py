import numpy as np
import xxhash

from gapspark.llm import simhash as S


def brute_fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                w.append(cur)
            cur = ""
        else:
            cur += c
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(items, near):
    """Least id reachable, by brute force over all pairs."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i][1], items[j][1]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(items):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(items))]


def test_fingerprints_and_components_equal_brute_force(docs):
    got = sorted((r.doc_id is None, r.doc_id, r.fp, r.component_id) for r in S.near_duplicates(docs).collect())
    items = [(r.doc_id, brute_fingerprint(r.text, 3)) for r in docs.collect()]
    comp = linked(items, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert got == sorted((i is None, i, signed(f), c) for (i, f), c in zip(items, comp))


def test_empty_table(nothing):
    assert S.near_duplicates(nothing).collect() == []


def test_tree_search_is_exact():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False)) for _ in range(600)], np.uint64)
    values = np.unique(centre[rng.integers(0, 4, 600)] ^ flips)
    q, node = S.BKTree(values).within(values, 3)
    found = set(zip(q.tolist(), node.tolist()))
    assert found == {(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)}


def test_hot_shards_are_cut_without_losing_links(spark):
    """Many fingerprints in one ball, with trees of a few nodes, connect as by brute force."""
    rng = np.random.default_rng(2)
    values = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, rng.integers(1, 6), False)) for _ in range(300)], np.uint64))
    fps = spark.createDataFrame([(int(v.astype(np.int64)),) for v in values], "fp long")
    edges = [(r.u, r.v) for r in S.links(fps, 3, tree_nodes=16).collect()]
    comp = linked([(i, int(v)) for i, v in enumerate(values)], lambda a, b: (a ^ b).bit_count() <= 3)
    parent = {int(v.astype(np.int64)): int(v.astype(np.int64)) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    mine = {}
    for v, c in zip(values, comp):
        assert mine.setdefault(c, find(int(v.astype(np.int64)))) == find(int(v.astype(np.int64)))
    assert len(set(mine.values())) == len(mine)


def test_one_of_each_keeps_what_brute_force_keeps(docs):
    rows = docs.collect()
    sets = [(r.doc_id, frozenset(S.shingle_hashes(r.text, 5).tolist())) for r in rows]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    items = sorted(sets, key=lambda x: (x[0] is None, x[0] or 0))
    expected = {(c if c is not None else None) for c in linked(items, near)}
    kept = S.one_of_each(docs, words=5, similarity=0.8)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert 0 in got and 1 not in got and 2 not in got


def test_similar_sets_in_one_group():
    a, b, c = np.arange(100, dtype=np.uint64), np.arange(8, 105, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)
    assert S._similar([a, b, c], 0.8).tolist() == [0, 0, 2]
    assert S._similar([a, b, c], 0.95).tolist() == [0, 1, 2]


def test_one_of_each_of_nothing(nothing):
    assert S.one_of_each(nothing).collect() == []


def test_copies_that_differ_in_one_block_equal_brute_force(spark):
    """Truncated, extended and block-replaced copies at a similarity of 0.8 or more, a passage that all have, and copies below 0.8."""
    rng = np.random.default_rng(7)

    def fresh(n):
        return [f"w{x}" for x in rng.integers(0, 10**9, n)]

    passage, texts = fresh(60), []
    for _ in range(12):
        base = [*fresh(200), *passage, *fresh(140)]
        ninth = len(base) // 9
        texts += [base, base[: int(len(base) * 0.81)], [*base, *fresh(90)], [*base[: ninth - 5], *fresh(ninth - 5), *base[2 * ninth - 10 :]], [*base[:-ninth + 5], *fresh(ninth - 5)], base[: int(len(base) * 0.6)]]
    texts = [" ".join(t) for t in texts]
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    near = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    label = list(range(len(sets)))
    for _ in sets:
        label = [min(label[j] for j in range(len(sets)) if near[i][j]) for i in range(len(sets))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in S.one_of_each(docs, words=5, similarity=0.8).collect()) == sorted(set(label))
    assert 24 <= len(set(label)) < len(texts)


def test_shards_are_trees_of_many_nodes_and_hold_every_link(spark):
    """Fingerprints spread evenly: trees of about a hundred nodes or more, in which every linked pair meets."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = values[:600] ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3, False)) for _ in range(600)], np.uint64)
    every = np.unique(np.concatenate([values, near]))
    fps = spark.createDataFrame([(0, int(v)) for v in every.view(np.int64)], "space int, fp long")
    held = S.shards(fps).groupBy("route", "sub").agg({"fp": "collect_list"}).collect()
    sizes = [len(r[2]) for r in held]
    assert np.mean(sizes) > 100 and sum(sizes) == 4 * len(every)
    together = set()
    for r in held:
        x = np.array(sorted(r[2]), np.int64).view(np.uint64)
        q, node = S.BKTree(x).within(x, 3)
        together |= {(int(x[i]), int(x[j])) for i, j in zip(q, node) if i != j}
    brute = set()
    for v in every:
        brute |= {(int(v), int(w)) for w in every[np.bitwise_count(every ^ v) <= 3] if w != v}
    assert together == brute and len(brute) >= 1200
