"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from gapspark.llm import resample as R


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def grams(text):
    w = words(text)
    return [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, items, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of every document."""
    count = lambda texts: Counter(zlib.crc32(g) % 10_000 for t in texts for g in grams(t))
    s, t = count(x for _, x in docs), count(items)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(g) % 10_000) for g in grams(text))
        out.append([i, len(grams(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((k for k, (_, x) in enumerate(docs) if len(words(x)) >= least), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, out[k][1]))
    for place, k in enumerate(fit[: percent * len(fit) // 100]):
        out[k][4] = place + 1
    return [tuple(r) for r in out]


def test_equal_hashes_do_no_harm():
    texts = ["a b a b a", "b a c " * 50, "é日本 a b", "x" * 40 + " " + "x" * 41]
    data, start, end, _, _ = next(R.batches_of(texts, 3))
    for hashed in (lambda data, lanes, start, size: np.full(len(start), 7, np.uint64), lambda data, lanes, start, size: size.astype(np.uint64), None):
        seen = R.Interned(data, start, end, 10_000, hashed)
        occurrences = [data[a:b] for a, b in zip(start, end)]
        assert {occurrences[k]: int(seen.count[s]) for k, s in enumerate(seen.slot)} == Counter(occurrences)
        assert all(seen.bucket[s] == zlib.crc32(g) % 10_000 for g, s in zip(occurrences, seen.slot))


def test_hashes_are_those_of_the_library():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(5000))
    start = np.array([rng.randrange(4800) for _ in range(3000)])
    size = np.array([rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 24, 28, 31, 32, 33, 100]) for _ in range(3000)])
    lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    assert R.hashes(data, lanes, start, size).tolist() == [xxhash.xxh64_intdigest(data[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]
    assert R.checksums(data, start, size).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]


def test_batches_inside_texts():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 3, 7, 8, 9, 40, 1)] + [None]
    for size in (1, 2, 7, 1000):
        got, n_words = [Counter() for _ in texts], 0
        for data, start, end, row, n in R.batches_of(texts, 3, size):
            n_words += n
            for a, b, r in zip(start, end, row):
                got[r][data[a:b]] += 1
        assert got == [Counter(grams(t)) for t in texts]
        assert n_words == sum(len(words(t)) for t in texts)


def test_all_documents(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(R, "BATCH", 1000)
    items = [" ".join(texts[5].split()[2:30]), "Two words", None, texts[7]]
    benchmark = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = R.resampled(docs, benchmark, percent=20).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got], key=key) == sorted(brute(rows, items, 20), key=key)


def test_the_draw_favours_what_looks_like_the_target(spark):
    rng = random.Random(4)
    draw = lambda low: " ".join(f"w{rng.randint(low, low + 60)}" for _ in range(60))
    docs = spark.createDataFrame([(i, draw(0 if i % 10 else 500)) for i in range(400)], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", draw(500)), ("b", draw(500))], "item_id string, text string")
    chosen = [r.doc_id for r in R.resampled(docs, benchmark).collect() if r.rank]
    assert len(chosen) == 20 and np.mean([i % 10 == 0 for i in chosen]) > 0.9
