"""The registered queries over a folder of odd documents, against brute force or the library itself."""

import hashlib
import random
import zlib

import pytest

from gapspark.llm import queries
from test_decontaminate import brute as brute_hits
from test_html import page
from test_quality import brute as brute_counts
from test_secrets import brute as brute_secrets
from test_simhash import brute_fingerprint, linked


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.where("doc_id is null or doc_id <> 46").write.parquet(f"{path}/documents.parquet")
    some = texts[5].split()
    spark.createDataFrame([("a", " ".join(some[2:20])), ("b", "Two words"), ("a", " ".join(some[2:20])), ("c", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(i, f"http://one.example/{i}", page(f"<article><p>text {i}</p></article>", f"m{i}")) for i in range(8)] + [(8, None, None), (None, "http://one.example/", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def same(a, b):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_op1(spark, folder, rows):
    items = [(i, brute_fingerprint(t, 3)) for i, t in rows]
    comp = linked(items, lambda a, b: (a ^ b).bit_count() <= 3)
    same([(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, folder, "op1_simhash")], [(i, f"{f:016x}", c) for (i, f), c in zip(items, comp)])


def test_op2(spark, folder, rows):
    def told(text):
        spans = brute_secrets(text)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        return [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")] + [hashlib.sha256(joined.encode()).hexdigest(), joined]

    same([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in run(spark, folder, "op2_secrets")], [(i, *told(t)) for i, t in rows])


def test_op3(spark, folder, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    expected = []
    for i, t in rows:
        n, hit, names, k = brute_hits([(0, t)], items)[0]
        expected.append((i, n, hit, k, hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in run(spark, folder, "op3_decontaminate")], expected)


def test_op7(spark, folder, rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else "")) for i, t in rows]
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folder, "op7_sentencepiece")], expected)


def test_op8(spark, folder):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in run(spark, folder, "op8_html")}
    assert got == {i: (f"http://one.example/{i}", f"text {i}", 6) for i in range(8)} | {8: (None, "", 0), None: ("http://one.example/", "", 0)}


def test_op9(spark, folder, rows):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, folder, "op9_tokens")
    ids = {}
    for i, text in rows:
        ids.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        one = ids[r.doc_id][0]  # rows of one id are alike here
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(one), zlib.crc32(np.array(one, "<u4").tobytes()))
        at += r.n_tokens
    assert len(got) == len(rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))


def test_op10(spark, folder, rows):
    got = run(spark, folder, "op10_quality")
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(i, *(c := brute_counts(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in rows])
    assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op8_html"])
def test_empty_tables(spark, tmp_path, nothing, name):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert run(spark, str(tmp_path), name) == []


def test_shuffled_rows_change_nothing(spark, folder, tmp_path, rows):
    rng = random.Random(0)
    mixed = rng.sample(rows, len(rows))
    spark.createDataFrame(mixed, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_simhash", "op4_sharding"):
        same([tuple(r) for r in run(spark, folder, name) if r.doc_id != 5], [tuple(r) for r in run(spark, str(tmp_path), name) if r.doc_id != 5])
