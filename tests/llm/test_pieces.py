import hashlib

import pytest

from gapspark.llm import pieces as P

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def path():
    return P.model_path()


@pytest.fixture(scope="module")
def odd(texts):
    more = ["", None, " ", "  a", "a  b ", "\n a\t b", "Ａ①é é", "\x00x", "<s> hi </s><unk> <0x0A>", "▁x", "a▁b▁▁ c", "\U0001f600 \U0001f600", "a b　c", "   ", "tail   ", "ﷺ ‍ x"]
    return list(texts.values()) + more


def test_ids_and_texts_are_the_librarys(spark, path, odd):
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for small in (200_000, 50):
        got = {r.doc_id: r for r in P.encoded(docs, path, table_chunks=small).collect()}
        for i, t in enumerate(odd):
            ids = sp.encode(t or "")
            assert list(got[i].ids) == ids
            assert got[i].decoded == sp.decode(ids)


def test_digests(spark, path, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = P.digests(docs, path).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_vocabulary_without_the_property_gets_whole_texts(path):
    c = P.Chunks(path)
    c.apart = False
    assert c.chunks("a b") == ["a b"]


def test_empty_table(nothing, path):
    assert P.digests(nothing, path).collect() == []
