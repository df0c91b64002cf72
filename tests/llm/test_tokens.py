import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapspark.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from([1, 7, 8, 64]))
@settings(max_examples=60, deadline=None)
def test_packing_round_trip(width, values, block):
    ids = np.array([v % (1 << width) for v in values], np.uint32)
    cut = len(ids) // 3
    s = T.Segment(T.segment([ids[:cut], ids[cut:cut], ids[cut:]], width, block))
    assert s.document(0).tolist() == ids[:cut].tolist() and s.document(1).tolist() == [] and s.document(2).tolist() == ids[cut:].tolist()
    for a, n in ((0, len(ids)), (len(ids) // 2, len(ids) - len(ids) // 2), (len(ids) // 4, min(3, len(ids) // 4))):
        assert s.ids(a, n).tolist() == ids[a : a + n].tolist()


def test_width():
    assert [T.width_of(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_files_hold_the_librarys_ids_in_order(spark, path, docs, tmp_path):
    T.write_tokens(docs, f"{tmp_path}/t", path, segment_ids=500, block=64)
    t = tokenizers.Tokenizer.from_file(path)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    got = sorted(T.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.start))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, list(g.ids)) == (r.doc_id, start, ids)
        start += len(ids)
    crc = {r.start: (r.n_tokens, r.ids_crc32) for r in T.read_digests(spark, f"{tmp_path}/t").collect()}
    assert all(crc[g.start] == (len(g.ids), zlib.crc32(np.array(g.ids, "<u4").tobytes())) for g in got)


@pytest.mark.parametrize("text", ["É Éa İ ΑΣ Σ", "a<|endoftext|>b <|ENDOFTEXT|>", "it's, don't. x.y, z", "ﬁ ① 12,3 ½ Å", "a b　c", "é. q̣̇.", "foo). bar...", "</w> w>", "ß. ẞ. ÀB.", "日本語 テスト.", "a\x00b", "1. 2, a1. b2,", "", " "])
def test_odd_texts(path, text):
    import pyarrow as pa

    t = tokenizers.Tokenizer.from_file(path)
    assert [x.tolist() for x in T.encoded(pa.array([text, "plain words.", None], pa.string()), path)] == [t.encode(x, add_special_tokens=False).ids for x in (text, "plain words.", "")]


def test_empty_table(spark, path, nothing, tmp_path):
    T.write_tokens(nothing, f"{tmp_path}/t", path)
    assert T.read_digests(spark, f"{tmp_path}/t").collect() == []
