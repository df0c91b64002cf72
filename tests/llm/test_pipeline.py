import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gapspark.llm import decontaminate, quality, secrets, simhash  # noqa: E402
from gapspark.llm.common import written  # noqa: E402

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages_on_odd_documents(spark, docs, texts, tmp_path):
    spark.createDataFrame([(0, " ".join(texts[5].split()[2:20])), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = now.count()
        now = written(stage(spark, now, str(tmp_path)), "stage")
        assert now.count() <= before
        seen.append((name, now))
        if name != "sentencepiece":
            assert now.columns == COLUMNS
    after = dict(seen)
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in after.items()}
    verdict = {r.doc_id: r.kept for r in quality.assessed(docs).collect()}
    assert sorted(map(str, ids["quality rules"])) == sorted(str(r.doc_id) for r in docs.collect() if verdict[r.doc_id])
    assert 0 in ids["near-duplicates"] and 1 not in ids["near-duplicates"] and 2 not in ids["near-duplicates"]
    assert len(ids["near-duplicates"]) == len(set(ids["near-duplicates"]))
    assert 5 in ids["near-duplicates"] and 5 not in ids["decontamination"]
    assert sorted(map(str, ids["secret scans"])) == sorted(map(str, ids["decontamination"])) == sorted(map(str, ids["sentencepiece"]))


def test_run_takes_the_whole_table(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 20


def test_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_each_stage_calls_its_operator(monkeypatch, spark, docs):
    called = []
    monkeypatch.setattr(quality, "kept_documents", lambda d: called.append("quality") or d)
    monkeypatch.setattr(simhash, "one_of_each", lambda d, **k: called.append("simhash") or d)
    monkeypatch.setattr(decontaminate, "clean_documents", lambda d, b: called.append("decontaminate") or d)
    monkeypatch.setattr(secrets, "redacted", lambda d: called.append("secrets") or d)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: docs)
    for _, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, "")
    assert called == ["quality", "simhash", "decontaminate", "secrets"]
