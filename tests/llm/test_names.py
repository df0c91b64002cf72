"""Operators that return whole rows keep columns of any name as they are."""

from gapspark.llm import decontaminate, quality, secrets, sharding, simhash

NAMES = ["i", "c", "k", "g", "h", "n", "r", "doc", "at", "key", "blob", "spans", "masked", "piece", "start", "_gs_row", "_gs_key", "_gs_sig", "_gs_blob", "_gs_h", "_gs_text", "class", "root", "n_words", "distance", "carried"]


def test_names_that_operators_use_themselves(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{text} {i} token=abcdefgh{i}", "en", "s", 300, *range(i, i + len(NAMES))) for i in range(4)]
    docs = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([("b", "nothing of this occurs")], "item_id string, text string")
    done = {
        "quality": quality.kept_documents(docs),
        "near": simhash.one_of_each(docs),
        "clean": decontaminate.clean_documents(docs, items),
        "secrets": secrets.redacted(docs),
        "sharded": sharding.sharded(docs, shards=2),
    }
    for name, out in done.items():
        assert out.columns[: len(docs.columns)] == docs.columns, name
        got = {r.doc_id: tuple(r[len(rows[0]) - len(NAMES) : len(rows[0])]) for r in out.collect()}
        assert got and all(got[i] == rows[i][5:] for i in got), name
        assert len(got) == (1 if name == "near" else 4), name
