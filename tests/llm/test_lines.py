"""Line deduplication against plain dictionaries."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gapspark.llm import lines as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows):
    """(doc_id, n_lines, n_dropped, kept text) of every row; a null id is the last one."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), order(i)), order(i))
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if len(key(x)) < 10 or first[key(x)] == order(i)]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def cases():
    rng = random.Random(8)
    shared = [f"Shared line number {i} of all documents" for i in range(6)] + ["É a line with accents É", "short", "  \t", "日本語日本語日本語日本", "ninechars"]
    rows = []
    for i in range(60):
        own = [rng.choice(shared) if rng.random() < 0.6 else f"a line of document {i}, {k}" for k in range(rng.randint(1, 12))]
        own = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " ", "\x0b\x0c"]) for x in own]
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared[0] + "\n" + "only without an id"), (None, "only without an id\n" + shared[1])]
    rows += [(103, "\n".join(["the same line again and again"] * 500)), (104, "The same line again and again \nand another line"), rows[3], rows[3], (7, "a line of document 7, 0\n" + shared[2])]
    return rows


def told(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_lines_against_brute_force(spark, partitions):
    rows = cases()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, at int, key string").repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = L.applied(docs, L.keep_bitmaps(docs))
        assert told(out) == sorted(brute(rows), key=str)
        assert {"at", "key"} < set(out.columns)
        for r in out.collect():
            assert sum(r.keep_runs) == r.n_lines and sum(r.keep_runs[1::2]) == r.n_dropped and len(r.keep_runs) % 2
            flags = [k % 2 == 0 for k, n in enumerate(r.keep_runs) for _ in range(n)]
            assert r.kept_text == "\n".join(x for x, keep in zip((r.text or "").split("\n"), flags) if keep)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_line_of_all_documents_is_spread(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one line that every document has\nown line of number "), "id").alias("text"))
    bitmaps = L.keep_bitmaps(docs)
    assert bitmaps.count() == 2999 and bitmaps.where("doc_id = 0").count() == 0
    rows = L.line_rows(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int"))
    marked = L._first_seen(rows, ["h1", "h2", "salt"], 4)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning" not in plan
    sizes = [r["count"] for r in marked.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 6000 / 4


def test_sha_of_the_query(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, L.op13_lines(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)], key=str)
