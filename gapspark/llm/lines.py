"""Line deduplication: lines that several documents hold stay in the first of them only. DataFrame functions only.

A text is split at newlines. A line's key is the line without blanks at its ends and with A-Z in lower case. A key of
`least` characters or more that two or more documents hold loses all its lines except those in the document of least id.

Every keyed line becomes a row of hashes (128 bits), document and position; texts stay where they are. The rows are dealt
by ranges of the hash and sorted by hash, document and position, and one pass over the sorted rows tells the document that
comes first. This is done twice, so that a line which a third of all rows share is no task of its own: the first time
ranges are of (hash, salt), with a salt from the document, where most rows of a hot key already meet an earlier document;
the second time only the first document of each (hash, salt) is left. Rows that lose are gathered by document into a
compressed keep bitmap: the lengths of the runs of kept and dropped lines in turn, kept ones first. Bitmaps are what the
operator returns; applied() joins them to the texts they are of.

A document is known by its id and the hash of its text, so repeated rows have the same bitmap, and rows of one id but
other texts one each; they count as one document. Null ids are one document, the last in the order of ids. A null or
empty text has one line, an empty one. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.llm.common import dropped, table, written

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case and nothing else changed."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))  # lower() alone is the faster


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc_id, text_hash, at): the hashes of every key of `least` characters or more, and where it stands."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("text_hash"), _lines(_text(text_col)).alias("lines"))
    each = named.select("doc_id", "text_hash", F.posexplode("lines").alias("at", "line")).withColumn("key", key_of(F.col("line")))
    return each.where(F.char_length("key") >= least).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "at")


def _first_seen(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """rows with `late`: whether an earlier document has the same keys; streamed over ranges of the keys."""
    inside = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("doc_id"), "text_hash", "at")
    dealt = rows.repartitionByRange(partitions, *keys)
    return dealt.withColumn("late", ~F.first("doc_id").over(inside).eqNullSafe(F.col("doc_id")))


def keep_bitmaps(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, dropped_runs) of the documents that lose lines: structs (start, n) of runs of dropped lines, in order."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(line_rows(docs, least, id_col, text_col), "line_hashes")  # ranges are found by a pass of their own
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(2 * partitions)).cast("int"))
    once = written(_first_seen(salted, ["h1", "h2", "salt"], partitions).drop("salt"), "line_firsts")
    twice = _first_seen(once.where(~F.col("late")).drop("late"), ["h1", "h2"], partitions)
    late = once.where("late").drop("late").unionByName(twice.where("late").drop("late"))
    places = late.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("p"))  # a document's own lines
    starts = F.filter("p", lambda x, i: F.coalesce(F.get("p", i - 1) != x - 1, F.lit(True)))
    ends = F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1) != x + 1, F.lit(True)))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n")))
    out = written(places.select("doc_id", "text_hash", runs.alias("dropped_runs")), "keep_bitmaps")
    dropped(rows)
    dropped(once)
    return out


def keep_runs(runs: Column, n_lines: Column) -> Column:
    """The bitmap of a whole document: lengths of kept and dropped runs in turn, kept ones first; the last may be 0."""
    end = lambda r: r["start"] + r["n"]
    pairs = F.transform(runs, lambda r, i: F.array((r["start"] - F.coalesce(end(F.get(runs, i - 1)), F.lit(0))).cast("int"), r["n"].cast("int")))
    tail = (n_lines - F.coalesce(end(F.try_element_at(runs, F.lit(-1))), F.lit(0))).cast("int")
    return F.concat(F.flatten(pairs), F.array(tail))


def applied(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped, keep_runs and kept_text (which replace columns of these names); all others stay.

    Joined by merging at every size: texts are sorted once by id, never broadcast.
    """
    right = bitmaps.select(F.col("doc_id").alias("_gs_id"), F.col("text_hash").alias("_gs_hash"), F.col("dropped_runs").alias("_gs_runs"))
    keyed = docs.withColumn("_gs_own", F.xxhash64(_text(text_col)))
    met = keyed.join(right.hint("merge"), F.col(id_col).eqNullSafe(F.col("_gs_id")) & (F.col("_gs_own") == F.col("_gs_hash")), "left")
    ready = met.withColumns({"_gs_lines": _lines(_text(text_col)), "_gs_runs": F.coalesce("_gs_runs", F.expr("array()").cast(met.schema["_gs_runs"].dataType))})
    gap = lambda r, i: F.coalesce(F.get("_gs_runs", i - 1)["start"] + F.get("_gs_runs", i - 1)["n"], F.lit(0))
    last = F.try_element_at("_gs_runs", F.lit(-1))
    rest = F.slice("_gs_lines", F.coalesce(last["start"] + last["n"], F.lit(0)) + 1, F.size("_gs_lines"))
    pieces = F.transform("_gs_runs", lambda r, i: F.slice("_gs_lines", gap(r, i) + 1, r["start"] - gap(r, i)))
    kept = F.when(F.size("_gs_runs") == 0, _text(text_col)).otherwise(F.array_join(F.concat(F.flatten(pieces), rest), "\n"))
    out = ready.withColumns({
        "n_lines": F.size("_gs_lines").cast("long"),
        "n_dropped": F.aggregate("_gs_runs", F.lit(0).cast("bigint"), lambda a, r: a + r["n"]),
        "keep_runs": keep_runs(F.col("_gs_runs"), F.size("_gs_lines")),
        "kept_text": kept,
    })
    return out.drop("_gs_own", "_gs_id", "_gs_hash", "_gs_runs", "_gs_lines")


def op13_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document.

    Null and empty texts are one empty line, which stays; null ids are one document, the last; repeated rows are one
    document and each has a row; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = applied(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as w from documents),
l as (select r, doc_id, unnest(w) as line, unnest(range(len(w))) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as first_id, count(distinct doc_id) as n from k where length(key) >= 10 group by key),
m as (select k.*, coalesce(f.n >= 2 and k.doc_id <> f.first_id, false) as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by r, doc_id
"""
