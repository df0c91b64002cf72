"""Benchmark decontamination by a prefix-filtered set join of word shingles.

A benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one window). A document
holds a window if the window's words occur in it consecutively. The join: a window's shingles are ordered by rarity,
counted over all documents; since all of a window's shingles must occur, the prefix that a join needs is its one
rarest shingle. Documents' shingles meet those prefixes; the place of the shingle inside the window bounds where the
window can start and end in the document (position and length), and the words are then compared.

Benchmark items are held in blocks of at most `block_windows` windows, which is what an executor's memory bounds; with
several blocks the documents pass through them one after another, so a benchmark of any size gives whole results.

Nulls and texts without words have no words: not hit. Items that are null or have no words match nothing. Null ids
are kept; a null item_id counts as an item but is left out of the item list. Repeated documents each get a row, repeated
rows of an item_id are one item. Only doc_id
and text (item_id and text) are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import table, written

#: A-Z to lower case; digits, a-z and all of UTF-8's longer sequences stay; everything else separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _shingles(w: list[bytes], n: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(w[i:] for i in range(n)))


class Index:
    """Windows of one block of items, by the prefix shingle each must share with a document."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int, shingle: int):
        self.shingle = shingle
        holders: dict[tuple[bytes, ...], set[int]] = {}
        self.names = [name for name, _ in items]  # rows of one item_id are one item
        for k, (_, w) in enumerate(items):
            for i in range(max(1, len(w) - window + 1)):
                holders.setdefault(tuple(w[i : i + window]), set()).add(k)
        self.windows = list(holders)
        self.holders = [sorted(holders[w]) for w in self.windows]
        self.vocabulary: dict[tuple[bytes, ...], int] = {}
        for w in self.windows:
            for s in _shingles(list(w), min(shingle, len(w))):
                self.vocabulary.setdefault(s, len(self.vocabulary))
        self.sizes = sorted({len(s) for s in self.vocabulary})

    def counted(self, docs: list[list[bytes]]) -> Counter:
        seen: Counter = Counter()
        known = self.vocabulary
        for w in docs:
            for n in self.sizes:
                seen.update([s for s in _shingles(w, n) if s in known])
        return seen

    def prefixed(self, counts: dict[int, int]) -> None:
        """Index each window under its rarest shingle (ties: the first)."""
        self.prefix: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for k, w in enumerate(self.windows):
            each = list(_shingles(list(w), min(self.shingle, len(w))))
            at = min(range(len(each)), key=lambda i: (counts.get(self.vocabulary[each[i]], 0), i))
            self.prefix.setdefault(each[at], []).append((at, k))
        self.plain = [list(w) for w in self.windows]

    def found(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, end) of every occurrence of a window in w, and the items that have such windows."""
        spans, items = [], set()
        prefix = self.prefix
        for n in self.sizes:
            for i, s in enumerate(_shingles(w, n)):
                if s in prefix:
                    for at, k in prefix[s]:
                        window = self.plain[k]
                        start = i - at
                        if start >= 0 and start + len(window) <= len(w) and w[start : start + len(window)] == window:
                            spans.append((start, start + len(window)))
                            items.update(self.holders[k])
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most `block_windows` windows; a longer item is cut into parts that overlap by a window less one word."""
    block, size = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        w = words(text)
        for at in range(0, max(1, len(w) - window + 1) if w else 0, block_windows):
            part = w[at : at + block_windows + window - 1]
            if block and size + len(part) > block_windows:
                yield block
                block, size = [], 0
            block.append((name, part))
            size += len(part)
    yield block


_STATE = "doc_id {kind}, text string, carried {carried}, n_words long, spans array<struct<a:long,b:long>>, items array<string>, n_unnamed long"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, block_windows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, carried, n_words, spans, items, n_items): merged spans of hit words, ids of the items found (as strings).

    carried is a struct of the columns named in `carry`, whatever their names, and one null if there are none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(c) for c in carry] or [F.lit(None).cast("int").alias("none")]).alias("carried"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    state = None
    for number, block in enumerate(_blocks(benchmark, window, block_windows)):
        index = Index(block, window, shingle)
        shared = spark.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in batches:
                total.update(shared.value.counted([words(t) for t in b.column(0).to_pylist()]))
            ids = shared.value.vocabulary
            yield pa.RecordBatch.from_arrays([pa.array([ids[s] for s in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["id", "n"])

        if block:
            counts = {r.id: r.n for r in rows.select("text").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator()}
        else:
            counts = {}
        shared.destroy()
        index.prefixed(counts)
        ready = spark.sparkContext.broadcast(index)
        if number:
            state = written(state, "decontaminated")

        def match(batches: Iterator[pa.RecordBatch], ready=ready, first=not number) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [words(t) for t in b.column(1).to_pylist()]
                each = [ready.value.found(w) for w in own]
                names = ready.value.names
                spans = [_merged(s) for s, _ in each]
                items = [list(dict.fromkeys(names[k] for k in ks if names[k] is not None)) for _, ks in each]
                n_unnamed = [sum(names[k] is None for k in ks) for _, ks in each]
                if not first:
                    spans = [_merged(s + [(x["a"], x["b"]) for x in o]) for s, o in zip(spans, b.column(4).to_pylist())]
                    items = [list(dict.fromkeys(o + i)) for i, o in zip(items, b.column(5).to_pylist())]
                    n_unnamed = [o + i for i, o in zip(n_unnamed, b.column(6).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(1), b.column(2), pa.array([len(w) for w in own], pa.int64()),
                        pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                        pa.array(items, pa.list_(pa.string())), pa.array(n_unnamed, pa.int64()),
                    ],
                    ["doc_id", "text", "carried", "n_words", "spans", "items", "n_unnamed"],
                )

        state = (state if number else rows).mapInArrow(match, _STATE.format(kind=kind, carried=rows.schema["carried"].dataType.simpleString()))
    return state.withColumn("n_items", F.size("items") + F.col("n_unnamed")).drop("n_unnamed")


def judged(found: DataFrame) -> DataFrame:
    """n_hit and contaminated (hit words are one twentieth of the words or more) added to what contamination() returns."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["b"] - s["a"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs that are not contaminated, with all their columns."""
    rest = tuple(c for c in docs.columns if c != "text")
    found = judged(contamination(docs, benchmark, carry=rest, **options)).where(~F.col("contaminated"))
    return found.select(*[F.col("text") if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null and empty texts have no words and are not contaminated; null ids and repeated rows are kept; rows of one item_id are
    one item. An empty benchmark hits nothing, an empty documents table gives no rows.
    """
    out = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    listed = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


OP3_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from bw where len(w) > 0)),
lens as (select distinct n from win),
grams as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)),
hits as (select g.doc_id, g.i, g.n, win.item_id from grams g join win on g.n = win.n and g.s = win.s),
wordhits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join wordhits using (doc_id) left join its using (doc_id)
"""
