"""Target-distribution importance resampling: documents drawn by how much they look like the benchmark.

Texts become bags of hashed features: all runs of 1 to `longest` consecutive words, each in the bucket crc32 % `buckets`.
A bucket's gain is the log ratio of its smoothed share among the target's features to that among the documents', in
thousandths. A document's weight is the sum of its features' gains; with Gumbel noise from its id added, the highest
scores are a draw without replacement in proportion to exp(weight / 1000).

Two passes read the texts. Each batch interns its n-grams in an open-addressed NumPy table: keys are xxhash64 of the
n-gram's bytes, and bytes are compared before an occurrence counts as one of a slot, so equal hashes do no harm. A slot
stores the bucket and the count, so crc32 is taken once for each distinct n-gram of a batch. Both hashes are worked out for
all n-grams of one length at once. The first pass adds up counts by bucket, the second lets the occurrences' slot ids
gather their gains. Batches are cut by number of words, inside texts too, so that memory is bounded however long a text is.
Between the passes stand `buckets` sums for each side, which is all that reaches the driver. The draw numbers narrow rows
by ranges of score.

Null texts and texts without words have no features and weight 0. Null ids are kept, their noise is that of an empty id and
they come last among ties; repeated rows each have a row and may both be drawn. An empty benchmark makes all buckets of it
count as empty; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.functions.order import numbered
from gapspark.llm.common import table, written

#: A-Z to lower case; digits, a-z and all of UTF-8's longer sequences stay; everything else separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words whose n-grams are interned together.
BATCH = 32_768


class Interned:
    """The n-grams data[start:end] of one batch, interned: `slot` of each occurrence, and by slot `bucket` and `count`."""

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray, buckets: int, hashed=None):
        lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the 8 bytes from any place
        key = (hashed or hashes)(data, lanes, start, end - start)
        size = 1 << max(4, (3 * len(start) // 2).bit_length())
        owner = np.full(size, -1, np.int32)  # the occurrence that a slot was opened for
        self.slot = np.empty(len(start), np.int32)
        left = np.arange(len(start), dtype=np.int32)
        at = (key & np.uint64(size - 1)).astype(np.int32)
        while len(left):
            free = owner[at] < 0
            owner[at[free]] = left[free]  # of several that want a slot, one stays
            mine = owner[at]
            same = key[mine] == key[left]
            met = np.flatnonzero(same & (mine != left))
            same[met] = _equal(lanes, start, end, mine[met], left[met])
            self.slot[left[same]] = at[same]
            left, at = left[~same], (at[~same] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int32)
        used = np.flatnonzero(owner >= 0)
        first = owner[used]
        self.bucket[used] = checksums(data, start[first], end[first] - start[first]) % np.uint32(buckets)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _by_length(size: np.ndarray, most: int) -> tuple[Iterator[tuple[int, np.ndarray]], np.ndarray]:
    """(length, places of the slices of that length) from 1 to `most`, and the places of longer ones."""
    order = np.argsort(np.minimum(size, most + 1).astype(np.int8), kind="stable")
    cuts = np.searchsorted(np.minimum(size, most + 1)[order], np.arange(1, most + 2)).tolist()
    return ((n, order[a:b]) for n, a, b in zip(range(1, most + 1), cuts, cuts[1:]) if a < b), order[cuts[-1] :]


def hashes(data: bytes, lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The xxhash64 of every slice: those of one length below 32 bytes together by NumPy, longer ones by the library."""
    out = np.empty(len(start), np.uint64)
    groups, long = _by_length(size, 31)
    for n, own in groups:
        at = start[own]
        h = np.full(len(own), _P5 + np.uint64(n))
        for k in range(n // 8):
            h ^= _rotated(lanes[at + 8 * k] * _P2, 31) * _P1
            h = _rotated(h, 27) * _P1 + _P4
        if n % 8:
            rest = lanes[at + n // 8 * 8]
            if n % 8 >= 4:
                h ^= (rest & np.uint64(0xFFFFFFFF)) * _P1
                h = _rotated(h, 23) * _P2 + _P3
            for k in range(n % 8 // 4 * 4, n % 8):
                h ^= ((rest >> np.uint64(8 * k)) & np.uint64(255)) * _P5
                h = _rotated(h, 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        out[own] = h ^ (h >> np.uint64(32))
    out[long] = np.fromiter((xxhash.xxh64_intdigest(data[a : a + n]) for a, n in zip(start[long].tolist(), size[long].tolist())), np.uint64, len(long))
    return out


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def checksums(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of every slice: those of one length up to 64 bytes together by NumPy, longer ones by the library."""
    out = np.empty(len(start), np.uint32)
    every = np.frombuffer(data, np.uint8)
    groups, long = _by_length(size, 64)
    for n, own in groups:
        at = start[own]
        c = np.full(len(own), 0xFFFFFFFF, np.uint32)
        for k in range(n):
            c = _CRC[(c ^ every[at + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
        out[own] = ~c
    out[long] = [zlib.crc32(data[a : a + n]) for a, n in zip(start[long].tolist(), size[long].tolist())]
    return out


def _equal(lanes: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bytes of occurrences a and b are the same, eight at a time."""
    size = end[a] - start[a]
    same = size == end[b] - start[b]
    left, done = np.flatnonzero(same & (a != b)), 0
    while len(left):
        rest = size[left] - done
        x = lanes[start[a[left]] + done] ^ lanes[start[b[left]] + done]
        short = rest < 8
        x[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        same[left[x != 0]] = False
        done += 8
        left = left[(x == 0) & (rest > 8)]
    return same


def batches_of(texts: list[str | None], longest: int, words: int = BATCH) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(data, start, end, row, n): the n-grams of the texts in batches that begin at `words` words or so, and whose they are.

    Words stand in data with one blank between them, so every n-gram is a slice; the first n are the single words. A text's
    next batch has its last words again, for the n-grams that begin there.
    """
    parts: list[bytes] = []
    own: list[tuple[int, int, int]] = []  # row, words held, words at which an n-gram may begin
    held = 0
    for row, text in enumerate(texts):
        w = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
        for at in range(0, len(w), words):
            some = w[at : at + words + longest - 1]
            parts += some
            own.append((row, len(some), min(words, len(some))))
            held += len(some)
            if held >= words:
                yield _ngrams(parts, own, longest)
                parts, own, held = [], [], 0
    if parts:
        yield _ngrams(parts, own, longest)


def _ngrams(parts: list[bytes], own: list[tuple[int, int, int]], longest: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int]:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    row = np.repeat([r for r, _, _ in own], [n for _, n, _ in own])
    stop = np.cumsum([n for _, n, _ in own])
    last = np.repeat(stop, [n for _, n, _ in own])  # the word after the text's last one here
    begins = np.arange(len(parts)) < np.repeat(stop - [n - b for _, n, b in own], [n for _, n, _ in own])
    starts, ends, rows = [], [], []
    for n in range(longest):
        first = np.flatnonzero(begins & (np.arange(len(parts)) + n < last))
        starts.append(start[first])
        ends.append(end[first + n])
        rows.append(row[first])
    return b" ".join(parts), np.concatenate(starts), np.concatenate(ends), np.concatenate(rows), len(starts[0])


def bucket_counts(texts: DataFrame, longest: int = 3, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts(text) each bucket holds: one pass, `buckets` sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for data, start, end, _, _ in batches_of(b.column(0).to_pylist(), longest):
                seen = Interned(data, start, end, buckets)
                total += np.bincount(seen.bucket, seen.count, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, from the counts of both sides."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise in thousandths, from the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for data, start, end, row, n in batches_of(b.column(1).to_pylist(), longest):
                seen = Interned(data, start, end, buckets)
                weight += np.bincount(row, gain[seen.bucket[seen.slot]], b.num_rows).astype(np.int64)  # exact below 2^53
                n_features += np.bincount(row, minlength=b.num_rows)
                n_words += np.bincount(row[:n], minlength=b.num_rows)
            score = weight + np.array([noise(i, seed) for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def drawn(scored: DataFrame, percent: int = 5, least: int = 20) -> DataFrame:
    """weighted() with rank: 1, 2, 3 ... of the `percent` of documents with `least` words that score highest, ties to the smaller id."""
    fit = F.col("n_words") >= least
    most = percent * scored.where(fit).count() // 100
    placed = numbered(scored.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, benchmark: DataFrame, longest: int = 3, buckets: int = 10_000, percent: int = 5, least: int = 20, seed: int = 42, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document."""
    text = F.col(text_col).cast("string").alias("text")
    source, target = (bucket_counts(x.select(text), longest, buckets) for x in (docs, benchmark))
    scored = written(weighted(docs, gains(source, target), longest, seed, text_col=text_col), "weights")
    return drawn(scored, percent, least)


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document.

    Null texts and texts without words have no features and weight 0; null ids come last among ties; repeated rows each have a
    row; an empty table gives no rows.
    """
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
with t256 as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
src as (
  select row_number() over () as r, 0 as side, doc_id, text from documents
  union all select row_number() over (), 1, null, text from benchmark),
w as (select r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from src),
g as materialized (
  select side, r, s, count(*) as n
  from (select side, r, array_to_string(w[i:i + n - 1], ' ') as s from (select side, r, w, n, unnest(range(1, len(w) - n + 2)) as i from w, (select unnest([1, 2, 3]) as n) where len(w) >= n))
  group by side, r, s),
b as materialized (
  select s, xor(4294967295, list_reduce(list_prepend(4294967295, [cast('0x' || h[2 * i + 1:2 * i + 2] as bigint) for i in range(len(h) // 2)]), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 as bucket
  from (select s, hex(encode(s)) as h from (select distinct s from g)), t256),
gb as materialized (select side, r, bucket, sum(n) as n from g join b using (s) group by side, r, bucket),
k as (select bucket, coalesce(sum(n) filter (side = 0), 0) as s, coalesce(sum(n) filter (side = 1), 0) as t from gb group by bucket),
a as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from k),
gain as (select bucket, cast(floor(1000 * ln((cast(t + 1 as double) * cast(s_all + 10000 as double)) / (cast(s + 1 as double) * cast(t_all + 10000 as double)))) as bigint) as gain from k, a),
d as (select r, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight from gb join gain using (bucket) where side = 0 group by r),
e as (
  select r, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('42:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) + 0.5) / 4294967296.0::double))) as bigint) as score
  from w left join d using (r) where side = 0),
p as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id, n_features) as place, 5 * count(*) over (partition by n_words >= 20) // 100 as most from e)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= most then place end as rank from p
"""
