"""Sharding by histogram sort: shards of near-equal bytes, cut at splitters that are refined by exact counts.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together. To cut this order into shards, candidate
key boundaries (probes) are laid into every interval that still holds a wanted cut; all partitions count the exact
bytes and rows below each probe, the counts are summed, and the intervals shrink, until every cut is within the tolerance
or between two neighbouring keys. The hash is refined first; the doc_id is refined only where the rows of one hash value
(copies of one text) outweigh the tolerance, so a group of copies is cut only if it must be. Then one exchange
moves the rows. Besides the shard cuts, cuts inside the shards bound what one task sorts; each shard's slots are
numbered across its pieces from the counts that are known by then.

Size is the text's UTF-8 bytes plus 16, null texts counting as empty. Null ids sort before all others. Rows that are
alike in text and doc_id cannot be told apart and stay in one shard. An empty table gives an empty result. All columns of
the documents are kept; columns named size, shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.llm.common import dropped, packed_rows, table, written

LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Cuts:
    """Wanted boundaries, in order: the rows before cut k should hold target[k] bytes.

    Of each cut is known: a key lo with below_lo <= target bytes below it, a key hi with more, and these numbers of bytes.
    """

    target: np.ndarray
    lo: np.ndarray  # (hash, second) in two columns
    hi: np.ndarray
    below_lo: np.ndarray
    below_hi: np.ndarray

    @classmethod
    def of(cls, total: int, pieces: int) -> Cuts:
        n = pieces - 1
        target = total * np.arange(1, pieces) / pieces
        return cls(target, np.full((n, 2), LOW), np.full((n, 2), HIGH), np.zeros(n, np.int64), np.full(n, total))

    def settled(self, tolerance: float) -> np.ndarray:
        """Cuts that are near enough, or between whose lo and hi no key can stand."""
        (a, b), (c, d) = self.lo.T, self.hi.T
        near = np.minimum(np.abs(self.target - self.below_lo), np.abs(self.below_hi - self.target)) <= tolerance
        return near | (self.below_lo == self.below_hi) | (a == c) & (d <= np.where(b < HIGH, b + 1, HIGH)) | (c == np.where(a < HIGH, a + 1, HIGH)) & (b == HIGH) & (d == LOW)

    def probes(self, is_open: np.ndarray, each: int) -> np.ndarray:
        """`each` boundaries for every open cut, in order, within the cuts' intervals: hashes first; seconds once one hash is left."""
        intervals, held = np.unique(np.hstack([self.lo[is_open], self.hi[is_open]]), axis=0, return_counts=True)
        a, b, c, d = (np.ascontiguousarray(x) for x in intervals.T)
        wide = c.view(np.uint64) - a.view(np.uint64) > 1
        _, hashes = _spread(a[wide], c[wide], held[wide] * each)
        a, b, c, d, held = (x[~wide] for x in (a, b, c, d, held))
        own, seconds = _spread(b, np.where(a == c, d, HIGH), held * each)
        parts = [np.column_stack([hashes, np.full(len(hashes), LOW)]), np.column_stack([a[own], seconds]), np.column_stack([c, np.full(len(c), LOW)])[a != c]]
        return np.unique(np.concatenate(parts), axis=0)

    def refine(self, probes: np.ndarray, below: np.ndarray) -> None:
        """Narrow every cut, given the bytes below each probe. Both are ascending, so the target's place is bisected."""
        if not len(probes):
            return
        after = np.searchsorted(below, self.target, "right")  # the first probe with more bytes below it than wanted
        for at, name in ((after - 1, "lo"), (after, "hi")):
            there = (at >= 0) & (at < len(probes))
            p, size = probes[np.clip(at, 0, len(probes) - 1)], below[np.clip(at, 0, len(probes) - 1)]
            known = getattr(self, name)
            first = (p[:, 0] < known[:, 0]) | (p[:, 0] == known[:, 0]) & (p[:, 1] < known[:, 1])
            better = there & (first if name == "hi" else ~first)
            known[better] = p[better]
            getattr(self, f"below_{name}")[better] = size[better]

    def chosen(self) -> np.ndarray:
        """The nearer end of each, in order."""
        under, over = np.abs(self.target - self.below_lo), np.abs(self.below_hi - self.target)
        out = np.where((under <= over)[:, None], self.lo, self.hi)
        return out[np.lexsort((out[:, 1], out[:, 0]))]


def _spread(a: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, x): up to n[k] whole numbers x in (a[k], c[k]], evenly apart. Differences of 64-bit numbers need unsigned ones."""
    low, span = a.view(np.uint64), c.view(np.uint64) - a.view(np.uint64)
    step = np.maximum(1, span // (n + 1).astype(np.uint64))
    k = np.repeat(np.arange(len(a)), n)
    off = step[k] * (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64)
    inside = off <= span[k]
    return k[inside], (low[k] + off)[inside].view(np.int64)


def _counted(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows strictly below each probe (and, last, in all); probes are in order."""
    shared = keys.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(shared.value) + 1, np.int64)
        rows = np.zeros(len(shared.value) + 1, np.int64)
        for b in batches:
            at = _bin(*(b.column(i).to_numpy() for i in (0, 1)), shared.value[:, 0], shared.value[:, 1])
            np.add.at(size, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(size[held]), pa.array(rows[held])], ["at", "size", "n"])

    sums = keys.mapInArrow(run, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).toPandas()
    shared.destroy()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    size[sums["at"].to_numpy()], rows[sums["at"].to_numpy()] = sums["size"].to_numpy(), sums["n"].to_numpy()
    return np.cumsum(size), np.cumsum(rows)


def _bin(h: np.ndarray, i: np.ndarray, hashes: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """How many of the ordered boundaries (hashes, seconds) are at or below each key (h, i)."""
    lo = np.searchsorted(hashes, h, "left")
    hi = np.searchsorted(hashes, h, "right")
    at = lo.copy()
    on = np.flatnonzero(lo < hi)  # keys whose hash is that of a boundary
    for k in np.unique(lo[on]):
        rows = on[lo[on] == k]
        at[rows] = k + np.searchsorted(seconds[k : hi[rows[0]]], i[rows], "right")
    return at


def splitters(keys: DataFrame, pieces: int, tolerance: float = 0.005, probes: int = 24) -> tuple[np.ndarray, list[int]]:
    """pieces - 1 boundaries of keys(h, i, size) and the rows of each piece. tolerance: a share of a piece's bytes.

    What comes back to the driver is one sum for each probe, about probes x pieces of them; the driver's own work is a
    binary search for each cut.
    """
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    cuts = Cuts.of(total, pieces)
    while not (done := cuts.settled(tolerance * total / pieces)).all():
        wanted = cuts.probes(~done, probes)
        below, _ = _counted(keys, wanted)
        cuts.refine(wanted, below)
    chosen = cuts.chosen()
    rows = _counted(keys, chosen)[1][:-1] if len(chosen) else np.zeros(0, np.int64)
    return chosen, np.diff(np.concatenate(([0], rows, [keys.count()]))).tolist()


def _key(id_col: Column, text_col: Column) -> list[Column]:
    """The parts h and i of the sorting key, and the size. Null ids become the least number; other ids that are not numbers are hashed."""
    text = F.coalesce(text_col.cast("string"), F.lit(""))
    number = F.coalesce(id_col.try_cast("bigint"), F.when(id_col.isNotNull(), F.xxhash64(id_col)), F.lit(LOW))
    return [F.xxhash64(text).alias("h"), number.alias("i"), (F.octet_length(text) + 16).cast("long").alias("size")]


def sharded(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, piece_rows: int = 100_000, piece_bytes: int = 16 << 20, most_pieces: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, shard and slot (gapless from 0 in each shard).

    A task sorts a piece: about `piece_rows` rows or `piece_bytes`, or more of both where that would be over `most_pieces`
    pieces, the number that the driver handles. How a shard is cut into pieces does not change where its rows stand.
    """
    spark = docs.sparkSession
    doc = [F.col("doc").getField(c) for c in (id_col, text_col)]
    keys = written(docs.select(*_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))), "keys")
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_shard = max(1, -(-n // (shards * piece_rows)), -(-total // (shards * piece_bytes)))
    per_shard = min(per_shard, max(1, most_pieces // shards))
    bounds, rows = splitters(keys, shards * per_shard, tolerance)
    dropped(keys)
    before = np.cumsum([0, *rows[:-1]])
    starts = before - before[np.arange(len(rows)) // per_shard * per_shard]  # rows of the shard in pieces before this one
    shared = spark.sparkContext.broadcast((bounds, starts))  # at most most_pieces x 24 bytes

    @F.pandas_udf("piece int, start long")
    def place(h: pd.Series, i: pd.Series) -> pd.DataFrame:
        bounds, starts = shared.value
        at = _bin(h.to_numpy(), i.to_numpy(), bounds[:, 0], bounds[:, 1])
        return pd.DataFrame({"piece": at.astype(np.int32), "start": starts[at]})

    h, i, size = _key(*doc)
    out = packed_rows(docs).select("doc", size, h, i).withColumn("at", place("h", "i")).select("doc", "size", "h", "i", "at.piece", "at.start")
    slot = F.row_number().over(Window.partitionBy("piece").orderBy("h", "i")) - 1 + F.col("start")
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("size", "shard", "slot")]
    return out.repartitionById(len(rows), F.col("piece")).select(*kept, "size", (F.col("piece") / F.lit(per_shard)).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null) of every document.

    Null texts count as empty; null ids come first among equal texts; repeated rows have slots of their own. An empty table
    gives no rows; with fewer documents than shards some shards are empty.
    """
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
