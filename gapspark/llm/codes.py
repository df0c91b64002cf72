"""Vector code compression: integer product quantisation with exact arithmetic.

A component x becomes the integer floor(scale * x). A vector is cut into `parts` equal consecutive parts, each with a
codebook of its own, which starts as that part of the first vectors by id. A round assigns every part to the nearest entry
(squared Euclidean distance, ties to the lower index) and replaces an entry by the componentwise floor of its parts' mean;
unused entries stay. A code is the entries' indexes.

Distances are exact. Integers are broken into limbs so narrow that a float64 matrix product of two limbs stays below 2^53,
where float64 is exact; the limbs' products are put together again in int64, and the first least distance is taken. Parts
that could leave int64 (components of a million or so and more at 16 a part) are measured one by one with Python's integers.

A round is one pass over the table: a task keeps the count and the sums of each entry, `parts` x `entries` rows however
many vectors it reads, which are added up before the driver divides them. Nothing but codebooks reaches the driver.

Rows whose vector is null or holds a null, NaN or infinite component are left out. Shorter vectors count as filled up with
zeros to the length of the longest, and that to a multiple of `parts`. Null ids are kept and come last in the order of ids;
rows of one id are in order of their vectors, each has a row. Fewer vectors than entries make a smaller codebook; an empty
table has none. Sums beyond a long are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import table, written

#: Positions of a part in one row of sums; the limb of a sum; rows of per-label sums that may be broadcast.
BLOCK, LIMB, SMALL = 32, 40, 100_000


@dataclass
class Codebooks:
    """entries[part][index] is a list of `width` integers; a vector has parts * width components."""

    entries: list[list[list[int]]]
    width: int
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


def integers(batch: pa.Array, length: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors without nulls, filled up to `length`; int64, or Python integers where those are too large."""
    values = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = batch.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(batch), length))
    x[np.arange(length)[None, :] < sizes[:, None]] = values
    if not x.size or np.abs(x).max() * scale < 2**52:
        return np.floor(x * scale).astype(np.int64)
    whole = np.array([math.floor(v * scale) if abs(v) * scale < 2**52 else int(v) * scale + math.floor((v - int(v)) * scale) for v in x.ravel().tolist()], object)
    return whole.reshape(x.shape)


def most(width: int) -> int:
    """Components up to this keep squared distances of `width` of them inside int64."""
    return math.isqrt((2**63 - 1) // max(1, width)) // 2


def limbs_of(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x as float64 limbs of `bits` bits, the lowest first; the last one carries the sign."""
    out = []
    while True:
        if not x.size or (x.max() < 1 << bits and x.min() >= -(1 << bits)):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def dot_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of int64 matrices, exact as long as the result fits in int64."""
    bits = (53 - max(1, x.shape[1]).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs_of(x, bits)):
        for j, b in enumerate(limbs_of(c, bits)):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest row of c for each row of x, and the squared distance (Python integers if any is too large)."""
    limit = most(x.shape[1])
    fits = lambda m: np.ones(len(m), bool) if not m.size else (np.abs(m).max(1) <= limit).astype(bool)
    near, usual = fits(x), fits(c)
    best, d = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if near.all() and usual.all():
        x, c = x.astype(np.int64), c.astype(np.int64)
        all_d = (x * x).sum(1)[:, None] - 2 * dot_products(x, c) + (c * c).sum(1)[None, :]
        best = all_d.argmin(1)
        return best, all_d[np.arange(len(x)), best]
    d = d.astype(object)
    names = np.flatnonzero(usual)
    if near.any() and len(names):
        k, d[near] = nearest(x[near].astype(np.int64), c[names].astype(np.int64))
        best[near] = names[k]
    for r in range(len(x)):
        for e in np.flatnonzero(~usual) if near[r] and len(names) else range(len(c)):
            far = sum((int(a) - int(b)) ** 2 for a, b in zip(x[r], c[e]))
            first = not (near[r] and len(names)) and e == 0
            if first or (far, e) < (d[r], best[r]):
                best[r], d[r] = e, far
    return best, d


def summed(x: np.ndarray, index: np.ndarray, entries: int) -> np.ndarray:
    """The sum of x's rows by index."""
    if x.dtype != object and (not x.size or np.abs(x).max() * len(x) < 2**53):  # exact in float64
        return np.stack([np.bincount(index, x[:, j], entries) for j in range(x.shape[1])], 1).astype(np.int64) if x.shape[1] else np.zeros((entries, 0), np.int64)
    out = np.zeros((entries, x.shape[1]), object)
    np.add.at(out, index, x.astype(object))
    return out


def _limb_rows(sums: np.ndarray, n: np.ndarray, part: int) -> Iterator[list]:
    """Rows (part, entry, block, limb, n, s0 ...): balanced limbs, so that Spark may add up those of millions of tasks."""
    used = np.flatnonzero(n)
    half, limb = 1 << (LIMB - 1), 0
    rest = sums[used]
    while limb == 0 or rest.any():
        low = ((rest + half) & ((1 << LIMB) - 1)) - half
        rest = (rest - low) >> LIMB
        for at in range(0, max(1, sums.shape[1]), BLOCK):
            some = low[:, at : at + BLOCK].astype(np.int64)
            wide = np.zeros((len(used), BLOCK), np.int64)
            wide[:, : some.shape[1]] = some
            for k, e in enumerate(used.tolist()):
                yield [part, e, at // BLOCK, limb, int(n[e]) if limb == 0 else 0, *wide[k].tolist()]
        limb += 1


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, label, vector) of rows whose vector is there and finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col)
    return vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), v.alias("vector")).where(F.col("vector").isNotNull() & fine)


def trained(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """The codebooks after `rounds` rounds over all of kept_vectors()."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()  # `entries` vectors
    start = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), parts * width, scale) if first else np.zeros((0, 0), np.int64)
    books = [[[int(x) for x in row[p * width : (p + 1) * width]] for row in start] for p in range(parts)]
    columns = ["part", "entry", "block", "limb", "n", *[f"s{i}" for i in range(BLOCK)]]
    for _ in range(rounds if first else 0):
        now = _arrays(books, width)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums: list = [0] * parts
            counts = [np.zeros(len(c), np.int64) for c in now]
            for b in batches:
                x = integers(b.column(0), parts * width, scale)
                for p, c in enumerate(now):
                    own = x[:, p * width : (p + 1) * width]
                    k, _ = nearest(own, c)
                    counts[p] += np.bincount(k, minlength=len(c))
                    sums[p] = sums[p] + summed(own, k, len(c))
                    if sums[p].dtype != object and sums[p].size and np.abs(sums[p]).max() > 2**60:
                        sums[p] = sums[p].astype(object)
            for p in range(parts):
                if counts[p].any():
                    rows = list(_limb_rows(sums[p], counts[p], p))
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], columns)

        shares = kept.select("vector").mapInArrow(run, ", ".join(f"{c} long" for c in columns))
        totals = shares.groupBy("part", "entry", "block", "limb").agg(*[F.sum(c).alias(c) for c in columns[4:]])
        found: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for r in totals.toLocalIterator():  # the size of the codebooks
            n, s = found.get((r.part, r.entry), (0, [0] * width))
            for i in range(r.block * BLOCK, min(width, (r.block + 1) * BLOCK)):
                s[i] += r[f"s{i - r.block * BLOCK}"] << (LIMB * r.limb)
            found[r.part, r.entry] = (n + (r.n if r.block == 0 else 0), s)
        for (p, e), (n, s) in found.items():
            books[p][e] = [x // n for x in s]
    return Codebooks(books, width, scale)


def _arrays(books: list[list[list[int]]], width: int) -> list[np.ndarray]:
    small = all(abs(x) < 2**62 for book in books for entry in book for x in entry)
    return [np.array(book, np.int64 if small else object).reshape(len(book), width) for book in books]


def encoded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): code has two hex digits for each part; error is null beyond a long."""
    parts, width, scale = len(books.entries), books.width, books.scale
    now = _arrays(books.entries, width)
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b.column(2), parts * width, scale)
                found = [nearest(x[:, p * width : (p + 1) * width], c) for p, c in enumerate(now)]
                code = np.stack([digits[k] for k, _ in found], 1)
                if all(d.dtype != object and (not len(d) or d.max() < 2**60 // parts) for _, d in found):
                    error = sum(d for _, d in found).tolist()
                else:
                    error = [e if e < 2**63 else None for e in (sum(int(d[i]) for _, d in found) for i in range(len(x)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(["".join(c) for c in code.tolist()], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return kept.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with the vector that each code stands for: entries over scale, plus half a step for the floor."""
    spark = codes.sparkSession
    rows = [(p, f"{e:02x}", [(x + 0.5) / books.scale for x in entry]) for p, book in enumerate(books.entries) for e, entry in enumerate(book)]
    known = F.broadcast(spark.createDataFrame(rows, "part int, digits string, piece array<double>").groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.struct("part", "digits"), "piece"))).alias("pieces")))  # the codebooks: one row
    pieces = [F.col("pieces")[F.struct(F.lit(p).alias("part"), F.substring("code", 2 * p + 1, 2).alias("digits"))] for p in range(len(books.entries))]
    return codes.join(known).withColumn("vector", F.concat(*pieces)).drop("pieces")


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: error summed over rows of the same label, nulls together.

    Labels have no bound: a few are broadcast, more are joined by merging, where Spark splits a hot label.
    """
    sums = written(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(19,0)")).try_cast("bigint").alias("label_error")), "label_errors")
    sums = sums.withColumnRenamed("label", "_gs_label")
    side = F.broadcast(sums) if sums.count() <= SMALL else sums.hint("merge")
    return codes.join(side, F.col("label").eqNullSafe(F.col("_gs_label"))).drop("_gs_label")


def op11_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of embeddings with a whole and finite vector.

    Null ids and repeated rows are kept; null labels are one label; an empty table gives no rows.
    """
    kept = kept_vectors(table(spark, sf_dir, "embeddings"))
    books = trained(kept)
    codes = written(encoded(kept, books), "codes")
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    square = "cast(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.w, c.w)]) as bigint)"
    assigned = f"""
a{k} as materialized (
  select i, p, arg_min(e, d * 1000 + e) as e, min(d) as d
  from (select v.i, v.p, c.e, {square} as d from parts v join c{k} c using (p)) group by i, p)"""
    if k == 4:
        return assigned
    return (
        assigned
        + f""",
m{k} as (
  select p, e, list((s - ((s % n) + n) % n) // n order by j) as w
  from (select p, e, j, sum(x) as s, count(*) as n from (select p, e, unnest(w) as x, generate_subscripts(w, 1) as j from a{k} join parts using (i, p)) group by p, e, j) group by p, e),
c{k + 1} as materialized (select c.p, c.e, cast(coalesce(m.w, c.w) as bigint[]) as w from c{k} c left join m{k} m using (p, e)),"""
    )


OP11_SQL = f"""
with kept as materialized (
  select row_number() over (order by vec_id) as i, vec_id, label, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
parts as materialized (select i, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] as w from kept, (select unnest(range(4)) as p)),
c0 as materialized (select p, i - 1 as e, w from parts where i <= 256),
{"".join(_round_sql(k) for k in range(5))},
coded as (select i, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from a4 group by i),
sha as (select sha256(string_agg(array_to_string(w, ','), ',' order by p, e)) as codebooks_sha256 from c4)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join coded using (i), sha
"""
