"""Language identification by language-bitmask n-gram filters.

Training counts, for every language, in how many of its training documents an n-gram of letters occurs, and keeps the
most frequent ones of each language. All go into one bit-sliced Bloom filter: a slot holds a bitmask with one bit for
each language, and the AND of an n-gram's slots names all languages that may contain it. A document's n-grams are counted
for each language (popcounts by bit), every count is corrected by that language's rate of false positives, and the
language with the largest corrected share wins; n-grams that all languages contain say nothing and are left out of it.

Training reads a bounded sample: for each language the `per_language` training documents of least hash of (doc_id, length
of the text). A language has at most `ngrams` n-grams in the filter. Every language of the training documents is learned: a
slot has as many 64-bit words (planes) as the languages need.

A text that is null or has no letter is `und` with score 0; with no language learned every text is `und`. Ties go to the
language that sorts first. A text none of whose n-grams is known gets the language most frequent in training and
score 0. Null langs and null ids are not learned from. Only doc_id, text and (for training) lang are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.llm.common import table, written

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


_OTHER = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters as one blank, a blank at both ends; empty without a letter."""
    if not any(map(str.isalpha, text)):
        return np.zeros(0, np.uint64)
    folded = f" {_OTHER.sub(' ', text.lower()).strip()} "
    return np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def hashed(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n-gram."""
    if len(points) < n:
        return np.zeros(0, np.uint64)
    m = len(points) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h ^ points[i : i + m]) * _MIX[0]
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # (planes, size) of uint64: language k is bit k % 64 of plane k // 64
    false_rate: np.ndarray
    n: int
    default: int

    @staticmethod
    def places(h: np.ndarray, size: int) -> list[np.ndarray]:
        return [((h * m) >> np.uint64(40)) & np.uint64(size - 1) for m in _MIX]

    @classmethod
    def built(cls, grams: dict[str, np.ndarray], frequent: str, n: int, bits: int = 20) -> Model:
        languages = sorted(grams)
        slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
        for k, name in enumerate(languages):
            for at in cls.places(grams[name], 1 << bits):
                slots[k // 64][at] |= np.uint64(1 << k % 64)
        fill = np.array([float(((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))])
        return cls(languages, slots, fill ** len(_MIX), n, languages.index(frequent) if frequent in languages else 0)

    def predicted(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        total = len(self.languages)
        every = [np.uint64((1 << min(64, total - at)) - 1) for at in range(0, total, 64)]
        for text in texts:
            points = letters_of(text or "")
            if len(points) < 3 or not total:
                names.append("und")
                scores.append(0.0)
                continue
            a, b, c = self.places(hashed(points, self.n), self.slots.shape[1])
            masks = self.slots[:, a] & self.slots[:, b] & self.slots[:, c]
            if total > 1:  # n-grams of all languages say nothing
                masks = masks[:, ~np.logical_and.reduce([m == e for m, e in zip(masks, every)])]
            count = np.array([int(((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum()) for k in range(total)], float)
            true = np.maximum(0, (count - masks.shape[1] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
            if true.sum() > 0:
                best = int(np.argmax(true))
                names.append(self.languages[best])
                scores.append(float(true[best] / true.sum()))
            else:
                names.append(self.languages[self.default])
                scores.append(0.0)
        return names, scores


def sampled(rows: DataFrame, per_language: int) -> DataFrame:
    """(lang, doc_id, o) of the `per_language` rows of least (o, doc_id) in each language of rows(lang, doc_id, o), o a hash.

    Counts by range of o, which Spark combines before the shuffle, tell up to which range a language's sample reaches; only
    rows up to there (the sample and one range more) are put in order, so no task gets all of a language.
    """
    part = F.shiftright("o", 48) + (1 << 15)
    counts = rows.groupBy("lang", part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("p")) - F.col("n")
    reach = counts.withColumn("before", before).where(F.col("before") < per_language).groupBy("lang").agg(F.max("p").alias("reach"))
    near = rows.join(reach.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l")).where(part <= F.col("reach"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))
    return near.withColumn("r", place).where(F.col("r") <= per_language).select("lang", "doc_id", "o")


def train(docs: DataFrame, n: int = 4, per_language: int = 2000, ngrams: int = 50_000, bits: int = 20) -> Model:
    """A model from docs(doc_id, text, lang)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0), n, 0)
    # The sample is chosen on narrow rows, the texts come from a second read. It has at most per_language rows a language,
    # and is written and joined as a table, which Spark broadcasts if it is small.
    sample = rows.withColumn("o", F.xxhash64(F.col("doc_id").cast("string"), F.length("text")))
    chosen = written(sampled(sample.select("lang", "doc_id", "o"), per_language), "sample").select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), F.col("o").alias("k"))
    picked = sample.join(chosen, (F.col("o") == F.col("k")) & (F.col("lang") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi").select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(np.unique(hashed(letters_of(text), n)).view(np.int64).tolist())
            for lang, c in seen.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["lang", "h", "n"])

    grams = picked.mapInArrow(counted, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    best = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))).where(F.col("r") <= ngrams)
    held: dict[str, list[int]] = {}
    for r in best.select("lang", "h").toLocalIterator():
        held.setdefault(r.lang, []).append(r.h)
    arrays = {k: np.array(v, np.int64).view(np.uint64) for k, v in held.items()}
    for k in sizes:
        arrays.setdefault(k, np.zeros(0, np.uint64))
    return Model.built(arrays, max(sizes, key=lambda k: (sizes[k], k)), n, bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predicted(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Null texts and texts without letters are `und` with score 0; null ids are predicted, not learned from, and not held out;
    ties go to the language that sorts first. With nothing to learn from all is `und`; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
