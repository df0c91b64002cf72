"""TF-IDF salience of keywords, with a graded back-off for those that are no term of the vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapspark.functions.text import normalize_keyword
from gapspark.operators.backoff import FLOOR, Index
from gapspark.sources.tables import materialized


def tokens(articles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., t: the words of each record's keywords, in order and across keywords."""
    text = F.array_join("keywords_normalized", " ")
    return articles.select(*by, F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[\w\-]+\b"), F.lit(0)).alias("t")).where(F.size("t") > 0)


def ngram_counts(articles: DataFrame, low: int = 1, high: int = 5, by: tuple[str, ...] = (), told: DataFrame | None = None) -> DataFrame:
    """by..., term, total, df: how often each word n-gram occurs, and in how many records; told may be the tokens, where they are kept."""
    grams = F.col("t") if low == high == 1 else F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))).otherwise(F.expr("array()").cast("array<string>"))))
    ordered = (tokens(articles, by) if told is None else told).select(*by, F.sort_array(grams).alias("g"))
    # in order, a record's first of equal n-grams counts for the record, so that records need not be grouped
    each = ordered.select(*by, F.explode(F.transform("g", lambda x, i: F.struct(x.alias("term"), F.coalesce(F.get("g", i - 1) != x, F.lit(True)).alias("new")))).alias("e"))
    return each.groupBy(*by, F.col("e.term").alias("term")).agg(F.count(F.lit(1)).alias("total"), F.count_if("e.new").alias("df"))


#: Most words, as a multiple of max_features, that tasks hold to leave out n-grams; with more, n-grams are counted without.
HELD = 20


def _by_key(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, pa.Array]]:
    """The token lists of a batch, for each corpus (the first n_keys columns) in turn."""
    lists = batch.column(n_keys)
    if not n_keys:
        yield (), lists
        return
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(n_keys)))):
        rows.setdefault(key, []).append(i)
    for key, at in rows.items():
        yield key, lists.take(pa.array(at))


def _numbered(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each token of the lists in order: the place of its list, and of the token in words (-1: in none)."""
    flat = lists.flatten()
    record = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return record, pc.index_in(flat, value_set=words.cast(flat.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _longer(at: np.ndarray, k: int, record: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which stretches of k - 1 known tokens, starting `at`, go on by a known token of their record."""
    end = np.minimum(at + k - 1, len(ids) - 1)
    return (at + k - 1 < len(ids)) & (record[end] == record[at]) & (ids[end] >= 0)


def _longer_counts(articles: DataFrame, high: int, by: tuple[str, ...], held: dict[tuple, set], told: DataFrame | None = None) -> DataFrame:
    """by..., term, total, df of the n-grams of two words or more whose words are all held."""
    from pyspark.sql.pandas.types import to_arrow_type

    told = tokens(articles, by) if told is None else told
    shared = told.sparkSession.sparkContext.broadcast(held)
    schema = pa.schema([*((c, to_arrow_type(told.schema[c].dataType)) for c in by), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {key: sorted(own) for key, own in shared.value.items()}
        known = {key: pa.array(own, pa.string()) for key, own in words.items()}
        for b in batches:
            rows = []
            for key, lists in _by_key(b, len(by)):
                if key not in known:
                    continue
                own = words[key]
                record, ids = _numbered(lists, known[key])
                at = np.flatnonzero(ids >= 0)
                code = ids[at]
                for k in range(2, high + 1):
                    on = _longer(at, k, record, ids)
                    at, code = at[on], code[on]
                    if not len(at):
                        break
                    _, where, code = np.unique(code * len(own) + ids[at + k - 1], return_index=True, return_inverse=True)
                    each = np.unique(record[at] * len(where) + code) % len(where)
                    terms = [" ".join([own[w] for w in ids[i : i + k]]) for i in at[where]]
                    rows += [(*key, *x) for x in zip(terms, np.bincount(code).tolist(), np.bincount(each).tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema.names)

    kinds = ", ".join([*(f"{c} {told.schema[c].dataType.simpleString()}" for c in by), "term string, n long, d long"])
    return told.mapInArrow(run, kinds).groupBy(*by, "term").agg(F.sum("n").alias("total"), F.sum("d").alias("df"))


def frequent_terms(articles: DataFrame, low: int, high: int, max_features: int, by: tuple[str, ...] = (), told: DataFrame | None = None) -> DataFrame:
    """by..., term, total, df of the most frequent max_features word n-grams (ties: by term).

    An n-gram occurs no more often than any of its words. So once the words are counted, those that occur less often than the
    max_features-th of them are in no n-gram that counts, and n-grams are made of the others only. The result is that of all n-grams.
    Tokens are kept as a table, unless they are told.
    """
    told = materialized(tokens(articles, by), "tokens") if told is None else told

    def most(counts: DataFrame) -> DataFrame:
        if by:
            return counts.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), "term"))).where(F.col("_p") <= max_features).drop("_p")
        return counts.orderBy(F.desc("total"), "term").limit(max_features)

    if low != 1 or high < 2:
        return most(ngram_counts(articles, low, high, by, told))
    words = materialized(ngram_counts(articles, 1, 1, by, told), "words")
    floors = most(words).groupBy(*by).agg(F.when(F.count(F.lit(1)) >= max_features, F.min("total")).otherwise(F.lit(1)).alias("floor"))  # a number for each corpus
    kept = (words.join(F.broadcast(floors), list(by)) if by else words.join(F.broadcast(floors))).where("total >= floor")
    if kept.count() > HELD * max_features * max(1, floors.count()):
        return most(words.unionByName(ngram_counts(articles, 2, high, by, told)))
    held: dict[tuple, set] = {}
    for r in kept.select(*by, "term").collect():  # HELD * max_features words for each corpus
        held.setdefault(tuple(r[c] for c in by), set()).add(r.term)
    return most(words.unionByName(_longer_counts(articles, high, by, held, told)))


class _Prefixes:
    """Terms by their words, as a tree: an edge is a node times the number of words, plus a word."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        words = sorted({w for t in split for w in t})
        place, edges, self.term = {w: i for i, w in enumerate(words)}, {}, [-1]
        for i, t in enumerate(split):
            node = 0
            for w in t:
                edge = node * len(words) + place[w]
                if edge not in edges:
                    edges[edge] = len(self.term)
                    self.term.append(-1)
                node = edges[edge]
            self.term[node] = i
        self.words, self.term = pa.array(words, pa.string()), np.array(self.term)
        self.edges, self.nodes = (np.array(x, np.int64) for x in zip(*sorted(edges.items())))

    def found(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of the list and the term of every occurrence of a term."""
        record, ids = _numbered(lists, self.words)
        at, k, records, terms = np.flatnonzero(ids >= 0), 1, [], []
        node = np.zeros(len(at), np.int64)
        while len(at):
            edge = node * len(self.words) + ids[at + k - 1]
            to = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            on = self.edges[to] == edge
            at, node = at[on], self.nodes[to[on]]
            is_term = self.term[node] >= 0
            records.append(record[at[is_term]])
            terms.append(self.term[node[is_term]])
            k += 1
            on = _longer(at, k, record, ids)
            at, node = at[on], node[on]
        return np.concatenate(records or [at]), np.concatenate(terms or [at])


def vocabulary(articles: DataFrame, low: int = 1, high: int = 5, max_features: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., term, score: the mean over records of the L2-normalised tf-idf weight; the most frequent max_features terms (ties: by term).

    by names the corpora (a few) that the records belong to; each has a vocabulary of its own. Weights are summed where the
    records are: every task holds the terms, max_features for each corpus, and passes on a sum for each.
    """
    n = {tuple(r[c] for c in by): r["count"] for r in articles.where(F.size("keywords_normalized") > 0).groupBy(*by).count().collect()}  # a row for each corpus
    kept = materialized(tokens(articles, by), "tokens")
    idf: dict[tuple, dict[str, float]] = {}
    for r in frequent_terms(articles, low, high, max_features, by, kept).collect():  # max_features for each corpus
        key = tuple(r[c] for c in by)
        idf.setdefault(key, {})[r.term] = math.log((1 + n[key]) / (1 + r.df)) + 1
    shared = articles.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {key: _Prefixes(list(own)) for key, own in shared.value.items()}
        weight = {key: np.array(list(own.values())) for key, own in shared.value.items()}
        sums = {key: np.zeros(len(own)) for key, own in shared.value.items()}
        for b in batches:
            for key, lists in _by_key(b, len(by)):
                if key in known:
                    record, term = known[key].found(lists)
                    met, tf = np.unique(record * len(weight[key]) + term, return_counts=True)
                    record, term = np.divmod(met, len(weight[key]))
                    w = tf * weight[key][term]
                    norm = np.sqrt(np.bincount(record, w * w, len(lists)))
                    sums[key] += np.bincount(term, w / norm[record], len(weight[key]))
        rows = [(*key, g, w) for key, own in sums.items() for g, w in zip(shared.value[key], own.tolist()) if w]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([*((c, to_arrow_type(articles.schema[c].dataType)) for c in by), ("term", pa.string()), ("w", pa.float64())])
    told = ", ".join(f"{c} {articles.schema[c].dataType.simpleString()}" for c in by)
    summed = kept.mapInArrow(run, f"{told}, term string, w double" if by else "term string, w double").groupBy(*by, "term").agg(F.sum("w").alias("w"))
    if not by:
        return summed.select("term", (F.col("w") / float(n.get((), 1))).alias("score"))
    counts = articles.sparkSession.createDataFrame([(*key, k) for key, k in n.items()], f"{told}, n long") if n else articles.select(*by, F.lit(1).cast("long").alias("n")).limit(0)
    return summed.join(F.broadcast(counts), list(by)).select(*by, "term", (F.col("w") / F.col("n")).alias("score"))


def matched_salience(keywords: DataFrame, terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., keyword, tfidf, match_type of keywords(by..., keyword), in one pass (see operators/backoff.py).

    All tasks hold the vocabularies, whose size is capped (max_features terms for each corpus).
    """
    held: dict[tuple, tuple[list, list]] = {}
    for r in terms.select(*by, "term", "score").collect():  # max_features for each corpus
        own = held.setdefault(tuple(r[c] for c in by), ([], []))
        own[0].append(r.term)
        own[1].append(r.score)
    shared = keywords.sparkSession.sparkContext.broadcast({k: Index(*v) for k, v in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Index([], [])
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(len(by)))) if by else ((),) * b.num_rows
            told = [shared.value.get(k, none).match(w or "") for k, w in zip(keys, b.column(len(by)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t for t, _ in told], pa.float64()), pa.array([m for _, m in told], pa.string())], [*by, "keyword", "tfidf", "match_type"])

    rows = keywords.select(*by, "keyword")
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", tfidf double, match_type string")


def salience(articles: DataFrame, low: int = 1, high: int = 5, max_features: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., keyword, tfidf, match_type of every keyword of the records."""
    keywords = articles.select(*by, F.explode("keywords_normalized").alias("keyword")).where("keyword <> ''").distinct()
    return matched_salience(keywords, vocabulary(articles, low, high, max_features, by), by)


class TfidfSalience:
    """The salience of a corpus's keywords as an object: single look-ups, the best score, statistics, the table."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def of(cls, articles: DataFrame, low: int = 1, high: int = 5, max_features: int = 10_000) -> TfidfSalience:
        return cls(materialized(salience(articles, low, high, max_features), "salience"))

    def get(self, keyword: str, default: float | None = None) -> float:
        """The keyword's salience; the floor (or the default) if it is no keyword of the corpus."""
        found = self.table.where(F.col("keyword") == normalize_keyword(F.lit(keyword))).select("tfidf").first()
        return found.tfidf if found else FLOOR if default is None else default

    @property
    def max_score(self) -> float:
        best = self.table.agg(F.max("tfidf")).first()[0]
        return 1.0 if best is None else best

    def match_statistics(self) -> dict[str, int]:
        return {r.match_type: r.n for r in match_statistics(self.table).collect()}

    def to_frame(self) -> DataFrame:
        return self.table.select("keyword", "tfidf", "match_type").orderBy(F.desc("tfidf"), "keyword")


def match_statistics(salient: DataFrame) -> DataFrame:
    return salient.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))
