"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it.

Features are the distinct lower-case words of a whole text and their first 3 to 8 letters, and in steps the shares of
capital words, exclamation marks, words said twice in a row and marks that prose has little of, all hashed, each weighed by its log-odds for the category (so words
that say nothing weigh nothing), and the earlier categories' probabilities. The models are logistic, with L2
regularisation. While training, the earlier probabilities of a document come from models that have not seen it (out-of-fold
over `folds` folds by hash of doc_id); in prediction they come from the final models, category by category. A category is
predicted from the probability on that has the best F1 out-of-fold.

Training reads at most `sample` labelled documents, those of least hash of doc_id; rows with a null label are left out. Of
several rows of labels for one doc_id the largest labels count, of several texts one.
Where a category has one class only, its probability is that class's share. Null and empty texts have no words and are
predicted from the intercept; null ids are predicted but not trained on; repeated rows each get a row. Only doc_id, text and
the label columns are read. An empty table gives an empty result; without labels all probabilities are 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import dropped, table, written

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Marks that prose has little of, and the shares of the words from which on a text counts as repeating itself, marked and so on.
MARKS = "#*$%&<>^~=+@"
STEPS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)


class Hasher:
    """Words to places in the weights; the words of earlier texts are remembered, up to a bound."""

    def __init__(self, bits: int, most: int = 300_000):
        self.size, self.most, self.known = 1 << bits, most, {}

    def _place(self, feature: str) -> int:
        return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), 7) % self.size

    def places(self, text: str | None) -> np.ndarray:
        text = text or ""
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = set()
        words = _WORD.findall(text)
        for w in set(map(str.lower, words)):
            at = known.get(w)
            if at is None:
                at = known[w] = [self._place(w), *[self._place(f"{w[:n]}*") for n in PREFIXES if len(w) > n]]
            out.update(at)
        if words:  # how much is shouted, repeated and marked, in steps
            loud = sum(w.isupper() for w in words if len(w) > 1) / len(words)
            out.add(self._place(f"#upper {int(loud * 10)}"))
            out.add(self._place(f"#bang {int(min(1.0, text.count('!') / len(words)) * 10)}"))
            shares = {"again": sum(map(str.__eq__, words, words[1:])), "mark": sum(map(text.count, MARKS)), "bar": text.count("|"), "stress": text.count("!!"), "loud": loud * len(words)}
            out.update(self._place(f"#{name} from {least}") for name, n in shares.items() for least in STEPS if n >= least * len(words))
        return np.fromiter(out, np.int32, len(out))


def squeezed(places: np.ndarray) -> bytes:
    """Places as compressed gaps: each fold's task gets a copy of them."""
    return zlib.compress(np.diff(np.sort(places), prepend=0).astype("<i4").tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int32)


def _minimised(f, x: np.ndarray, steps: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives value and gradient."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            a = s @ d / (y @ s)
            alphas.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            d += s * (a - y @ d / (y @ s))
        slope, t = grad @ d, 1.0
        if slope <= 1e-12:
            break
        for _ in range(30):
            new_value, new_grad = f(x - t * d)
            if new_value <= value - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = -t * d, new_grad - grad
        x = x + s
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        value, grad = new_value, new_grad
        if y @ s > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        if done:
            break
    return x


def _fitted(rows: list[np.ndarray], earlier: np.ndarray, label: np.ndarray, size: int, l2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights of words, weights of the earlier categories' probabilities, intercept)."""
    n, share = len(rows), float(label.mean()) if len(rows) else 0.0
    none = np.zeros(size, np.float32), np.zeros(earlier.shape[1])
    if share in (0.0, 1.0):
        return *none, (1 if share else -1) * 20.0
    at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    pos = np.bincount(at, weights=label[owner], minlength=size)
    neg = np.bincount(at, minlength=size) - pos
    odds = np.log((pos + 0.5) / (label.sum() + 1)) - np.log((neg + 0.5) / (n - label.sum() + 1))
    odds[(pos + neg) < 2] = 0  # a word of one document says nothing about others
    used = np.flatnonzero(np.abs(odds) > 0.7)
    column = np.full(size, -1)
    column[used] = np.arange(len(used))
    keep = column[at] >= 0
    i, j, v = owner[keep], column[at[keep]], odds[at[keep]]
    k = earlier.shape[1]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, u, b = x[: len(used)], x[len(used) : len(used) + k], x[-1]
        z = np.bincount(i, weights=v * w[j], minlength=n) + earlier @ u + b
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        value = float(np.logaddexp(0, np.where(label > 0, -z, z)).sum() + l2 / 2 * (w @ w + u @ u))
        e = p - label
        return value, np.concatenate([np.bincount(j, weights=v * e[i], minlength=len(used)) + l2 * w, earlier.T @ e + l2 * u, [e.sum()]])

    x = _minimised(loss, np.concatenate([np.zeros(len(used) + k), [np.log(share / (1 - share))]]))
    words = np.zeros(size, np.float32)
    words[used] = x[: len(used)] * odds[used]
    return words, x[len(used) : len(used) + k], float(x[-1])


def _probability(model: tuple[np.ndarray, np.ndarray, float], rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    words, others, b = model
    z = np.array([words[r].sum() for r in rows], float) + (earlier @ others if len(others) else 0.0) + b
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _out_of_fold(rows: list[np.ndarray], earlier: np.ndarray, label: np.ndarray, fold: np.ndarray, f: int, bits: int, l2: float) -> np.ndarray:
    """The probabilities of fold f's rows by a model of the other folds."""
    mine, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
    m = _fitted([rows[i] for i in rest], earlier[rest], label[rest], 1 << bits, l2)
    return _probability(m, [rows[i] for i in mine], earlier[mine])


def _threshold(p: np.ndarray, label: np.ndarray) -> float:
    """The probability, a half or less, from which on predictions have the best F1; of equals the highest."""
    grid = np.arange(50, 9, -1) / 100
    f1 = [2 * (label * (p >= t)).sum() / max(1.0, label.sum() + (p >= t).sum()) for t in grid]
    return float(grid[int(np.argmax(f1))])


@dataclass
class Chain:
    categories: list[str]
    bits: int
    models: list[tuple[np.ndarray, np.ndarray, float]]
    thresholds: list[float]

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """One row for each document, one column for each category, in the chain's order."""
        p = np.zeros((len(rows), 0))
        for model in self.models:
            p = np.column_stack([p, _probability(model, rows, p)])
        return p

    @classmethod
    def fitted(cls, categories: list[str], rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, bits: int, l2: float) -> Chain:
        earlier, models, thresholds = np.zeros((len(rows), 0)), [], []
        for k in range(len(categories)):
            models.append(_fitted(rows, earlier, labels[:, k], 1 << bits, l2))
            p = np.zeros(len(rows))
            for f in np.unique(fold):
                p[fold == f] = _out_of_fold(rows, earlier, labels[:, k], fold, f, bits, l2)
            thresholds.append(_threshold(p, labels[:, k]))
            earlier = np.column_stack([earlier, p])
        return cls(categories, bits, models, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = 12_000, folds: int = 5, bits: int = 18, l2: float = 1.0) -> Chain:
    """A chain from docs(doc_id, text) and labels(doc_id, a 0/1 column for each category), in the order of `categories`."""
    spark = docs.sparkSession
    told = labels.select("doc_id", F.array(*[F.col(c).cast("double") for c in categories]).alias("y")).where("doc_id is not null").where(~F.exists("y", lambda x: x.isNull()))
    told = told.groupBy("doc_id").agg(*[F.max(F.get("y", F.lit(k))).alias(f"y{k}") for k in range(len(categories))]).select("doc_id", F.array(*[f"y{k}" for k in range(len(categories))]).alias("y"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("i"), "y")
    # at most `sample` rows of an id and a few numbers are broadcast, and as many feature rows meet in the training task
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("i"))
    rows = rows.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold"), F.xxhash64("doc_id").alias("o"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(bits)
        for b in batches:
            x = pa.array([squeezed(h.places(t)) for t in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([x, b.column(1), b.column(2), b.column(3)], ["x", "y", "fold", "o"])

    # one row of each doc_id, whatever repeats
    told = rows.mapInArrow(featured, "x binary, y array<double>, fold int, o long").groupBy("o").agg(F.min(F.struct("x", "y", "fold")).alias("r")).select("o", "r.*")
    told = written(told, "toxicity_features")
    each = told.withColumn("f", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))))
    models, thresholds, earlier = [], [], {}
    for k in range(len(categories)):

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            """The model of all rows (f is -1), or the probabilities of fold f's rows: one task each, of `sample` rows at most."""
            pdf = pdf.sort_values(["o", "x"]).reset_index(drop=True)
            f, fold, label = int(pdf["f"].iloc[0]), pdf["fold"].to_numpy(), np.array(pdf["y"].tolist())[:, k]
            x, before = [unsqueezed(v) for v in pdf["x"]], np.array([earlier[o] if k else () for o in pdf["o"]], float).reshape(len(pdf), k)
            if f >= 0:
                mine = pdf[fold == f]
                p = _out_of_fold(x, before, label, fold, f, bits, l2) if len(mine) else []
                return pd.DataFrame({"o": mine["o"], "p": p, "y": label[fold == f], "at": None, "w": None, "u": None, "b": None})
            w, u, b = _fitted(x, before, label, 1 << bits, l2)
            return pd.DataFrame([(None, None, None, np.flatnonzero(w).astype(np.int32).tobytes(), w[np.flatnonzero(w)].tobytes(), list(u), b)], columns=["o", "p", "y", "at", "w", "u", "b"])

        found = each.groupBy("f").applyInPandas(fit, "o long, p double, y double, at binary, w binary, u array<double>, b double").collect()  # `sample` numbers and a model
        for r in found:
            if r.o is None:
                words = np.zeros(1 << bits, np.float32)
                words[np.frombuffer(r.at, np.int32)] = np.frombuffer(r.w, np.float32)
                models.append((words, np.array(r.u, float), r.b))
        own = [r for r in found if r.o is not None]
        thresholds.append(_threshold(np.array([r.p for r in own]), np.array([r.y for r in own])))
        earlier = {r.o: (*earlier.get(r.o, ()), r.p) for r in own}
    dropped(told)
    if not models:
        thresholds = [0.5] * len(categories)
        models = [(np.zeros(1 << bits, np.float32), np.zeros(k), -50.0) for k in range(len(categories))]
    return Chain(categories, bits, models, thresholds)


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, probabilities array<double>) in the chain's order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 2**bits weights for each category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(shared.value.bits)
        for b in batches:
            p = shared.value.probabilities([h.places(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "probabilities"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, probabilities array<double>")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, probabilities and verdicts of low quality and toxicity of every document.

    Learned from at most 12,000 labelled documents; of conflicting labels the largest counts. Null and empty texts are judged by
    the intercepts; null ids and repeated rows are kept. Without labels nothing is toxic; an empty table gives no rows.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = train(docs, labels, ["low_quality", "toxic"])
    out = predict(docs, chain)
    p = F.col("probabilities")
    return out.select("doc_id", F.round(p[0], 6).alias("p_low_quality"), F.round(p[1], 6).alias("p_toxic"), *[(p[k] >= chain.thresholds[k]).alias(c) for k, c in enumerate(chain.categories)])
