"""Texts to vectors. An encoder takes a DataFrame (row_id, text) and returns (row_id, vector)."""

from __future__ import annotations

import json
import os
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gapspark.config import EncoderConfig
from gapspark.functions.order import numbered
from gapspark.functions.vectors import l2_normalize
from gapspark.sources.tables import materialized


def batched(items: Sequence, size: int) -> Iterator[Sequence]:
    if size < 1:
        raise ValueError("size must be 1 or more")
    for i in range(0, len(items), size):
        yield items[i : i + size]


class Encoder(ABC):
    """The plug-in contract: implement _encode; null texts arrive as empty ones."""

    name = ""

    def __init__(self, config: EncoderConfig | None = None):
        self.config = config or EncoderConfig(name=self.name)

    @abstractmethod
    def _encode(self, texts: DataFrame) -> DataFrame: ...

    def encode(self, texts: DataFrame) -> DataFrame:
        """Checked vectors: one for each text, finite, of unit length if the config says so."""
        ready = texts.select("row_id", F.coalesce("text", F.lit("")).alias("text"))
        out = self._encode(ready)
        if self.config.normalize:
            out = out.withColumn("vector", l2_normalize(F.col("vector")))
        finite = F.when(F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()), F.raise_error(F.lit(f"{self.name}: a vector is not finite"))).otherwise(F.col("vector"))
        return out.select("row_id", finite.alias("vector"))

    def describe(self) -> dict:
        return {"name": self.name, "model": self.config.model, "dimensions": self.config.dimensions}


def tfidf_features(texts: DataFrame) -> DataFrame:
    """row_id, term, w: L2-normalised sublinear tf-idf of word 1-2-grams, and of character 3-5-grams inside words, each on its own."""
    lower = F.lower("text")
    words = F.regexp_extract_all(lower, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.expr("array()").cast("array<string>"))
    word = texts.select("row_id", words.alias("w")).select("row_id", F.explode(F.concat("w", pairs)).alias("term")).withColumn("kind", F.lit("w"))
    padded = F.transform(F.filter(F.split(F.regexp_replace(lower, r"(?U)\s+", " "), " "), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def grams(x):
        size = F.length(x)
        # a padded word shorter than n gives itself, once
        each = [F.when(size > n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i, n=n: F.substring(x, i, F.lit(n)))).when((size == n) | F.lit(n == 3), F.array(x)).otherwise(F.expr("array()").cast("array<string>")) for n in (3, 4, 5)]
        return F.concat(*each)

    char = texts.select("row_id", F.explode(padded).alias("x")).select("row_id", F.explode(grams(F.col("x"))).alias("term")).withColumn("kind", F.lit("c"))
    tf = word.unionByName(char).groupBy("row_id", "kind", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    df = tf.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df"))
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    weighted = tf.join(df, ["kind", "term"]).join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row_id", "kind")))
    return weighted.select("row_id", F.concat_ws(":", "kind", "term").alias("term"), (F.col("w") / length).alias("w"))


class TfidfSvdEncoder(Encoder):
    """Offline and repeatable: tf-idf, then a truncated SVD (U times the singular values).

    Transductive: texts that are to be compared must be encoded together. Up to `local_rows` texts the decomposition is
    that of the texts' Gram matrix in one task; beyond, RowMatrix.computeSVD finds the same one distributed over the same terms.
    """

    name = "tfidf-svd"
    local_rows = 4096  # the Gram matrix takes 134 MB then

    def _encode(self, texts: DataFrame) -> DataFrame:
        spark = texts.sparkSession
        n = texts.count()
        dims = int(self.config.dimensions or 128)
        kind = texts.schema["row_id"].dataType.simpleString()
        features = tfidf_features(texts)
        if n <= self.local_rows:
            # one task holds the sparse rows of at most local_rows texts
            every = texts.select("row_id").withColumns({"term": F.lit(None).cast("string"), "w": F.lit(0.0)})

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                ids = sorted(pdf["row_id"].unique())
                at = {r: i for i, r in enumerate(ids)}
                real = pdf[pdf["term"].notna()]
                codes, terms = pd.factorize(real["term"], sort=True)
                rows = real["row_id"].map(at).to_numpy()
                gram = np.zeros((len(ids), len(ids)))
                order = np.argsort(codes, kind="stable")
                codes, rows, w = codes[order], rows[order], real["w"].to_numpy()[order]
                for lo in range(0, len(terms), 4096):
                    a, b = np.searchsorted(codes, [lo, lo + 4096])
                    block = np.zeros((len(ids), 4096))
                    block[rows[a:b], codes[a:b] - lo] = w[a:b]
                    gram += block @ block.T
                k = max(1, min(dims, min(len(ids), max(1, len(terms))) - 1))
                values, vectors = np.linalg.eigh(gram)
                top = np.argsort(-values)[:k]
                out = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
                out *= np.where(out[np.abs(out).argmax(0), range(k)] < 0, -1, 1)  # signs do not matter, but are kept fixed
                return pd.DataFrame({"row_id": ids, "vector": out.tolist()})

            return features.unionByName(every).groupBy().applyInPandas(run, f"row_id {kind}, vector array<double>")
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

        terms = numbered(features.select("term").distinct(), ["term"], "i")
        size = terms.count()
        rows = features.join(terms, "term").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct((F.col("i") - 1).cast("int").alias("i"), "w"))).alias("v"))
        keyed = materialized(numbered(rows.withColumn("_h", F.xxhash64("row_id")), ["_h", "row_id"], "k").select("row_id", "k", "v"), "rows")
        matrix = IndexedRowMatrix(keyed.select("k", "v").rdd.map(lambda r: IndexedRow(r.k, Vectors.sparse(size, [(x.i, x.w) for x in r.v]))), numRows=n + 1, numCols=size)
        svd = matrix.computeSVD(max(1, min(dims, min(n, max(1, size)) - 1)), computeU=True)
        s = svd.s.toArray().tolist()
        u = materialized(svd.U.rows.map(lambda r: (r.index, [float(x * y) for x, y in zip(r.vector.toArray(), s)])).toDF("k long, vector array<double>"), "vectors")
        # signs do not matter, but are kept fixed: the largest part of each component is positive
        largest = u.select("k", F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.max_by("x", F.struct(F.abs("x"), -F.col("k"))).alias("x")).collect()
        signs = F.array(*[F.lit(-1.0 if r.x < 0 else 1.0) for r in sorted(largest, key=lambda r: r.d)])
        u = u.select("k", F.zip_with("vector", signs, lambda a, b: a * b).alias("vector"))
        zero = F.array(*[F.lit(0.0)] * len(s))
        return texts.select("row_id").join(keyed.select("row_id", "k").join(u, "k"), "row_id", "left").select("row_id", F.coalesce("vector", zero).alias("vector"))


class PrecomputedEncoder(Encoder):
    """Vectors from a table (text, vector): extra={'vectors': DataFrame}. A text without a vector is an error."""

    name = "precomputed"

    def _encode(self, texts: DataFrame) -> DataFrame:
        known = self.config.extra["vectors"].select(F.col("text").alias("_t"), "vector")
        found = texts.join(known, F.col("text") == F.col("_t"), "left")
        missing = F.raise_error(F.concat(F.lit("no vector for: "), F.col("text"))).cast("array<double>")
        return found.select("row_id", F.when(F.col("vector").isNull(), missing).otherwise(F.col("vector")).alias("vector"))


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct texts that a cache (text, vector) lacks: only these need to be encoded."""
    return texts.select("text").distinct().join(cache.select("text"), "text", "left_anti")


class CachedEncoder(Encoder):
    """Another encoder with a cache: a Parquet folder (text, vector) that is read first and gets what it lacked.

    Only for encoders whose vectors do not depend on the other texts. A rerun over the same texts encodes nothing; if two
    runs add the same text, one of its vectors is taken.
    """

    name = "cached"

    def __init__(self, inner: Encoder, folder: str):
        super().__init__(inner.config)
        self.inner, self.folder = inner, folder

    def _stored(self, texts: DataFrame) -> DataFrame:
        try:
            return texts.sparkSession.read.parquet(self.folder).groupBy("text").agg(F.min("vector").alias("vector"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return texts.sparkSession.createDataFrame([], "text string, vector array<double>")

    def _encode(self, texts: DataFrame) -> DataFrame:
        new = missing_texts(texts, self._stored(texts)).withColumn("row_id", F.monotonically_increasing_id())
        new = materialized(new, "missing")  # so that row_id is the same in both uses
        if new.limit(1).count():
            self.inner.encode(new).join(new, "row_id").select("text", "vector").write.mode("append").parquet(self.folder)
        found = self._stored(texts).withColumnRenamed("text", "_t")
        return texts.join(found, F.col("text") == F.col("_t")).select("row_id", "vector")


#: A transport takes (url, headers, payload) and returns the decoded JSON reply; tests pass their own.
Transport = Callable[[str, dict, dict], dict]


def http_transport(url: str, headers: dict, payload: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=120) as reply:
        return json.load(reply)


class RemoteEncoder(Encoder):
    """A hosted model, called in batches from the tasks. The key is read from the environment and never stored."""

    url = ""
    key_env = ""
    default_model = ""
    most = 100

    def _payload(self, texts: list[str]) -> dict:
        return {"model": self.config.model or self.default_model, "input": texts}

    def _vectors(self, reply: dict) -> list[list[float]]:
        return [x["embedding"] for x in sorted(reply["data"], key=lambda x: x.get("index", 0))]

    def api_key(self) -> str:
        name = self.config.api_key_env or self.key_env
        if not os.environ.get(name):
            raise RuntimeError(f"{self.name} needs a key in the environment variable {name}")
        return os.environ[name]

    def encode_texts(self, texts: list[str], transport: Transport) -> list[list[float]]:
        out: list[list[float]] = []
        headers = {"Authorization": f"Bearer {self.api_key()}"}
        for part in batched(texts, max(1, min(self.most, self.config.batch_size))):
            vectors = self._vectors(transport(self.url, headers, self._payload(list(part))))
            if len(vectors) != len(part):
                raise RuntimeError(f"{self.name} gave {len(vectors)} vectors for {len(part)} texts")
            out += vectors
        return out

    def _encode(self, texts: DataFrame) -> DataFrame:
        transport = self.config.extra.get("transport", http_transport)
        kind = texts.schema["row_id"].dataType.simpleString()

        def run(rows: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                yield pd.DataFrame({"row_id": pdf["row_id"], "vector": self.encode_texts(pdf["text"].tolist(), transport)})

        return texts.mapInPandas(run, f"row_id {kind}, vector array<double>")


# Fixed values, here and in the three classes below: services' public addresses, default models, environment variables of keys, batch limits.
class OpenAIEncoder(RemoteEncoder):
    name, url, key_env, default_model, most = "openai", "https://api.openai.com/v1/embeddings", "OPENAI_API_KEY", "text-embedding-3-large", 256

    def _payload(self, texts: list[str]) -> dict:
        return super()._payload(texts) | ({"dimensions": self.config.dimensions} if self.config.dimensions else {})


class CohereEncoder(RemoteEncoder):
    name, url, key_env, default_model, most = "cohere", "https://api.cohere.com/v2/embed", "COHERE_API_KEY", "embed-english-v3.0", 96

    def _payload(self, texts: list[str]) -> dict:
        return {"model": self.config.model or self.default_model, "texts": texts, "input_type": "clustering", "embedding_types": ["float"]}

    def _vectors(self, reply: dict) -> list[list[float]]:
        return reply["embeddings"]["float"]


class JinaEncoder(RemoteEncoder):
    name, url, key_env, default_model, most = "jina", "https://api.jina.ai/v1/embeddings", "JINA_API_KEY", "jina-embeddings-v3", 100


class NomicEncoder(RemoteEncoder):
    name, url, key_env, default_model, most = "nomic", "https://api-atlas.nomic.ai/v1/embedding/text", "NOMIC_API_KEY", "nomic-embed-text-v1.5", 100

    def _payload(self, texts: list[str]) -> dict:
        return {"model": self.config.model or self.default_model, "texts": texts, "task_type": "clustering"}

    def _vectors(self, reply: dict) -> list[list[float]]:
        return reply["embeddings"]


class SentenceTransformerEncoder(Encoder):
    """A local checkpoint, where the sentence-transformers library is installed."""

    name = "sbert"

    def _encode(self, texts: DataFrame) -> DataFrame:
        model_name, size = self.config.model or "all-mpnet-base-v2", self.config.batch_size
        kind = texts.schema["row_id"].dataType.simpleString()

        def run(rows: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(model_name)
            for pdf in rows:
                yield pd.DataFrame({"row_id": pdf["row_id"], "vector": model.encode(pdf["text"].tolist(), batch_size=size).astype(float).tolist()})

        return texts.mapInPandas(run, f"row_id {kind}, vector array<double>")


_REGISTRY: dict[str, Callable[[EncoderConfig], Encoder]] = {
    c.name: c for c in (TfidfSvdEncoder, PrecomputedEncoder, OpenAIEncoder, CohereEncoder, JinaEncoder, NomicEncoder, SentenceTransformerEncoder)
}


def register_encoder(name: str, factory: Callable[[EncoderConfig], Encoder]) -> None:
    _REGISTRY[name] = factory


def available_encoders() -> list[str]:
    return sorted(_REGISTRY)


def get_encoder(config: EncoderConfig) -> Encoder:
    if config.name not in _REGISTRY:
        raise ValueError(f"unknown encoder {config.name!r}; known: {', '.join(available_encoders())}")
    return _REGISTRY[config.name](config)


