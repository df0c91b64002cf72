"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character, so no merge crosses from a character
into the marker that follows it. A text is therefore cut before every run of markers; each distinct chunk ("marked word")
is segmented and decoded by the library once for a batch, or less often, and the ids are joined back by position.
The table of a task keeps at most `table_chunks` chunks between batches.

The vocabulary is checked for this property when it is loaded; where it does not hold, whole texts are encoded.

Null texts are encoded as empty ones: no ids. Null ids and repeated rows are kept. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import table

MARK = "▁"

@lru_cache(maxsize=4)
def _processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    return sp, not any(MARK in p.lstrip(MARK) for p in pieces)


class Chunks:
    """What each distinct chunk becomes: its ids, and its text after decoding (without the chunk's first marker)."""

    def __init__(self, path: str, table_chunks: int = 200_000):
        self.sp, self.apart = _processor(path)
        self.most = table_chunks
        self.held: dict[str, tuple[list[int], str, str]] = {}

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each without its first marker (which the library adds to every input)."""
        if not text:
            return []
        if not self.apart:
            return [text]
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out: list[str] = []
        run = ""
        last = len(parts) - 1
        for k, p in enumerate(parts):
            if p or k == last:
                out.append(run + p)
                run = ""
            else:
                run += " "
        return out

    def segmented(self, docs: list[list[str]]) -> None:
        new = [c for c in dict.fromkeys(c for d in docs for c in d) if c not in self.held]
        if len(self.held) + len(new) > self.most:
            self.held = {}
            new = list(dict.fromkeys(c for d in docs for c in d))
        # an input of no characters has no marker either: the chunk of one marker alone is the id of that piece
        ids = self.sp.encode([c or MARK for c in new], num_threads=1)
        for c, i in zip(new, ids):
            if not c:
                i = [self.sp.piece_to_id(MARK)]
            self.held[c] = (i, ",".join(map(str, i)), self.sp.decode(i) if c else "")


def encoded(docs: DataFrame, path: str, table_chunks: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string)."""
    return _mapped(docs, path, table_chunks, id_col, text_col, "ids array<int>, decoded string", lambda rows: [pa.array([[x for i, _, _ in r for x in i] for r in rows], pa.list_(pa.int32())), pa.array([" ".join([t for _, _, t in r]) for r in rows], pa.string())])


def digests(docs: DataFrame, path: str, table_chunks: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encoded() returns, without moving the ids."""

    def sha(parts: list[str], by: str) -> str:
        return hashlib.sha256(by.join(parts).encode("utf-8", "surrogatepass")).hexdigest()

    return _mapped(docs, path, table_chunks, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda rows: [pa.array([sum([len(i) for i, _, _ in r]) for r in rows], pa.int64()), pa.array([sha([s for _, s, _ in r], ",") for r in rows]), pa.array([sha([t for _, _, t in r], " ") for r in rows])])


def _mapped(docs: DataFrame, path: str, table_chunks: int, id_col: str, text_col: str, schema: str, made) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chunks(path, table_chunks)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 500):
                b = whole.slice(at, 500)
                chunked = [known.chunks(t or "") for t in b.column(1).to_pylist()]
                known.segmented(chunked)
                held = known.held
                yield pa.RecordBatch.from_arrays([b.column(0), *made([[held[c] for c in d] for d in chunked])], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Null texts count as empty and have no ids; null ids and repeated rows are kept. An empty table gives no rows.
    """
    return digests(table(spark, sf_dir, "documents"), model_path())
