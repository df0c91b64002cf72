"""Token ids in a binary format: fixed-width bit packing with a block index.

An id takes the least number of bits that the vocabulary needs. A segment is one record of bytes:

    magic "GSTK" | u32 version | u32 width | u32 block | u64 n_ids | u32 n_docs
    n_docs x (i64 first id, i64 n_ids)         where each document stands in the segment
    n_blocks x u64                             byte offset of each block of `block` ids in what follows
    packed ids, each block starting on a byte

so any id is found from its block's offset alone, and whole blocks are unpacked by numpy at once. Documents are in order
of doc_id (ties: hash of the text), a document lies in one segment, and the container of the segments is Parquet with
(part, segment, before, n_ids, doc_ids, payload), which Spark commits and reads wherever the shared folder is.

Texts are cut at ASCII white space, where this tokenizer's pieces always end, and each distinct word is encoded by the
library once for a slice of some MB of texts; the tokenizer is checked when loaded, and one that keeps white space or case
gets whole texts.

Null texts are encoded as empty ones, so they have the end id only. Null ids sort first and are kept. Repeated rows each
get a place. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.llm.common import ASCII_LOWER, new_path, table

MAGIC, VERSION = b"GSTK", 1
_HEAD = struct.Struct("<4sIIIQI")


def width_of(vocabulary: int) -> int:
    """The least bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, width: int) -> bytes:
    """ids as little-endian bit fields, the last byte filled up with zeros."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids[:, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def segment(docs: list[np.ndarray], width: int, block: int = 4096) -> bytes:
    """One segment with these documents' ids."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [packed(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1])).astype("<u8") if blocks else np.zeros(0, "<u8")
    index = np.stack([np.cumsum(sizes) - sizes, sizes], 1).astype("<i8")
    return b"".join([_HEAD.pack(MAGIC, VERSION, width, block, len(ids), len(docs)), index.tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """Random access to a segment's bytes."""

    def __init__(self, payload: bytes):
        magic, version, self.width, self.block, self.n_ids, self.n_docs = _HEAD.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.index = np.frombuffer(payload, "<i8", 2 * self.n_docs, at).reshape(-1, 2)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(payload, "<u8", n_blocks, at + self.index.nbytes)
        self.data = memoryview(payload)[at + self.index.nbytes + self.offsets.nbytes :]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the given one, touching only their blocks."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        if self.block * self.width % 8 == 0:  # full blocks stand end to end without padding
            have = min(self.n_ids, (last + 1) * self.block) - first * self.block
            out = unpacked(self.data[int(self.offsets[first]) :][: -(-have * self.width // 8)], have, self.width)
        else:
            out = np.concatenate([unpacked(self.data[int(self.offsets[b]) :][: -(-min(self.block, self.n_ids - b * self.block) * self.width // 8)], min(self.block, self.n_ids - b * self.block), self.width) for b in range(first, last + 1)])
        return out[start - first * self.block :][:n]

    def document(self, k: int) -> np.ndarray:
        return self.ids(*map(int, self.index[k]))


_END = "</w>"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The tokenizer; whether its pieces end at white space; which ids end a piece (by the mark of word ends)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    probe = "a b\tc\nd\r e  \x0b f A. b, c"
    whole = t.encode(probe, add_special_tokens=False).ids
    apart = whole == [i for w in probe.lower().replace(".", " .").replace(",", " ,").split() for i in t.encode(w, add_special_tokens=False).ids] and t.encode(" ", add_special_tokens=False).ids == []
    ends = np.zeros(t.get_vocab_size(with_added_tokens=True), bool)
    for token, i in t.get_vocab(with_added_tokens=True).items():
        ends[i] = token.endswith(_END)
    return t, apart, ends


def vocabulary(path: str) -> int:
    return _tokenizer(path)[0].get_vocab_size(with_added_tokens=True)


def _encoded_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, end to end, and how many each has.

    Words of letters alone are one piece each: many are encoded as one text and cut where a piece ends; if the
    number of ends is not that of the words, they are encoded one by one, as all other words are.
    """
    t, _, ends = _tokenizer(path)
    plain = pc.match_substring_regex(words, r"^\p{L}+$").to_numpy(zero_copy_only=False)
    listed = words.to_pylist()
    out: list[list[int] | np.ndarray | None] = [None] * len(listed)
    letters = np.flatnonzero(plain).tolist()
    rest = np.flatnonzero(~plain).tolist()
    for at in range(0, len(letters), 2000):
        some = letters[at : at + 2000]
        ids = np.array(t.encode(" ".join([listed[k] for k in some]), add_special_tokens=False).ids, np.uint32)
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) == len(some) and cut[-1] == len(ids):
            for k, a, b in zip(some, [0, *cut[:-1].tolist()], cut.tolist()):
                out[k] = ids[a:b]
        else:
            rest += some
    for at in range(0, len(rest), 2000):
        some = rest[at : at + 2000]
        for k, e in zip(some, t.encode_batch([listed[k] for k in some], add_special_tokens=False)):
            out[k] = np.array(e.ids, np.uint32)
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.array([len(x) for x in out], np.int64)


def encoded(texts: pa.Array, path: str) -> list[np.ndarray]:
    """The ids of every text (null: none): a table of its distinct words, joined back by position."""
    t, apart, _ = _tokenizer(path)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not apart or pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are looked for in raw text
        return [np.array(e.ids, np.uint32) for e in t.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    # A-Z to lower case, and a stop or comma after a letter and before a blank set apart: neither changes a piece
    texts = pa.array([x.translate(ASCII_LOWER) for x in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    texts = pc.replace_substring_regex(texts, r"([a-z])([.,])([ \n]|$)", r"\1 \2\3")
    words = pc.ascii_split_whitespace(texts)
    table_of = words.values.dictionary_encode()
    at = table_of.indices.to_numpy(zero_copy_only=False)
    ids, sizes = _encoded_words(table_of.dictionary, path)
    starts = np.cumsum(sizes) - sizes
    n = sizes[at]
    done = np.concatenate(([0], np.cumsum(n)))
    flat = ids[np.repeat(starts[at] - done[:-1], n) + np.arange(done[-1])]
    return np.split(flat, done[words.offsets.to_numpy()[1:-1]]) if len(texts) else []


def _slices(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about that many bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int | None = 1, segment_ids: int = 1 << 20, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs, append end_id, and write the segments in ascending doc_id order to the folder `out`.

    The texts are dealt by ranges of doc_id once, before they are encoded; parts are numbered in order of range.
    """
    spark = docs.sparkSession
    width = width_of(vocabulary(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("o", F.xxhash64("text")).repartitionByRange(n, "doc_id", "o").sortWithinPartitions("doc_id", "o")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        held: list[np.ndarray] = []
        names: list = []
        size, before, number, part, id_type = 0, 0, 0, None, None

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([segment(held, width, block)], pa.binary())],
                ["part", "segment", "before", "n_ids", "doc_ids", "payload"],
            )

        for whole in batches:
            id_type = whole.column(0).type
            for b in _slices(whole, 1):
                part = b.column(2)[0].as_py()
                for name, ids in zip(b.column(0).to_pylist(), encoded(b.column(1), path)):
                    held.append(np.concatenate((ids, tail)))
                    names.append(name)
                    size += len(held[-1])
                    if size >= segment_ids:
                        yield flushed()
                        held, names, before, size, number = [], [], before + size, 0, number + 1
        if held:
            yield flushed()

    ordered.mapInArrow(run, f"part int, segment int, before long, n_ids long, doc_ids array<{kind}>, payload binary").write.parquet(out)


def read_tokens(spark, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the folder: start counts the ids of all documents before it."""
    return _read(spark, folder, "ids array<long>", lambda ids: [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))])


def read_digests(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the files."""
    return _read(spark, folder, "n_tokens long, ids_crc32 long", lambda ids: [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())])


def _read(spark, folder: str, schema: str, made) -> DataFrame:
    stored = spark.read.parquet(folder)
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    # A segment knows the ids before it in its part; what stands before a part is a sum over the parts. There are as many
    # parts as the writer had shuffle partitions, 12 bytes each, which bounds what is broadcast.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = stored.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "payload")
    names = ["doc_id", "start", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                s = Segment(b.column(2)[k].as_py())
                docs = b.column(1)[k].values
                first = pa.array(b.column(0)[k].as_py() + s.index[:, 0], pa.int64())
                for at in range(0, s.n_docs, 2000):
                    ids = [s.document(i) for i in range(at, min(s.n_docs, at + 2000))]
                    yield pa.RecordBatch.from_arrays([docs.slice(at, 2000), first.slice(at, 2000), *made(ids)], names)

    return rows.mapInArrow(run, f"doc_id {kind}, start long, {schema}")


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    Null texts count as empty and have the end id alone; null ids come first; repeated rows each have a place, rows of one
    doc_id are in order of the hash of their text. An empty table gives no rows.
    """
    import public_tokenizers

    folder = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_digests(spark, folder)
