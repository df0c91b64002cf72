"""SimHash near-duplicates: fingerprints of word shingles, linked by sharded BK-trees.

A fingerprint has 64 bits; bit j is 1 if more than half of the shingles' XXH64 have it. Fingerprints at `radius`
or fewer differing bits are linked, and linked documents form components.

Finding the links: the bits are cut into `radius + 1` blocks, of which linked fingerprints share at least one, so the
leading bits of each block give a shard in which linked fingerprints meet. As many bits are used as leave a shard a few
hundred fingerprints, and each shard is one BK-tree (`shards` says what becomes of hot ones). A whole tree is never sent to
all executors, because the number of distinct fingerprints has no bound; what is dealt to a shard's task is its tree and
the queries that can meet it. A search follows only the edges whose distance is within the radius of the query's distance
to the node. A task reports a spanning forest of what it found, never all pairs.

Nulls and empty texts have no shingle and fingerprint zero, and link like any other. Rows with a null doc_id take part
in linking but never name a component (which is null if no member has an id). Repeated rows give repeated results.
Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.llm.common import ASCII_LOWER, packed_rows, table, unpacked_rows, written
from gapspark.llm.components import components

BITS = 64


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), 42)
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
    ends = ends[words - 1 :].tolist()
    n = len(ends)
    h = np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 4096):
        block = np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += block.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long with the same bits."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([text_fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return out.mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """A BK-tree over 64-bit values: a child hangs on the edge named by its Hamming distance to its parent."""

    def __init__(self, values: np.ndarray):
        self.values = values = np.ascontiguousarray(values, np.uint64)
        # All values descend together, a level at a time; of those that meet on a free edge the first becomes the child.
        q, at = np.arange(1, len(values)), np.zeros(max(0, len(values) - 1), np.int64)
        keys, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(q):
            edge = np.bitwise_count(values[q] ^ values[at]).astype(np.int64)
            key, first, of = np.unique(at * (BITS + 2) + edge, return_index=True, return_inverse=True)
            keys.append(key)
            kids.append(q[first])
            at = q[first][of]
            q, at = q[q != at], at[q != at]
        key, child = np.concatenate(keys), np.concatenate(kids)
        order = np.argsort(key)
        #: children in order of (parent, edge); first[p, e] is where p's children with an edge of e or more begin.
        self.child = child[order]
        self.first = np.searchsorted(key[order], np.arange(len(values) * (BITS + 2))).reshape(len(values), BITS + 2)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node) of every hit, following only edges within the radius."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        hit_q, hit_node = [q[:0]], [node[:0]]
        while len(q) and len(self.values):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit_q.append(q[d <= radius])
            hit_node.append(node[d <= radius])
            lo = self.first[node, np.maximum(d - radius, 0)]
            n = self.first[node, np.minimum(d + radius, BITS) + 1] - lo
            q, lo, n = q[n > 0], lo[n > 0], n[n > 0]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            node = self.child[np.repeat(lo, n) + within]
            q = np.repeat(q, n)
        return np.concatenate(hit_q), np.concatenate(hit_node)


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(tree: BKTree, queries: np.ndarray, parent: list[int], radius: int) -> list[tuple[int, int]]:
    """Unite the tree's nodes that a query connects; (query index, node) once per query that hit."""
    out = []
    for i in range(0, len(queries), 512):
        q, node = tree.within(queries[i : i + 512], radius)
        roots = np.array([_root(parent, x) for x in range(len(parent))], np.int64)[node]
        pairs = np.unique(q * len(parent) + roots)
        last = -1
        for p in pairs.tolist():
            at, root = divmod(p, len(parent))
            if at != last:
                out.append((i + at, root))
                last, held = at, root
            else:
                parent[_root(parent, root)] = _root(parent, held)
    return out


def _own_forest(tree: BKTree, parent: list[int], radius: int) -> None:
    """Unite the tree's nodes that are linked to each other.

    Nodes of the largest component so far are not searched for: their links to others are found from the others.
    """
    todo, step = np.arange(len(parent)), 64
    while len(todo):
        _forest(tree, tree.values[todo[:step]], parent, radius)
        todo, step = todo[step:], 512
        roots = np.array([_root(parent, x) for x in range(len(parent))], np.int64)
        todo = todo[roots[todo] != np.bincount(roots).argmax()]


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, a shard's tree nodes before its other queries."""
        key, nodes, tree, parent = None, [], None, []
        out_s: list[int] = []
        out_u: list[int] = []
        out_v: list[int] = []

        def link(u: int, v: int) -> None:
            out_s.append(key[0])
            out_u.append(u)
            out_v.append(v)

        def grown() -> None:
            nonlocal tree, parent
            if tree is None:
                tree = BKTree(np.concatenate(nodes))
                parent = list(range(len(tree.values)))
                _own_forest(tree, parent, radius)

        def ended() -> None:
            nonlocal tree, nodes, parent
            if nodes and (tree is not None or sum(map(len, nodes)) > 1):
                grown()
                plain = tree.values.tolist()
                for i, x in enumerate(plain):
                    if (r := _root(parent, i)) != i:
                        link(x, plain[r])
            tree, nodes, parent = None, [], []

        def flushed() -> pa.RecordBatch:
            arrays = [pa.array(out_s, pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (out_u, out_v))]
            for x in (out_s, out_u, out_v):
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, ["space", "u", "v"])

        for b in batches:
            space, route, sub, own, fp = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("space", "route", "sub", "own", "fp"))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((space[1:] != space[:-1]) | (route[1:] != route[:-1]) | (sub[1:] != sub[:-1]) | (own[1:] != own[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if lo == hi:
                    continue
                if key != (k := (int(space[lo]), int(route[lo]), int(sub[lo]))):
                    ended()
                    key = k
                if own[lo]:
                    nodes.append(fp[lo:hi])
                elif nodes:
                    grown()
                    plain = tree.values.tolist()
                    for i, node in _forest(tree, fp[lo:hi], parent, radius):
                        link(int(fp[lo + i]), plain[node])
            if len(out_u) > 50_000:
                yield flushed()
        ended()
        yield flushed()

    return run


def shards(fps: DataFrame, radius: int = 3, shard_nodes: int = 256, tree_nodes: int = 4096) -> DataFrame:
    """(space, route, sub, own, fp): the shards of fps(space, fp), each tree (sub) with its nodes (own = 1) and other queries.

    Of `radius + 1` blocks of bits linked fingerprints share at least one. Each block routes by its leading bits, so many
    that a shard has about `shard_nodes` fingerprints where they are spread evenly. A shard of more than `tree_nodes`
    is dealt again by the whole block and one of `radius + 1` blocks of the remaining bits, which linked fingerprints share
    for the same reason; where even that is too many, it becomes several trees, all of which its queries visit.
    """
    blocks = radius + 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    rest = BITS - (cuts[1] - cuts[0])
    inner = [rest * j // blocks for j in range(blocks + 1)]

    def bits(x: Column | str, lo: int, hi: int) -> Column:
        return F.shiftrightunsigned(x, lo).bitwiseAND((1 << (hi - lo)) - 1) if hi - lo < BITS else F.col(x)

    per_space = fps.groupBy("space").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    wide = min(cuts[1] - cuts[0], max(1, math.ceil(math.log2(max(1, per_space) / shard_nodes))))
    leading = [F.struct(F.lit(i).alias("i"), (bits("fp", cuts[i + 1] - wide, cuts[i + 1]) * blocks + i).alias("route")) for i in range(blocks)]
    routed = fps.select("space", "fp", F.explode(F.array(*leading)).alias("r")).select("space", "fp", "r.i", "r.route")
    hot = written(routed.groupBy("space", "route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_nodes).select("space", "route", F.lit(True).alias("hot")), "hot")
    plain = [F.lit(0).alias("sub"), F.lit(1).alias("own"), "fp"]
    if hot.first() is None:
        return routed.select("space", "route", *plain)
    marked = routed.join(hot, ["space", "route"], "left")
    # the remaining bits, end to end: those below the block and those above it
    others = [bits("fp", 0, cuts[i]) + F.shiftleft(bits("fp", cuts[i + 1], BITS), cuts[i]) if cuts[i + 1] < BITS else bits("fp", 0, cuts[i]) for i in range(blocks)]
    finer = F.array(*[F.xxhash64(F.lit(i), F.lit(j), bits("fp", cuts[i], cuts[i + 1]), bits(others[i], inner[j], inner[j + 1])) for i in range(blocks) for j in range(blocks)])
    again = marked.where("hot").select("space", "fp", F.explode(F.slice(finer, F.col("i") * blocks + 1, F.lit(blocks))).alias("route"))
    several = again.groupBy("space", "route").agg(F.ceil(F.count(F.lit(1)) / F.lit(tree_nodes)).cast("int").alias("trees")).where("trees > 1")
    dealt = again.join(written(several, "several"), ["space", "route"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    dealt = dealt.select("space", "route", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("sub"))
    dealt = dealt.select("space", "route", "sub", (F.col("mine") == F.col("sub")).cast("int").alias("own"), "fp")
    return marked.where("hot is null").select("space", "route", *plain).unionByName(dealt)


def links(fps: DataFrame, radius: int = 3, shard_nodes: int = 256, tree_nodes: int = 4096) -> DataFrame:
    """Edges (space, u, v) that connect exactly the distinct fingerprints of fps(fp) that chains of links connect.

    fps may have a whole number `space` besides: fingerprints of different spaces are never linked.
    """
    if "space" not in fps.columns:
        fps = fps.withColumn("space", F.lit(0))
    dealt = shards(fps.select("space", "fp"), radius, shard_nodes, tree_nodes)
    dealt = dealt.repartition("space", "route", "sub").sortWithinPartitions("space", "route", "sub", F.desc("own"))
    return dealt.mapInArrow(_shard_links(radius), "space int, u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach, the row's own included."""
    marked = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(fps.select("fp"), radius).select("u", "v"))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


# Near-duplicates by the similarity of shingle sets.

def _mixed(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    z = h + seed
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order; fewer words make one shingle, none make none."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))], np.uint64))


def signature(text: str | None, words: int, tables: int) -> bytes:
    """A content key (of the shingle set), then `tables` fingerprints of the set of distinct words, 8 bytes each."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    key = xxhash.xxh64_digest(b" ".join(w))[::-1]
    if not w:
        return key + bytes(8 * tables)
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in set(w)], np.uint64)
    seeds = np.array([t * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for t in range(tables)], np.uint64)
    ones = np.zeros(BITS * tables, np.int64)
    for i in range(0, len(h), 1024):
        mixed = _mixed(h[i : i + 1024, None], seeds)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return key + np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def _similar(sets: list[np.ndarray], similarity: float, chunk: int = 2048) -> np.ndarray:
    """Labels of the connected components of sets with at least that Jaccard similarity, all pairs compared exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    at = place[value]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((n, n), np.float32)
    for lo in range(0, len(shared), chunk):
        a, b = np.searchsorted(at, [lo, lo + chunk])
        held = np.zeros((n, chunk), np.float32)
        held[owner[a:b], at[a:b] - lo] = 1
        common += held @ held.T
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-3
    near |= np.eye(n, dtype=bool)
    labels = np.arange(n)
    while True:
        least = np.where(near, labels[None, :], n).min(axis=1)
        least = np.minimum(labels, least)[np.minimum(labels, least)]
        if (least == labels).all():
            return labels
        labels = least


def _least_common(n: int, similarity: float) -> int:
    """How many of its n shingles a set has in common with any set that _similar finds near."""
    return int(np.ceil(similarity * n - 1e-3))


def rare_shingles(texts: DataFrame, keys: DataFrame, words: int, similarity: float, bits: int = 1 << 24) -> DataFrame:
    """(_gs_key, h) so that any two keys whose sets have at least that Jaccard similarity have an h in common.

    A set of n shingles has at least c = ceil(similarity * n) in common with a near one. In whatever order all shingles are
    put, the first n - c + k of both sets then have k in common. First the order is that of the hashes and k a tenth of
    n (at least 1): a key with fewer shingles that another key also has among its first ones is done with (k is taken for
    a set of c shingles, the least that can be near). All shingles of the others are counted and put in order of their
    counts, so common passages come last, and k is 1. The others are told to the tasks as `bits` bits by hash of the row;
    rows let through by chance cost time and change nothing.
    """
    spark = texts.sparkSession
    size = bits

    def k_of(n: int) -> int:
        return max(1, n // 10)

    @F.pandas_udf("k int, hs array<long>")
    def first(text: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(t, words) for t in text]
        least = [_least_common(len(h), similarity) for h in sets]
        return pd.DataFrame({"k": [k_of(c) for c in least], "hs": [h[: len(h) - c + k_of(len(h))].view(np.int64) for h, c in zip(sets, least)]})

    def met(df: DataFrame) -> DataFrame:
        """df(_gs_key, h, ...) where another key has the same h; n_h is the number of rows with it."""
        same = Window.partitionBy("h")
        out = df.withColumns({"a": F.min("_gs_key").over(same), "b": F.max("_gs_key").over(same), "n_h": F.count(F.lit(1)).over(same)})
        return out.where("a <> b").drop("a", "b")

    firsts = texts.select("_gs_key", first("text").alias("f")).select("_gs_key", "f.k", F.explode("f.hs").alias("h"))
    shared_by = met(firsts).groupBy("_gs_key", "h").agg(F.first("k").alias("k")).groupBy("_gs_key").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("least"))
    alive = shared_by.where("n >= least").select(F.col("_gs_key").alias("k"))
    place = F.pmod(F.xxhash64("_gs_row"), F.lit(size))
    chosen = keys.join(alive, F.col("_gs_key") == F.col("k")).select(place.alias("p"))
    bitmap = np.zeros(size // 64, np.uint64)
    longs = chosen.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    found = longs.toPandas()  # size / 64 rows at most
    bitmap[found["w"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("array<long>")
    def whole(text: pd.Series, at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.uint64)
        held = shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
        return pd.Series([shingle_hashes(t, words).view(np.int64) if x else None for t, x in zip(text, held)], dtype=object)

    every = texts.select("_gs_key", whole("text", place).alias("s")).where("s is not null").select("_gs_key", F.size("s").alias("n"), F.explode("s").alias("h"))
    ranked = met(every).withColumn("r", F.dense_rank().over(Window.partitionBy("_gs_key").orderBy("n_h", "h")))
    held = ranked.withColumn("m", F.max("r").over(Window.partitionBy("_gs_key")))  # shingles that only this key has come before
    least = F.ceil(F.lit(float(similarity)) * F.col("n") - 1e-3)
    return written(held.where(F.col("r") <= F.col("m") - least + 1).select("_gs_key", "h").distinct(), "rare")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, tables: int = 2, radius: int = 3, block: int = 1024, block_bytes: int = 32 << 20, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows is a table of docs (struct doc) with _gs_row and _gs_key; classes is (_gs_key, class) of keys with near-duplicates.

    Documents are near-duplicates if the sets of their `words`-word shingles have a Jaccard similarity of `similarity`
    or more; classes are the components of this relation. Texts with the same words share a key. Candidates come from
    `tables` SimHash fingerprints of the set of distinct words, linked by BK-trees as above in each table, and from rare
    shingles in common (rare_shingles), which alone miss no pair: where one block of a text differs, the fingerprints are
    too far apart. Null and empty texts share a key, so one of them is kept; so do repeated rows and ties. An empty table
    gives empty results, and no name of a column of docs can clash. Candidate components are cut into blocks of about `block` keys or `block_bytes` of text, every pair of a component's blocks is
    one group, and all pairs in a group are compared exactly, so no candidate is taken on trust.
    """

    @F.pandas_udf("binary")
    def signed(text: pd.Series) -> pd.Series:
        return pd.Series([signature(t, words, tables) for t in text])

    body = F.col("doc").getField(text_col).cast("string")
    rows = packed_rows(docs).withColumn("_gs_sig", signed(body)).withColumn("_gs_row", F.monotonically_increasing_id())

    def number(i: int) -> Column:
        return F.conv(F.hex(F.expr(f"substring(_gs_sig, {8 * i + 1}, 8)")), 16, -10).cast("long")

    rows = written(rows.withColumn("_gs_key", number(0)).withColumn("_gs_bytes", F.coalesce(F.octet_length(body), F.lit(0))), "signed")
    keys = rows.groupBy("_gs_key").agg(F.min("_gs_row").alias("_gs_row"), F.first("_gs_sig").alias("_gs_sig"), F.max("_gs_bytes").alias("_gs_bytes"))
    tabled = keys.select("_gs_key", F.explode(F.array(*[F.struct(F.lit(t).alias("space"), number(t + 1).alias("fp")) for t in range(tables)])).alias("x")).select("_gs_key", "x.space", "x.fp")
    tabled = written(tabled, "tables")
    found = links(tabled.groupBy("space", "fp").agg(F.count(F.lit(1)).alias("n")), radius)
    found = written(found, "links")

    def node(fp: str) -> Column:
        return F.xxhash64("space", fp)

    ends = found.select("space", F.col("u").alias("fp")).unionByName(found.select("space", F.col("v").alias("fp")))
    several = tabled.groupBy("space", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("space", "fp")
    linked = ends.unionByName(several).distinct()
    spokes = tabled.join(linked, ["space", "fp"]).select(F.col("_gs_key").alias("u"), node("fp").alias("v"))
    rare = rare_shingles(rows.select("_gs_row", "_gs_key", body.alias("text")), keys, words, similarity).select(F.col("_gs_key").alias("u"), F.xxhash64(F.lit("shingle"), "h").alias("v"))
    rooted = components(spokes.unionByName(found.select(node("u").alias("u"), node("v").alias("v"))).unionByName(rare))
    members = keys.select("_gs_key", "_gs_row", "_gs_bytes").join(rooted, F.col("_gs_key") == F.col("node")).select("_gs_key", "_gs_row", "_gs_bytes", "root")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("_gs_bytes").alias("bytes")).where("n > 1")
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("n") / F.lit(block), F.least(F.col("n"), F.col("bytes") / F.lit(block_bytes)))).cast("int").alias("blocks"))
    members = written(members.join(sizes, "root").withColumn("b", F.pmod(F.xxhash64("_gs_key"), F.col("blocks")).cast("int")), "members")
    wanted = members.select(F.col("_gs_row").alias("r"), "_gs_key", "root", "blocks", "b").hint("merge")  # alike at every size, and may spill
    texts = rows.select("_gs_row", body.alias("text")).join(wanted, F.col("_gs_row") == F.col("r"))

    @F.pandas_udf("binary")
    def hashes(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, words).tobytes() for t in text])

    texts = texts.select("root", "_gs_key", "blocks", "b", hashes("text").alias("s"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    dealt = texts.select("root", "_gs_key", "s", "b", other).select("root", "_gs_key", "s", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        key = group["_gs_key"].to_numpy()
        label = _similar([np.frombuffer(x, np.uint64) for x in group["s"]], similarity)
        rest = label != np.arange(len(label))
        return pd.DataFrame({"u": key[rest], "v": key[label[rest]]})

    edges = dealt.groupBy("root", "i", "j").applyInPandas(compare, "u long, v long")
    classes = components(edges).select(F.col("node").alias("_gs_key"), F.col("root").alias("class"))
    return rows, classes


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each class the row of least doc_id stays (nulls last; of repeated rows, the first)."""
    rows, classes = similar_documents(docs, **options)
    narrow = rows.select("_gs_row", "_gs_key", F.col("doc").getField("doc_id").alias("id")).join(classes, "_gs_key", "left")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_gs_row")).alias("m")
    kept = narrow.groupBy(F.coalesce("class", "_gs_key").alias("c")).agg(first).select(F.col("m._gs_row").alias("k")).hint("merge")
    return unpacked_rows(rows.join(kept, F.col("_gs_row") == F.col("k"), "left_semi"), docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    Null and empty texts and texts without words have fingerprint zero and are linked; repeated rows are repeated; a null doc_id
    is linked but names no component. An empty table gives no rows.
    """
    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
