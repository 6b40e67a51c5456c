"""A Merkle manifest of a data set, its subtrees in van Emde Boas layout.

Every row is a leaf, the leaves of a source form a 16-ary tree, and the
sources' roots form the tree above them.  A tree is cut into aligned blocks
of ``LEVELS`` hash levels (4,096 leaves); a block is one row of the manifest,
its digests stored by the van Emde Boas rule: split at half height, the top
part first, then each subtree below it, the parts again by the same rule.  The
same address arithmetic (``addresses``) places the digests when a block is
built and finds the siblings of a leaf when it is proved.  The blocks' roots
are the leaves of the next layer, built by the same function, so a tree of n
leaves takes log(n) / log(4096) rounds.

A leaf's place in its tree is its rank by key.  It comes from a range
partitioning by (source, key), so a source that holds a third of all rows is
many tasks: rows are numbered inside their partition and the partitions'
counts (one row per partition and source) are summed.  Blocks are grouped by
(tree, block), at most 4,096 rows; no source is ever gathered.

Proofs: the sibling path above a block is the same for all its leaves.  Paths
go down from layer to layer with the block rows, and the rows of a block meet
it to take their own path and fold it.

Cases: null columns hash as ``-``; a null source is a tree of its own, first;
null keys come first in their tree; rows that repeat a key follow each other
by leaf digest, equal ones in any order (their leaves are alike); a source of
one row has its leaf as root, and so has a table of one source; texts are
hashed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangoflow.llm.common import materialise

FAN = 16
LEVELS = 3  # hash levels of a block
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = ""  # the tree of the sources' roots


# ---- leaves ------------------------------------------------------------

def record_hash(values: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else byte count, ``:``, value."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]), 256)


def tree_of(source: Column) -> Column:
    """A key without nulls that sorts like the source, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", source: str = "source",
           altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """tree, key, digest of every row and ``other``: the digest of the rows
    that ``where`` selects with the columns in ``altered`` replaced (null for
    the rest).  Reads the texts once."""
    of = lambda put: F.unhex(record_hash([put.get(x, docs[x]) for x in columns]))
    other = F.when(where, of(altered)) if altered else F.lit(None).cast("binary")
    return docs.select(tree_of(docs[source]).alias("tree"), docs[key].alias("key"), of({}).alias("digest"), other.alias("other"))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# ---- places ------------------------------------------------------------

def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place of a row in its tree by ``order`` (from
    0), and ``m``, the tree's number of rows.  Ties are split between
    partitions by a row number."""
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    numbered = materialise(numbered, "merkle-rows")
    by = ["tree", *order, "__row"]
    spread = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("__row")
    names = spread.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            trees = batch.column(0).to_pylist()
            places = []
            for t in trees:
                held, at = (t, at + 1) if t == held else (t, 0)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(trees), pa.int64()), pa.array(places, pa.int64())],
                                             names=[*names, "part", "at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema.fields)
    known = materialise(spread.mapInArrow(run, f"{fields}, part long, at long"), "merkle-places")
    counts = known.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"),
                                        F.sum("n").over(whole).alias("m")), "merkle-offsets")
    return known.join(offsets, ["tree", "part"]).withColumn("i", F.col("__before") + F.col("at")).drop("__before", "part", "at")


# ---- the layout of a block ---------------------------------------------

def full_size(height: int) -> int:
    """Nodes of a complete tree of ``height`` node levels."""
    return (FAN**height - 1) // (FAN - 1)


@functools.cache
def addresses(height: int) -> list[np.ndarray]:
    """By depth: the addresses of the nodes, left to right, in the layout of a
    complete tree of ``height`` node levels."""
    if height == 1:
        return [np.zeros(1, dtype=np.int64)]
    top = height // 2
    upper, lower = addresses(top), addresses(height - top)
    starts = full_size(top) + np.arange(FAN**top) * full_size(height - top)
    return upper + [(starts[:, None] + below[None, :]).ravel() for below in lower]


def levels_of(m: int) -> int:
    """Hash levels of a tree of ``m`` leaves."""
    n = 0
    while m > 1:
        m, n = -(-m // FAN), n + 1
    return n


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


class Block:
    """A subtree of ``levels`` hash levels over up to ``FAN ** levels`` digests."""

    def __init__(self, levels: int, counts: list[int], store: bytes | bytearray) -> None:
        self.levels, self.counts, self.store = levels, counts, store

    @staticmethod
    def counted(levels: int, n: int) -> list[int]:
        """Number of nodes by level, from the leaves up."""
        out = [n]
        for _ in range(levels):
            out.append(-(-out[-1] // FAN))
        return out

    @classmethod
    def build(cls, levels: int, digests: list[bytes]) -> Block:
        counts, where = cls.counted(levels, len(digests)), addresses(levels + 1)
        last = max(int(where[levels - k][n - 1]) for k, n in enumerate(counts))
        block = cls(levels, counts, bytearray(32 * (last + 1)))
        for i, d in enumerate(digests):
            block.put(0, i, d)
        for k in range(1, levels + 1):
            for i in range(counts[k]):
                block.put(k, i, sha(block.run(k - 1, i)))
        return block

    def at(self, level: int, i: int) -> int:
        return 32 * int(addresses(self.levels + 1)[self.levels - level][i])

    def put(self, level: int, i: int, digest: bytes) -> None:
        a = self.at(level, i)
        self.store[a:a + 32] = digest

    def get(self, level: int, i: int) -> bytes:
        a = self.at(level, i)
        return bytes(self.store[a:a + 32])

    def run(self, level: int, parent: int) -> bytes:
        """The children of a node as hex text, left to right."""
        lo = parent * FAN
        return b"".join(self.get(level, i) for i in range(lo, min(lo + FAN, self.counts[level]))).hex().encode()

    def runs(self) -> list[list[bytes]]:
        """All runs by level; a leaf's siblings are slices of them."""
        return [[self.run(k, p) for p in range(self.counts[k + 1])] for k in range(self.levels)]


def siblings(runs: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of leaf ``i`` and of its ancestors."""
    out = []
    for level in runs:
        run, at = level[i // FAN], 64 * (i % FAN)
        out.append((run[:at], run[at + 64:]))
        i //= FAN
    return out


def pack_path(path: list[tuple[bytes, bytes]]) -> bytes:
    """Per level the number of digests on the left and on the right, then they."""
    return b"".join(struct.pack("BB", len(a) // 64, len(b) // 64) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpack_path(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(data):
        a, b = data[at], data[at + 1]
        text = data[at + 2:at + 2 + 32 * (a + b)].hex().encode()
        out.append((text[:64 * a], text[64 * a:]))
        at += 2 + 32 * (a + b)
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    node = digest.hex().encode()
    for left, right in path:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


# ---- the manifest ------------------------------------------------------

MANIFEST = "tree string, layer int, block long, levels int, n int, m long, root binary, store binary"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Whole (tree, block) groups of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            if held and keys[lo] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[lo]
            held.append(batch.slice(lo, hi - lo))
            lo = hi
    if held:
        yield key, pa.Table.from_batches(held)


def _layer(nodes: DataFrame, layer: int) -> DataFrame:
    """Blocks over nodes (tree, i, m, digest)."""

    def run(batches):
        for (tree, block), t in _grouped(batches):
            m = t.column("m")[0].as_py()
            levels = min(LEVELS, levels_of(m))
            b = Block.build(levels, t.column("digest").to_pylist())
            yield pa.RecordBatch.from_pylist([{"tree": tree, "layer": layer, "block": block, "levels": levels, "n": t.num_rows,
                                               "m": m, "root": b.get(levels, 0), "store": bytes(b.store)}], schema=schema)

    schema = pa.schema([("tree", pa.string()), ("layer", pa.int32()), ("block", pa.int64()), ("levels", pa.int32()),
                        ("n", pa.int32()), ("m", pa.int64()), ("root", pa.binary()), ("store", pa.binary())])
    cut = nodes.select("tree", F.floor(F.col("i") / BLOCK).alias("block"), "i", "m", "digest")
    sorted_ = cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return sorted_.mapInArrow(run, MANIFEST)


def forest(nodes: DataFrame) -> list[DataFrame]:
    """The block tables of all trees, layer by layer, each written."""
    out, layer = [], 0
    while True:
        out.append(materialise(_layer(nodes, layer), "merkle-blocks"))
        blocks = out[-1].where(F.col("m") > BLOCK)
        if blocks.isEmpty():
            return out
        nodes = blocks.select("tree", F.col("block").alias("i"), F.ceil(F.col("m") / BLOCK).alias("m"), F.col("root").alias("digest"))
        layer += 1


def roots(layers: list[DataFrame]) -> DataFrame:
    """tree, root."""
    tops = [x.where(F.col("m") <= BLOCK).select("tree", F.col("root").alias("digest")) for x in layers]
    return functools.reduce(DataFrame.unionByName, tops)


def _handed_down(blocks: DataFrame) -> DataFrame:
    """From blocks with ``above`` (the path over their root): tree, i, above
    of each of their leaves."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["levels"], Block.counted(r["levels"], r["n"]), r["store"])
                runs = b.runs()
                above = [pack_path(siblings(runs, i)) + r["above"] for i in range(r["n"])]
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * r["n"], pa.string()),
                                                  pa.array([r["block"] * BLOCK + i for i in range(r["n"])], pa.int64()),
                                                  pa.array(above, pa.binary())], names=["tree", "i", "above"])

    return blocks.select("tree", "block", "levels", "n", "store", "above").mapInArrow(run, "tree string, i long, above binary")


def with_paths(layers: list[DataFrame], tops: DataFrame) -> list[DataFrame]:
    """``layers`` with ``above``; ``tops`` has the path over each tree's root
    (tree, above)."""
    out: list[DataFrame] = []
    for x in reversed(layers):
        own = x.where(F.col("m") <= BLOCK).join(tops, "tree")
        if out:
            down = _handed_down(out[0]).withColumnRenamed("i", "block")
            own = own.unionByName(x.where(F.col("m") > BLOCK).join(down, ["tree", "block"]).select(*own.columns))
        out.insert(0, materialise(own, "merkle-paths"))
    return out


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", source: str = "source",
             altered: dict[str, Column] | None = None, where: Column | None = None) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """The placed leaves, the layers of the sources' trees and those of the
    tree above them, all written."""
    rows = materialise(placed(leaves(docs, columns, key, source, altered, where), ["key", "digest"]), "merkle-leaves")
    layers = forest(rows.select("tree", "i", "m", "digest"))
    subroots = roots(layers).select(F.lit(TOP).alias("tree"), F.col("tree").alias("sub"), "digest")
    top_rows = materialise(placed(subroots, ["sub"]), "merkle-subroots")
    return rows, layers, [top_rows, *forest(top_rows.select("tree", "i", "m", "digest"))]


PROVED = ("key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def proved(rows: DataFrame, layers: list[DataFrame], top: list[DataFrame]) -> DataFrame:
    """Every row's proof, folded from ``other`` where there is one, else from
    its own digest, and held against the root."""
    spark = rows.sparkSession
    top_rows, *top_layers = top
    head = roots(top_layers).first()  # one digest
    if head is None:
        return spark.createDataFrame([], PROVED.format(key=rows.schema["key"].dataType.simpleString()))
    text = bytes(head["digest"]).hex()
    first = spark.createDataFrame([(TOP, bytearray())], "tree string, above binary")
    down = _handed_down(with_paths(top_layers, first)[0]).withColumnRenamed("above", "__above")
    over = top_rows.join(down, ["tree", "i"]).select(F.col("sub").alias("tree"), F.col("__above").alias("above"))
    over = materialise(over, "merkle-over")
    blocks = with_paths(layers, over)[0].join(top_rows.select(F.col("sub").alias("tree"), F.col("digest").alias("subroot")), "tree")
    # block rows and leaf rows meet by (tree, block); the block row comes first
    kind = rows.schema["key"].dataType
    none = lambda t: F.lit(None).cast(t)
    as_block = blocks.select("tree", "block", F.lit(-1).cast("long").alias("i"), none(kind).alias("key"), none("binary").alias("digest"),
                             none("binary").alias("other"), "levels", "n", "store", "above", "subroot")
    as_rows = rows.select("tree", F.floor(F.col("i") / BLOCK).alias("block"), "i", "key", "digest", "other", none("int").alias("levels"),
                          none("int").alias("n"), none("binary").alias("store"), none("binary").alias("above"),
                          none("binary").alias("subroot"))
    met = as_block.unionByName(as_rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "i")

    def run(batches):
        runs, above, tail, sub = [], [], b"", ""
        for batch in batches:
            of = {f: batch.column(f).to_pylist() for f in ("i", "key", "digest", "other")}
            keys, out = [], []
            for j, i in enumerate(of["i"]):
                if i < 0:
                    r = batch.slice(j, 1).to_pylist()[0]
                    runs = Block(r["levels"], Block.counted(r["levels"], r["n"]), r["store"]).runs()
                    above = unpack_path(r["above"])
                    tail, sub = b"".join(a + b for a, b in above), r["subroot"].hex()
                    continue
                own = siblings(runs, i % BLOCK)
                digest = of["digest"][j]
                folded = fold(of["other"][j] or digest, own + above).decode()
                proof = hashlib.sha256(b"".join(a + b for a, b in own) + tail).hexdigest()
                keys.append(of["key"][j])
                out.append((digest.hex(), sub, text, proof, folded, folded == text))
            if out:
                strings = [pa.array(c, pa.string()) for c in list(zip(*out, strict=True))[:5]]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), *strings,
                                                  pa.array([x[5] for x in out], pa.bool_())],
                                                 names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return met.mapInArrow(run, PROVED.format(key=kind.simpleString()))


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of all rows of ``documents``; where 5 divides the key's CRC-32,
    from a leaf whose text was lower-cased (A to Z)."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    rows, layers, top = manifest(docs, altered={"text": lowered(docs["text"])}, where=F.coalesce(hit, F.lit(False)))
    return proved(rows, layers, top).withColumnRenamed("key", "doc_id")
