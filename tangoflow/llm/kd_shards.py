"""Shards of near equal bytes by k-d tree partitioning over metadata.

All documents are one node; a node that must still become several shards is
split at its weighted median (by bytes) along its widest dimension, until
every leaf has its share, the target bytes of a shard.  Dimensions are a
document's numbers (on a log scale), its categories (hashed, so that any
number of them costs nothing) and its key, each scaled to ``COORD_BITS`` bits
over the whole table.  All nodes of a level are split together.

A median is found by refinement, never by a sort: the split key of a document
is (coordinate, digest of its text, hash of its key), ``DIGITS`` digits of
``BITS`` bits, and one aggregation per digit gives the bytes of at most
``2 ** BITS`` bins a node, among those that hold the median so far.  A node is
done as soon as a border between bins is near enough.  What reaches the driver
is bins times nodes of a level, whatever the table's size.

Documents with equal texts are a group: they take the metadata of the group's
first document (smallest key), so they have one split key up to its last part
and share a shard, unless keeping them together would move a cut by more than
``SLACK`` of the node's bytes; such a group (one that may hold a third of all
rows) is cut between its documents, by hashes of their keys and rows.

Texts are read once, for their size, checksum and digest; all else moves some
tens of bytes a document.  Groups are aggregated partially; hot ones (fewer
than ``HOT`` of them) are broadcast, the others of several documents joined.

Cases: a null text has no bytes and size 1, an empty one too; null metadata
are a value of their own (below all others); a null key is the smallest; repeated rows
are documents of one group; an empty table gives no rows; texts of any length
are sized whole and never split; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangoflow.llm.common import materialise

BITS = 10  # of a digit: bins of one refinement
COORD_BITS = 20
PARTS = (COORD_BITS, 40, 40)  # bits of coordinate, digest and key hash in the split key
DIGITS = sum(PARTS) // BITS
GROUP_DIGITS = (PARTS[0] + PARTS[1]) // BITS
SLACK = 0.001  # of a node's bytes that a cut may miss its place, for the sake of a group
FINE = 0.0001  # and where a group is cut
HOT = 1024
SHARDS = 16


# ---- documents as points -----------------------------------------------

def _scaled(value: Column, lo: Column, hi: Column) -> Column:
    """A number in 1 .. 2**COORD_BITS - 1, 0 if it is null."""
    span = hi - lo
    at = F.when(span > 0, (value - lo) / span).otherwise(0.0)
    return F.coalesce(F.floor(at * ((1 << COORD_BITS) - 2)).cast("long") + 1, F.lit(0).cast("long"))


def _category(value: Column) -> Column:
    hashed = F.pmod(F.xxhash64(F.lit("kd"), value.cast("string")), F.lit((1 << COORD_BITS) - 1)) + 1
    return F.when(value.isNull(), 0).otherwise(hashed).cast("long")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", numbers: tuple[str, ...] = ("n_chars",),
          categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """key, size, text_crc32, digest (of the text) and the metadata."""
    data = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    nulled = F.when(docs[text].isNull(), 0).otherwise(1)
    return docs.select(
        docs[key].alias("key"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"),
        F.xxhash64(nulled, data).alias("digest"), *[docs[n].cast("double").alias(f"n{i}") for i, n in enumerate(numbers)],
        *[docs[n].alias(f"c{i}") for i, n in enumerate(categories)])


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with the metadata of their text's first document.  A text that
    has over 1 in ``HOT`` of all rows is joined by broadcast (there are fewer
    than ``HOT`` of them), and its rows are spread over the other join."""
    c = F.col
    meta = [n for n in rows.columns if n not in ("size", "text_crc32", "digest", "key")]
    first = rows.groupBy("digest").agg(F.min(F.struct("key", *meta)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(first, "kd-groups")
    total = rows.count()
    hot = first.where(c("n") * HOT > total).select("digest", c("first").alias("hot"))
    j = rows.join(F.broadcast(hot), "digest", "left")
    j = j.withColumn("spread", c("hot").isNotNull())
    j = j.withColumn("at", F.when(c("spread"), F.xxhash64(F.monotonically_increasing_id())).otherwise(c("digest")))
    rest = first.where(c("n") * HOT <= total).select(c("digest").alias("at"), F.lit(False).alias("spread"), "first")
    j = j.join(rest, ["at", "spread"], "left").withColumn("of", F.coalesce("hot", "first"))
    return j.select("key", c("of.key").alias("group_key"), c("of").isNotNull().alias("copied"), "size", "text_crc32", "digest",
                    *[F.when(c("of").isNull(), c(n)).otherwise(c(f"of.{n}")).alias(n) for n in meta])


def points(rows: DataFrame) -> tuple[DataFrame, int]:
    """key, size, text_crc32, one coordinate ``x<k>`` per dimension, and the two
    tails of the split key; the number of dimensions."""
    c = F.col
    numbers = [n for n in rows.columns if n.startswith("n") and n[1:].isdigit()]
    categories = [n for n in rows.columns if n.startswith("c") and n[1:].isdigit()]
    whole = rows.schema["key"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    joined = materialise(grouped(rows), "kd-grouped")
    own = F.when(c("copied"), c("group_key")).otherwise(c("key"))
    logged = {n: F.log1p(F.greatest(c(n), F.lit(0.0))) for n in numbers}
    if whole:
        logged["own"] = own.cast("double")
    ranges = joined.agg(*[f(v).alias(f"{n}_{f.__name__}") for n, v in logged.items() for f in (F.min, F.max)]).first()
    bound = lambda n, f: F.lit(ranges[f"{n}_{f}"]).cast("double")
    x = [_scaled(v, bound(n, "min"), bound(n, "max")) for n, v in logged.items()] + [_category(c(n)) for n in categories]
    tail = lambda v, bits: F.pmod(v, F.lit(1 << bits)).cast("long")
    out = joined.select("key", "size", "text_crc32", *[v.alias(f"x{k}") for k, v in enumerate(x)],
                        tail(c("digest"), PARTS[1]).alias("t1"), tail(F.xxhash64(F.lit("kd"), "key", F.monotonically_increasing_id()), PARTS[2]).alias("t2"))
    return materialise(out, "kd-points"), len(x)


# ---- splitting ---------------------------------------------------------

@dataclass
class Node:
    """A node of the tree: ``shards`` leaves from ``first`` on.  ``dim`` and
    ``cut`` (the digits of the first split key on the right) are set once it is split."""

    first: int
    shards: int
    dim: int = -1
    cut: tuple[int, ...] = ()


def _digit(dim: Column, dims: int, d: int) -> Column:
    """Digit ``d`` of the split key along the dimension in column ``dim``."""
    bit = d * BITS
    for part, (bits, value) in enumerate(zip(PARTS, (None, F.col("t1"), F.col("t2")), strict=True)):
        if bit < bits:
            v = F.get(F.array(*[f"x{k}" for k in range(dims)]), dim) if part == 0 else value
            return F.shiftright(v, bits - bit - BITS).bitwiseAND((1 << BITS) - 1).cast("int")
        bit -= bits
    raise ValueError(d)


def _key_columns(dim: Column, dims: int) -> Column:
    """The split key along ``dim`` as a comparable struct."""
    x = F.get(F.array(*[f"x{k}" for k in range(dims)]), dim)
    return F.struct(x.alias("x"), F.col("t1").alias("t1"), F.col("t2").alias("t2"))


def _cut_struct(cut: tuple[int, ...]) -> Column:
    """The smallest split key that begins with the digits ``cut``."""
    digits = [*cut, *[0] * (DIGITS - len(cut))]
    out, d = [], 0
    for bits, name in zip(PARTS, ("x", "t1", "t2"), strict=True):
        v = 0
        for _ in range(bits // BITS):
            v = (v << BITS) + digits[d]
            d += 1
        out.append(F.lit(v).cast("long").alias(name))
    return F.struct(*out)


def _by_node(node: Column, values: dict[int, Column]) -> Column:
    """A column by node; there are fewer nodes than shards."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.element_at(table, node)


def _widest(placed: DataFrame, open_: list[Node], dims: int) -> dict[int, tuple[int, int]]:
    """By node: its widest dimension and its bytes."""
    some = placed.where(F.col("node").isin([n.first for n in open_]))
    rows = some.groupBy("node").agg(F.sum("size").alias("size"), *[
        (F.max(f"x{k}") - F.min(f"x{k}")).alias(f"w{k}") for k in range(dims)]).collect()
    return {r["node"]: (max(range(dims), key=lambda k: (r[f"w{k}"], -k)), r["size"]) for r in rows}


def split_level(placed: DataFrame, open_: list[Node], dims: int) -> list[Node]:
    """Splits all ``open_`` nodes of a level; returns those that have documents."""
    wide = _widest(placed, open_, dims)
    nodes = [n for n in open_ if n.first in wide]
    todo, before, prefix = {}, {}, {}
    for n in nodes:
        n.dim, total = wide[n.first]
        todo[n.first], before[n.first], prefix[n.first] = (n, total, total * (n.shards // 2) / n.shards), 0, ()
    for d in range(DIGITS):
        if not todo:
            break
        c = F.col
        dim = _by_node(c("node"), {k: F.lit(n.dim) for k, (n, _, _) in todo.items()})
        here = placed.where(c("node").isin(list(todo))).withColumn("__dim", dim)
        for e in range(d):  # the digits found so far
            here = here.where(_digit(c("__dim"), dims, e) == _by_node(c("node"), {k: F.lit(prefix[k][e]) for k in todo}))
        bins = here.groupBy("node", _digit(c("__dim"), dims, d).alias("bin")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        by_node: dict[int, list] = {}
        for r in bins:
            by_node.setdefault(r["node"], []).append((r["bin"], r["size"], r["n"]))
        for k in list(todo):
            n, total, want = todo[k]
            some = sorted(by_node[k])
            sums = before[k] + np.cumsum([0] + [s for _, s, _ in some])  # bytes left of each bin, and of the end
            j = min(int(np.searchsorted(sums, want, side="right")) - 1, len(some) - 1)  # the bin that holds the median
            low, high = want - sums[j], sums[j + 1] - want
            near = min(low, high) <= (SLACK if d < GROUP_DIGITS else FINE) * total or some[j][2] == 1 or d == DIGITS - 1
            if near and low <= high:
                n.cut = (*prefix[k], some[j][0])
            elif near and some[j][0] + 1 < 1 << BITS:
                n.cut = (*prefix[k], some[j][0] + 1)
            elif near:  # the border is that of the digit before
                n.cut = _next(prefix[k])
            else:
                prefix[k], before[k] = (*prefix[k], some[j][0]), int(sums[j])
                continue
            del todo[k]
    return nodes


def _next(prefix: tuple[int, ...]) -> tuple[int, ...]:
    """The digits after all keys that begin with ``prefix``."""
    out = list(prefix)
    while out and out[-1] + 1 == 1 << BITS:
        out.pop()
    return (*out[:-1], out[-1] + 1) if out else (1 << BITS,)


def tree(rows: DataFrame, dims: int, shards: int = SHARDS) -> tuple[DataFrame, list[Node]]:
    """``rows`` with ``node``, their shard, and the nodes that were split."""
    placed = rows.withColumn("node", F.lit(0))
    open_, done = [Node(0, shards)], []
    while open_ := [n for n in open_ if n.shards > 1]:
        split = split_level(placed, open_, dims)
        done += split
        if not split:
            break
        dim = _by_node(F.col("node"), {n.first: F.lit(n.dim) for n in split})
        right = _key_columns(dim, dims) >= _by_node(F.col("node"), {n.first: _cut_struct(n.cut) for n in split})
        moved = _by_node(F.col("node"), {n.first: F.lit(n.first + n.shards // 2) for n in split})
        placed = placed.withColumn("node", F.when(F.coalesce(right, F.lit(False)), moved).otherwise(F.col("node")))
        placed = materialise(placed, "kd-nodes")
        open_ = [half for n in split for half in (Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2))]
    return placed, done


# ---- slots -------------------------------------------------------------

def slotted(placed: DataFrame) -> DataFrame:
    """``placed`` with ``slot``, gapless from 0 in each shard (``node``):
    numbered inside the partitions, whose counts are then summed."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    names = placed.columns
    where = names.index("node")

    def run(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            shard = batch.column(where).to_numpy(zero_copy_only=False)
            at = np.empty(len(shard), dtype=np.int64)
            for s in np.unique(shard).tolist():
                on = np.flatnonzero(shard == s)
                at[on] = seen.get(s, 0) + np.arange(len(on))
                seen[s] = seen.get(s, 0) + len(on)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part), pa.int64()), pa.array(at)],
                                             names=[*names, "part", "at"])

    known = materialise(placed.mapInArrow(run, f"{fields}, part long, at long"), "kd-numbered")
    counts = known.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select("node", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "kd-offsets")
    return known.join(offsets, ["node", "part"]).withColumn("slot", F.col("before") + F.col("at")).drop("before", "part", "at")


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", numbers: tuple[str, ...] = ("n_chars",),
           categories: tuple[str, ...] = ("lang", "source"), target_bytes: int | None = None, count: int = SHARDS) -> DataFrame:
    """key, size, text_crc32, shard, slot.  ``target_bytes`` (if given) sets
    the number of shards: as many as the whole needs at that size."""
    rows = materialise(sized(docs, key, text, numbers, categories), "kd-sizes")
    if target_bytes:
        whole = rows.agg(F.sum("size")).first()[0] or 0
        count = max(1, -(-whole // target_bytes))
    found, dims = points(rows)
    placed, _ = tree(found, dims, count)
    return slotted(placed.select("key", "size", "text_crc32", "node")).select(
        F.col("key").alias(key), "size", "text_crc32", F.col("node").cast("int").alias("shard"), "slot")
