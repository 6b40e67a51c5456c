"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors at cosine ``c`` are ``sqrt(2 - 2c)`` apart.  A table hashes
a vector by ``HASHES`` projections on Gaussian directions, shifted and cut
into steps of ``STEP``; ``TABLES`` tables make a pair at the threshold miss
all buckets with probability under 3e-4, pairs above it with less (see ``miss``).  Vectors that share a
bucket are compared exactly, in double precision.

Equal vectors of a label are hashed once.  A bucket is dealt in blocks of
about ``BLOCK`` vectors, and pairs of blocks are compared, so a hot bucket is
many bounded tasks.  A linked pair counts in the first table where the two
meet, so no pair is ever emitted or shuffled: a block comparison returns one
row per vector, with its number of links there and the smallest vector that
it reached by links inside the comparison.

Cases: null vectors, vectors with null or non-finite components, zero
vectors and vectors with a null label or a null id link with nothing; vectors of different
lengths don't compare; repeated rows (same id and vector) are copies of each
other and count as links; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangoflow.llm.common import materialise
from tangoflow.llm.components import components

LEAST_COSINE = 0.93
STEP = 1.6
HASHES = 12
TABLES = 96
BLOCK = 512
SHORT = 24  # rows of a run up to which its pairs are compared row by row
SEED = 20240229


def collision(distance: float, step: float = STEP) -> float:
    """Probability that one projection puts two points into the same step."""
    if distance <= 0:
        return 1.0
    r = step / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def miss(cosine: float = LEAST_COSINE) -> float:
    """Probability that a pair at this cosine meets in no table."""
    p = collision(math.sqrt(max(0.0, 2 - 2 * cosine)))
    return (1 - p**HASHES) ** TABLES


@functools.lru_cache(maxsize=8)
def _projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64([SEED, dim]))
    k = TABLES * HASHES
    return g.standard_normal((dim, k)), g.uniform(0, STEP, k), g.integers(1, 2**63 - 1, HASHES, dtype=np.int64) | 1


def bucket_keys(unit: np.ndarray) -> np.ndarray:
    """Keys (vectors x tables) of unit vectors."""
    a, b, mult = _projections(unit.shape[1])
    q = np.floor((unit @ a + b) / STEP).astype(np.int64).reshape(len(unit), TABLES, HASHES)
    with np.errstate(over="ignore"):
        return (q * mult).sum(axis=2) ^ (q[:, :, 0] >> 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64, copy=False)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distinct_vectors(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, label, v: null if it links with nothing), and the
    distinct (label, v) with their smallest id and number of rows."""
    c = F.col
    v = c(vector)
    fine = (c(key).isNotNull() & c(label).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    # minus zero and zero are one component value
    plain = F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    out = rows.select(c(key).alias("id"), c(label).alias("label"), F.when(F.coalesce(fine, F.lit(False)), plain).alias("v"))
    one = out.where(c("v").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return out, one


def _hashed(reps: DataFrame) -> DataFrame:
    """rep, label, dim and the key of each table."""
    kind = reps.schema["rep"].dataType.simpleString()
    label = reps.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                vs = part.column(2).to_pylist()
                keys: list = [None] * len(vs)
                for dim in {len(x) for x in vs}:
                    at = [i for i, x in enumerate(vs) if len(x) == dim]
                    for i, k in zip(at, bucket_keys(_unit(np.array([vs[i] for i in at]))), strict=True):
                        keys[i] = k.tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in vs], pa.int32()),
                                                  pa.array(keys, pa.list_(pa.int64()))],
                                                 names=["rep", "label", "dim", "keys"])

    return reps.select("rep", "label", "v").mapInArrow(run, f"rep {kind}, label {label}, dim int, keys array<long>")


def _pairs(x: np.ndarray, run_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the same run (rows of a run are neighbours) at or above
    the cosine: row by row at each distance for short runs, as matrix products
    for long ones."""
    n = len(x)
    start = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1]))
    size = np.diff(np.append(start, n))
    out = [(np.empty(0, dtype=np.int64),) * 2]
    length = np.repeat(size, size)
    left = np.repeat(start + size, size) - np.arange(n)  # rows to the end of the run
    for gap in range(1, min(SHORT, int(size.max(initial=1)))):
        i = np.flatnonzero((length <= SHORT) & (left > gap))
        i = i[np.einsum("ij,ij->i", x[i], x[i + gap]) >= LEAST_COSINE]
        out.append((i, i + gap))
    for s, m in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        for lo in range(s, s + m, 256):
            i, j = np.nonzero(x[lo:min(lo + 256, s + m)] @ x[lo:s + m].T >= LEAST_COSINE)
            out.append((i[j > i] + lo, j[j > i] + lo))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _compare(t: pa.Table) -> pa.Table:
    """Links inside complete runs: those of pairs whose first common table is
    the run's.  Per vector the linked rows, and the smallest vector reached."""
    ids, copies, table, blk = (t.column(c).to_numpy() for c in ("rep", "copies", "t", "blk"))
    x = _unit(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
    run_of, crossed = t.column("run").to_numpy(), t.column("crossed").to_numpy(zero_copy_only=False)
    label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    p, q = _pairs(x, run_of)
    fit = (~crossed[p] | (blk[p] != blk[q])) & (label[p] == label[q])
    p, q = p[fit], q[fit]
    own = []
    for at in range(0, len(p), 8192):
        i, j = p[at:at + 8192], q[at:at + 8192]
        rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = bucket_keys(x[rows])
        own.append((keys[back[:len(i)]] == keys[back[len(i):]]).argmax(axis=1) == table[i])
    own = np.concatenate(own) if own else np.empty(0, dtype=bool)
    p, q = p[own], q[own]
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, p, copies[q])
    np.add.at(links, q, copies[p])
    order = np.argsort(ids, kind="stable")
    low = np.empty(len(ids), dtype=np.int64)
    low[order] = np.arange(len(ids))
    while len(p):  # spread the smallest vector's place along the links
        before = low.copy()
        np.minimum.at(low, p, low[q])
        np.minimum.at(low, q, low[p])
        if (before == low).all():
            break
    on = np.flatnonzero(links)
    return pa.table({"rep": ids[on], "links": links[on], "root": ids[order[low[on]]]})


def linked(reps: DataFrame, hashed: DataFrame) -> DataFrame:
    """rep, links (linked rows, summed per comparison) and root (the smallest
    vector reached in that comparison)."""
    c = F.col
    member = hashed.select("rep", "label", "dim", F.posexplode("keys").alias("t", "k"))
    bucket = ["label", "dim", "t", "k"]
    sizes = member.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(c("m") / BLOCK).cast("int")
    placed = member.join(sizes, bucket).select(
        "rep", *bucket, blocks.alias("blocks"), F.pmod(F.xxhash64("rep", F.lit(SEED)), blocks).cast("int").alias("blk"))
    # a bucket of one block is one comparison; in others a vector goes to every pair of blocks that has its own
    dealt = placed.select("rep", *bucket, "blk", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("other"))
    run = F.xxhash64(*bucket, F.least("blk", "other"), F.greatest("blk", "other")).alias("run")
    dealt = dealt.select("rep", "t", "blk", run, (c("blk") != c("other")).alias("__own"), "other")
    full = dealt.join(reps.select("rep", "label", "v", "copies", F.size("v").alias("dim")), "rep")
    full = full.select("rep", "label", "v", "copies", "dim", "t", "blk", c("__own").alias("crossed"), "run")
    spread = full.repartition("run").sortWithinPartitions("run", "dim")
    kind = hashed.schema["rep"].dataType.simpleString()

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            run_, dim = batch.column("run").to_numpy(), batch.column("dim").to_numpy()
            ends = np.flatnonzero((run_[1:] != run_[:-1]) | (dim[1:] != dim[:-1])) + 1
            if held and batch.num_rows and (held[-1].column("run")[-1].as_py(), held[-1].column("dim")[-1].as_py()) != (
                    run_[0], dim[0]):
                yield from _several(held)
                held = []
            if len(ends):
                yield from _several([*held, batch.slice(0, int(ends[-1]))])
                held = [batch.slice(int(ends[-1]))]
            else:
                held.append(batch)
        yield from _several(held)

    return spread.mapInArrow(compare, f"rep {kind}, links long, root {kind}")


def _several(batches: list[pa.RecordBatch]):
    """Compare complete runs; vectors of different lengths apart."""
    if not sum(b.num_rows for b in batches):
        return
    t = pa.Table.from_batches(batches)
    for dim in np.unique(t.column("dim").to_numpy()):
        yield from _compare(t.filter(pc.equal(t.column("dim"), int(dim)))).to_batches()


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept: one row per input row."""
    c = F.col
    all_, one = distinct_vectors(rows, key, vector, label)
    reps = materialise(one, "vectors")
    found = materialise(linked(reps, materialise(_hashed(reps), "vector-keys")), "vector-links")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "root").select(c("node").alias("rep"), "root")
    per = reps.join(degree, "rep", "left").join(roots, "rep", "left").select(
        "label", "v", (c("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = all_.join(per, ["label", "v"], "left").select(
        c("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", c(key).eqNullSafe(c("component_id")))
