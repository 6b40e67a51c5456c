"""Hard-negative mining over rotated one-bit codes.

Vectors become integers (``floor(256 * x)``) and scores are their integer
inner products.  The index holds, for every vector, ``STAGES`` one-bit codes:
the vector is turned by a random rotation and the signs of its components are
its code, a unit vector; the *alignment* (inner product of vector and code) is
stored, and what the code does not explain, the residual, is turned by the
next rotation and coded in the same way.  The norm of the last residual is
stored too.  So a vector is ``sum(alignment_k * code_k) + residual``.

An anchor's rotated components are cut into ``PLANES`` bit planes.  Its inner
product with a code is estimated by popcounts of code and planes, and the
Cauchy-Schwarz inequality bounds what is missing, deterministically: the
residual's norm times the anchor's, and the alignments times the norms of the
planes' rounding errors.  A pair whose interval holds no score that the anchor
still asks for is dropped unscored; the pairs that survive are scored in
integers.  The filter drops no pair that belongs into the result, so the
result is exact.

Work is dealt in tiles: anchors (a stated set, such as every hundredth row)
and rows are packed in blocks of bounded bytes, and a tile meets a few blocks
of each.  A tile keeps the best rows of each anchor and returns no others; the
tiles' results are ranked by Spark.  Two passes: the positives, then, with
their scores, the negatives.

Cases: rows with a null label, vector or id, or a null or non-finite
component, take no part; rows that repeat in id, label and vector are one row;
different rows of one id are rows of their own; vectors of different lengths
don't meet; empty vectors and zero vectors score 0; equal scores are ordered
by id; scores beyond a long are compared exactly and written as the nearest
long; an anchor without positives, or a positive without negatives, has no
rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangoflow.llm.common import materialise

SCALE = 256
STAGES = 5
PLANES = 8
BLOCK_BYTES = 1 << 21
BLOCK_ROWS = 4096
ANCHOR_ROWS = 512
TILE = (2, 8)  # blocks of rows and of anchors that meet in a tile
STRIP = 32  # anchors whose intervals with a block are computed at a time
SEED = 71
LONG = (1 << 63) - 1


# ---- codes -------------------------------------------------------------

@functools.lru_cache(maxsize=32)
def rotation(dim: int, stage: int) -> np.ndarray:
    """A random orthogonal matrix."""
    g = np.random.Generator(np.random.PCG64([SEED, dim, stage]))
    q, r = np.linalg.qr(g.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, dim = bits.shape
    padded = np.zeros((n, -(-dim // 64) * 64), dtype=np.uint8)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


@np.errstate(over="ignore", invalid="ignore")
def encode(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (vectors x stages x words), alignments and residual norms."""
    n, dim = z.shape
    rest, codes, along = z.astype(np.float64), [], []
    for k in range(STAGES):
        turn = rotation(dim, k)
        turned = rest @ turn.T
        bits = turned >= 0
        sign = np.where(bits, 1.0, -1.0) / np.sqrt(dim)
        a = (turned * sign).sum(axis=1)
        codes.append(words(bits))
        along.append(a)
        rest = rest - a[:, None] * (sign @ turn)
    return np.stack(codes, axis=1), np.stack(along, axis=1), np.sqrt((rest * rest).sum(axis=1))


class Anchors:
    """Bit planes of anchors' rotated components, and the norms that bound."""

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, z: np.ndarray) -> None:
        q, dim = z.astype(np.float64), z.shape[1]
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.planes, self.low, self.step, self.total, self.error = [], [], [], [], []
        for k in range(STAGES):
            turned = q @ rotation(dim, k).T
            low = turned.min(axis=1, keepdims=True)
            step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
            u = np.rint((turned - low) / step).astype(np.int64)
            off = turned - (low + step * u)
            self.planes.append(np.stack([words((u >> j) & 1 == 1) for j in range(PLANES)], axis=1))
            self.low.append(low[:, 0])
            self.step.append(step[:, 0])
            self.total.append(u.sum(axis=1))
            self.error.append(np.sqrt((off * off).sum(axis=1)))
        self.dim = dim

    @np.errstate(over="ignore", invalid="ignore")
    def intervals(self, on: slice, codes: np.ndarray, along: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of the anchors ``on`` with all coded vectors."""
        n, dim = len(codes), self.dim
        mid = np.zeros((len(self.norm[on]), n))
        wide = self.norm[on][:, None] * rest[None, :]
        for k in range(STAGES):
            planes, code = self.planes[k][on], codes[:, k]
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
            hits = np.zeros(mid.shape, dtype=np.int64)
            for j in range(PLANES):
                for w in range(code.shape[1]):
                    hits += np.bitwise_count(planes[:, j, w][:, None] & code[:, w][None, :]).astype(np.int64) << j
            low, step, total = (x[k][on][:, None] for x in (self.low, self.step, self.total))
            product = (low * (2 * ones - dim)[None, :] + step * (2 * hits - total)) / np.sqrt(dim)
            mid += product * along[:, k][None, :]
            wide += np.abs(along[:, k])[None, :] * self.error[k][on][:, None]
        size = np.sqrt((along * along).sum(axis=1) + rest * rest)
        wide += 1e-9 * self.norm[on][:, None] * size[None, :] + 1e-6  # rounding of the doubles
        unknown = ~np.isfinite(mid) | ~np.isfinite(wide)  # overflow: nothing is known
        return np.where(unknown, -np.inf, mid - wide), np.where(unknown, np.inf, mid + wide)


# ---- exact scores ------------------------------------------------------

def scores(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Integer inner products of the paired rows: in doubles or longs where
    those are exact, else in Python integers."""
    i, j = pairs
    if not len(i):
        return np.empty(0, dtype=np.int64)
    if a.dtype == object or b.dtype == object:
        return np.array([sum(int(x) * int(y) for x, y in zip(a[p], b[q], strict=True)) for p, q in zip(i, j, strict=True)], dtype=object)
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        a, b = a.astype(np.float64), b.astype(np.float64)
        if len(i) * 4 > len(a) * len(b):
            return (a @ b.T)[i, j].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", a[i[k:k + 65536]], b[j[k:k + 65536]]) for k in range(0, len(i), 65536)]).astype(np.int64)
    if most < 1 << 62:
        return np.concatenate([np.einsum("ij,ij->i", a[i[k:k + 65536]], b[j[k:k + 65536]]) for k in range(0, len(i), 65536)])
    return scores(a.astype(object), b, pairs)


def within(score: np.ndarray, positive: int) -> np.ndarray:
    """Which scores are from 80 % of the positive's to all of it."""
    if score.dtype != object and max(abs(positive), int(np.abs(score).max(initial=0))) < 1 << 55:
        return (100 * score >= 80 * positive) & (score <= positive)
    return np.array([100 * int(x) >= 80 * positive and int(x) <= positive for x in score], dtype=bool)


def sortable(score: int) -> str:
    """A text that sorts like the integer, of any size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{''.join(str(9 - int(d)) for d in digits)}"


def as_double(x: int, down: int = 0) -> float:
    """An integer as a double (infinite if none is as large); with ``down``
    a little smaller, so that rounding can't lift it over a bound."""
    try:
        y = float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf
    return y - down * (1e-12 * abs(y) + 1e-6)


class Best:
    """Per (anchor, place) the ``k`` best rows so far: score, then smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def offer(self, key, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score) > self.k and score.dtype != object:
            on = np.lexsort((rows, ids, -score))[:self.k]
            score, ids, rows = score[on], ids[on], rows[on]
        some = [(-int(s), i, r) for s, i, r in zip(score, ids.tolist(), rows.tolist(), strict=True)]
        self.held[key] = sorted(self.held.get(key, []) + some)[:self.k]

    def least(self, key) -> int | None:
        """The k-th best score, if there are k."""
        held = self.held.get(key, [])
        return -held[-1][0] if len(held) == self.k else None


# ---- the index ---------------------------------------------------------

INDEX = ("row long, dim int, n int, ids binary, labels binary, rows binary, z binary, wide boolean, codes binary, along binary, rest binary")
INDEX_TYPES = pa.schema([("row", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                         ("rows", pa.binary()), ("z", pa.binary()), ("wide", pa.bool_()), ("codes", pa.binary()), ("along", pa.binary()),
                         ("rest", pa.binary())])


def usable(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """id, label, v: the rows that take part, each once; components as
    floored multiples, in doubles."""
    v = rows[vector]
    fine = rows[key].isNotNull() & label.isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(SCALE)) < float("inf")))
    whole = F.transform(v, lambda x: _floored(x) + F.lit(0.0))  # minus zero is zero
    return rows.where(F.coalesce(fine, F.lit(False))).select(
        rows[key].cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v")).distinct()


def _floored(x: Column) -> Column:
    """floor(SCALE * x) as a double, also where that is beyond a long."""
    y = x.cast("double") * float(SCALE)
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)


def _integers(v: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """Rows of whole doubles as longs, or as Python integers if they need it."""
    x = np.array(v, dtype=np.float64).reshape(len(v), -1)
    if np.abs(x).max(initial=0.0) < 2.0**31:
        return x.astype(np.int64), False
    return np.array([[int(y) for y in r] for r in x], dtype=object).reshape(x.shape), True


def _packed(z: np.ndarray, wide: bool) -> bytes:
    """Wide ones as doubles, which hold them exactly."""
    return z.astype("<f8" if wide else "<i4").tobytes()


def _unpacked(data: bytes, dim: int, n: int, wide: bool) -> np.ndarray:
    x = np.frombuffer(data, dtype="<f8" if wide else "<i4").reshape(n, dim)
    return _integers(list(x))[0] if wide else x.astype(np.int64)


def index(rows: DataFrame) -> DataFrame:
    """Blocks of (id, label, v) rows with their codes, written."""

    def block(held: list[tuple], first: int, dim: int) -> pa.RecordBatch:
        ids, labels, vs = zip(*held, strict=True)
        z, wide = _integers(list(vs))
        codes, along, rest = encode(z.astype(np.float64)) if dim else (np.empty((len(vs), STAGES, 0)), np.zeros((len(vs), STAGES)), np.zeros(len(vs)))
        as_bytes = [np.array(ids, dtype="<i8"), np.array(labels, dtype="<i8"), first + np.arange(len(ids), dtype="<i8")]
        return pa.RecordBatch.from_pylist([dict(zip(INDEX_TYPES.names, (
            first, dim, len(ids), *[x.tobytes() for x in as_bytes], _packed(z, wide), wide, codes.astype("<u8").tobytes(),
            along.astype("<f8").tobytes(), rest.astype("<f8").tobytes()), strict=True))], schema=INDEX_TYPES)

    def run(batches):
        at, held = TaskContext.get().partitionId() << 40, {}
        for batch in batches:
            values, offsets = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
            for i, (ident, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                v = values[offsets[i]:offsets[i + 1]]
                some = held.setdefault(len(v), [])
                some.append((ident, label, v.copy()))
                if len(some) >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * len(v) + 8))):
                    yield block(held.pop(len(v)), at, len(v))
                    at += len(some)
        for dim, some in held.items():
            yield block(some, at, dim)
            at += len(some)

    return materialise(rows.mapInArrow(run, INDEX), "negatives-index")


class Rows:
    """A block of the index."""

    def __init__(self, r: dict) -> None:
        n, dim = r["n"], r["dim"]
        self.n, self.dim = n, dim
        self.ids, self.labels, self.rows = (np.frombuffer(r[k], dtype="<i8") for k in ("ids", "labels", "rows"))
        self.z = _unpacked(r["z"], dim, n, r["wide"])
        self.codes = np.frombuffer(r["codes"], dtype="<u8").reshape(n, STAGES, -1)
        self.along = np.frombuffer(r["along"], dtype="<f8").reshape(n, STAGES)
        self.rest = np.frombuffer(r["rest"], dtype="<f8")


# ---- tiles -------------------------------------------------------------

ASKED = "row long, dim int, n int, ids binary, labels binary, rows binary, z binary, wide boolean, floors array<array<string>>"


def anchors(blocks: DataFrame, every: int) -> DataFrame:
    """row, dim, id, label, z, wide of the indexed rows whose id ``every`` divides."""
    schema = pa.schema([("row", pa.int64()), ("dim", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("z", pa.binary()), ("wide", pa.bool_())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Rows(r)
                on = np.flatnonzero(b.ids % every == 0)
                yield pa.RecordBatch.from_pylist([{"row": int(b.rows[i]), "dim": b.dim, "id": int(b.ids[i]), "label": int(b.labels[i]),
                                                   "z": _packed(b.z[i], r["wide"]), "wide": r["wide"]} for i in on], schema=schema)

    return blocks.mapInArrow(run, "row long, dim int, id long, label long, z binary, wide boolean")


def _asked(asking: DataFrame, name: str) -> DataFrame:
    """Anchors (with ``floors``, what they ask for) packed into blocks."""
    schema = pa.schema([("row", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                        ("rows", pa.binary()), ("z", pa.binary()), ("wide", pa.bool_()), ("floors", pa.list_(pa.list_(pa.string())))])

    def block(some: list[dict]) -> pa.RecordBatch:
        dim, wide = some[0]["dim"], some[0]["wide"]
        of = lambda k: np.array([r[k] for r in some], dtype="<i8").tobytes()
        return pa.RecordBatch.from_pylist([{"row": some[0]["row"], "dim": dim, "n": len(some), "ids": of("id"), "labels": of("label"),
                                            "rows": of("row"), "z": b"".join(r["z"] for r in some), "wide": wide,
                                            "floors": [r["floors"] for r in some]}], schema=schema)

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                some = held.setdefault((r["dim"], r["wide"]), [])
                some.append(r)
                if len(some) >= min(ANCHOR_ROWS, max(1, BLOCK_BYTES // (8 * r["dim"] + 8))):
                    yield block(held.pop((r["dim"], r["wide"])))
        for some in held.values():
            yield block(some)

    # few anchors should not be spread over many blocks: each block meets every block of rows
    n = asking.count()
    return materialise(asking.repartition(max(1, -(-n // (ANCHOR_ROWS * 4)))).mapInArrow(run, ASKED), name)


def _tiled(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of rows and of anchors, dealt so that each pair of equal length
    meets in one tile; in a tile the anchors come first."""
    c = F.col
    groups = lambda df, per: materialise(df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("own")), "negatives-tiles")
    rows_in, asked_in = groups(blocks, TILE[0]), groups(asked, TILE[1])
    number = F.pmod(F.xxhash64(F.lit("tile"), "row"), c("own")).cast("int")
    other = lambda df: df.withColumnRenamed("own", "other")
    none = lambda t: F.lit(None).cast(t)
    left = blocks.join(rows_in, "dim").join(other(asked_in), "dim").withColumns({"__no": number, "__a": F.explode(F.expr("sequence(0, other - 1)"))})
    right = asked.join(asked_in, "dim").join(other(rows_in), "dim").withColumns({"__no": number, "__b": F.explode(F.expr("sequence(0, other - 1)"))})
    tile = lambda a, b: F.xxhash64("dim", a, b).alias("tile")
    held = ("row", "dim", "n", "ids", "labels", "rows", "z", "wide")
    rows = left.select(tile("__a", "__no"), F.lit(1).alias("side"), *held, "codes", "along", "rest", none("array<array<string>>").alias("floors"))
    asks = right.select(tile("__no", "__b"), F.lit(0).alias("side"), *held, *[none("binary").alias(x) for x in ("codes", "along", "rest")], "floors")
    return rows.unionByName(asks).repartition("tile").sortWithinPartitions("tile", "side")


FOUND = "anchor_row long, anchor_id long, place int, row long, id long, score string, at string, nearest long"
FOUND_TYPES = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("id", pa.int64()),
                         ("score", pa.string()), ("at", pa.string()), ("nearest", pa.int64())])


def _meet(asked: dict, q: np.ndarray, planes: Anchors, b: Rows, best: Best, same: bool, k: int) -> tuple[int, int]:
    """Offers a block's rows to a block of anchors.  ``same``: rows of the
    anchor's label (but itself) are asked for, else rows of other labels whose
    score is within one of the anchor's windows (``windows``: scores of its
    positives).  Returns the numbers of pairs asked for and scored."""
    asked_for = scored = 0
    labels, own, windows = asked["labels"], asked["rows"], asked["windows"]
    for lo in range(0, len(q), STRIP):
        on = slice(lo, min(lo + STRIP, len(q)))
        fit = (labels[on][:, None] == b.labels[None, :]) == same
        if same:
            fit &= own[on][:, None] != b.rows[None, :]
        low, high = planes.intervals(on, b.codes, b.along, b.rest) if b.dim else (np.zeros(fit.shape),) * 2
        asked_for += int(fit.sum())
        for i in range(fit.shape[0]):
            a = lo + i
            if same:
                floor = best.least((a, 0))
                at = fit[i].nonzero()[0]
                bound = -np.inf if floor is None else as_double(floor, 1)
                if floor is None and len(at) > k:  # the k-th largest lower bound is surely reached
                    bound = np.partition(low[i][at], len(at) - k)[len(at) - k]
                fit[i] &= high[i] >= bound
            else:
                some = np.zeros(b.n, dtype=bool)
                for place, p in enumerate(windows[a]):
                    least = best.least((a, place))
                    floor = max(as_double(-(-4 * p // 5), 1), -np.inf if least is None else as_double(least, 1))
                    some |= (high[i] >= floor) & (low[i] <= as_double(p, -1))
                fit[i] &= some
        i, j = np.nonzero(fit)
        scored += len(i)
        exact = scores(q[on], b.z, (i, j))
        ends = np.searchsorted(i, np.arange(fit.shape[0] + 1))
        for r in range(fit.shape[0]):
            s, at = exact[ends[r]:ends[r + 1]], j[ends[r]:ends[r + 1]]
            if same:
                best.offer((lo + r, 0), s, b.ids[at], b.rows[at])
                continue
            for place, p in enumerate(windows[lo + r]):
                in_ = within(s, p)
                best.offer((lo + r, place), s[in_], b.ids[at[in_]], b.rows[at[in_]])
    return asked_for, scored


def _searched(blocks: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each tile by anchor and place."""

    def run(batches):
        held, now = [], None

        def found():
            out = []
            for asked_, best in held:
                for (a, place), some in best.held.items():
                    out += [{"anchor_row": int(asked_["rows"][a]), "anchor_id": int(asked_["ids"][a]), "place": place, "row": r, "id": i,
                             "score": str(-s), "at": sortable(-s), "nearest": max(-LONG, min(LONG, -s))} for s, i, r in some]
            return pa.RecordBatch.from_pylist(out, schema=FOUND_TYPES)

        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                if r["tile"] != now:
                    if held:
                        yield found()
                    held, now = [], r["tile"]
                if r["side"] == 0:
                    z = _unpacked(r["z"], r["dim"], r["n"], r["wide"])
                    asked_ = {x: np.frombuffer(r[x], dtype="<i8") for x in ("ids", "labels", "rows")}
                    asked_ |= {"windows": [[int(p) for p in f or []] for f in r["floors"]], "q": z, "planes": Anchors(z) if r["dim"] else None}
                    held.append((asked_, Best(k)))
                    continue
                b = Rows(r)
                for asked_, best in held:
                    _meet(asked_, asked_["q"], asked_["planes"], b, best, same, k)
        if held:
            yield found()

    return _tiled(blocks, asked).mapInArrow(run, FOUND)


def _ranked(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The first ``k`` of each group: higher scores, then smaller ids."""
    c = F.col
    w = Window.partitionBy(*by).orderBy(c("at").desc(), c("id"), c("row"))
    return materialise(found.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k), name)


def mine(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, every: int = 100,
         positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score for all anchors (rows whose id ``every`` divides)."""
    c = F.col
    blocks = index(usable(rows, key, vector, rows["label"] if label is None else label))
    asking = materialise(anchors(blocks, every), "negatives-asking")
    bare = asking.withColumn("floors", F.array().cast("array<string>"))
    first = _ranked(_searched(blocks, _asked(bare, "negatives-asked"), True, positives), ["anchor_row"], positives, "positives")
    per = first.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    with_floors = asking.join(per, asking["row"] == per["anchor_row"]).select(*asking.columns, c("p.score").alias("floors"))
    again = _asked(with_floors, "negatives-asked")
    second = _ranked(_searched(blocks, again, False, negatives), ["anchor_row", "place"], negatives, "negatives")
    p = first.select("anchor_row", (c("rank") - 1).alias("place"), c("id").alias("positive_id"), c("nearest").alias("positive_score"))
    return second.join(p, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", c("rank").cast("int").alias("rank"), c("id").alias("negative_id"), "positive_score",
        c("nearest").alias("negative_score"))
