"""Near-duplicates by BagMinHash signatures of word-shingle multisets.

A shingle of weight ``c`` (its number of occurrences) owns Poisson processes
over the weight axis, cut into (0, 1], (1, 2], (2, 4], (4, 8], ...; points of
a process carry a time, a register and a height, and count if the height is at
most ``c``.  A register keeps its earliest point, so two documents agree in a
register with probability sum(min) / sum(max), the weighted Jaccard
similarity.  Points are drawn in order of time and only until every register
of the document is settled, so heavy weights and long texts cost no more than
their first points.

Documents with equal words are one text, a node.  Registers are banded; each
bucket has a leader, its text that meets the most others in all buckets, and
every text is compared with the leaders it meets, by exact multiset overlap.
The texts of a leader's buckets are its group.  Components over the links give
classes; a group that still holds several classes is open, and its strays, the
texts of another class than the leader's, may be linked with members other
than the leader.  They are found by longer signatures (``LONG_REGISTERS``):
inside bounded blocks, strays are held against the members of other classes,
and only pairs that the long signatures don't rule out become rows, are
verified, and join the components.  A text moves once to its own place and
once for each leader it meets.

Buckets and groups are salted: a hot one is many tasks, each with a copy of
its leader.

Cases: null and empty texts link with nothing; texts of fewer words than a
shingle are one shingle; repeated rows and copies share a class; a class's id
is its smallest id that is not null, so rows with a null id join their text's
class, and several texts of one id are several nodes; texts are used whole,
and batches of them are bounded by bytes; an empty table gives an empty
result; extra columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangoflow.llm.common import Scratch, materialise, words_of
from tangoflow.llm.components import components

SHINGLE = 5
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: A pair of similarity 0.8 is in no common bucket with probability (1 - 0.8 ** 5) ** 30 = 7e-6.
SIMILAR = (8, 10)
#: Signature agreement below which a pair of 0.8 falls with probability under 1e-5, for short and long signatures.
LEAST_AGREEMENT = 0.65
LONG_REGISTERS = 600
LEAST_LONG = 0.73
BLOCK = 1024  # members of an open group that meet as many others in one comparison
SALT = 256  # rows of a bucket or group to a salt
BATCH_BYTES = 1 << 22
DRAWS = 8
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # ASCII white space: what ends a word


def shingles(ws: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all shingles, in order, with repetitions."""
    import xxhash

    if not ws:
        return np.empty(0, dtype=U64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in ws], dtype=U64)
    n = max(1, len(ws) - width + 1)
    out = np.zeros(n, dtype=U64)
    for k in range(min(width, len(ws))):
        out = _mix(out + h[k:k + n] + U64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
    return out


def _draw(x: np.ndarray, k: int) -> np.ndarray:
    return _mix(x + U64((0xD1B54A32D192ED03 * (k + 1)) & (2**64 - 1)))


def _exponential(h: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return -np.log(((h >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate


def signatures(bags: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Register times (documents x registers) of bags of shingle hashes."""
    n_docs = len(bags)
    regs = np.full(n_docs * registers, np.inf)
    size = np.array([len(b) for b in bags], dtype=np.int64)
    doc = np.repeat(np.arange(n_docs), size)
    x = np.concatenate(bags) if n_docs else np.empty(0, dtype=U64)
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    first = np.ones(len(x), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(x)))
    doc, x = doc[at], x[at]
    # the processes: one per shingle and interval of the weight axis that begins below its weight
    p_doc, p_seed, p_low, p_rate, p_count = [doc], [_mix(x)], [np.zeros(len(x), dtype=np.int64)], [np.ones(len(x))], [count]
    level = 1
    while len(on := np.flatnonzero(count > 2 ** (level - 1))):
        low = 2 ** (level - 1)
        p_doc.append(doc[on])
        p_seed.append(_mix(x[on] + U64(level)))
        p_low.append(np.full(len(on), low))
        p_rate.append(np.full(len(on), float(low)))
        p_count.append(count[on])
        level += 1
    doc, seed, low, rate, count = map(np.concatenate, (p_doc, p_seed, p_low, p_rate, p_count))
    until = registers * (np.log(registers) + 3.0) / np.maximum(size, 1)
    todo = np.flatnonzero(size > 0)
    while len(todo):
        live = np.zeros(n_docs, dtype=bool)
        live[todo] = True
        on = np.flatnonzero(live[doc])
        time = np.zeros(len(on))
        k = 0
        while len(on):
            many = 1 if k == 0 else DRAWS
            for j in range(k, k + many):
                h = _draw(seed[on], j)
                time = time + _exponential(h, rate[on])
                g = _mix(h ^ U64(0xA0761D6478BD642F))
                lo = low[on]
                width = np.maximum(rate[on].astype(np.int64), 1).astype(U64)
                height = lo + 1 + ((g >> U64(32)) % width).astype(np.int64)
                hit = np.flatnonzero((time <= until[doc[on]]) & (height <= count[on]))
                np.minimum.at(regs, doc[on[hit]] * registers + ((g[hit] & U64(0xFFFFFFFF)) % U64(registers)).astype(np.int64),
                              time[hit])
            k += many
            go = np.flatnonzero(time <= until[doc[on]])
            on, time = on[go], time[go]
        open_ = ~np.isfinite(regs.reshape(n_docs, registers)[todo]).all(axis=1)
        todo = todo[open_]
        until[todo] *= 2.0
    return regs.reshape(n_docs, registers)


def short(regs: np.ndarray) -> np.ndarray:
    """16 bits per register."""
    return (_mix(np.ascontiguousarray(regs).view(U64)) >> U64(48)).astype("<u2")


def _bounded(texts: list[str | None]) -> Iterator[slice]:
    """Slices of at most 512 texts and, but for single ones, BATCH_BYTES characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo == 512 or size + len(t or "") > BATCH_BYTES):
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield slice(lo, len(texts))


def digest_of(text: Column) -> Column:
    """What ``signed`` calls the digest: of a text's words, null if it has none."""
    ws = words_of(text)
    return F.when(F.size(ws) > 0, F.unhex(F.md5(F.array_join(ws, " ").cast("binary"))))


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, digest of its words (null: no word), number of shingles,
    16 bits per register."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in _bounded(texts):
                ws = [words(t) for t in texts[part]]
                bags = [shingles(w) for w in ws]
                sig = short(signatures(bags))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(part.start, part.stop - part.start),
                    pa.array([hashlib.md5(b" ".join(w), usedforsecurity=False).digest() if w else None for w in ws], pa.binary()),
                    pa.array([len(b) for b in bags], pa.int64()),
                    pa.array([s.tobytes() if w else None for s, w in zip(sig, ws, strict=True)], pa.binary()),
                ], names=["id", "digest", "n", "sig"])

    schema = f"id {docs.schema[key].dataType.simpleString()}, digest binary, n long, sig binary"
    return docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def bucket_keys(sig: str = "sig") -> Column:
    """A key per band."""
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(b), F.substring(sig, b * width + 1, width)) for b in range(BANDS)])


def _tokens(bag: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th occurrence of a hash is its own token."""
    bag = np.sort(bag)
    start = np.flatnonzero(np.append(True, bag[1:] != bag[:-1])) if len(bag) else np.empty(0, dtype=np.int64)
    nth = np.arange(len(bag)) - np.repeat(start, np.diff(np.append(start, len(bag))))
    return np.sort(_mix(bag + nth.astype(U64) * U64(0x9E3779B97F4A7C15)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two token sets' overlap reaches the similarity."""
    low, high = sorted((len(a), len(b)))
    if low * SIMILAR[1] < high * SIMILAR[0]:
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same * SIMILAR[1] >= (low + high - same) * SIMILAR[0]


def _salts(n: Column) -> Column:
    return F.ceil(n / SALT).cast("long")


def _salt(node: str, salts: Column) -> Column:
    return F.pmod(F.xxhash64(node), salts)


def _each_salt() -> Column:
    return F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' multisets are similar enough.
    The texts of all ``b`` meet that of their ``a``, copied to each salt."""
    c = F.col
    many = pairs.groupBy("a").agg(_salts(F.count(F.lit(1))).alias("salts"))
    right = pairs.join(many, "a").join(texts.withColumnRenamed("node", "b"), "b").select(
        "a", _salt("b", c("salts")).alias("salt"), F.lit(1).alias("side"), "b", "text")
    left = many.select("a", _each_salt()).join(texts.withColumnRenamed("node", "a"), "a").select(
        "a", "salt", F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "text")
    met = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def run(batches):
        held = None
        for batch in batches:
            of, to, side, texts_ = (batch.column(x).to_pylist() for x in ("a", "b", "side", "text"))
            found = []
            for i, t in enumerate(texts_):
                own = _tokens(shingles(words(t)))
                if not side[i]:
                    held = own
                elif similar(held, own):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in found], pa.int64()) for x in (of, to)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def long_signatures(texts: DataFrame) -> DataFrame:
    """node, number of shingles, long signature."""

    def run(batches):
        for batch in batches:
            nodes, all_ = batch.column(0), batch.column(1).to_pylist()
            for part in _bounded(all_):
                bags = [shingles(words(t)) for t in all_[part]]
                yield pa.RecordBatch.from_arrays([
                    nodes.slice(part.start, part.stop - part.start), pa.array([len(b) for b in bags], pa.int64()),
                    pa.array([s.tobytes() for s in short(signatures(bags, LONG_REGISTERS))], pa.binary())], names=["node", "n", "long"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, long binary")


def _candidates(n: np.ndarray, class_: np.ndarray, stray: np.ndarray, blk: np.ndarray, crossed: bool, sig: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a comparison, a stray and another of a different class, that
    sizes and long signatures don't rule out."""
    out = []
    for i in np.flatnonzero(stray):
        fit = (class_ != class_[i]) & (np.minimum(n, n[i]) * SIMILAR[1] >= np.maximum(n, n[i]) * SIMILAR[0])
        fit &= ~stray | (np.arange(len(n)) > i)  # two strays meet once
        if crossed:
            fit &= blk != blk[i]
        at = np.flatnonzero(fit)
        at = at[(sig[at, :REGISTERS] == sig[i, :REGISTERS]).mean(axis=1) >= LEAST_AGREEMENT]
        at = at[(sig[at] == sig[i]).mean(axis=1) >= LEAST_LONG]
        out += [(int(i), int(j)) for j in at]
    return out


def strays_met(groups: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify in open groups.  ``groups``: group, node, class,
    stray, size.  Groups are dealt in blocks, and a comparison holds two."""
    c = F.col
    blocks = F.ceil(c("size") / BLOCK).cast("int")
    placed = groups.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("node"), c("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    run_key = F.xxhash64("group", F.least("blk", "other"), F.greatest("blk", "other")).alias("run")
    rows = dealt.select(run_key, "node", "class", "stray", "blk", (c("blk") != c("other")).alias("crossed"))
    rows = rows.join(long, "node").repartition("run").sortWithinPartitions("run", "node")

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            runs = batch.column("run").to_numpy()
            ends = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for lo, hi in zip(ends, ends[1:], strict=False):
                if held and held[-1].column("run")[0].as_py() != runs[lo]:
                    yield pairs(held)
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield pairs(held)

    def pairs(held):
        t = pa.Table.from_batches(held)
        sig = np.frombuffer(b"".join(t.column("long").to_pylist()), dtype="<u2").reshape(t.num_rows, -1)
        n, class_, stray, blk, crossed, node = (t.column(x).to_numpy() for x in ("n", "class", "stray", "blk", "crossed", "node"))
        # rows of a comparison of two blocks are all crossed, those of one block none
        found = _candidates(n, class_, stray, blk, bool(crossed[0]), sig)
        return pa.RecordBatch.from_arrays([pa.array([int(node[p[k]]) for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


FILTER_BITS = 20


def _may_be_in(ids: DataFrame, value: str = "id") -> Column:
    """Whether ``value`` may be among ``ids``: one bit per hash value, at most
    16,384 words whatever the number of ids.  It only spares texts a shuffle
    before the exact join; beyond a million ids it spares fewer."""
    at = lambda name: f"pmod(xxhash64({name}), {1 << FILTER_BITS})"
    rows = ids.groupBy(F.expr(f"{at('id')} div 64").alias("w")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({at('id')} % 64 as int)))").alias("m")).collect()
    words_ = [0] * (1 << (FILTER_BITS - 6))
    for r in rows:
        words_[r["w"]] = r["m"]
    table = F.from_json(F.lit(json.dumps(words_)), "array<bigint>")
    return F.bit_get(F.get(table, F.expr(f"cast({at(value)} div 64 as int)")), F.expr(f"cast({at(value)} % 64 as int)")) == 1


def _met(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(first, node): each node with the leaders of its buckets, once."""
    c = F.col
    members = nodes.select("node", F.explode(bucket_keys()).alias("key")).repartition("key")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = scratch.keep(members.join(shared, "key"), "near-met")
    # a bucket's leader is the text that meets the most others in all buckets: the original of many near copies,
    # which are each like it, though not like one another
    known = met.groupBy("node").agg(F.sum("size").alias("known"))
    salts = _salts(c("size")).alias("salts")
    firsts = met.join(known, "node").groupBy("key").agg(F.min_by("node", F.struct(-c("known"), "node")).alias("first"), F.max("size").alias("size"))
    firsts = firsts.select("key", "first", salts).select("key", "first", _each_salt())
    salted = met.select("node", "key", _salt("node", _salts(c("size"))).alias("salt"))
    return salted.join(firsts, ["key", "salt"]).where("node <> first").select("first", "node").distinct()


def _linked(nodes: DataFrame, docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """node, class (the smallest node of its component) of all linked nodes."""
    c = F.col
    pairs = scratch.keep(_met(nodes, scratch).select(c("first").alias("a"), c("node").alias("b")), "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.keep(nodes.join(wanted, "node", "left_semi").select("node", "id", "digest"), "near-wanted")
    source = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    source = source.where(_may_be_in(wanted) | c("id").isNull()).withColumn("digest", digest_of(c("text")))
    of = source.join(wanted, source["id"].eqNullSafe(wanted["id"]) & (source["digest"] == wanted["digest"])).select(
        "node", "text")
    texts = scratch.keep(of.dropDuplicates(["node"]), "near-candidates")  # rows may repeat
    links = scratch.keep(verified(pairs, texts), "near-links")
    found = scratch.keep(components(links, "a", "b").select("node", c("root").alias("class")), "near-classes")
    of_node = lambda name, out: found.select(c("node").alias(name), c("class").alias(out))
    group = pairs.join(of_node("a", "ca"), "a", "left").join(of_node("b", "cb"), "b", "left").select(
        c("a").alias("group"), c("b").alias("node"), F.coalesce("cb", "b").alias("class"), F.coalesce("ca", "a").alias("own"))
    group = scratch.keep(group.withColumn("stray", c("class") != c("own")).drop("own"), "near-groups")
    open_ = group.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.max("stray").alias("open"),
                                       F.min("class").alias("low"), F.max("class").alias("high")).where("open and low <> high")
    open_ = scratch.keep(group.join(open_.select("group", "size"), "group"), "near-open")
    long = scratch.keep(long_signatures(texts.join(open_.select("node").distinct(), "node", "left_semi")), "near-long")
    more = scratch.keep(strays_met(open_, long).distinct(), "near-more")
    if more.isEmpty():
        return found
    links = scratch.keep(links.unionByName(verified(more, texts)), "near-links")
    return scratch.keep(components(links, "a", "b").select("node", c("root").alias("class")), "near-classes")


def _classed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, digest, and of its class ``kept_id`` and ``kept_digest``
    (the smallest id that is not null, its text); these are null for rows that
    have no word.  Written."""
    c = F.col
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(signed(docs, key, text), "near-signed")
    some = rows.where(c("digest").isNotNull())
    nodes = some.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    found = _linked(nodes, docs, key, text, scratch)
    by_text = nodes.select("node", "digest", "id").join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    kept = by_text.groupBy("class").agg(F.min(F.struct(c("id").isNull().alias("none"), "id", "digest")).alias("k"))
    by_text = by_text.join(kept, "class").select("digest", c("k.id").alias("kept_id"), c("k.digest").alias("kept_digest"))
    classed = some.select("id", "digest").join(by_text, "digest").select("id", "digest", "kept_id", "kept_digest")
    empty = rows.where(c("digest").isNull()).select("id", "digest", F.lit(None).cast(rows.schema["id"].dataType).alias("kept_id"),
                                                    F.lit(None).cast("binary").alias("kept_digest"))
    out = materialise(classed.unionByName(empty), "near-classed")
    scratch.free()
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``class_id`` (the smallest id of
    its near-duplicate class, itself included)."""
    c = F.col
    return _classed(docs, key, text).select(c("id").alias(key), F.when(c("digest").isNull(), c("id")).otherwise(c("kept_id")).alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (all columns) with one document of each class: the one with
    the class's smallest id.  Of rows that repeat that id and text the smallest
    stays.  The few ids that go are anti-joined, and rows that can't be among
    them pass by the join."""
    c = F.col
    rows = _classed(docs, key, text)
    stays = c("digest").isNull() | (c("id").eqNullSafe(c("kept_id")) & (c("digest") == c("kept_digest")))
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(stays).alias("stay"), F.count("digest").alias("texts"))
    moved = materialise(ids.where((c("stay") < c("n")) | ((c("n") > 1) & (c("texts") > 0))).select(
        "id", (c("stay") > 0).alias("mixed")), "near-moved")
    named = moved.select(c("id").alias("__k"), c("mixed").alias("__mixed"))
    maybe = _may_be_in(moved, f"`{key}`")
    out = docs.where(~maybe).unionByName(docs.where(maybe).join(named, docs[key].eqNullSafe(named["__k"]), "left_anti"))
    mixed = moved.where("mixed")
    if mixed.isEmpty():
        return out
    # ids on several rows: each row is told by its text
    kept = materialise(rows.where(stays).join(mixed.select(c("id").alias("__k")), c("id").eqNullSafe(c("__k")), "left_semi")
                       .select(c("id").alias("__k"), c("digest").alias("__d")).distinct(), "near-mixed")
    told = docs.withColumn("__digest", digest_of(docs[text]))
    on = docs[key].eqNullSafe(kept["__k"]) & told["__digest"].eqNullSafe(kept["__d"])
    left = told.join(kept, on, "left_semi")
    one = left.where(c("__digest").isNotNull()).groupBy(key, "__digest").agg(
        F.min(F.struct(*[c(x) for x in docs.columns])).alias("__row")).select("__row.*")
    return out.unionByName(one).unionByName(left.where(c("__digest").isNull()).select(*docs.columns))
