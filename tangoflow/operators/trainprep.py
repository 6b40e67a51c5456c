"""Model-input preparation (S10, S11, O3, M1-M4) and training-log reports
(A11, A12, W7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangoflow import params as P
from tangoflow.functions.text import seeded_key
from tangoflow.operators import split

PAIR_JSON = T.StructType([
    T.StructField("input_text", T.StringType()), T.StructField("target_text", T.StringType()),
    T.StructField("error_category", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("pair_id", T.StringType()),
])


def export_pairs_json(processed: DataFrame, path: str) -> str:
    """S10 — formatted pairs as JSON lines (confidence_score → confidence,
    UTF-8 text written as is)."""
    (processed.select("input_text", "target_text", "error_category",
                      F.col("confidence_score").alias("confidence"), "pair_id")
     .write.mode("overwrite").json(path))
    return path


def load_pairs_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """S11 — exported pairs, from JSON lines or (``array``) from files that
    each hold one JSON array; a missing category becomes 'unknown'."""
    df = spark.read.schema(PAIR_JSON).option("multiLine", array).json(path)
    return df.select("pair_id", "input_text", "target_text",
                     F.coalesce(F.col("error_category"), F.lit(P.UNKNOWN_CATEGORY)).alias("error_category"))


def sample_pairs(pairs: DataFrame, n: int = 3) -> DataFrame:
    """O3 — the first n pairs by id (a top-n: TakeOrderedAndProject)."""
    return pairs.orderBy("pair_id").limit(n)


# Exact split: md5 rank buckets.  2**16 buckets of the md5 prefix give a small,
# fixed-size count table; ranks inside one bucket need a window over ~n/65536
# uniformly spread rows, never over the whole input.
SPLIT_BUCKET_HEX = 4


def md5_rank(pairs: DataFrame, seed: str = P.SPLIT_SEED, id_col: str = "pair_id") -> DataFrame:
    """Exact global rank (1..n) of every row by (md5(seed|id), id), plus n.

    Distributed: rank = (rows in earlier md5-prefix buckets) + (rank inside
    the bucket).  The bucket count table has at most 16**SPLIT_BUCKET_HEX rows
    whatever n is, so its prefix sum (a bounded single-partition window) and
    its broadcast are bounded; the in-bucket window holds ~n/65,536 uniformly
    spread rows.  No global sort, no unbounded top-k.
    """
    key = seeded_key(seed, F.col(id_col))
    keyed = pairs.select("*", key.alias("_h"), F.substring(key, 1, SPLIT_BUCKET_HEX).alias("_b"))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    w_all = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_b", (F.sum("_c").over(w_all) - F.col("_c")).alias("_before"),
                            F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = keyed.join(F.broadcast(offsets), "_b")
    inner = Window.partitionBy("_b").orderBy("_h", id_col)
    return ranked.select(*pairs.columns, (F.col("_before") + F.row_number().over(inner)).alias("_rank"), "_n")


def train_val_split(pairs: DataFrame, fraction: float = P.VALIDATION_FRACTION, seed: str = P.SPLIT_SEED,
                    id_col: str = "pair_id") -> DataFrame:
    """M1 — exact-size random split: the ceil(fraction·n) pairs with the
    smallest md5(seed|id) (ties by id) are 'val', the rest 'train'.

    The split is one comparison with the last validation pair's (hash, id), so
    no pair is shuffled.  Finding that pair takes the counts of the ≤ 65,536
    md5-prefix buckets and the ranks of the pairs of one bucket.
    """
    key = seeded_key(seed, F.col(id_col))
    bucket = F.substring(key, 1, SPLIT_BUCKET_HEX)
    counts = sorted((r["b"], r["n"]) for r in pairs.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    left = math.ceil(sum(n for _, n in counts) * fraction)
    at = None
    for at, n in counts:
        if left <= n:
            break
        left -= n
    if at is None or left <= 0:
        return pairs.withColumn("split", F.lit("train"))
    inner = Window.partitionBy("b").orderBy("h", "id")
    last = (pairs.where(bucket == at).select(bucket.alias("b"), key.alias("h"), F.col(id_col).alias("id"))
            .withColumn("r", F.row_number().over(inner)).where(F.col("r") == left).first())
    val = (key < last["h"]) | ((key == last["h"]) & (F.col(id_col) <= last["id"]))
    return pairs.withColumn("split", F.when(val, "val").otherwise("train"))


TOKEN_PATTERN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"


def tokens(text: F.Column) -> F.Column:
    """Lower-cased tokens: runs of Latin letters/digits, or single other
    non-blank characters (so Japanese text tokenises per character)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


SUMMARY_TOKENS = 65_536
SLICE_BYTES = 1 << 22  # a batch's texts are cut into tokens so many bytes at a time
_BLANK, _RUN, _SINGLE, _REST = range(4)
_KIND = np.full(256, _SINGLE, np.uint8)  # of a UTF-8 byte: blank, of a run, first or other byte of any other character
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[[b for b in range(128) if chr(b).isalnum()]] = _RUN
_KIND[0x80:0xC0] = _REST


def lowered(text: str) -> F.Column:
    """What ``token_slices`` takes: a text in lower case, empty where null."""
    return F.coalesce(F.lower(F.col(text)), F.lit(""))


def token_slices(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The tokens (``tokens``) of lowered texts, slice by slice: all tokens of
    some texts as one array, and each text's bounds in it.  A token is a span
    of bytes, and all but the blanks lie in one, so spans are found with a few
    vector operations and no regular expression."""
    wide = pa.types.is_large_string(texts.type)
    offset = np.int64 if wide else np.int32
    at = np.frombuffer(texts.buffers()[1], offset)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, int(at[first]) + SLICE_BYTES, "right")) - 1)
        begin = at[first:last + 1] - at[first]
        chars = data[at[first]:at[last]]
        kind = _KIND[chars]
        run = kind == _RUN
        start = run.copy()
        start[1:] &= ~run[:-1]
        heads = begin[:-1][begin[:-1] < begin[1:]]
        start[heads] = run[heads]
        start |= kind == _SINGLE
        kept = kind != _BLANK
        spans = np.append(np.flatnonzero(start[kept]), np.count_nonzero(kept)).astype(offset)
        out = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(len(spans) - 1, pa.py_buffer(spans), pa.py_buffer(chars[kept]))
        yield out, np.searchsorted(np.flatnonzero(start), begin)
        first = last


def added(tables: list[pa.Table]) -> pa.Table:
    """Tables of tokens and numbers as one without repeats."""
    return pa.concat_tables(tables).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])


def token_counts(pairs: DataFrame, cols, limit: int) -> DataFrame:
    """Numbers of the tokens of some columns, (token, n), added up in the tasks
    alone: a task counts in tables of at most 4 * limit rows and one batch, and
    lets a table go, whole, when it has more than ``limit`` tokens."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for column in batch.columns:
                for some, _ in token_slices(column):
                    seen = pc.value_counts(some)
                    held.append(pa.table({"token": seen.field("values").cast(pa.string()), "n": seen.field("counts")}))
                    rows += len(seen)
                    if rows > 4 * limit:
                        held = [added(held)]
                        rows = len(held[0])
                        if rows > limit:
                            yield from held[0].to_batches()
                            held, rows = [], 0
        if held:
            yield from added(held).to_batches()

    return pairs.select(*[lowered(c).alias(f"t{i}") for i, c in enumerate(cols)]).mapInArrow(run, "token string, n long")


def summary_of(counts: DataFrame, capacity: int) -> DataFrame:
    """Frequent tokens in bounded space: (token, low), and a row with a null
    token whose ``low`` is the error.  A token's number is at least its low and
    at most low + error; a token without row has at most the error.

    Each task adds up numbers (``token_counts``) in a table of at most
    8 * capacity rows and one batch.  When it is full, the count of the first
    token beyond ``capacity`` is taken off all (and added to the task's error),
    which leaves at most ``capacity``.  The tables add up, so at most capacity
    rows a task are shuffled."""

    def run(batches):
        held, rows, error = [], 0, 0

        def cut(most):
            nonlocal error
            table = added(held)
            n = table["n"].to_numpy()
            if len(n) <= most:
                return table
            off = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
            error += off
            return pa.table({"token": table["token"], "n": pa.array(n - off)}).filter(pa.array(n > off))

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows > 8 * capacity:
                held = [cut(2 * capacity)]
                rows = len(held[0])
        if held:
            yield from cut(capacity).rename_columns(["token", "low"]).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([error], pa.int64())], names=["token", "low"])

    return counts.mapInArrow(run, "token string, low long").groupBy("token").agg(F.sum("low").alias("low"))


def token_summary(pairs: DataFrame, cols, capacity: int) -> DataFrame:
    """``summary_of`` the tokens of some columns."""
    return summary_of(token_counts(pairs, cols, 2 * capacity), capacity)


def fit_vocab(pairs: DataFrame, size: int, cols=("input_text", "target_text"), capacity: int | None = None) -> DataFrame:
    """M2 — token → id (1..size) for the ``size`` most frequent tokens (ties by
    token); 0 is the padding id, size+1 the unknown id.

    The pairs are read once: each task's own numbers of tokens are written.
    What follows reads those.  First a mergeable summary (``summary_of``).  If
    it made no error, its counts are exact.  Else, let ``bound`` be the size-th
    largest low: if the error is less, no token without row can be among the
    most frequent, and the candidates, those with low + error >= bound, are
    added up exactly.  If not, the summary is widened and made again.  So what
    is shuffled is bounded by the summary, however many different tokens there
    are."""
    capacity = capacity or max(SUMMARY_TOKENS, 8 * size)
    c = F.col
    counts = split.written(token_counts(pairs, cols, 2 * capacity), "token-counts")
    while True:
        summary = split.written(summary_of(counts, capacity), "token-summary")
        error = (summary.where(c("token").isNull()).first() or (None, 0))[1]
        lows = summary.where(c("token").isNotNull()).withColumnRenamed("low", "count")
        first = lows.orderBy(F.desc("count"), "token").limit(size)
        if not error:
            top = first
            break
        kept, bound = first.agg(F.count(F.lit(1)), F.min("count")).first()
        if kept == size and bound > error:
            some = split.written(lows.where(c("count") + error >= bound).select("token"), "token-candidates")
            exact = counts.join(some, "token", "left_semi").groupBy("token").agg(F.sum("n").alias("count"))
            top = exact.orderBy(F.desc("count"), "token").limit(size)
            break
        capacity *= 4
    # Bounded single-partition window over the ≤ size kept tokens.
    w = Window.orderBy(F.desc("count"), "token")
    return top.withColumn("id", F.row_number().over(w).cast("int")).select("token", "id", "count")


def token_ids(texts: pa.Array, vocab: pa.Array, ids: np.ndarray, max_len: int) -> pa.Array:
    """The ids of each lowered text's first ``max_len`` tokens; the last of
    ``ids`` is that of a token which is not in ``vocab``."""
    sizes, found = [np.zeros(1, np.int32)], [np.zeros(0, np.int32)]
    for some, bounds in token_slices(texts):
        n = np.diff(bounds)
        taken = np.arange(len(some)) - np.repeat(bounds[:-1], n) < max_len
        known = pc.fill_null(pc.index_in(some.cast(vocab.type), value_set=vocab), len(vocab)).to_numpy(zero_copy_only=False)
        found.append(ids[known[taken]])
        sizes.append(np.minimum(n, max_len))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(found), pa.int32()))


def encode_pairs(pairs: DataFrame, vocab: DataFrame, size: int, max_len: int = P.MAX_SEQ_LEN,
                 id_col: str = "pair_id") -> DataFrame:
    """M3 — input ids / attention mask / labels, each exactly ``max_len`` long:
    truncated, padded with 0; labels use −100 where padded.

    The vocabulary is limited to ``size`` rows here, whatever the caller
    passes, and sent to the tasks, where an Arrow function cuts a batch of
    texts into tokens and looks them up: no shuffle, no regroup of exploded
    tokens, and two pairs with one id stay two rows.
    """
    table = {r["token"]: r["id"] for r in vocab.orderBy("id").limit(size).select("token", "id").collect()}
    known = pairs.sparkSession.sparkContext.broadcast((list(table), [*table.values(), size + 1]))

    @F.arrow_udf("array<int>")
    def coded(texts: pa.Array) -> pa.Array:
        words, ids = known.value
        return token_ids(texts, pa.array(words, pa.string()), np.array(ids, np.int32), max_len)

    g = pairs.select(id_col, coded(lowered("input_text")).alias("_s"), coded(lowered("target_text")).alias("_t"))
    ns, nt = F.size("_s"), F.size("_t")

    def fill(v, k):
        return F.array_repeat(F.lit(v), F.lit(max_len) - k)

    return g.select(
        id_col,
        F.concat("_s", fill(0, ns)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), ns), fill(0, ns)).alias("attention_mask"),
        F.concat("_t", fill(P.LABEL_IGNORE, nt)).alias("labels"))


def assign_batches(pairs: DataFrame, batch_size: int = P.TRAIN_BATCH, shard_rows: int = 1 << 20,
                   seed: str = P.SPLIT_SEED, id_col: str = "pair_id") -> DataFrame:
    """M4 — seeded shuffle into batches: pairs in md5(seed|id) order (the
    exact distributed rank of ``md5_rank``), cut into shards of ``shard_rows``
    consecutive pairs (one data-loader stream each) and batches of
    ``batch_size`` inside a shard.  Shards grow in number, not size, with n."""
    r = md5_rank(pairs, seed, id_col)
    i = F.col("_rank") - 1
    in_shard = i % F.lit(shard_rows)
    return r.select(*pairs.columns, (i / F.lit(shard_rows)).cast("int").alias("shard"),
                    (in_shard / F.lit(batch_size)).cast("int").alias("batch_no"),
                    (in_shard % F.lit(batch_size)).cast("int").alias("pos_in_batch"))


def steps_per_epoch(batches: DataFrame) -> DataFrame:
    """Optimizer steps per epoch: Σ over shards of ceil(n_shard / batch) —
    the number of distinct (shard, batch) pairs (partially aggregated)."""
    return batches.select("shard", "batch_no").distinct().agg(F.count(F.lit(1)).alias("steps_per_epoch"))


# Losses are summed as integer micro-units: integer sums are associative, so a
# partial / chunked sum equals a sequential one exactly, in any engine; the
# mean is rounded half-up to 1e-9 with integer arithmetic.
MICRO = 1_000_000


def micro(loss: F.Column) -> F.Column:
    return F.round(loss * F.lit(float(MICRO))).cast("bigint")


def exact_mean(sum_micro: F.Column, n: F.Column) -> F.Column:
    """Half-up rounded mean in units of 1e-9 from an exact integer sum."""
    nano = F.floor((sum_micro * F.lit(2000) + n) / (F.lit(2) * n)).cast("bigint")
    return nano.cast("double") / F.lit(1e9)


def epoch_loss(log: DataFrame) -> DataFrame:
    """A11 — mean batch loss per (run, epoch, phase)."""
    g = log.groupBy("run", "epoch", "phase").agg(F.sum(micro(F.col("loss"))).alias("_s"),
                                                 F.count(F.lit(1)).alias("batches"))
    return g.select("run", "epoch", "phase", exact_mean(F.col("_s"), F.col("batches")).alias("mean_loss"), "batches")


def best_epoch(log: DataFrame) -> DataFrame:
    """A12 — per run, the epoch with the lowest validation loss (ties: the
    earlier epoch)."""
    val = epoch_loss(log).where(F.col("phase") == "val")
    return val.groupBy("run").agg(
        F.min_by(F.col("epoch"), F.struct("mean_loss", "epoch")).alias("best_epoch"),
        F.min("mean_loss").alias("best_val_loss"))


def running_loss(log: DataFrame, chunk_steps: int = 10_000) -> DataFrame:
    """W7 — cumulative mean loss inside (run, epoch, phase), ordered by step.

    A (run, epoch, phase) group can hold a third of the log, so the running
    sum is a two-level prefix scan: a running window inside fixed step
    chunks, plus per-chunk offsets from a prefix sum over the (few) chunk
    totals, joined back on the chunk key.
    """
    keys = ["run", "epoch", "phase"]
    c = log.withColumn("_chunk", F.floor(F.col("step") / F.lit(chunk_steps)))
    wl = Window.partitionBy(*keys, "_chunk").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_m", micro(F.col("loss")))
    local = (c.withColumn("_ls", F.sum("_m").over(wl))
              .withColumn("_ln", F.count(F.lit(1)).over(wl)))
    tot = c.groupBy(*keys, "_chunk").agg(F.sum("_m").alias("_s"), F.count(F.lit(1)).alias("_n"))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = (tot.withColumn("_ps", F.coalesce(F.sum("_s").over(wc), F.lit(0)))
              .withColumn("_pn", F.coalesce(F.sum("_n").over(wc), F.lit(0))))
    j = local.join(off.select(*keys, "_chunk", "_ps", "_pn"), [*keys, "_chunk"])
    return j.select(*keys, "step", "loss",
                    exact_mean(F.col("_ps") + F.col("_ls"), F.col("_pn") + F.col("_ln")).alias("running_loss"))
