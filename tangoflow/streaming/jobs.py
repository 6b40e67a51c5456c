"""Structured Streaming jobs (T1, T2; T3 is in ``streaming.store``).

* T1 ``stream_word_state`` — review events → running learning state, one
  state per (user, word) with ``transformWithState``, which is called once per
  bucket of keys and appends the states it changed to a list.  A key's state
  holds a settled summary and its reviews of the last ``horizon``, in order,
  so a late or repeated review inside the horizon costs its own key only and
  is exact.  Reviews behind the horizon come out as rows of a side table
  (``late_reviews``), and ``finish_state`` replays their keys.  There is no
  watermark, so Spark drops no event.  An idle key settles by a timer.
* T2 ``daily_count_writer`` — chats per learner per day.  Micro-batches leave
  counts; a day is emitted once, when the watermark passes its end; chats that
  arrive later are corrections, added when the counts are read.

Every job writes its checkpoint under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tangoflow.streaming import files

REVIEW_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("word", T.StringType()),
    T.StructField("wn", T.IntegerType()), T.StructField("reviewed_at", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()), T.StructField("correct", T.BooleanType()),
])
LOG_SCHEMA = T.StructType([*REVIEW_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
KEYS = ("user_id", "word")
LOG_BUCKETS = 32
STATE_BUCKETS = 1024
#: Reviews a bucket of T1's state is meant for: enough to share a call to the
#: state server, few enough that a micro-batch of some keys reads little more.
BUCKET_REVIEWS = 1024

# ---- T1 ----------------------------------------------------------------

# The settled part (count, right ones, trailing run, first and last time) up
# to ``floor``, and the open reviews after it, ordered by (time, seq).
STATE_SCHEMA = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("ok", T.LongType()), T.StructField("run", T.LongType()),
    T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("floor", T.LongType()),
    T.StructField("us", T.ArrayType(T.LongType())), T.StructField("seq", T.ArrayType(T.LongType())),
    T.StructField("correct", T.ArrayType(T.BooleanType())),
])
STATE_OUT = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("word", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("review_count", T.LongType()), T.StructField("correct_count", T.LongType()),
    T.StructField("streak", T.LongType()), T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()),
    T.StructField("repeated", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("correct", T.BooleanType()),
])
# States a micro-batch left in a bucket, as a JSON array: the columns of the
# key and of STATE_SCHEMA, in order.  As one value they cross to Python at once.
ENTRY_SCHEMA = T.StructType([T.StructField("states", T.StringType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def composed(n: int, ok: int, run: int, flags: list[bool]) -> tuple[int, int, int]:
    """(count, right ones, trailing run) continued by ordered answers."""
    tail = next((k for k, f in enumerate(reversed(flags)) if not f), None)
    return n + len(flags), ok + sum(flags), run + len(flags) if tail is None else tail


_Out = Row(*STATE_OUT.names)


def replayed(held: tuple | None, reviews: list[tuple[int, int, bool]], horizon_us: int) -> tuple[tuple, int, list]:
    """A key's state after a micro-batch's reviews (time, seq, correct), how
    many of them it had already, and those from behind its horizon."""
    n, ok, run, first, last, floor = held[:6] if held else (0, 0, 0, None, None, None)
    open_ = list(zip(*held[6:9], strict=True)) if held else []
    known, repeated, late = {(us, seq) for us, seq, _ in open_}, 0, []
    for us, seq, correct in reviews:
        if floor is not None and us <= floor:
            late.append((us, seq, correct))
        elif (us, seq) in known:
            repeated += 1
        else:
            known.add((us, seq))
            open_.append((us, seq, correct))
    open_.sort()
    if open_:
        first = open_[0][0] if first is None else min(first, open_[0][0])
        last = open_[-1][0] if last is None else max(last, open_[-1][0])
    if last is not None:
        bound = last - horizon_us
        done = [x for x in open_ if x[0] <= bound]
        n, ok, run = composed(n, ok, run, [x[2] for x in done])
        open_ = open_[len(done):]
        floor = bound if floor is None else max(floor, bound)
    return (n, ok, run, first, last, floor, *([x[k] for x in open_] for k in range(3))), repeated, late


def _emitted(key, state: tuple, repeated: int, late: list) -> Iterator[tuple]:
    now = composed(*state[:3], state[8])
    yield (*key, "state", *now, state[3], state[4], repeated, None, None)
    for us, seq, correct in late:
        yield (*key, "late", None, None, None, us, us, None, seq, correct)


class BucketReplay(StatefulProcessor):
    """States of a bucket of (user, word), as a list of which a key's newest
    state counts: a micro-batch reads the list and appends the states of its
    own keys, each in one call to the state server.  A list of mostly outdated
    states is written anew, so it stays within twice its keys.  Reviews come
    and rows leave as JSON, as Spark hands values to Python one by one."""

    def __init__(self, horizon_us: int) -> None:
        self.horizon_us = horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", ENTRY_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        taken: dict[tuple, list] = {}
        for r in rows:
            x = json.loads(r["review"])
            taken.setdefault((x["user_id"], x["word"]), []).append((x["us"], x["seq"], x["correct"]))
        held, length = {}, len(taken)
        for (states,) in self.entries.get():
            for user_id, word, *state in json.loads(states):
                held[user_id, word] = state
                length += 1
        changed, out = {}, []
        for word, reviews in taken.items():
            changed[word], repeated, late = replayed(held.get(word), reviews, self.horizon_us)
            out += (dict(zip(STATE_OUT.names, x, strict=True)) for x in _emitted(word, changed[word], repeated, late))
        held.update(changed)
        outdated = length > 2 * len(held) + 8
        states = json.dumps([(*word, *state) for word, state in (held if outdated else changed).items()])
        (self.entries.put if outdated else self.entries.appendList)([(states,)])
        yield Row(rows=json.dumps(out))

    def close(self) -> None:
        pass


class WordReplay(StatefulProcessor):
    """State of one (user, word), for streams with timers, which Spark keeps
    per group.  ``horizon_us``: how far behind its newest review a key's
    reviews stay open; ``idle_ms``: after so long without an event (processing
    time) all of them are settled."""

    def __init__(self, horizon_us: int, idle_ms: int | None = None) -> None:
        self.horizon_us, self.idle_ms = horizon_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        reviews = [(r["us"], r["seq"], bool(r["correct"])) for r in rows]
        state, repeated, late = replayed(self.state.get(), reviews, self.horizon_us)
        self.state.update(state)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from (_Out(*x) for x in _emitted(key, state, repeated, late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held:
            n, ok, run = composed(*held[:3], list(held[8]))
            self.state.update((n, ok, run, held[3], held[4], held[4], [], [], []))
        yield from ()

    def close(self) -> None:
        pass


def key_bucket(buckets: int = LOG_BUCKETS):
    """The folder of a key in a review log."""
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def review_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Streaming review log from Parquet files."""
    return spark.readStream.schema(REVIEW_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def state_buckets(reviews: int) -> int:
    """Buckets of T1's state for a log of so many reviews."""
    return max(64, -(-reviews // BUCKET_REVIEWS))


def stream_word_state(events: DataFrame, horizon: dt.timedelta = dt.timedelta(days=30), idle: dt.timedelta | None = None,
                      buckets: int = STATE_BUCKETS) -> DataFrame:
    """T1 — in update mode, per micro-batch and touched key, the key's state
    (``kind`` "state") and its reviews from behind the horizon ("late").  Keys
    live in RocksDB, whose change log holds the written keys alone.  A
    checkpoint keeps to its number of ``buckets`` (``state_buckets``).  With ``idle`` the stream
    has processing-time timers and a group per key; such a stream runs until it
    is stopped (Spark gives it no last micro-batch)."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    us = F.unix_micros(F.col("reviewed_at").cast("timestamp"))
    reviews = events.select(*KEYS, us.alias("us"), "seq", F.coalesce("correct", F.lit(False)).alias("correct"))
    horizon_us = horizon // dt.timedelta(microseconds=1)
    if idle:
        return reviews.groupBy(*KEYS).transformWithState(
            WordReplay(horizon_us, idle // dt.timedelta(milliseconds=1)), STATE_OUT, "Update", "ProcessingTime")
    packed = reviews.select(key_bucket(buckets).alias("bucket"),
                            F.to_json(F.struct(*reviews.columns), {"ignoreNullFields": "false"}).alias("review"))
    out = packed.groupBy("bucket").transformWithState(BucketReplay(horizon_us), "rows string", "Update", "None")
    return out.select(F.inline(F.from_json("rows", T.ArrayType(STATE_OUT), {"mode": "FAILFAST"})))


def late_reviews(rows: DataFrame) -> DataFrame:
    """The side table: reviews that came from behind their key's horizon."""
    return rows.where("kind = 'late'").select(*KEYS, F.timestamp_micros("last_us").cast("timestamp_ntz").alias("reviewed_at"), "seq", "correct")


_STATE = ("review_count", "correct_count", "success_rate", "streak", "first_reviewed", "last_reviewed", "interval_days",
          "next_review")


def finish_state(rows: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Latest emitted state per key → the word-state columns of the batch
    operator (rate, interval, next review).  With ``log``, the reviews as
    delivered (and their ``bucket``, if it is laid out so), the keys of the
    side table are replayed; only their buckets are read."""
    from tangoflow.functions.schedule import review_interval
    from tangoflow.operators import split
    from tangoflow.operators.reviews import word_state

    # a key's counts grow with every micro-batch that changes it
    last = rows.where("kind = 'state'").groupBy(*KEYS).agg(
        F.max_by(F.struct("review_count", "correct_count", "streak", "last_us", "first_us"), F.col("review_count")).alias("s"))
    rate = F.try_divide(F.col("s.correct_count").cast("double"), F.col("s.review_count").cast("double"))
    day = lambda us: F.to_date(F.timestamp_micros(us).cast("timestamp_ntz"))
    out = last.select(*KEYS, F.col("s.review_count").alias("review_count"), F.col("s.correct_count").alias("correct_count"),
                      rate.alias("success_rate"), F.col("s.streak").cast("int").alias("streak"),
                      day(F.col("s.first_us")).alias("first_reviewed"), day(F.col("s.last_us")).alias("last_reviewed"))
    out = out.withColumn("interval_days", review_interval(F.col("success_rate"), F.col("streak")))
    out = out.withColumn("next_review", F.date_add("last_reviewed", F.col("interval_days"))).select(*KEYS, *_STATE)
    if log is None:
        return out
    late = split.written(late_reviews(rows).select(*KEYS).distinct(), "late-keys")
    if late.isEmpty():
        return out
    if "bucket" in log.columns:
        touched = [r[0] for r in late.select(key_bucket()).distinct().collect()]  # at most LOG_BUCKETS
        log = log.where(F.col("bucket").isin(touched))
    again = word_state(log.join(late, list(KEYS), "left_semi").dropDuplicates([*KEYS, "seq"]))
    return out.join(late, list(KEYS), "left_anti").unionByName(again.select(*KEYS, *_STATE))


# ---- T2 ----------------------------------------------------------------

COUNTS = "user_id long, day date, late boolean, conversations long"


def chat_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Streaming chats from Parquet files, all that have arrived by default."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _watermark(spark: SparkSession, base: str, below: int, lateness: dt.timedelta) -> dt.datetime | None:
    """Newest chat of all micro-batches before ``below``, less the lateness."""
    seen = files.read_if_there(spark, f"{base}/progress", "newest timestamp_ntz, b long").where(F.col("b") < below)
    newest = seen.agg(F.max("newest")).first()[0]
    return None if newest is None else newest - lateness


def _open_until(mark: dt.datetime | None) -> Column:
    """The first day that is not closed: days that end by the watermark are."""
    return F.lit((dt.date.min if mark is None else mark.date()).isoformat()).cast("date")


def daily_count_writer(base: str, lateness: dt.timedelta = dt.timedelta(days=1)):
    """T2 — ``foreachBatch`` function.  The micro-batch's counts go to
    ``counts/b=<id>``, those of days closed before as ``late``; days that its
    newest chat closes are emitted to ``closed/b=<id>``, each once.  All
    folders are named by the batch, so a retry writes the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _open_until(_watermark(spark, base, batch_id, lateness))
        day = F.to_date("created_at").alias("day")
        counts = batch.groupBy("user_id", day).agg(F.count(F.lit(1)).alias("conversations"))
        counts = counts.select("user_id", "day", F.coalesce(F.col("day") < before, F.lit(False)).alias("late"), "conversations")
        counts.write.mode("overwrite").parquet(f"{base}/counts/b={batch_id}")
        batch.agg(F.max(F.col("created_at").cast("timestamp_ntz")).alias("newest")).write.mode("overwrite").parquet(f"{base}/progress/b={batch_id}")
        until = _open_until(_watermark(spark, base, batch_id + 1, lateness))
        seen = files.read_if_there(spark, f"{base}/counts", f"{COUNTS}, b long")
        closing = seen.where((F.col("b") <= batch_id) & ~F.col("late") & (F.col("day") >= before) & (F.col("day") < until))
        closing = closing.groupBy("user_id", "day").agg(F.sum("conversations").alias("conversations"))
        closing.write.mode("overwrite").parquet(f"{base}/closed/b={batch_id}")

    return write


def daily_counts(spark: SparkSession, base: str, lateness: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """The counts as read: closed days, their corrections, and open days so
    far; ``closed`` says which."""
    until = _open_until(_watermark(spark, base, 1 << 62, lateness))
    closed = files.read_if_there(spark, f"{base}/closed", "user_id long, day date, conversations long, b long").drop("b")
    seen = files.read_if_there(spark, f"{base}/counts", f"{COUNTS}, b long")
    more = seen.where(F.col("late") | F.col("day").isNull() | (F.col("day") >= until)).select("user_id", "day", "conversations")
    out = closed.unionByName(more).groupBy("user_id", "day").agg(F.sum("conversations").alias("conversations"))
    return out.withColumn("closed", F.coalesce(F.col("day") < until, F.lit(False)))


def corrections(spark: SparkSession, base: str) -> DataFrame:
    """The correction stream: counts that arrived after their day was closed."""
    return files.read_if_there(spark, f"{base}/counts", f"{COUNTS}, b long").where("late").drop("late")


def run_available(query_writer, checkpoint: str):
    """Start a stream with ``availableNow`` and wait for it to finish."""
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
