"""Registered queries: the streaming jobs, run to completion (availableNow)
over the review log / chat history delivered in time slices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tangoflow.params import DEFAULT
from tangoflow.plans.oracle_fixtures import with_fixtures
from tangoflow.plans.registry import query
from tangoflow.session import scratch_path
from tangoflow.sources import fixtures as fx
from tangoflow.streaming import jobs, store

# Delivery: the time range, whatever months it covers, is cut into this many slices of equal length.
SLICES = 3
#: T1 in the query: shorter than a slice, so that some late reviews come from behind it.
HORIZON = dt.timedelta(days=12)


def _deliver(df, ts_col: str, path: str, repeat_every: int | None = None, late_every: int | None = None, after=None,
             key: str = "seq", bucketed: bool = False):
    """Write ``df`` slice by slice, in time order, each in parallel; optionally
    hold every k-th row back for the next slice (late), and repeat every k-th
    row there (at-least-once delivery).  ``after`` is called once a slice has
    arrived whole, however many files it has."""
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    lo, hi = df.select(F.min(at), F.max(at)).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // SLICES))
    own = F.floor((at - F.lit(lo or 0)) / F.lit(width)).cast("int")
    if late_every:
        own = own + F.when(F.col(key) % late_every == 0, 1).otherwise(0)
    sent = F.least(own, F.lit(SLICES - 1))
    for i in range(SLICES):
        now = sent == i
        if repeat_every:
            now = now | ((sent == i - 1) & (F.col(key) % repeat_every == 0))
        part = df.where(now)
        if bucketed:
            part = part.withColumn("bucket", jobs.key_bucket()).repartition("bucket")
        writer = part.write.mode("append")
        (writer.partitionBy("bucket") if bucketed else writer).parquet(path)
        if after:
            after()
    return path


_WS_COLS = ("user_id", "word", "review_count", "correct_count", "success_rate", "streak", "first_reviewed",
            "last_reviewed", "interval_days", "next_review")
_WS = f"SELECT {', '.join(_WS_COLS)} FROM word_state"


def _each(out: str):
    """Rows of a micro-batch go into batch=<id>, so a retried batch overwrites
    its own folder: the sink is idempotent."""
    return lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")


@query("stream_word_state", with_fixtures(_WS, "word_state"))
def q_stream_word_state(spark, sf_dir):
    """Reviews streamed in micro-batches, 1/7 of them delivered twice and 1/20
    late by a slice; the final state per key equals the batch state."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("review-stream", "t1-updates", "ckpt-t1"))
    reviews = fx.reviews(spark, sf_dir)
    buckets = jobs.state_buckets(reviews.count())

    def take():
        stream = jobs.stream_word_state(jobs.review_events(spark, src, 10_000), HORIZON, buckets=buckets)
        jobs.run_available(stream.writeStream.outputMode("update").foreachBatch(_each(out)), ckpt)

    _deliver(reviews, "reviewed_at", src, 7, 20, after=take, bucketed=True)
    log = spark.read.schema(jobs.LOG_SCHEMA).parquet(src)
    return jobs.finish_state(spark.read.schema(jobs.STATE_OUT).parquet(out), log).select(*_WS_COLS)


@query("stream_daily_counts", with_fixtures(
    "SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS conversations FROM chats GROUP BY ALL", "chats"))
def q_stream_daily_counts(spark, sf_dir):
    """Every day, open ones too; 1/20 of the chats come a slice (about ten
    days) late, after their day was closed, and are counted as corrections."""
    c = fx.chats(spark, sf_dir)
    src, base, ckpt = (scratch_path(spark, n) for n in ("chat-stream", "t2-counts", "ckpt-t2"))

    def take():
        chats = jobs.chat_events(spark, src, c.schema)
        jobs.run_available(chats.writeStream.foreachBatch(jobs.daily_count_writer(base)), ckpt)

    _deliver(c, "created_at", src, late_every=20, after=take, key="conv_id")
    return jobs.daily_counts(spark, base).drop("closed")


@query("stream_upsert", with_fixtures(_WS, "word_state"))
def q_stream_upsert(spark, sf_dir):
    """foreachBatch upsert under repeated and late delivery into a store that
    is merged on read; what it holds equals the batch state."""
    src, base, ckpt = (scratch_path(spark, n) for n in ("review-stream-u", "word-state-store", "ckpt-t3"))

    def take():
        events = jobs.review_events(spark, src, 10_000)
        jobs.run_available(events.writeStream.foreachBatch(store.upsert_batch_writer(base, DEFAULT)), ckpt)

    _deliver(fx.reviews(spark, sf_dir), "reviewed_at", src, 7, 20, after=take)
    return store.read_store(spark, base).select(*_WS_COLS)
