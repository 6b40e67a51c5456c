"""T3 — word state kept by a stream, merged on read.

The store has base files, bucketed by key, and one delta per micro-batch with
the new rows of the keys that the batch touched.  A reader takes the base
rows of keys without delta and the newest delta row of the others.  Every
``COMPACT_EVERY`` batches the merged rows become the next base.  So what a
micro-batch writes grows with the batch, and the base's cost is spread over
many batches.

Layout under the store's folder: ``log/b=<id>/bucket=<k>`` (reviews as
delivered), ``delta/b=<id>``, ``base/v=<id>/bucket=<k>``, and the ledger
``manifest/m=<number>``, one row each, naming the base and the last batch.
A version exists once its ledger row does; everything before is a folder named
by the batch, which a retry overwrites.  Bases and deltas that neither the
current version nor the one before names are retired.

Repeated deliveries of recent batches are recognised by (key, seq) against
their logs.  A review that is older than its key's last one makes the key
late: its reviews are replayed from the log, of which only the late keys'
buckets are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangoflow.operators import split
from tangoflow.operators.reviews import apply_review_updates, word_state
from tangoflow.params import DEFAULT, Params
from tangoflow.streaming import files
from tangoflow.streaming.jobs import KEYS, LOG_BUCKETS, key_bucket

COMPACT_EVERY = 8
REPEAT_WINDOW = 4  # batches whose reviews may be delivered again without a replay
LOG = "user_id long, word string, reviewed_at timestamp_ntz, seq long, correct boolean"
LOG_COLUMNS = ("user_id", "word", "reviewed_at", "seq", "correct")
STATE = T.StructType([T.StructField(name, kind) for name, kind in (
    ("user_id", T.LongType()), ("word", T.StringType()), ("review_count", T.LongType()), ("correct_count", T.LongType()),
    ("success_rate", T.DoubleType()), ("streak", T.IntegerType()), ("interval_days", T.IntegerType()),
    ("first_reviewed", T.DateType()), ("last_reviewed", T.DateType()), ("next_review", T.DateType()),
    ("last_at", T.TimestampNTZType()), ("last_seq", T.LongType()))])
BUCKETED = T.StructType([*STATE.fields, T.StructField("bucket", T.IntegerType())])
LEDGER = "version long, batch long"


def current(spark: SparkSession, base: str):
    """The ledger's last row: ``version`` (of the base, -1: none), ``batch``."""
    return files.latest(spark, f"{base}/manifest", LEDGER)


def read_store(spark: SparkSession, base: str, buckets: list[int] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The stored state, base and deltas merged; of some buckets, or some keys."""
    now = current(spark, base)
    version, batch = (now["version"], now["batch"]) if now else (-1, -1)
    some = lambda df: df if buckets is None else df.where(F.col("bucket").isin(buckets))
    of = lambda df: df if keys is None else df.join(keys, list(KEYS), "left_semi")
    old = of(some(files.read_if_there(spark, f"{base}/base", BUCKETED, f"v={version}"))).select(*STATE.names)
    if batch <= version:
        return old
    deltas = files.read_if_there(spark, f"{base}/delta", T.StructType([*BUCKETED.fields, T.StructField("b", T.LongType())]),
                                 *[f"b={b}" for b in range(version + 1, batch + 1)])
    newest = of(some(deltas)).groupBy(*KEYS).agg(F.max_by(F.struct(*STATE.names[2:]), F.col("b")).alias("s")).select(*KEYS, "s.*")
    # the deltas' keys are as many as recent batches touched, however large the base
    touched = some(deltas).select(*KEYS)
    return old.join(touched, list(KEYS), "left_anti").unionByName(newest)


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", key_bucket())


def _continued(spark: SparkSession, base: str, batch_id: int, new: DataFrame, params: Params) -> DataFrame:
    """The state rows of all keys that have ``new`` reviews."""
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most LOG_BUCKETS
    recent = files.read_if_there(spark, f"{base}/log", f"{LOG}, b long, bucket int").where(
        (F.col("b") < batch_id) & (F.col("b") >= batch_id - REPEAT_WINDOW) & F.col("bucket").isin(touched))
    new = new.dropDuplicates([*KEYS, "seq"]).join(recent, [*KEYS, "seq"], "left_anti").drop("bucket")
    new = split.written(new, "store-new")
    keys = new.select(*KEYS).distinct()
    stored = split.written(read_store(spark, base, touched, keys), "store-touched")
    first = new.groupBy(*KEYS).agg(F.min(F.struct("reviewed_at", "seq")).alias("first"))
    late = first.join(stored, list(KEYS)).where(F.col("first") <= F.struct(F.col("last_at").alias("reviewed_at"), F.col("last_seq").alias("seq")))
    late = split.written(late.select(*KEYS), "store-late")
    out = apply_review_updates(stored.drop("last_at", "last_seq").join(late, list(KEYS), "left_anti"),
                               new.join(late, list(KEYS), "left_anti"), params, how="full")
    again = [r[0] for r in late.select(key_bucket()).distinct().collect()]
    if again:
        log = files.read_if_there(spark, f"{base}/log", f"{LOG}, b long, bucket int").where(
            (F.col("b") <= batch_id) & F.col("bucket").isin(again))
        log = log.join(late, list(KEYS), "left_semi").dropDuplicates([*KEYS, "seq"]).select(*new.columns)
        out = out.unionByName(word_state(log, params).select(*out.columns))
    marks = stored.select(*KEYS, F.struct("last_at", "last_seq").alias("at")).unionByName(
        new.select(*KEYS, F.struct(F.col("reviewed_at").alias("last_at"), F.col("seq").alias("last_seq")).alias("at")))
    marks = marks.groupBy(*KEYS).agg(F.max("at").alias("at"))
    return out.join(marks, list(KEYS)).select("*", "at.*").select(*[F.col(f.name).cast(f.dataType) for f in STATE.fields])


def upsert_batch_writer(base: str, params: Params = DEFAULT, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """T3 — ``foreachBatch`` function: log the batch, write the touched keys'
    new state as a delta, publish it, and compact when it is time."""
    base = base.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = current(spark, base)
        if now and now["batch"] >= batch_id:
            return  # committed before a restart
        rows = _bucketed(batch.select(*LOG_COLUMNS))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/log/b={batch_id}")
        new = spark.read.schema(f"{LOG}, bucket int").parquet(f"{base}/log/b={batch_id}")
        state = _bucketed(_continued(spark, base, batch_id, new, params))
        state.sortWithinPartitions("bucket", *KEYS).write.mode("overwrite").parquet(f"{base}/delta/b={batch_id}")
        version = now["version"] if now else -1
        files.publish(spark, f"{base}/manifest", 2 * batch_id, version=version, batch=batch_id)
        if batch_id - version >= compact_every:
            compact(spark, base)

    return write


def compact(spark: SparkSession, base: str) -> None:
    """The merged rows as the next base; then what the version before the
    last one needed alone is retired.  Can run at any time between batches."""
    now = current(spark, base)
    if not now or now["batch"] <= now["version"]:
        return
    batch, old = now["batch"], now["version"]
    merged = _bucketed(read_store(spark, base)).repartition("bucket").sortWithinPartitions("bucket", *KEYS)
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/base/v={batch}")
    files.publish(spark, f"{base}/manifest", 2 * batch + 1, version=batch, batch=batch)
    before = files.latest(spark, f"{base}/manifest", LEDGER, 2 * old + 1 if old >= 0 else 0)
    if before:  # readers may still hold the version before this one, not older ones
        if before["version"] >= 0:
            files.retire(spark, f"{base}/base/v={before['version']}", STATE)
        for b in range(before["version"] + 1, old + 1):
            files.retire(spark, f"{base}/delta/b={b}", BUCKETED)
