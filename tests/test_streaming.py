"""Streaming jobs: stream = batch, late and repeated events, corrections,
write volume, idempotent restarts."""

import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from tangoflow.operators import reviews as rv
from tangoflow.plans import streams
from tangoflow.session import scratch_path
from tangoflow.streaming import files, jobs, store

SCHEMA = "user_id long, word string, wn int, reviewed_at timestamp_ntz, seq long, correct boolean"
BASE = dt.datetime(2024, 1, 10)
WS = ("user_id", "word", "review_count", "correct_count", "streak", "first_reviewed", "last_reviewed", "next_review")


def _hours(h):
    return BASE + dt.timedelta(hours=h)


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _states(df):
    return sorted(map(tuple, df.select(*WS).collect()))


def _want(spark, rows):
    return _states(rv.word_state(spark.createDataFrame(rows, SCHEMA).dropDuplicates(["seq"])))


def _take(spark, src, out, ckpt, **kw):
    stream = jobs.stream_word_state(jobs.review_events(spark, src), **kw)
    return jobs.run_available(stream.writeStream.outputMode("update").foreachBatch(streams._each(out)), ckpt)


def _folders(spark, *names):
    return [scratch_path(spark, n) for n in names]


# ---- T1 ----------------------------------------------------------------

def test_stream_state_is_exact_for_late_and_repeated_rows_inside_the_horizon(spark):
    b1 = [(1, "a", 0, _hours(i), i, i % 3 != 0) for i in range(10)] + [(1, "b", 0, _hours(1), 900, None)]
    b2 = [(1, "a", 0, _hours(20 + i), 100 + i, True) for i in range(5)]
    late = [(1, "a", 0, _hours(2) + dt.timedelta(minutes=30), 50, False), (1, "a", 0, _hours(22), 51, False)]
    src, out, ckpt = _folders(spark, "t1-src", "t1-out", "t1-ck")
    for rows in (b1, b2 + b2[:1] + b1[3:5], late + b2[2:4]):
        _write(spark, rows, src)
    _take(spark, src, out, ckpt)
    emitted = spark.read.schema(jobs.STATE_OUT).parquet(out)
    assert jobs.late_reviews(emitted).count() == 0
    assert emitted.agg(F.sum("repeated")).first()[0] == 5
    assert _states(jobs.finish_state(emitted)) == _want(spark, b1 + b2 + late)


def test_rows_behind_the_horizon_are_counted_and_merged(spark):
    b1 = [(1, w, 0, _hours(i), 100 * k + i, i % 4 != 0) for k, w in enumerate("abc") for i in range(0, 400, 7)]
    behind = [(1, "a", 0, _hours(3), 9001, False), (1, "a", 0, _hours(380), 9002, False), (2, "n", 0, _hours(0), 9003, True)]
    src, out, ckpt = _folders(spark, "t1-src", "t1-out", "t1-ck")
    for rows in (b1, behind + b1[:2]):  # the first two are repeated from behind the horizon
        _write(spark, rows, src)
    _take(spark, src, out, ckpt, horizon=dt.timedelta(days=2))
    emitted = spark.read.schema(jobs.STATE_OUT).parquet(out)
    assert sorted(r.seq for r in jobs.late_reviews(emitted).collect()) == [0, 7, 9001]
    log = spark.read.schema(SCHEMA).parquet(src).withColumn("bucket", jobs.key_bucket())
    assert _states(jobs.finish_state(emitted, log)) == _want(spark, b1 + behind)


def test_a_batch_writes_the_state_of_its_own_keys_only(spark):
    many = [(1, f"w{i}", 0, _hours(1), i, True) for i in range(3000)]
    src, out, ckpt = _folders(spark, "t1-src", "t1-out", "t1-ck")
    _write(spark, many, src)
    _take(spark, src, out, ckpt)
    _write(spark, [(1, "w5", 0, _hours(2), 5000, False)], src)
    q = _take(spark, src, out, ckpt)
    ops = [op for p in q.recentProgress for op in p["stateOperators"]]
    assert sum(op["numRowsUpdated"] for op in ops) <= 2
    assert spark.read.parquet(f"{out}/batch=1").count() == 1


class _Handle:
    """A key's state and timers in memory, for the processor alone."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return [(t,) for t in self.timers]

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_an_idle_key_settles_by_its_timer():
    handle, replay = _Handle(), jobs.WordReplay(10**12, idle_ms=50)
    replay.init(handle)
    rows = lambda *xs: iter([{"us": us, "seq": seq, "correct": ok} for us, seq, ok in xs])
    out = list(replay.handleInputRows((1, "a"), rows((10, 1, True), (30, 3, True), (20, 2, False)), _Now(100)))
    assert [(r.kind, r.review_count, r.streak) for r in out] == [("state", 3, 1)] and handle.timers == [150]
    list(replay.handleInputRows((1, "a"), rows((40, 4, True)), _Now(120)))
    assert handle.timers == [170]  # one timer a key
    assert not list(replay.handleExpiredTimer((1, "a"), _Now(170), None)) and handle.value[6] == []
    out = list(replay.handleInputRows((1, "a"), rows((25, 9, False), (50, 5, True)), _Now(200)))
    assert [(r.kind, r.review_count, r.streak, r.seq) for r in out] == [("state", 5, 3, None), ("late", None, None, 9)]


class _Entries:
    """A bucket's list of entries in memory, for the processor alone."""

    def __init__(self):
        self.list, self.calls = [], []

    def getListState(self, name, schema):
        return self

    def states(self):
        return sum(len(json.loads(states)) for states, in self.list)

    def get(self):
        self.calls.append(("get", self.states()))
        return iter(self.list)

    def appendList(self, entries):
        self.calls.append(("append", len(json.loads(entries[0][0]))))
        self.list += entries

    def put(self, entries):
        self.calls.append(("put", len(json.loads(entries[0][0]))))
        self.list = entries


def test_the_keys_of_a_bucket_share_their_calls_and_write_their_own_states():
    bucket, replay = _Entries(), jobs.BucketReplay(10)
    replay.init(bucket)

    def take(*xs):
        rows = [{"review": json.dumps(dict(zip(("user_id", "word", "us", "seq", "correct"), x, strict=True)))} for x in xs]
        (out,) = replay.handleInputRows((0,), iter(rows), None)
        return [tuple(r[k] for k in ("user_id", "word", "kind", "review_count", "streak", "repeated", "seq"))
                for r in json.loads(out.rows)]

    many = [(u, w, 100, u, True) for u in range(50) for w in ("a", None)]
    assert len(take(*many)) == 100 and bucket.calls == [("get", 0), ("append", 100)]
    # a key again: an open review, a repeated one, one from behind its horizon
    got = take((7, "a", 105, 1, False), (7, "a", 100, 7, True), (7, "a", 90, 2, True), (7, None, 100, 9, True))
    assert got == [(7, "a", "state", 2, 0, 1, None), (7, "a", "late", None, None, None, 2), (7, None, "state", 2, 2, 0, None)]
    assert bucket.calls[2:] == [("get", 100), ("append", 2)]
    for i in range(120):  # the list stays within twice its keys
        take((7, "a", 106 + i, 100 + i, True))
    assert bucket.states() <= 208 and ("put", 100) in bucket.calls
    assert take((7, "a", 300, 999, True)) == [(7, "a", "state", 123, 121, 0, None)]


def test_keys_in_few_buckets_are_exact_over_many_batches(spark):
    rows = [(u, w, 0, _hours(9 * i), 1000 * (u or 0) + 100 * k + i, (u or 0) % 3 != i % 3)
            for u in (1, 2, 3, None) for k, w in enumerate(("a", "b", None)) for i in range(12)]
    src, out, ckpt = _folders(spark, "t1-src", "t1-out", "t1-ck")
    for i in range(4):  # a third of each part is repeated in the next
        _write(spark, [r for r in rows if i in (r[4] % 4, r[4] % 4 + (r[4] % 3 == 0))], src)
    _take(spark, src, out, ckpt, buckets=2)
    emitted = spark.read.schema(jobs.STATE_OUT).parquet(out)
    got, want = jobs.finish_state(emitted), rv.word_state(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in got.select(*WS).collect()} == {tuple(r) for r in want.select(*WS).collect()}


# ---- T3 ----------------------------------------------------------------

def _batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _bytes(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_store_restart_is_idempotent(spark):
    rows = [(u, w, 0, _hours(i), u * 1000 + 100 * k + i, i % 4 != 0) for u in (1, 2) for k, w in enumerate("ab") for i in range(12)]
    src, base, ckpt = _folders(spark, "t3-src", "t3-out", "t3-ck")
    _write(spark, rows[:20], src)
    _write(spark, rows[20:], src)
    jobs.run_available(jobs.review_events(spark, src).writeStream.foreachBatch(store.upsert_batch_writer(base)), ckpt)
    first = _states(store.read_store(spark, base))
    store.upsert_batch_writer(base)(_batch(spark, rows[20:]), 1)  # a committed batch, once more
    assert _states(store.read_store(spark, base)) == first == _want(spark, rows)


def test_an_unpublished_batch_does_not_count(spark, monkeypatch):
    rows = [(1, w, 0, _hours(i), 100 * k + i, i % 4 != 0) for k, w in enumerate("ab") for i in range(12)]
    (base,) = _folders(spark, "t3-crash")
    write = store.upsert_batch_writer(base)
    write(_batch(spark, rows[:12]), 0)
    before = _states(store.read_store(spark, base))

    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(files, "publish", crash)
        try:
            write(_batch(spark, rows[12:]), 1)
        except RuntimeError:
            pass
    assert _states(store.read_store(spark, base)) == before
    write(_batch(spark, rows[12:]), 1)
    assert _states(store.read_store(spark, base)) == _want(spark, rows)


def test_store_takes_late_and_repeated_rows_over_compactions(spark):
    rows = [(1, w, 0, _hours(i), 100 * k + i, i % 4 != 0) for k, w in enumerate("abc") for i in range(12)]
    (base,) = _folders(spark, "t3-late")
    write = store.upsert_batch_writer(base, compact_every=2)
    parts = [rows[4:12] + rows[14:20], rows[:6], rows[2:4] + rows[10:16], rows[20:30], rows[20:22] + rows[30:], rows[:3], rows[33:]]
    for i, part in enumerate(parts):
        write(_batch(spark, part), i)
    assert _states(store.read_store(spark, base)) == _want(spark, rows)
    now = store.current(spark, base)
    assert (now["version"], now["batch"]) == (5, 6)
    live = [d for d in sorted(os.listdir(f"{base}/base")) if spark.read.schema(store.STATE).parquet(f"{base}/base/{d}").count()]
    assert live == ["v=3", "v=5"]  # older versions are retired


def test_what_a_micro_batch_writes_grows_with_the_batch(spark):
    (base,) = _folders(spark, "t3-bytes")
    write = store.upsert_batch_writer(base, compact_every=3)
    write(_batch(spark, [(u, f"word number {w}", 0, _hours(w), 1000 * u + w, True) for u in range(40) for w in range(500)]), 0)
    store.compact(spark, base)
    store_bytes = _bytes(f"{base}/base")
    write(_batch(spark, [(3, "word number 7", 0, _hours(900), 10**7, False)]), 1)
    small = _bytes(f"{base}/delta/b=1") + _bytes(f"{base}/log/b=1") + _bytes(f"{base}/manifest/m=2")
    assert small < store_bytes / 10 and spark.read.schema(store.STATE).parquet(f"{base}/delta/b=1").count() == 1
    got = store.read_store(spark, base)
    assert got.count() == 20_000 and got.where("user_id = 3 and word = 'word number 7'").first().streak == 0


def test_updates_with_history_replay_late_keys(spark):
    base = dt.datetime(2024, 1, 1)
    old = [(1, "a", 0, base + dt.timedelta(days=9), 1, True), (1, "a", 0, base + dt.timedelta(days=10), 2, False),
           (1, "b", 0, base, 3, True)]
    new = [(1, "a", 0, base + dt.timedelta(days=2), 4, True), (1, "b", 0, base + dt.timedelta(days=1), 5, True),
           (1, "b", 0, base + dt.timedelta(days=1), 5, True), (1, "b", 0, base, 3, True), (2, "c", 0, base, 6, True)]
    o, n = (spark.createDataFrame(x, SCHEMA) for x in (old, new))
    got = rv.apply_review_updates(rv.word_state(o), n, how="full", history=o)
    want = rv.word_state(spark.createDataFrame(old + [new[0], new[1], new[4]], SCHEMA)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    alone = {r.word: r for r in rv.apply_review_updates(rv.word_state(o), n.where("word = 'a'")).collect()}
    assert alone["a"].last_reviewed == dt.date(2024, 1, 11)  # never moves back


# ---- T2 ----------------------------------------------------------------

def _chats(spark, days=30, users=4):
    base = dt.datetime(2024, 1, 1, 0, 30)
    rows = [(u, d * 100 + 10 * u + k, base + dt.timedelta(days=d, hours=6 * k)) for d in range(days) for u in range(users) for k in range(3)]
    return spark.createDataFrame(rows, "user_id long, conv_id long, created_at timestamp_ntz")


def _counted(df):
    return {(r.user_id, r.day): r.conversations for r in df.collect()}


def test_daily_counts_take_chats_that_come_days_late(spark, monkeypatch):
    chats = _chats(spark)
    want = {(r.user_id, r.day): r["count"] for r in
            chats.groupBy("user_id", F.to_date("created_at").alias("day")).count().collect()}
    # several files per slice, the latest days first; 1/20 of the chats come ten days late
    monkeypatch.setattr(streams.fx, "chats", lambda *_: chats.repartitionByRange(6, F.desc("created_at")))
    assert _counted(streams.q_stream_daily_counts(spark, "")) == want


def test_days_are_emitted_once_and_corrected_on_read(spark):
    chats = _chats(spark, days=9)
    (base,) = _folders(spark, "t2-out")
    write, day = jobs.daily_count_writer(base), F.dayofmonth("created_at")
    parts = [chats.where(day <= 5), chats.where(day == 7), chats.where((day == 6) | (day >= 8))]
    for i, part in enumerate(parts):
        write(part, i)
        write(part, i)  # a retried batch writes the same
    closed = spark.read.parquet(f"{base}/closed").groupBy("user_id", "day").count()
    assert closed.agg(F.max("count")).first()[0] == 1
    late = jobs.corrections(spark, base).collect()
    assert not late  # day 6 was still open: its end is not past the watermark
    write(chats.where(day == 2), 3)
    late = jobs.corrections(spark, base)
    assert {(r.day.day, r.conversations) for r in late.collect()} == {(2, 3)}
    got = jobs.daily_counts(spark, base)
    assert {(r.day.day, r.conversations, r.closed) for r in got.collect()} == {
        (d, 6 if d == 2 else 3, d < 8) for d in range(1, 10)}
