"""The replay against an independent Python spec on random review logs
(property test), with and without hot keys."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tangoflow.operators import reviews as rv
from tangoflow.params import Params


def spec_interval(rate, streak):
    rate = rate or 0.0
    streak = streak or 0
    base = 7 if rate >= 0.9 else 3 if rate >= 0.7 else 2 if rate >= 0.5 else 1
    return min(base * (1 + streak // 2), 30)


def spec_replay(rows):
    """rows: (user, word, ts, seq, correct) — replay each key in (ts, seq) order."""
    out = {}
    keys = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        keys.setdefault((r[0], r[1]), []).append(r)
    for k, rs in keys.items():
        flags = []
        for u, w, ts, seq, ok in rs:
            flags.append(bool(ok))
            n = len(flags)
            rate = sum(flags) / n
            streak = 0
            for f in reversed(flags):
                if not f:
                    break
                streak += 1
            iv = spec_interval(rate, streak)
            out[(u, w, seq)] = (n, sum(flags), rate, streak, iv, ts.date() + dt.timedelta(days=iv))
    return out


def _log(seed, n):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ts = base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 20))
        rows.append((rnd.randrange(3), f"w{rnd.randrange(4)}", ts, i, rnd.random() < 0.75))
    return rows


SCHEMA = "user_id long, word string, reviewed_at timestamp_ntz, seq long, correct boolean"


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.sampled_from([None, 10, 40]))
def test_replay_matches_spec(spark, seed, limit):
    rows = _log(seed, 300)
    spec = spec_replay(rows)
    got = rv.review_replay(spark.createDataFrame(rows, SCHEMA), Params(split_rows=limit)).collect()
    assert len(got) == len(rows)
    for g in got:
        e = spec[(g.user_id, g.word, g.seq)]
        assert (g.review_no, g.correct_count, g.streak, g.interval_days, g.next_review) == \
               (e[0], e[1], e[3], e[4], e[5])
        assert abs(g.success_rate - e[2]) < 1e-12


def test_word_state_is_last_replay_row(spark):
    rows = _log(7, 500)
    df = spark.createDataFrame(rows, SCHEMA)
    last = {}
    for (u, w, seq), v in spec_replay(rows).items():
        if (u, w) not in last or v[0] > last[(u, w)][0]:
            last[(u, w)] = v
    for b in (20, None):
        for s in rv.word_state(df, Params(split_rows=b)).collect():
            e = last[(s.user_id, s.word)]
            assert (s.review_count, s.correct_count, s.streak, s.next_review) == (e[0], e[1], e[3], e[5])


def test_incremental_update_equals_full_replay(spark):
    rows = _log(11, 400)
    cut = dt.datetime(2024, 1, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    full = {(r.user_id, r.word): r for r in rv.word_state(df).collect()}
    stored = rv.word_state(df.where(df.reviewed_at < cut))
    upd = rv.apply_review_updates(stored, df.where(df.reviewed_at >= cut), how="full").collect()
    assert len(upd) == len(full)
    for u in upd:
        f = full[(u.user_id, u.word)]
        assert (u.review_count, u.correct_count, u.streak, u.next_review, u.first_reviewed) == \
               (f.review_count, f.correct_count, f.streak, f.next_review, f.first_reviewed)


def test_hot_key_spreads_over_blocks(spark):
    """One (user, word) holding all rows: the replay's shuffle is keyed by
    (user, word, block), so the hot key lands in many partitions."""
    base = dt.datetime(2024, 1, 1)
    rows = [(1, "hot", base + dt.timedelta(hours=i), i, i % 5 != 0) for i in range(24 * 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    prepared, by = rv._prepared(df, Params(split_rows=40))
    parts = prepared.repartition(8, *by).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    spec = spec_replay(rows)
    got = {r.seq: r.streak for r in rv.review_replay(df, Params(split_rows=40)).collect()}
    assert all(got[s] == spec[(1, "hot", s)][3] for s in got)
