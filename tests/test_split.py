"""Hot groups cut into blocks: replay, turns, deletes, and block sizes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangoflow.operators import chats as ch, progress as pg, reviews as rv, split
from tangoflow.params import Params

BASE = dt.datetime(2024, 1, 10, 12)


def test_no_block_where_no_group_is_hot(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    assert split.blocks(rows, ["k"], F.col("id"), 20) is None
    assert split.blocks(rows, ["k"], F.col("id"), None) is None
    assert split.blocks(rows.where("false"), ["k"], F.col("id"), 20) is None


def test_a_group_of_half_the_rows_is_cut_into_even_blocks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 10_000, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    cut = split.blocks(rows, ["k"], F.col("id"), 500)
    sizes = [r["count"] for r in cut.where("k is null").groupBy(split.BLOCK).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 20 and max(sizes) <= 750
    assert cut.where(f"k is not null and {split.BLOCK} is not null").count() == 0


def test_ranks_in_hot_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randrange(500), i) for i in range(2000)] + [(None, 1, 5000)]
    df = spark.createDataFrame(rows, "g string, at long, id long")
    got = {r.id: r.n for r in split.numbered(df, ["g"], [F.col("at"), F.col("id")], F.col("at"), 100, "n").collect()}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted(x for x in rows if x[0] == g), 1) if g else [(1, rows[-1])]:
            assert got[r[2]] == n


def test_turns_of_a_conversation_of_half_the_table(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system"]
    rows = [(c, 3 * t - 50, rng.choice(roles), f"{c}/{t}") for c, n in ((1, 3000), (2, 40), (3, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted((a[0], a[1], a[3], b[3]) for a, b in zip(rows, rows[1:], strict=False)
                  if a[0] == b[0] and a[2] == "user" and b[2] == "assistant")
    for limit in (None, 100, 7):
        assert sorted(map(tuple, ch.pair_turns(df, Params(split_rows=limit)).collect())) == want


@pytest.mark.parametrize("limit", [None, 50])
def test_delete_the_oldest_of_many_equal_chats(spark, limit):
    chats = [(1, i, "hi", "yo", "2024-01-10 12:00", None, "t", BASE + dt.timedelta(seconds=i // 3)) for i in range(400)]
    chats += [(2, 1000 + i, "hi", "yo", "2024-01-10 12:00", "A", None, BASE) for i in range(3)]
    schema = ("user_id long, conv_id long, user_message string, ai_response string, timestamp string, level string, topic string, "
              "created_at timestamp_ntz")
    df = spark.createDataFrame(chats, schema)
    asked = spark.createDataFrame([chats[0]] * 130 + [chats[400]], schema).select(*ch.CONTENT)
    left = ch.delete_chats(df, asked, Params(split_rows=limit))
    assert left.columns == df.columns
    assert sorted(r.conv_id for r in left.collect()) == [*range(130, 400), 1001, 1002]


def test_replay_of_a_key_hot_within_one_day(spark):
    rng = random.Random(3)
    rows = [(1, "hot", BASE + dt.timedelta(seconds=rng.randrange(3600)), i, rng.random() < 0.9) for i in range(1500)]
    rows += [(u, "w", BASE + dt.timedelta(days=u), 10_000 + u, True) for u in range(20)]
    df = spark.createDataFrame(rows, "user_id long, word string, reviewed_at timestamp_ntz, seq long, correct boolean")
    plain, cut = Params(split_rows=None), Params(split_rows=100)
    for op in (rv.review_replay, rv.word_state, rv.ladder_schedule):
        assert sorted(map(tuple, op(df, cut).collect())) == sorted(map(tuple, op(df, plain).collect()))
    r, by = rv._prepared(df, cut)
    sizes = [x["count"] for x in r.where("word = 'hot'").groupBy(*by).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 200


def test_breakdowns_have_a_cell_for_every_day_and_value(spark):
    rows = [(1, "2024-01-01 10:00", "A", None), (1, "2024-01-01 11:00", "A", "x"), (1, "2024-01-03 10:00", "B", "y"),
            (1, "2024-01-05 10:00", None, "x"), (2, "2024-01-02 10:00", "C", None)]
    df = spark.createDataFrame(rows, T._parse_datatype_string("user_id long, timestamp string, level string, topic string"))
    got = {(r.user_id, r.day.day, r.level): r.conversations for r in pg.daily_by_level(df).collect()}
    assert got == {(1, 1, "A"): 2, (1, 1, "B"): 0, (1, 3, "A"): 0, (1, 3, "B"): 1, (2, 2, "C"): 1}
    got = {(r.user_id, r.day.day, r.topic): r.conversations for r in pg.daily_by_topic(df).collect()}
    assert got == {(1, 1, "x"): 1, (1, 1, "y"): 0, (1, 3, "x"): 0, (1, 3, "y"): 1, (1, 5, "x"): 1, (1, 5, "y"): 0}
