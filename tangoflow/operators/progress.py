"""Progress report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangoflow.operators.chats import todays_chats
from tangoflow.params import DEFAULT, Params


def chat_day(chats: DataFrame) -> F.Column:
    """Calendar day of a chat from its minute text."""
    return F.to_date(F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd HH:mm")))


def daily_counts(chats: DataFrame) -> DataFrame:
    """A4 — chats per learner and day (partial aggregation)."""
    return chats.groupBy("user_id", chat_day(chats).alias("day")).agg(F.count(F.lit(1)).alias("conversations"))


def _daily_by(chats: DataFrame, col: str) -> DataFrame:
    """Chats per learner, day and value of ``col``, zero where a day has none
    of a value: as many rows as a pivot has cells.  Days and values are those
    that occur with a value, whatever they are.  The spine joins a learner's
    distinct days with their distinct values; the chats are aggregated before."""
    c = (chats.where(F.col(col).isNotNull()).groupBy("user_id", chat_day(chats).alias("day"), col)
              .agg(F.count(F.lit(1)).alias("conversations")))
    days = c.select("user_id", "day").distinct()
    values = c.select(F.col("user_id").alias("_u"), col).distinct()
    spine = days.join(values, F.col("user_id").eqNullSafe(F.col("_u"))).select(
        "user_id", "day", col, F.lit(0).cast("bigint").alias("conversations"))
    return spine.unionByName(c).groupBy("user_id", "day", col).agg(F.sum("conversations").alias("conversations"))


def daily_by_level(chats: DataFrame) -> DataFrame:
    """A5 — day × level counts, dense."""
    return _daily_by(chats, "level")


def daily_by_topic(chats: DataFrame) -> DataFrame:
    """A6 — day × topic counts, dense."""
    return _daily_by(chats, "topic")


def practice_days(chats: DataFrame) -> DataFrame:
    """D1 — distinct practice days per learner (map-side de-duplication)."""
    return chats.select("user_id", chat_day(chats).alias("day")).where(F.col("day").isNotNull()).distinct()


def practice_day_streak(chats: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """W2 — day streak per learner: (last day is today ? 1 : 0) + (length of
    the trailing run of consecutive days − 1).

    Distinct days first (partial aggregation, so a heavy learner is reduced
    to at most one row per day before any shuffle), then gaps-and-islands over
    the days of each learner — a bounded set (one row per calendar day).
    """
    days = practice_days(chats)
    w = Window.partitionBy("user_id").orderBy("day")
    isl = days.withColumn("grp", F.date_sub(F.col("day"), F.row_number().over(w).cast("int")))
    runs = isl.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("run_len"), F.max("day").alias("last_day"))
    last = runs.groupBy("user_id").agg(F.max_by(F.struct("run_len", "last_day"), F.col("last_day")).alias("r"))
    today = F.lit(params.today).cast("date")
    streak = F.col("r.run_len") - 1 + F.when(F.col("r.last_day") == today, 1).otherwise(0)
    return last.select("user_id", F.col("r.last_day").alias("last_day"), streak.cast("int").alias("day_streak"))


def progress_summary(chats: DataFrame, words: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A7 — per learner with chats: total chats, words learned, today's chats,
    day streak.  All inputs are per-user aggregates joined on user_id."""
    total = chats.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_chats"))
    wc = words.groupBy("user_id").agg(F.count(F.lit(1)).alias("words_learned"))
    today = todays_chats(chats, params)
    streak = practice_day_streak(chats, params).select("user_id", "day_streak")
    return (total.join(wc, "user_id", "left").join(today, "user_id", "left").join(streak, "user_id", "left")
                 .select("user_id", "total_chats",
                         F.coalesce("words_learned", F.lit(0)).cast("bigint").alias("words_learned"),
                         F.coalesce("today_chats", F.lit(0)).cast("bigint").alias("today_chats"),
                         F.coalesce("day_streak", F.lit(0)).alias("day_streak")))


# What a stored row holds, serialised as JSON to tell its size.
WORD_ROW = ("japanese", "english", "added_date", "last_reviewed", "next_review", "review_count", "correct_count", "streak")
CHAT_ROW = ("user_message", "ai_response", "timestamp", "level", "topic")
MEBIBYTE = 1048576


def row_bytes(cols) -> F.Column:
    """UTF-8 octets of the row as JSON, nulls written."""
    return F.octet_length(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).cast("bigint")


def store_statistics(words: DataFrame, chats: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A3 — per learner: total words, total chats, words with reviews, today's
    chats and the size of the serialised rows, in bytes and in MB (two decimals)."""
    w = words.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_words"),
        F.count_if(F.col("review_count") > 0).alias("words_with_reviews"),
        F.sum(row_bytes(WORD_ROW)).alias("word_bytes"))
    today = F.col("timestamp").startswith(params.today.isoformat())
    c = chats.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_conversations"),
        F.count_if(today).alias("today_conversations"),
        F.sum(row_bytes(CHAT_ROW)).alias("chat_bytes"))
    j = w.join(c, "user_id", "full")
    size = F.coalesce(F.col("word_bytes"), F.lit(0)) + F.coalesce(F.col("chat_bytes"), F.lit(0))
    return j.select(
        "user_id",
        F.coalesce("total_words", F.lit(0)).cast("bigint").alias("total_words"),
        F.coalesce("total_conversations", F.lit(0)).cast("bigint").alias("total_conversations"),
        F.coalesce("words_with_reviews", F.lit(0)).cast("bigint").alias("words_with_reviews"),
        F.coalesce("today_conversations", F.lit(0)).cast("bigint").alias("today_conversations"),
        size.cast("bigint").alias("size_bytes"), F.round(size / MEBIBYTE, 2).alias("size_mb"))
