"""Due list, review priority and quiz sessions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangoflow.functions.schedule import strict_day
from tangoflow.functions.text import seeded_bucket
from tangoflow.params import DEFAULT, Params


def _today(params: Params) -> F.Column:
    return F.lit(params.today).cast("date") if isinstance(params.today, _dt.date) else F.to_date(F.lit(params.today))


def due_words(words: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """P1 — words due on ``params.today``.

    Missing, NULL or unparsable next_review means due; otherwise due when the
    parsed day is on or before today.  A pure filter: no shuffle.
    """
    d = strict_day(F.col("next_review"))
    return words.where(d.isNull() | (d <= _today(params)))


def due_priority(words: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """O2 — the due list ordered weakest first: success rate ascending, then
    the (parsed) due day, then the word.  A global sort (range partitioned),
    so one learner with many due words still spreads over many tasks."""
    due = due_words(words, params).withColumn("due_day", strict_day(F.col("next_review")))
    return due.orderBy(F.col("user_id"), F.col("success_rate").asc_nulls_first(),
                       F.col("due_day").asc_nulls_first(), F.col("japanese"))


def quiz_session(words: DataFrame, params: Params = DEFAULT, max_words: int | None = None) -> DataFrame:
    """W6 — per learner the first min(max_words, due) due words in load order
    (newest added first, then the word); position i and progress i/len.

    ``row_number() <= k`` is planned as a WindowGroupLimit: each map task keeps
    at most k rows per learner before the shuffle, so a learner with millions
    of due words ships only k rows per task.
    """
    k = min(max_words or params.quiz_words, params.max_quiz_words)
    w = Window.partitionBy("user_id").orderBy(F.col("added_date").desc_nulls_last(), F.col("japanese"))
    top = due_words(words, params).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    size = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return (top.withColumn("session_size", size)
               .withColumn("progress", F.col("position") / F.col("session_size"))
               .select("user_id", "japanese", "english", F.col("position").cast("int").alias("position"),
                       F.col("session_size").cast("int").alias("session_size"), "progress"))


MODES = ("jp_to_en", "en_to_jp", "mixed")


def quiz_question(session: DataFrame, mode: str = "jp_to_en", session_id: str = "s1",
                  params: Params = DEFAULT) -> DataFrame:
    """H4 — direction, prompt side and expected answer for each quiz word.

    'mixed' picks the direction from a seeded hash of (user, word, session), so
    reruns ask the same way.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "jp_to_en":
        jp_to_en = F.lit(True)
    elif mode == "en_to_jp":
        jp_to_en = F.lit(False)
    else:
        jp_to_en = seeded_bucket(params.seed, F.col("user_id"), F.col("japanese"), F.lit(session_id)) % 2 == 0
    return (session.withColumn("jp_to_en", jp_to_en)
            .withColumn("prompt", F.when(F.col("jp_to_en"), F.col("japanese")).otherwise(F.col("english")))
            .withColumn("expected", F.when(F.col("jp_to_en"), F.col("english")).otherwise(F.col("japanese"))))
