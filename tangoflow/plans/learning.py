"""Registered queries: review replay, word state, due lists, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tangoflow.functions.schedule import next_review_date, review_interval
from tangoflow.operators import due, reviews as rv, split
from tangoflow.params import DEFAULT
from tangoflow.plans.oracle_fixtures import TODAY, interval_sql, with_fixtures
from tangoflow.plans.registry import query
from tangoflow.sources import fixtures as fx

_REPLAY_COLS = ("user_id, word, seq, reviewed_at, correct, review_no, correct_count, "
                "success_rate, streak, interval_days, next_review")


@query("review_replay", with_fixtures(f"SELECT {_REPLAY_COLS} FROM replay", "replay"))
def q_review_replay(spark, sf_dir):
    return rv.review_replay(fx.reviews(spark, sf_dir), DEFAULT)


@query("word_state", with_fixtures(
    "SELECT user_id, word, review_count, correct_count, success_rate, streak, interval_days, "
    "first_reviewed, last_reviewed, next_review FROM word_state", "word_state"))
def q_word_state(spark, sf_dir):
    return rv.word_state(fx.reviews(spark, sf_dir), DEFAULT)


@query("success_rate", with_fixtures(
    "SELECT user_id, word, count(*) AS review_count, CAST(count_if(correct) AS BIGINT) AS correct_count, "
    "count_if(correct) / count(*) AS success_rate FROM reviews GROUP BY user_id, word", "reviews"))
def q_success_rate(spark, sf_dir):
    return rv.success_rate(fx.reviews(spark, sf_dir))


@query("word_streak", with_fixtures("SELECT user_id, word, streak FROM word_state", "word_state"))
def q_word_streak(spark, sf_dir):
    return rv.word_streak(fx.reviews(spark, sf_dir), DEFAULT)


@query("review_interval", with_fixtures(
    f"SELECT user_id, japanese, success_rate, streak, {interval_sql('success_rate', 'streak')} AS interval_days "
    "FROM words", "words"))
def q_review_interval(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    return w.select("user_id", "japanese", "success_rate", "streak",
                    review_interval(F.col("success_rate"), F.col("streak")).alias("interval_days"))


@query("next_review_date", with_fixtures(
    f"SELECT user_id, word, seq, CAST(reviewed_at AS DATE) + {interval_sql('success_rate', 'streak')} "
    "AS next_review FROM replay", "replay"))
def q_next_review_date(spark, sf_dir):
    rp = rv.review_replay(fx.reviews(spark, sf_dir), DEFAULT)
    return rp.select("user_id", "word", "seq",
                     next_review_date(F.col("reviewed_at"),
                                      review_interval(F.col("success_rate"), F.col("streak"))).alias("next_review"))


_STRICT = ("CASE WHEN regexp_full_match(next_review, '\\d{4}-\\d{1,2}-\\d{1,2}') "
           "THEN try_strptime(next_review, '%Y-%m-%d')::DATE END")


@query("due_words", with_fixtures(
    f"SELECT user_id, japanese, english, next_review, success_rate FROM words "
    f"WHERE {_STRICT} IS NULL OR {_STRICT} <= {TODAY}", "words"))
def q_due_words(spark, sf_dir):
    return due.due_words(fx.words(spark, sf_dir), DEFAULT).select(
        "user_id", "japanese", "english", "next_review", "success_rate")


@query("due_priority", with_fixtures(
    f"SELECT user_id, japanese, success_rate, {_STRICT} AS due_day, row_number() OVER (PARTITION BY user_id "
    f"ORDER BY success_rate NULLS FIRST, {_STRICT} NULLS FIRST, japanese) AS position FROM words "
    f"WHERE {_STRICT} IS NULL OR {_STRICT} <= {TODAY}", "words"))
def q_due_priority(spark, sf_dir):
    """The due list with each word's place in it."""
    listed = due.due_priority(fx.words(spark, sf_dir), DEFAULT).select("user_id", "japanese", "success_rate", "due_day")
    return split.positions(listed, ["user_id"])


@query("quiz_session", with_fixtures(
    "SELECT user_id, japanese, english, CAST(position AS INTEGER) AS position, "
    "CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS session_size, "
    "position / count(*) OVER (PARTITION BY user_id) AS progress FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added_date DESC NULLS LAST, japanese) AS position "
    f"FROM words WHERE {_STRICT} IS NULL OR {_STRICT} <= {TODAY}) WHERE position <= 10", "words"))
def q_quiz_session(spark, sf_dir):
    return due.quiz_session(fx.words(spark, sf_dir), DEFAULT)


@query("review_stats", with_fixtures(
    "SELECT user_id, count(*) AS total_words, CAST(count_if(review_count > 0) AS BIGINT) AS words_with_reviews, "
    "round(COALESCE(avg(CASE WHEN review_count > 0 THEN success_rate END), 0.0), 9) AS average_success_rate, "
    "CAST(sum(review_count) AS BIGINT) AS total_reviews FROM words GROUP BY user_id", "words"))
def q_review_stats(spark, sf_dir):
    return rv.review_stats(fx.words(spark, sf_dir))


_LADDER = ("CASE WHEN NOT correct THEN 1 WHEN cb < 6 THEN list_extract([1, 3, 7, 14, 30, 90], cb + 1) "
           "ELSE CAST(90 * pow(2, least(cb - 5, 40)) AS BIGINT) END")


@query("ladder_schedule", with_fixtures(
    f"SELECT user_id, word, seq, correct, cb AS correct_before, CAST({_LADDER} AS BIGINT) AS ladder_days, "
    f"CASE WHEN {_LADDER} <= date_diff('day', CAST(reviewed_at AS DATE), DATE '9999-12-31') "
    f"THEN CAST(reviewed_at AS DATE) + CAST(least({_LADDER}, 3000000) AS INTEGER) END AS ladder_next_review "
    "FROM (SELECT *, correct_count - CAST(correct AS BIGINT) AS cb FROM replay)", "replay"))
def q_ladder_schedule(spark, sf_dir):
    return rv.ladder_schedule(fx.reviews(spark, sf_dir), DEFAULT)


@query("apply_review_updates", with_fixtures(
    "SELECT user_id, word, review_count, correct_count, success_rate, streak, interval_days, last_reviewed, "
    "next_review FROM word_state s WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.user_id = s.user_id "
    f"AND r.word = s.word AND r.reviewed_at < {TODAY})", "word_state"))
def q_apply_review_updates(spark, sf_dir):
    """Stored state from the reviews before today, then today's batch applied
    on top: must equal the full replay's final state."""
    r = fx.reviews(spark, sf_dir)
    today = F.lit(DEFAULT.today).cast("timestamp_ntz")
    stored = rv.word_state(r.where(F.col("reviewed_at") < today), DEFAULT)
    out = rv.apply_review_updates(stored, r.where(F.col("reviewed_at") >= today), DEFAULT)
    return out.select("user_id", "word", "review_count", "correct_count", "success_rate", "streak",
                      "interval_days", "last_reviewed", "next_review")
