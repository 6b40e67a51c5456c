"""Registered queries: conversations and the progress report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tangoflow import params as P
from tangoflow.operators import chats as ch, progress as pg
from tangoflow.params import DEFAULT
from tangoflow.plans.oracle_fixtures import TODAY, with_fixtures
from tangoflow.plans.registry import query
from tangoflow.sources import fixtures as fx

DAY = "CAST(strptime(timestamp, '%Y-%m-%d %H:%M') AS DATE)"
SEED_BUCKET = "('0x' || substr(md5(concat_ws('|', '42', CAST({c} AS VARCHAR))), 1, 8))::BIGINT"


@query("pair_turns", with_fixtures(
    "SELECT conv_id, turn, text AS user_message, nt AS ai_response FROM ("
    "SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM turns "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'", "turns"))
def q_pair_turns(spark, sf_dir):
    return ch.pair_turns(fx.turns(spark, sf_dir))


@query("recent_chats", with_fixtures(
    "SELECT user_id, conv_id, CAST(rk AS INTEGER) AS recent_rank, CAST(total - rk + 1 AS BIGINT) AS conversation_no, "
    "COALESCE(topic, 'Unknown') AS topic_label, COALESCE(level, 'Unknown') AS level_label, "
    "user_message, ai_response, timestamp FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, conv_id DESC) AS rk, "
    "count(*) OVER (PARTITION BY user_id) AS total FROM chats) WHERE rk <= 5", "chats"))
def q_recent_chats(spark, sf_dir):
    return ch.recent_chats(fx.chats(spark, sf_dir), 5, DEFAULT)


@query("load_chats", with_fixtures(
    "SELECT user_id, conv_id, user_message AS \"user\", ai_response AS ai, timestamp, level, topic, created_at FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, conv_id DESC) AS rk FROM chats) "
    "WHERE rk <= 20", "chats"))
def q_load_chats(spark, sf_dir):
    return ch.load_chats(fx.chats(spark, sf_dir), 20)


@query("todays_chats", with_fixtures(
    "SELECT user_id, count(*) AS today_chats FROM chats WHERE starts_with(timestamp, '2024-01-30') "
    "GROUP BY user_id", "chats"))
def q_todays_chats(spark, sf_dir):
    return ch.todays_chats(fx.chats(spark, sf_dir), DEFAULT)


_CONTENT = "user_id, user_message, ai_response, timestamp, level, topic"
_ON = " AND ".join(f"n.{c} IS NOT DISTINCT FROM r.{c}" for c in _CONTENT.split(", "))


@query("delete_chats", with_fixtures(
    f"SELECT n.user_id, n.conv_id, n.user_message, n.ai_response, n.timestamp, n.level, n.topic, n.created_at "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY {_CONTENT} ORDER BY created_at, conv_id) AS rn FROM chats) n "
    f"LEFT JOIN (SELECT {_CONTENT}, count(*) AS k FROM (SELECT DISTINCT {_CONTENT} FROM chats "
    f"WHERE topic IS NULL AND level IS NULL) GROUP BY ALL) r ON {_ON} WHERE r.k IS NULL OR n.rn > r.k", "chats"))
def q_delete_chats(spark, sf_dir):
    """Delete requests: one per distinct untitled, level-less chat content."""
    c = fx.chats(spark, sf_dir)
    req = c.where(F.col("topic").isNull() & F.col("level").isNull()).select(*ch.CONTENT).distinct()
    return ch.delete_chats(c, req)


_SYS = ("You are a patient Japanese tutor. Learner level: %s. Conversation topic: %s. "
        "Write every Japanese sentence as: Japanese [romanisation] (English). "
        "Always give the English meaning, introduce one or two new words, correct mistakes kindly "
        "and keep answers short.")


@query("build_chat_prompts", with_fixtures(
    f"SELECT user_id, conv_id, printf('{_SYS}', COALESCE(level, 'Beginner'), COALESCE(topic, 'Free Conversation')) "
    "AS system_prompt, user_message AS user_prompt, CAST(to_json([{'role': 'system', 'content': system_prompt}, "
    "{'role': 'user', 'content': user_prompt}]) AS VARCHAR) AS messages FROM chats", "chats"))
def q_build_chat_prompts(spark, sf_dir):
    """The prompts and the messages built of them (as JSON text)."""
    return ch.build_chat_prompts(fx.chats(spark, sf_dir), DEFAULT).withColumn("messages", F.to_json("messages"))


@query("has_vocab_flag", with_fixtures(
    "SELECT user_id, conv_id, contains(ai_response, '(') AND contains(ai_response, ')') AS has_vocab FROM chats",
    "chats"))
def q_has_vocab_flag(spark, sf_dir):
    c = fx.chats(spark, sf_dir)
    return c.select("user_id", "conv_id", ch.has_vocab_flag(F.col("ai_response")).alias("has_vocab"))


_PAT = ch.vocab_pattern(ch.LATIN_EXPRESSION).replace("'", "''")


@query("extract_vocab", with_fixtures(
    "SELECT user_id, conv_id, CAST(unnest(generate_series(0, len(e) - 1)) AS INTEGER) AS item_no, "
    "nullif(unnest(e), '') AS expression, nullif(unnest(r), '') AS reading, nullif(unnest(m), '') AS romaji, "
    "nullif(unnest(t), '') AS meaning FROM (SELECT user_id, conv_id, "
    f"regexp_extract_all(ai_response, '{_PAT}', 1) AS e, regexp_extract_all(ai_response, '{_PAT}', 2) AS r, "
    f"regexp_extract_all(ai_response, '{_PAT}', 3) AS m, regexp_extract_all(ai_response, '{_PAT}', 4) AS t "
    "FROM chats)", "chats"))
def q_extract_vocab(spark, sf_dir):
    return ch.extract_vocab(fx.chats(spark, sf_dir), ch.LATIN_EXPRESSION)


_APP_TOPICS = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in P.APP_TOPICS) + "]"
_SUGG = " UNION ALL ".join(
    "SELECT '" + t.replace("'", "''") + "' AS t, [" + ", ".join("'" + x.replace("'", "''") + "'" for x in s) + "] AS phrases"
    for t, s in P.TOPIC_SUGGESTIONS)


@query("topic_suggestions", with_fixtures(
    "SELECT c.user_id, c.conv_id, c.app_topic, CASE WHEN s.phrases IS NOT NULL THEN "
    f"list_extract(s.phrases, CAST({SEED_BUCKET.format(c='c.conv_id')} % len(s.phrases) + 1 AS INTEGER)) END "
    f"AS suggestion FROM (SELECT user_id, conv_id, list_extract({_APP_TOPICS}, "
    "CAST(substr(topic, 6) AS INTEGER) + 1) AS app_topic FROM chats) c "
    f"LEFT JOIN ({_SUGG}) s ON c.app_topic = s.t", "chats"))
def q_topic_suggestions(spark, sf_dir):
    """Chat topics 'topicN' are the app's N-th topic."""
    c = fx.chats(spark, sf_dir)
    app = F.element_at(F.array(*[F.lit(t) for t in P.APP_TOPICS]),
                       (F.substring("topic", 6, 4).cast("int") + 1))
    c = c.select("user_id", "conv_id", F.when(F.col("topic").isNotNull(), app).alias("app_topic"))
    return ch.topic_suggestions(c, ch.suggestions_table(spark), "app_topic", DEFAULT)


@query("daily_counts", with_fixtures(
    f"SELECT user_id, {DAY} AS day, count(*) AS conversations FROM chats GROUP BY ALL", "chats"))
def q_daily_counts(spark, sf_dir):
    return pg.daily_counts(fx.chats(spark, sf_dir))


def _by_sql(col):
    return (f"SELECT d.user_id, d.day, v.{col}, CAST(COALESCE(c.n, 0) AS BIGINT) AS conversations "
            f"FROM (SELECT DISTINCT user_id, day FROM cells) d JOIN (SELECT DISTINCT user_id, {col} FROM cells) v "
            f"ON v.user_id = d.user_id LEFT JOIN cells c ON c.user_id = d.user_id AND c.day = d.day AND c.{col} = v.{col}")


def _cells(col):
    return {"cells": f"SELECT user_id, {DAY} AS day, {col}, count(*) AS n FROM chats WHERE {col} IS NOT NULL GROUP BY ALL"}


@query("daily_by_level", with_fixtures(_by_sql("level"), "chats", extra=_cells("level")))
def q_daily_by_level(spark, sf_dir):
    return pg.daily_by_level(fx.chats(spark, sf_dir))


@query("daily_by_topic", with_fixtures(_by_sql("topic"), "chats", extra=_cells("topic")))
def q_daily_by_topic(spark, sf_dir):
    return pg.daily_by_topic(fx.chats(spark, sf_dir))


@query("practice_days", with_fixtures(f"SELECT DISTINCT user_id, {DAY} AS day FROM chats", "chats"))
def q_practice_days(spark, sf_dir):
    return pg.practice_days(fx.chats(spark, sf_dir))


_STREAK_CTES = {
    "d": f"SELECT DISTINCT user_id, {DAY} AS day FROM chats",
    "isl": "SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS grp "
           "FROM d",
    "runs": "SELECT user_id, grp, count(*) AS run_len, max(day) AS last_day FROM isl GROUP BY ALL",
    "streak": f"SELECT user_id, last_day, CAST(run_len - 1 + CASE WHEN last_day = {TODAY} THEN 1 ELSE 0 END AS INTEGER) "
              "AS day_streak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_day DESC) AS rk "
              "FROM runs) WHERE rk = 1",
}


@query("practice_day_streak", with_fixtures("SELECT * FROM streak", "chats", extra=_STREAK_CTES))
def q_practice_day_streak(spark, sf_dir):
    return pg.practice_day_streak(fx.chats(spark, sf_dir), DEFAULT)


@query("progress_summary", with_fixtures(
    "SELECT t.user_id, t.total_chats, CAST(COALESCE(w.n, 0) AS BIGINT) AS words_learned, "
    "CAST(COALESCE(td.n, 0) AS BIGINT) AS today_chats, COALESCE(s.day_streak, 0) AS day_streak "
    "FROM (SELECT user_id, count(*) AS total_chats FROM chats GROUP BY user_id) t "
    "LEFT JOIN (SELECT user_id, count(*) AS n FROM words GROUP BY user_id) w ON w.user_id = t.user_id "
    "LEFT JOIN (SELECT user_id, count(*) AS n FROM chats WHERE starts_with(timestamp, '2024-01-30') GROUP BY user_id) td "
    "ON td.user_id = t.user_id LEFT JOIN streak s ON s.user_id = t.user_id", "chats", "words", extra=_STREAK_CTES))
def q_progress_summary(spark, sf_dir):
    return pg.progress_summary(fx.chats(spark, sf_dir), fx.words(spark, sf_dir), DEFAULT)


def _bytes_sql(cols):
    return "strlen(CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in cols) + "}) AS VARCHAR))"


_SIZE = "(COALESCE(w.b, 0) + COALESCE(c.b, 0))"


@query("store_statistics", with_fixtures(
    "SELECT COALESCE(w.user_id, c.user_id) AS user_id, CAST(COALESCE(w.total_words, 0) AS BIGINT) AS total_words, "
    "CAST(COALESCE(c.total_conversations, 0) AS BIGINT) AS total_conversations, "
    "CAST(COALESCE(w.words_with_reviews, 0) AS BIGINT) AS words_with_reviews, "
    "CAST(COALESCE(c.today_conversations, 0) AS BIGINT) AS today_conversations, "
    f"CAST({_SIZE} AS BIGINT) AS size_bytes, round({_SIZE} / {pg.MEBIBYTE}.0, 2)::DOUBLE AS size_mb FROM "
    f"(SELECT user_id, count(*) AS total_words, count_if(review_count > 0) AS words_with_reviews, "
    f"sum({_bytes_sql(pg.WORD_ROW)}) AS b FROM words GROUP BY user_id) w FULL JOIN "
    f"(SELECT user_id, count(*) AS total_conversations, count_if(starts_with(timestamp, '2024-01-30')) "
    f"AS today_conversations, sum({_bytes_sql(pg.CHAT_ROW)}) AS b FROM chats GROUP BY user_id) c "
    "ON w.user_id = c.user_id", "chats", "words"))
def q_store_statistics(spark, sf_dir):
    return pg.store_statistics(fx.words(spark, sf_dir), fx.chats(spark, sf_dir), DEFAULT)
