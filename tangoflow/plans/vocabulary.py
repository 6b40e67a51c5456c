"""Registered queries: vocabulary, quiz grading, store maintenance, backups."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from tangoflow.functions.text import normalize_answer
from tangoflow.operators import chats as ch, due, reviews as rv, search, split, store, vocab
from tangoflow.params import DEFAULT
from tangoflow.plans.oracle_fixtures import TODAY, with_fixtures, word_state_ctes
from tangoflow.plans.registry import query
from tangoflow.session import scratch_path
from tangoflow.sources import backups as bk, fixtures as fx

WORD_COLS = ("user_id", "japanese", "english", "added_date", "practice_count", "last_reviewed", "next_review",
             "review_count", "correct_count", "success_rate", "streak")
_WC = ", ".join(WORD_COLS)
SEARCH_TERM = "ring"
EXPORT_AT = _dt.datetime(2024, 1, 30, 12, 0, 0)


def _words(spark, sf_dir):
    return fx.words(spark, sf_dir, DEFAULT).select(*WORD_COLS)


@query("vocab_search", with_fixtures(
    f"SELECT {_WC} FROM words WHERE COALESCE(regexp_matches(japanese, '{SEARCH_TERM}', 'i'), false) "
    f"OR COALESCE(regexp_matches(english, '{SEARCH_TERM}', 'i'), false)", "words"))
def q_vocab_search(spark, sf_dir):
    return vocab.vocab_search(_words(spark, sf_dir), SEARCH_TERM)


@query("vocab_search_index", with_fixtures(
    f"SELECT {_WC} FROM words WHERE COALESCE(regexp_matches(japanese, '{SEARCH_TERM}', 'i'), false) "
    f"OR COALESCE(regexp_matches(english, '{SEARCH_TERM}', 'i'), false)", "words"))
def q_vocab_search_index(spark, sf_dir):
    """The same search over a trigram index of the words."""
    path = search.build_index(_words(spark, sf_dir), scratch_path(spark, "vocab-index"))
    return search.search_index(spark, path, SEARCH_TERM).select(*WORD_COLS)


@query("vocab_sort", with_fixtures(
    f"SELECT {_WC}, row_number() OVER (PARTITION BY user_id ORDER BY english DESC NULLS LAST, japanese) AS position FROM words", "words"))
def q_vocab_sort(spark, sf_dir):
    """Each learner's words with their place in the sorted table."""
    return split.positions(vocab.vocab_sort(_words(spark, sf_dir), "English", newest_first=True), ["user_id"])


@query("words_with_reviews", with_fixtures(f"SELECT {_WC} FROM words WHERE review_count > 0", "words"))
def q_words_with_reviews(spark, sf_dir):
    return vocab.words_with_reviews(_words(spark, sf_dir))


@query("delete_words", with_fixtures(
    f"SELECT {_WC} FROM words WHERE NOT (review_count > 0 AND correct_count = 0)", "words"))
def q_delete_words(spark, sf_dir):
    """Delete the words a learner never answered right."""
    w = _words(spark, sf_dir)
    gone = w.where((F.col("review_count") > 0) & (F.col("correct_count") == 0))
    return vocab.delete_words(w, gone)


_PAT = ch.vocab_pattern(ch.LATIN_EXPRESSION).replace("'", "''")
_CAND = {
    "cand0": "SELECT user_id, conv_id, timestamp, "
             f"regexp_extract_all(ai_response, '{_PAT}', 1) AS e, regexp_extract_all(ai_response, '{_PAT}', 4) AS t "
             "FROM chats",
    "cand": "SELECT user_id, conv_id, timestamp, CAST(unnest(generate_series(0, len(e) - 1)) AS INTEGER) AS item_no, "
            "unnest(e) AS japanese, unnest(t) AS english FROM cand0",
}
_DEFAULTS = (f"{TODAY} AS added_date, 0 AS practice_count, CAST(NULL AS DATE) AS last_reviewed, "
             "'2024-01-30' AS next_review, CAST(0 AS BIGINT) AS review_count, CAST(0 AS BIGINT) AS correct_count, "
             "CAST(0.0 AS DOUBLE) AS success_rate, 0 AS streak")


def _candidates(chats):
    v = ch.extract_vocab(chats, ch.LATIN_EXPRESSION)
    return v.join(chats.select("user_id", "conv_id", "timestamp"), ["user_id", "conv_id"]).select(
        "user_id", "conv_id", "timestamp", "item_no", F.col("expression").alias("japanese"),
        F.col("meaning").alias("english"))


@query("new_word_defaults", with_fixtures(
    f"SELECT user_id, japanese, english, {_DEFAULTS} FROM cand WHERE length(japanese) > 0 AND length(english) > 0",
    "chats", extra=_CAND))
def q_new_word_defaults(spark, sf_dir):
    return vocab.new_word_defaults(_candidates(fx.chats(spark, sf_dir)), DEFAULT)


@query("add_words_anti", with_fixtures(
    f"SELECT user_id, japanese, english, {_DEFAULTS} FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id, japanese ORDER BY conv_id, item_no) AS rk FROM cand "
    "WHERE starts_with(timestamp, '2024-01-30') AND length(japanese) > 0 AND length(english) > 0) b "
    "WHERE rk = 1 AND NOT EXISTS (SELECT 1 FROM words w WHERE w.user_id = b.user_id AND w.japanese = b.japanese) "
    "AND NOT EXISTS (SELECT 1 FROM cand o WHERE o.user_id = b.user_id AND o.japanese = b.japanese "
    "AND NOT starts_with(o.timestamp, '2024-01-30'))", "chats", "words", extra=_CAND))
def q_add_words_anti(spark, sf_dir):
    """Today's new vocabulary from the tutor's replies, minus every word the
    learner already has (stored words plus words added on earlier days)."""
    c = _candidates(fx.chats(spark, sf_dir))
    today = F.col("timestamp").startswith(DEFAULT.today.isoformat())
    stored = _words(spark, sf_dir).unionByName(vocab.new_word_defaults(c.where(~today), DEFAULT))
    return vocab.add_words_anti(stored, c.where(today), DEFAULT)


@query("normalize_answer", with_fixtures(
    "SELECT user_id, word, seq, lower(trim(answer)) AS normalized FROM answers", "answers"))
def q_normalize_answer(spark, sf_dir):
    a = fx.answers(spark, sf_dir)
    return a.select("user_id", "word", "seq", normalize_answer(F.col("answer")).alias("normalized"))


@query("grade_answers", with_fixtures(
    "SELECT a.user_id, a.word, a.seq, lower(trim(a.answer)) AS given, "
    "lower(trim(a.answer)) = lower(trim(w.english)) AS is_correct FROM answers a "
    "JOIN words w ON w.user_id = a.user_id AND w.japanese = a.word WHERE lower(trim(a.answer)) <> ''",
    "answers", "words"))
def q_grade_answers(spark, sf_dir):
    return vocab.grade_answers(fx.answers(spark, sf_dir), _words(spark, sf_dir), jp_to_en=True)


_STRICT = ("CASE WHEN regexp_full_match(next_review, '\\d{4}-\\d{1,2}-\\d{1,2}') "
           "THEN try_strptime(next_review, '%Y-%m-%d')::DATE END")
_MIXED = "(('0x' || substr(md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), japanese, 's1')), 1, 8))::BIGINT % 2 = 0)"


@query("quiz_question", with_fixtures(
    f"SELECT user_id, japanese, CAST(position AS INTEGER) AS position, {_MIXED} AS jp_to_en, "
    f"CASE WHEN {_MIXED} THEN japanese ELSE english END AS prompt, "
    f"CASE WHEN {_MIXED} THEN english ELSE japanese END AS expected FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added_date DESC NULLS LAST, japanese) AS position "
    f"FROM words WHERE {_STRICT} IS NULL OR {_STRICT} <= {TODAY}) WHERE position <= 10", "words"))
def q_quiz_question(spark, sf_dir):
    s = due.quiz_session(fx.words(spark, sf_dir), DEFAULT)
    q = due.quiz_question(s, "mixed", "s1", DEFAULT)
    return q.select("user_id", "japanese", "position", "jp_to_en", "prompt", "expected")


_US_COLS = "user_id, word AS japanese, review_count, correct_count, success_rate, streak, last_reviewed"
_SPLIT = {
    "rv_before": f"SELECT * FROM reviews WHERE reviewed_at < {TODAY}",
    "rv_today": f"SELECT * FROM reviews WHERE reviewed_at >= {TODAY}",
}


@query("upsert_words", with_fixtures(
    f"SELECT {_US_COLS.replace('word AS japanese', 'japanese')} FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id, japanese ORDER BY last_reviewed DESC, src DESC) AS rk FROM ("
    f"SELECT {_US_COLS}, 0 AS src FROM word_state_b UNION ALL SELECT {_US_COLS}, 1 AS src FROM word_state_t)) "
    "WHERE rk = 1", "reviews",
    extra={**_SPLIT, **word_state_ctes("rv_before", "_b"), **word_state_ctes("rv_today", "_t")}))
def q_upsert_words(spark, sf_dir):
    """Stored words = state of the reviews before today; incoming = rows
    re-computed from today's reviews alone (insert-or-replace semantics)."""
    r = fx.reviews(spark, sf_dir)
    today = F.lit(DEFAULT.today).cast("timestamp_ntz")

    def rows(df):
        return rv.word_state(df, DEFAULT).select(
            "user_id", F.col("word").alias("japanese"), "review_count", "correct_count", "success_rate", "streak",
            "last_reviewed", F.col("last_reviewed").alias("updated_at"))

    out = store.upsert_words(rows(r.where(F.col("reviewed_at") < today)), rows(r.where(F.col("reviewed_at") >= today)))
    return out.drop("updated_at")


@query("upsert_settings", with_fixtures(
    "SELECT user_id, setting_key, setting_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, setting_key "
    "ORDER BY updated_at DESC, src DESC) AS rk FROM ("
    "SELECT user_id, setting_key, setting_value, DATE '2024-01-01' AS updated_at, 0 AS src FROM settings_kv "
    "UNION ALL SELECT user_id, 'daily_goal', CAST(count(*) AS VARCHAR), DATE '2024-01-30', 1 FROM chats "
    "WHERE starts_with(timestamp, '2024-01-30') GROUP BY user_id)) WHERE rk = 1", "settings_kv", "chats"))
def q_upsert_settings(spark, sf_dir):
    """Learners active today get their daily goal set to today's chat count."""
    s = fx.settings_kv(spark, sf_dir).withColumn("updated_at", F.lit("2024-01-01").cast("date"))
    inc = (ch.todays_chats(fx.chats(spark, sf_dir), DEFAULT)
           .select("user_id", F.lit("daily_goal").alias("setting_key"),
                   F.col("today_chats").cast("string").alias("setting_value"),
                   F.lit("2024-01-30").cast("date").alias("updated_at")))
    return store.upsert_settings(s, inc).drop("updated_at")


_CHAT_COLS = "user_id, conv_id, user_message, ai_response, timestamp, level, topic, created_at"


@query("append_chats", with_fixtures(f"SELECT {_CHAT_COLS} FROM chats", "chats"))
def q_append_chats(spark, sf_dir):
    """Store the history up to yesterday partitioned by day, append today's
    chats (arriving in backup field names), read the dataset back."""
    c = fx.chats(spark, sf_dir)
    day = F.substring("timestamp", 1, 10)
    today = F.col("timestamp").startswith(DEFAULT.today.isoformat())
    path = scratch_path(spark, "chats")
    c.where(~today).withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(path)
    incoming = c.where(today).withColumnRenamed("user_message", "user").withColumnRenamed("ai_response", "ai")
    store.from_backup_chats(incoming).withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)
    return spark.read.parquet(path).select(*c.columns)


@query("dedupe_chats", with_fixtures(f"SELECT DISTINCT {_CHAT_COLS} FROM chats", "chats"))
def q_dedupe_chats(spark, sf_dir):
    """A merge import that re-delivers today's chats: exact duplicates go."""
    c = fx.chats(spark, sf_dir)
    again = c.where(F.col("timestamp").startswith(DEFAULT.today.isoformat()))
    return store.dedupe_chats(c.unionByName(again))


_DECODE = ("CASE WHEN json_valid(setting_value) THEN CAST(json(setting_value) AS VARCHAR) "
           "ELSE CAST(to_json(setting_value) AS VARCHAR) END")
_KIND = ("CASE left(value_json, 1) WHEN '\"' THEN 'string' WHEN '[' THEN 'array' WHEN '{' THEN 'object' "
         "WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' ELSE 'number' END")
_SETTINGS_CTES = {
    "stored": f"SELECT user_id, setting_key, {_DECODE} AS value_json FROM settings_kv",
    "defaults": "SELECT * FROM (VALUES ('preferred_level', '\"Beginner\"'), ('favorite_topics', '[]'), "
                "('daily_goal', '5')) d(setting_key, value_json)",
    "loaded": "SELECT * FROM stored UNION ALL SELECT c.c_custkey, d.setting_key, d.value_json FROM customer c, "
              "defaults d WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = c.c_custkey "
              "AND s.setting_key = d.setting_key)",
}


@query("load_settings", with_fixtures(f"SELECT *, {_KIND} AS kind FROM loaded", "settings_kv",
                                      extra=_SETTINGS_CTES))
def q_load_settings(spark, sf_dir):
    return store.load_settings(fx.settings_kv(spark, sf_dir), fx.users(spark, sf_dir))


@query("encode_setting", with_fixtures(
    "SELECT user_id, setting_key, CASE WHEN left(value_json, 1) = '\"' THEN json_extract_string(value_json, '$') "
    "ELSE value_json END AS stored FROM loaded", "settings_kv", extra=_SETTINGS_CTES))
def q_encode_setting(spark, sf_dir):
    s = store.load_settings(fx.settings_kv(spark, sf_dir), fx.users(spark, sf_dir))
    return s.select("user_id", "setting_key", store.encode_setting(F.col("value_json")).alias("stored"))


_GONE = "NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')"


@query("clear_user_data", with_fixtures(
    f"SELECT 'words' AS kind, user_id, japanese AS item FROM words WHERE user_id {_GONE} UNION ALL "
    f"SELECT 'chats', user_id, CAST(conv_id AS VARCHAR) FROM chats WHERE user_id {_GONE} UNION ALL "
    f"SELECT 'settings', user_id, setting_key FROM settings_kv WHERE user_id {_GONE} UNION ALL "
    f"SELECT 'reviews', user_id, CAST(seq AS VARCHAR) FROM reviews WHERE user_id {_GONE}",
    "words", "chats", "settings_kv", "reviews"))
def q_clear_user_data(spark, sf_dir):
    """Erase every learner of one market segment from all tables; what is left."""
    gone = fx.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE") \
        .select(F.col("c_custkey").alias("user_id"))
    left = store.clear_users({"words": _words(spark, sf_dir), "chats": fx.chats(spark, sf_dir),
                              "settings": fx.settings_kv(spark, sf_dir), "reviews": fx.reviews(spark, sf_dir)}, gone)
    item = {"words": "japanese", "chats": "conv_id", "settings": "setting_key", "reviews": "seq"}
    rows = [df.select(F.lit(k).alias("kind"), "user_id", F.col(item[k]).cast("string").alias("item")) for k, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _export(spark, sf_dir, max_items=25, max_reviews=8):
    """Write the backups of all learners; small part/chunk sizes so that the
    sf0.01 data really is split over several parts and chunks."""
    words = fx.words(spark, sf_dir, DEFAULT)
    reviews = rv.review_replay(fx.reviews(spark, sf_dir), DEFAULT)
    env = bk.export_backups(words, reviews, fx.chats(spark, sf_dir), fx.settings_kv(spark, sf_dir),
                            EXPORT_AT, max_items=max_items, max_reviews=max_reviews)
    return bk.write_backups(env, scratch_path(spark, "backups"))


@query("export_backups", with_fixtures(
    "SELECT COALESCE(w.user_id, c.user_id, s.user_id) AS user_id, CAST(COALESCE(w.n, 0) AS BIGINT) AS words, "
    "CAST(COALESCE(w.r, 0) AS BIGINT) AS reviews, CAST(COALESCE(c.n, 0) AS BIGINT) AS chats, "
    "CAST(COALESCE(s.n, 0) AS BIGINT) AS settings FROM "
    "(SELECT user_id, count(*) AS n, sum(review_count) AS r FROM words GROUP BY user_id) w "
    "FULL JOIN (SELECT user_id, count(*) AS n FROM chats GROUP BY user_id) c ON c.user_id = w.user_id "
    "FULL JOIN (SELECT user_id, count(*) AS n FROM settings_kv GROUP BY user_id) s "
    "ON s.user_id = COALESCE(w.user_id, c.user_id)", "words", "chats", "settings_kv"))
def q_export_backups(spark, sf_dir):
    """Per learner: what the written envelopes hold."""
    env = bk.read_envelopes(spark, _export(spark, sf_dir))
    lw = env.select("user_id", F.explode("learned_words").alias("w"))
    w = lw.groupBy("user_id").agg(F.count_distinct("w.japanese").alias("words"),
                                  F.sum(F.size("w.review_sequence")).cast("bigint").alias("reviews"))
    c = env.groupBy("user_id").agg(F.sum(F.size("conversation_history")).cast("bigint").alias("chats"))
    s = env.groupBy("user_id").agg(F.sum(F.size("user_settings")).cast("bigint").alias("settings"))
    j = w.join(c, "user_id", "full").join(s, "user_id", "full")
    return j.select("user_id", *[F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x)
                                 for x in ("words", "reviews", "chats", "settings")]).where(
        (F.col("words") + F.col("chats") + F.col("settings")) > 0)


_BW = "user_id, japanese, english, added_date, practice_count, last_reviewed, next_review"


@query("read_backups", with_fixtures(f"SELECT {_BW} FROM words", "words"))
def q_read_backups(spark, sf_dir):
    valid, _ = bk.validate_backups(bk.read_envelopes(spark, _export(spark, sf_dir)))
    return bk.backup_words(valid).select(*_BW.split(", "))


@query("read_backup_reviews", with_fixtures(
    "SELECT user_id, word, review_no, CAST(date_trunc('second', reviewed_at) AS TIMESTAMP) AS reviewed_at, correct "
    "FROM replay", "replay"))
def q_read_backup_reviews(spark, sf_dir):
    valid, _ = bk.validate_backups(bk.read_envelopes(spark, _export(spark, sf_dir)))
    return bk.backup_reviews(valid)


def _md5_part(key, n):
    return (f"CAST(('0x' || substr(md5({key}), 1, 8))::BIGINT % CAST(greatest(1, ceil({n} / 25)) AS BIGINT) "
            "AS INTEGER)")


_PARTS = {
    "wchunks": "SELECT DISTINCT user_id, word AS japanese, (review_no - 1) // 8 AS chunk FROM replay",
    "wentries": "SELECT w.user_id, w.japanese, COALESCE(c.chunk, 0) AS chunk FROM words w LEFT JOIN wchunks c "
                "ON c.user_id = w.user_id AND c.japanese = w.japanese",
    "wparts": "SELECT DISTINCT e.user_id, "
              + _md5_part("e.japanese || '|' || CAST(e.chunk AS VARCHAR)", "n.n") + " AS part FROM wentries e "
              "JOIN (SELECT user_id, count(*) AS n FROM wentries GROUP BY user_id) n USING (user_id)",
    "cparts": f"SELECT DISTINCT c.user_id, {_md5_part('CAST(c.conv_id AS VARCHAR)', 'n.n')} AS part FROM chats c "
              "JOIN (SELECT user_id, count(*) AS n FROM chats GROUP BY user_id) n USING (user_id)",
    "sparts": "SELECT DISTINCT user_id, 0 AS part FROM settings_kv",
}


@query("validate_backups", with_fixtures(
    "SELECT user_id, part, 'valid' AS status FROM (SELECT * FROM wparts UNION SELECT * FROM cparts "
    "UNION SELECT * FROM sparts) UNION ALL SELECT CAST(NULL AS BIGINT), 0, 'unparsable' "
    "UNION ALL SELECT 2, 9, 'conversation_history'", "words", "replay", "chats", "settings_kv", extra=_PARTS))
def q_validate_backups(spark, sf_dir):
    """Real envelopes plus one broken line and one envelope without its chat
    history: per envelope, valid or the reason it was quarantined."""
    path = _export(spark, sf_dir)
    bad_path = scratch_path(spark, "bad-backups")
    bad = spark.createDataFrame([('{"user_id": 1, "learned_words": [',),
                                 ('{"user_id": 2, "part": 9, "learned_words": [], "user_settings": {}}',)], "value string")
    bad.coalesce(1).write.mode("overwrite").text(bad_path)
    valid, quarantine = bk.validate_backups(bk.read_envelopes(spark, [path, bad_path]))
    return (valid.select("user_id", "part", F.lit("valid").alias("status"))
            .unionByName(quarantine.select("user_id", "part", F.col("reason").alias("status"))))


@query("import_backups", with_fixtures(
    "SELECT 'words' AS kind, user_id, japanese AS item, review_count AS n, CAST(streak AS BIGINT) AS m FROM words UNION ALL "
    "SELECT 'chats', user_id, CAST(conv_id AS VARCHAR), NULL, NULL FROM chats UNION ALL "
    "SELECT 'settings', user_id, setting_key || '=' || setting_value, NULL, NULL FROM settings_kv UNION ALL "
    "SELECT 'reviews', user_id, word, review_no, CAST(correct AS BIGINT) FROM replay",
    "words", "chats", "settings_kv", "replay"))
def q_import_backups(spark, sf_dir):
    """Merge-import full backups into a store that holds the chats up to
    yesterday and no review: the learning state comes back by replay, chats
    imported again are de-duplicated; rows of all tables."""
    c = fx.chats(spark, sf_dir)
    stored = {"words": fx.words(spark, sf_dir, DEFAULT),
              "chats": c.where(~F.col("timestamp").startswith(DEFAULT.today.isoformat())),
              "settings": fx.settings_kv(spark, sf_dir)}
    valid, _ = bk.validate_backups(bk.read_envelopes(spark, _export(spark, sf_dir)))
    got = bk.import_backups(stored, valid, "merge")
    none = F.lit(None).cast("bigint")
    row = lambda kind, item, n=none, m=none: got[kind].select(
        F.lit(kind).alias("kind"), "user_id", item.cast("string").alias("item"), n.cast("bigint").alias("n"),
        m.cast("bigint").alias("m"))
    return (row("words", F.col("japanese"), F.col("review_count"), F.col("streak"))
            .unionByName(row("chats", F.col("conv_id")))
            .unionByName(row("settings", F.concat_ws("=", "setting_key", "setting_value")))
            .unionByName(row("reviews", F.col("word"), F.col("review_no"), F.col("correct"))))


@query("load_words", with_fixtures(
    "SELECT e.user_id, e.japanese, CAST(e.chunk AS BIGINT) AS chunk, CAST(len(e.r) AS BIGINT) AS reviews, "
    "row_number() OVER (PARTITION BY e.user_id ORDER BY w.added_date DESC NULLS LAST, e.japanese, e.chunk) AS position FROM ("
    "SELECT w.user_id, w.japanese, COALESCE(c.chunk, 0) AS chunk, COALESCE(c.r, []) AS r FROM words w LEFT JOIN ("
    "SELECT user_id, word AS japanese, (review_no - 1) // 8 AS chunk, list(review_no) AS r FROM replay GROUP BY ALL) c "
    "ON c.user_id = w.user_id AND c.japanese = w.japanese) e JOIN words w ON w.user_id = e.user_id AND w.japanese = e.japanese",
    "words", "replay"))
def q_load_words(spark, sf_dir):
    """Words stored the single-user way (review_sequence as JSON text), loaded
    and decoded: per stored entry its reviews and its place in load order."""
    valid, _ = bk.validate_backups(bk.read_envelopes(spark, _export(spark, sf_dir)))
    e = valid.select("user_id", F.explode("learned_words").alias("w")).select(
        "user_id", "w.japanese", F.to_date("w.added_date").alias("added_date"), F.floor(F.col("w.review_offset") / 8).alias("chunk"),
        F.to_json("w.review_sequence").alias("review_sequence"))
    loaded = split.positions(bk.load_words(e, "chunk"), ["user_id"])
    return loaded.select("user_id", "japanese", F.col("chunk").cast("bigint").alias("chunk"),
                         F.size("review_sequence").cast("bigint").alias("reviews"), "position")


_ALL_TABLES = ("SELECT 'words' AS kind, user_id, japanese || '=' || COALESCE(english, '') AS item, review_count AS n FROM words UNION ALL "
               "SELECT 'chats', user_id, CAST(conv_id AS VARCHAR) || '=' || ai_response, NULL FROM chats UNION ALL "
               "SELECT 'settings', user_id, setting_key || '=' || setting_value, NULL FROM settings_kv")


def _store_tables(spark, sf_dir):
    return {"words": _words(spark, sf_dir), "chats": fx.chats(spark, sf_dir), "settings": fx.settings_kv(spark, sf_dir)}


def _tagged(tables):
    """The rows of all stored tables."""
    pair = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("="), F.coalesce(b, F.lit("")))
    of = {"words": (pair("japanese", "english"), F.col("review_count")), "chats": (pair("conv_id", "ai_response"), F.lit(None)),
          "settings": (pair("setting_key", "setting_value"), F.lit(None))}
    rows = [tables[k].select(F.lit(k).alias("kind"), "user_id", item.alias("item"), n.cast("bigint").alias("n")) for k, (item, n) in of.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("save_tables", with_fixtures(_ALL_TABLES, "words", "chats", "settings_kv"))
def q_save_tables(spark, sf_dir):
    """Every table of the store, saved and read back."""
    paths = bk.save_tables(_store_tables(spark, sf_dir), scratch_path(spark, "store-v1"))
    return _tagged({k: spark.read.parquet(p) for k, p in paths.items()})


@query("snapshot_backup", with_fixtures(_ALL_TABLES, "words", "chats", "settings_kv"))
def q_snapshot_backup(spark, sf_dir):
    """Every table of the snapshot, as read back."""
    return _tagged(bk.snapshot_backup(spark, _store_tables(spark, sf_dir), scratch_path(spark, "snapshots"), EXPORT_AT))


@query("export_vocab_csv", with_fixtures(
    f"SELECT {_WC} FROM words WHERE COALESCE(regexp_matches(japanese, '{SEARCH_TERM}', 'i'), false) "
    f"OR COALESCE(regexp_matches(english, '{SEARCH_TERM}', 'i'), false)", "words"))
def q_export_vocab_csv(spark, sf_dir):
    view = vocab.vocab_sort(vocab.vocab_search(_words(spark, sf_dir), SEARCH_TERM), "Added Date", True)
    path = bk.export_vocab_csv(view, scratch_path(spark, "vocab-csv"))
    return spark.read.schema(view.schema).option("header", True).csv(path)
