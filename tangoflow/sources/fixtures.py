"""Learner tables derived from the supplied Parquet tables.

Every table here is a pure projection / bounded-broadcast join of the given
tables, so its size grows with them.  ``sf_dir`` is a folder holding
``<table>.parquet``.  The same definitions exist as SQL in
``tangoflow.plans.oracle`` for the DuckDB parity check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangoflow import params as P
from tangoflow.functions.text import sentences_of
from tangoflow.params import DEFAULT, Params

# Fixed fixture rules: words per user are k % WORDS_PER_USER; chats join part
# on k; two never-reviewed words per user.
WORDS_PER_USER = 20
NEW_WORDS = (("new1", "new word one"), ("new2", "new word two"))
NEW_WORD_ADDED = "2024-01-01"
NEW_WORD_NEXT = "2024-02-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table (read-only input)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> F.Column:
    return F.from_json(F.col("props"), "k int")["k"]


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part columns that name words.  No hint: Spark knows the file's size
    and picks the join."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review log: one row per answered review."""
    k = _k()
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.concat(F.lit("w"), (k % WORDS_PER_USER).cast("string")).alias("word"),
        (k % WORDS_PER_USER).cast("int").alias("wn"),
        F.col("ts").alias("reviewed_at"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") != F.lit("error")).alias("correct"),
    )


def dirty_next_review(user_id: F.Column, wn: F.Column, next_review: F.Column) -> F.Column:
    """Store next_review as text with the dirt real stores carry."""
    m = (user_id + wn) % 10
    unpadded = F.concat_ws("-", F.year(next_review).cast("string"), F.month(next_review).cast("string"),
                           F.dayofmonth(next_review).cast("string"))
    return (F.when(m == 0, F.lit(None).cast("string"))
            .when(m == 1, F.lit("bad"))
            .when(m == 2, unpadded)
            .otherwise(F.date_format(next_review, P.DAY_FORMAT)))


def words(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    """Vocabulary table: final replay state of every reviewed word, english
    from ``part``, plus two never-reviewed words per learner."""
    from tangoflow.operators.reviews import word_state

    state = word_state(reviews(spark, sf_dir), params).withColumn(
        "wn", F.substring("word", 2, 8).cast("int"))
    names = part(spark, sf_dir)
    reviewed = (state.join(names, state.wn == names.p_partkey, "left")
                .select("user_id",
                        F.col("word").alias("japanese"),
                        F.col("p_name").alias("english"),
                        F.col("first_reviewed").alias("added_date"),
                        F.lit(0).alias("practice_count"),
                        "last_reviewed",
                        dirty_next_review(F.col("user_id"), F.col("wn"), F.col("next_review")).alias("next_review"),
                        "review_count", "correct_count", "success_rate", "streak", "wn"))
    users = reviews(spark, sf_dir).select("user_id").distinct()
    fresh = F.inline(F.array(*[F.struct(F.lit(j).alias("japanese"), F.lit(e).alias("english"))
                               for j, e in NEW_WORDS]))
    new = users.select("user_id", fresh).select(
        "user_id", "japanese", "english",
        F.lit(NEW_WORD_ADDED).cast("date").alias("added_date"),
        F.lit(0).alias("practice_count"),
        F.lit(None).cast("date").alias("last_reviewed"),
        F.lit(NEW_WORD_NEXT).alias("next_review"),
        F.lit(0).cast("bigint").alias("review_count"),
        F.lit(0).cast("bigint").alias("correct_count"),
        F.lit(0.0).alias("success_rate"),
        F.lit(0).alias("streak"),
        F.lit(None).cast("int").alias("wn"))
    return reviewed.unionByName(new)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation history: one chat per event."""
    k = _k()
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    names = part(spark, sf_dir)
    j = ev.join(names, ev.k == names.p_partkey, "left")
    vocab = F.concat(F.col("p_name"), F.lit(" ["), F.col("p_brand"), F.lit("] ("), F.col("p_type"), F.lit(")"))
    level = (F.when(F.col("event_type").isin("click", "error"), F.lit("Beginner"))
             .when(F.col("event_type") == "view", F.lit("Intermediate"))
             .when(F.col("event_type") == "purchase", F.lit("Advanced")))
    return j.select(
        "user_id",
        F.col("event_id").alias("conv_id"),
        F.concat(F.lit("ask "), F.col("k").cast("string")).alias("user_message"),
        F.when(F.col("k") % 3 == 0, vocab).otherwise(F.lit("no vocabulary")).alias("ai_response"),
        F.date_format("ts", P.MINUTE_FORMAT).alias("timestamp"),
        level.alias("level"),
        F.when(F.col("k") % 10 != 9, F.concat(F.lit("topic"), (F.col("k") % 6).cast("string"))).alias("topic"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("created_at"),
    )


def settings_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings key/value rows (values raw text or JSON text)."""
    c = F.col("c_custkey")
    rows = F.array_compact(F.array(
        F.when(c % 3 != 0, F.struct(F.lit("preferred_level").alias("setting_key"),
                                    F.lit("Advanced").alias("setting_value"))),
        F.when(c % 2 == 0, F.struct(F.lit("daily_goal").alias("setting_key"),
                                    (c % 9 + 1).cast("string").alias("setting_value"))),
        F.when(c % 5 == 0, F.struct(F.lit("favorite_topics").alias("setting_key"),
                                    F.lit('["topic1"]').alias("setting_value"))),
    ))
    return (table(spark, sf_dir, "customer")
            .select(c.alias("user_id"), F.inline(rows)))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every learner known to the store (customer keys)."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed quiz answers: one per review, typed four ways by seq % 4."""
    r = reviews(spark, sf_dir)
    names = part(spark, sf_dir)
    j = r.join(names, r.wn == names.p_partkey, "left")
    m = F.col("seq") % 4
    typed = (F.when(m == 0, F.col("p_name"))
             .when(m == 1, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
             .when(m == 2, F.lit("wrong"))
             .otherwise(F.lit("   ")))
    return j.select("user_id", "word", "seq", F.col("reviewed_at").alias("answered_at"), typed.alias("answer"))


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training metrics log: (run, epoch, phase, step, loss)."""
    k = _k()
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("run"),
        (F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int").alias("epoch"),
        F.when(k % 5 == 0, F.lit("val")).otherwise(F.lit("train")).alias("phase"),
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus sentences of every language with their position in the document
    (whole texts)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return docs.select("doc_id", "lang", F.posexplode(sentences_of(F.col("text"))).alias("pos", "sentence")).select(
        "doc_id", "lang", F.col("pos").cast("int").alias("pos"), "sentence")


# Fixed error-injection rules: (language, error_type, right form, wrong form, level).
ERROR_RULES = (
    ("en", "article", " the ", " a ", 1),
    ("en", "agreement", " is ", " are ", 2),
    ("en", "preposition", " in ", " on ", 3),
    ("en", "conjunction", " and ", " but ", None),
    ("de", "article", " der ", " die ", 1),
    ("de", "agreement", " ist ", " sind ", 2),
    ("de", "preposition", " in ", " auf ", 3),
    ("de", "conjunction", " und ", " aber ", None),
    ("fr", "article", " le ", " la ", 1),
    ("fr", "agreement", " est ", " sont ", 2),
    ("fr", "preposition", " dans ", " sur ", 3),
    ("fr", "conjunction", " et ", " mais ", None),
    ("es", "article", " el ", " la ", 1),
    ("es", "agreement", " es ", " son ", 2),
    ("es", "preposition", " en ", " de ", 3),
    ("es", "conjunction", " y ", " pero ", None),
)
