"""Conversation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangoflow import params as P
from tangoflow.functions.text import seeded_bucket
from tangoflow.operators import split
from tangoflow.params import DEFAULT, Params

CONTENT = ("user_id", "user_message", "ai_response", "timestamp", "level", "topic")


def pair_turns(turns: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """W8 — a user turn followed by an assistant turn becomes one chat row
    (conv_id, turn, user_message, ai_response).  A conversation of very many
    turns is cut into blocks of turns, and one row is carried over each border."""
    t = turns.select("conv_id", "turn", "role", "text")
    nxt = split.with_next(t, ["conv_id"], ["turn"], F.col("turn"), {"role": "next_role", "text": "next_text"}, params.split_rows)
    return (nxt.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
               .select("conv_id", "turn", F.col("text").alias("user_message"), F.col("next_text").alias("ai_response")))


def _chrono(desc: bool = False):
    if desc:
        return (F.col("created_at").desc(), F.col("conv_id").desc())
    return (F.col("created_at").asc(), F.col("conv_id").asc())


def recent_chats(chats: DataFrame, n: int | None = None, params: Params = DEFAULT) -> DataFrame:
    """W5 — the newest n (1..20, default 5) chats per learner, newest first,
    each labelled with its running number in chronological order.

    The top-n is a WindowGroupLimit (partial top-n before the shuffle); the
    learner's total comes from a partially aggregated count, so a learner with
    a huge history never lands in one task whole.
    """
    n = max(1, min(n or params.recent_chats, P.MAX_RECENT_CHATS))
    w = Window.partitionBy("user_id").orderBy(*_chrono(desc=True))
    top = chats.withColumn("recent_rank", F.row_number().over(w)).where(F.col("recent_rank") <= n)
    totals = chats.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_chats"))
    return (top.join(totals, "user_id")
               .select("user_id", "conv_id", F.col("recent_rank").cast("int").alias("recent_rank"),
                       (F.col("total_chats") - F.col("recent_rank") + 1).cast("bigint").alias("conversation_no"),
                       F.coalesce(F.col("topic"), F.lit("Unknown")).alias("topic_label"),
                       F.coalesce(F.col("level"), F.lit("Unknown")).alias("level_label"),
                       "user_message", "ai_response", "timestamp"))


def load_chats(chats: DataFrame, limit: int | None = None) -> DataFrame:
    """S6 — per learner the newest ``limit`` chats (all when None), returned
    oldest first, columns renamed user_message→user, ai_response→ai."""
    out = chats
    if limit:
        w = Window.partitionBy("user_id").orderBy(*_chrono(desc=True))
        out = out.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= limit).drop("_rk")
    return (out.select("user_id", "conv_id", F.col("user_message").alias("user"), F.col("ai_response").alias("ai"),
                       "timestamp", "level", "topic", "created_at")
               .orderBy("user_id", *_chrono()))


def todays_chats(chats: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """P3 — today's chats per learner.  ``startswith`` on the minute text is
    pushed to the Parquet scan as a string-prefix filter."""
    prefix = params.today.isoformat()
    return (chats.where(F.col("timestamp").startswith(prefix))
                 .groupBy("user_id").agg(F.count(F.lit(1)).alias("today_chats")))


def delete_chats(chats: DataFrame, requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """P6 — each request row removes the *first* (oldest) chat equal to it in
    content; k equal requests remove the k oldest equal chats.  NULLs are equal.

    The counted requests are written first, so Spark knows their size: few
    requests are broadcast and no chat moves.  Only chats that some request
    names are numbered; very many equal chats are cut into blocks of time.
    """
    req = requests.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("_k"))
    req = split.written(req.withColumn("_r", F.monotonically_increasing_id()), "delete-requests")
    cond = [chats[c].eqNullSafe(req[c]) for c in CONTENT]
    asked = chats.join(req, cond).select(*[chats[c] for c in chats.columns], "_k", "_r")
    ranked = split.numbered(asked, ["_r"], list(_chrono()), split.seconds(F.col("created_at")), params.split_rows)
    left = ranked.where(F.col("_rn") > F.col("_k")).select(*chats.columns)
    return chats.join(req, cond, "left_anti").unionByName(left)


def build_chat_prompts(chats: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """P9 — the tutor's system message and the user's message for each chat,
    as an array of (role, content) plus the two texts."""
    system = F.format_string(
        "You are a patient Japanese tutor. Learner level: %s. Conversation topic: %s. "
        "Write every Japanese sentence as: Japanese [romanisation] (English). "
        "Always give the English meaning, introduce one or two new words, correct mistakes kindly "
        "and keep answers short.",
        F.coalesce(F.col("level"), F.lit("Beginner")), F.coalesce(F.col("topic"), F.lit("Free Conversation")))
    msgs = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col("user_message").alias("content")))
    return chats.select("user_id", "conv_id", system.alias("system_prompt"),
                        F.col("user_message").alias("user_prompt"), msgs.alias("messages"))


def has_vocab_flag(text: F.Column) -> F.Column:
    """P10 — the response contains both '(' and ')'."""
    return text.contains("(") & text.contains(")")


# Vocabulary in a tutor reply: expression, optional (reading), optional
# [romanisation], then (meaning starting with a Latin letter).
JAPANESE_EXPRESSION = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々〜？！。、]+"
LATIN_EXPRESSION = r"[^\s\[\]()]+"


def vocab_pattern(expression_class: str = JAPANESE_EXPRESSION) -> str:
    return (f"({expression_class})\\s*(?:\\(([^)]*)\\))?\\s*(?:\\[([^\\]]*)\\])?\\s*"
            r"\(([A-Za-z][^)]*)\)")


def extract_vocab(chats: DataFrame, expression_class: str = JAPANESE_EXPRESSION,
                  text_col: str = "ai_response") -> DataFrame:
    """P11 — (expression, reading, romanisation, meaning) items from replies of
    the forms 'text (reading) [romaji] (meaning)' and 'text (meaning)'.  One
    regex over the whole reply, groups zipped and exploded — no UDF."""
    pat = F.lit(vocab_pattern(expression_class))
    groups = [F.regexp_extract_all(F.col(text_col), pat, F.lit(i)) for i in range(1, 5)]
    z = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("expression", "reading", "romaji", "meaning"))])
    items = chats.select("user_id", "conv_id", F.posexplode(z).alias("item_no", "it"))
    return items.select("user_id", "conv_id", F.col("item_no").cast("int").alias("item_no"),
                        *[F.nullif(F.col(f"it.{n}"), F.lit("")).alias(n)
                          for n in ("expression", "reading", "romaji", "meaning")])


def suggestions_table(spark) -> DataFrame:
    rows = [(t, list(s)) for t, s in P.TOPIC_SUGGESTIONS]
    return spark.createDataFrame(rows, "topic string, phrases array<string>")


def topic_suggestions(chats: DataFrame, suggestions: DataFrame, topic_col: str = "topic",
                      params: Params = DEFAULT) -> DataFrame:
    """J3 — one suggested question per chat for its topic (seeded choice);
    unknown topic → NULL.  The suggestions table is a fixed six-row list, a
    proven size bound, so it is broadcast."""
    s = F.broadcast(suggestions.withColumnRenamed("topic", "_t"))
    j = chats.join(s, chats[topic_col] == s["_t"], "left")
    pick = F.element_at(F.col("phrases"),
                        (seeded_bucket(params.seed, F.col("conv_id")) % F.size("phrases") + 1).cast("int"))
    return j.select(*[chats[c] for c in chats.columns], F.when(F.col("phrases").isNotNull(), pick).alias("suggestion"))
