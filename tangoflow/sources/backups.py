"""Backup envelopes and table I/O.

Envelope layout (JSON, one envelope per line, or one pretty-printed file per
learner in the single-user format):

    {user_id, part, export_date,
     learned_words: [{japanese, english, added_date, practice_count,
                      review_sequence: [{date, correct}], last_reviewed,
                      next_review, review_offset}],
     conversation_history: [{user, ai, timestamp, level, topic, conv_id, created_at}],
     user_settings: {key: value-text}}

Scale: a learner's whole history is never collected into one row.  Reviews
of a word are cut into chunks of at most ``max_reviews`` (a word may appear
in several entries, ``review_offset`` tells where its chunk starts), and the
entries of a learner are spread over ``ceil(n / max_items)`` parts by a hash
of the entry key.  Readers explode entries back into rows — no regrouping.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tangoflow import params as P

REVIEW_ENTRY = T.StructType([T.StructField("date", T.StringType()), T.StructField("correct", T.BooleanType())])
WORD_ENTRY = T.StructType([
    T.StructField("japanese", T.StringType()), T.StructField("english", T.StringType()),
    T.StructField("added_date", T.StringType()), T.StructField("practice_count", T.LongType()),
    T.StructField("review_sequence", T.ArrayType(REVIEW_ENTRY)),
    T.StructField("last_reviewed", T.StringType()), T.StructField("next_review", T.StringType()),
    T.StructField("review_offset", T.LongType()),
])
CHAT_ENTRY = T.StructType([
    T.StructField("user", T.StringType()), T.StructField("ai", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("topic", T.StringType()), T.StructField("conv_id", T.LongType()),
    T.StructField("created_at", T.StringType()),
])
ENVELOPE = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("export_date", T.StringType()),
    T.StructField("learned_words", T.ArrayType(WORD_ENTRY)),
    T.StructField("conversation_history", T.ArrayType(CHAT_ENTRY)),
    T.StructField("user_settings", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])
REQUIRED = ("learned_words", "conversation_history", "user_settings")


def _parts(entries: DataFrame, key: F.Column, max_items: int) -> DataFrame:
    """Spread a learner's entries over ceil(n / max_items) parts by an md5
    bucket of the entry key (text); n per learner is a partially aggregated
    count.  md5 keeps the assignment reproducible outside Spark."""
    n = entries.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    nparts = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(max_items))).cast("bigint")
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return (entries.join(n, "user_id")
            .withColumn("part", F.pmod(bucket, nparts).cast("int"))
            .drop("_n"))


def export_backups(words: DataFrame, reviews: DataFrame, chats: DataFrame, settings: DataFrame,
                   export_date: _dt.datetime, max_items: int = 1000, max_reviews: int = 1000) -> DataFrame:
    """S3 — one envelope (or several parts) per learner.

    ``reviews`` must carry review_no (position of the review in its word's
    history, e.g. from ``review_replay``)."""
    chunk = F.floor((F.col("review_no") - 1) / F.lit(max_reviews)).cast("bigint")
    rv = reviews.select("user_id", F.col("word").alias("japanese"), chunk.alias("chunk"), "review_no",
                        F.date_format("reviewed_at", P.SECOND_FORMAT).alias("date"), "correct")
    seqs = rv.groupBy("user_id", "japanese", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("review_no", "date", "correct"))).alias("s"))
    seqs = seqs.select("user_id", "japanese", "chunk",
                       F.transform("s", lambda x: F.struct(x["date"].alias("date"), x["correct"].alias("correct")))
                       .alias("review_sequence"))
    w = words.join(seqs, ["user_id", "japanese"], "left")
    entry = F.struct(
        F.col("japanese"), F.col("english"), F.date_format("added_date", P.DAY_FORMAT).alias("added_date"),
        F.col("practice_count").cast("bigint").alias("practice_count"),
        F.coalesce(F.col("review_sequence"), F.array().cast(T.ArrayType(REVIEW_ENTRY))).alias("review_sequence"),
        F.date_format("last_reviewed", P.DAY_FORMAT).alias("last_reviewed"), F.col("next_review"),
        (F.coalesce(F.col("chunk"), F.lit(0)) * F.lit(max_reviews)).cast("bigint").alias("review_offset"))
    wparts = _parts(w.select("user_id", F.col("japanese").alias("_k"), F.coalesce("chunk", F.lit(0)).alias("_c"),
                             entry.alias("e")), F.concat_ws("|", "_k", "_c"), max_items)
    wagg = wparts.groupBy("user_id", "part").agg(F.sort_array(F.collect_list(F.struct("_k", "_c", "e"))).alias("x"))
    wagg = wagg.select("user_id", "part", F.transform("x", lambda x: x["e"]).alias("learned_words"))

    centry = F.struct(F.col("user_message").alias("user"), F.col("ai_response").alias("ai"), "timestamp", "level",
                      "topic", "conv_id", F.date_format("created_at", P.SECOND_FORMAT).alias("created_at"))
    cparts = _parts(chats.select("user_id", "conv_id", "created_at", centry.alias("e")),
                    F.col("conv_id").cast("string"), max_items)
    cagg = cparts.groupBy("user_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("created_at", "conv_id", "e"))).alias("x"))
    cagg = cagg.select("user_id", "part", F.transform("x", lambda x: x["e"]).alias("conversation_history"))

    # Settings: a handful of keys per learner (bounded), in part 0.
    sagg = settings.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("setting_key", "setting_value"))).alias("user_settings")
    ).withColumn("part", F.lit(0))

    env = wagg.join(cagg, ["user_id", "part"], "full").join(sagg, ["user_id", "part"], "full")
    return env.select(
        "user_id", "part", F.lit(export_date.isoformat()).alias("export_date"),
        F.coalesce("learned_words", F.array().cast(T.ArrayType(WORD_ENTRY))).alias("learned_words"),
        F.coalesce("conversation_history", F.array().cast(T.ArrayType(CHAT_ENTRY))).alias("conversation_history"),
        F.coalesce("user_settings", F.create_map().cast(T.MapType(T.StringType(), T.StringType()))).alias("user_settings"))


def write_backups(envelopes: DataFrame, path: str) -> str:
    """Envelopes as JSON lines (UTF-8, unescaped non-ASCII)."""
    envelopes.write.mode("overwrite").json(path)
    return path


def read_envelopes(spark: SparkSession, path, multiline: bool = False, learners: DataFrame | None = None) -> DataFrame:
    """S1/S2 raw read: explicit schema, PERMISSIVE, corrupt text kept; for
    single-user files without a user_id field the id comes from ``learners``
    (file_name, user_id), or from a ``user<digits>`` file name (e.g.
    ``user_42.json``), else it stays NULL and the file is quarantined."""
    df = (spark.read.schema(ENVELOPE).option("mode", "PERMISSIVE").option("multiLine", multiline)
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path if isinstance(path, str) else list(path)))
    fname = F.col("_metadata.file_name")
    from_name = F.regexp_extract(fname, r"(?i)user[_-]?(\d+)", 1)
    uid = F.coalesce(F.col("user_id"), F.when(from_name != "", from_name.cast("bigint")))
    out = df.select(uid.alias("user_id"), F.coalesce("part", F.lit(0)).alias("part"), "export_date",
                    *REQUIRED, "_corrupt_record", fname.alias("file_name"))
    if learners is None:
        return out
    named = learners.select("file_name", F.col("user_id").alias("_named"))
    return out.join(named, "file_name", "left").select(
        F.coalesce("user_id", "_named").alias("user_id"), *[c for c in out.columns if c != "user_id"])


def validate_backups(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2 — (valid, quarantine): valid envelopes parse, carry all three keys
    and belong to a learner; everything else is quarantined with a reason."""
    missing = [F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED]
    missing.append(F.when(F.col("user_id").isNull(), F.lit("no learner")))
    reason = F.when(F.col("_corrupt_record").isNotNull(), F.lit("unparsable")).otherwise(
        F.concat_ws(",", *missing))
    tagged = envelopes.withColumn("reason", reason)
    ok = (F.col("reason") == "")
    return tagged.where(ok).drop("reason", "_corrupt_record"), tagged.where(~ok)


def _age() -> F.Column:
    """Order of envelopes: by export date, then file name."""
    return F.struct("export_date", "file_name")


def backup_words(valid: DataFrame) -> DataFrame:
    """S1 — word rows (one per learner and word; chunk entries de-duplicated)."""
    e = valid.select("user_id", _age().alias("at"), F.explode("learned_words").alias("w"))
    w = e.select("user_id", "at", "w.japanese", "w.english", F.to_date("w.added_date").alias("added_date"),
                 F.col("w.practice_count").cast("int").alias("practice_count"),
                 F.to_date("w.last_reviewed").alias("last_reviewed"), "w.next_review")
    # Chunk entries of one word carry the same attributes; of several backups of a learner the newest counts.
    rest = [c for c in w.columns if c not in ("user_id", "japanese", "at")]
    return (w.groupBy("user_id", "japanese").agg(F.max_by(F.struct(*rest), F.struct("at", *rest)).alias("_w"))
             .select("user_id", "japanese", "_w.*"))


def backup_reviews(valid: DataFrame) -> DataFrame:
    """S1 — the review log back from the words' review sequences."""
    e = valid.select("user_id", F.explode("learned_words").alias("w"))
    r = e.select("user_id", F.col("w.japanese").alias("word"), F.col("w.review_offset").alias("off"),
                 F.posexplode("w.review_sequence").alias("pos", "r"))
    return r.select("user_id", "word", (F.coalesce("off", F.lit(0)) + F.col("pos") + 1).alias("review_no"),
                    F.to_timestamp_ntz(F.col("r.date"), F.lit(P.SECOND_FORMAT)).alias("reviewed_at"),
                    F.col("r.correct").alias("correct"))


def backup_chats(valid: DataFrame) -> DataFrame:
    """S1 — chat rows (backup names user/ai renamed to the stored names)."""
    c = valid.select("user_id", F.explode("conversation_history").alias("c"))
    return c.select("user_id", F.col("c.conv_id").alias("conv_id"), F.col("c.user").alias("user_message"),
                    F.col("c.ai").alias("ai_response"), "c.timestamp", "c.level", "c.topic",
                    F.to_timestamp_ntz(F.col("c.created_at"), F.lit(P.SECOND_FORMAT)).alias("created_at"))


def backup_settings(valid: DataFrame) -> DataFrame:
    """S1 — stored settings rows."""
    s = valid.select("user_id", _age().alias("at"), F.explode("user_settings").alias("setting_key", "setting_value"))
    return s.groupBy("user_id", "setting_key").agg(
        F.max_by("setting_value", F.struct("at", "setting_value")).alias("setting_value"))


def with_review_state(words: DataFrame, reviews: DataFrame) -> DataFrame:
    """Words with the learning state that their reviews replay to."""
    from tangoflow.operators.reviews import word_state

    state = word_state(reviews.withColumnRenamed("review_no", "seq")).select(
        "user_id", F.col("word").alias("japanese"), "review_count", "correct_count", "success_rate", "streak")
    zero = {"review_count": 0, "correct_count": 0, "success_rate": 0.0, "streak": 0}
    return words.join(state, ["user_id", "japanese"], "left").na.fill(zero)


def import_backups(stored: dict, valid: DataFrame, mode: str = "merge") -> dict:
    """S4 — merge (upsert words/settings by key, reviews by (learner, word,
    number), chats appended then exact duplicates removed) or replace (the
    backup's tables as they are).  Words come with the state that their
    reviews replay to, so nothing of the learning history is lost."""
    from tangoflow.operators import store

    words, chats, settings = backup_words(valid), backup_chats(valid), backup_settings(valid)
    keys = ["user_id", "word", "review_no"]
    reviews = backup_reviews(valid).dropDuplicates(keys)
    if mode == "replace":
        return {"words": with_review_state(words, reviews), "chats": chats.dropDuplicates(), "settings": settings,
                "reviews": reviews}
    if mode != "merge":
        raise ValueError("mode must be 'merge' or 'replace'")
    ts = F.lit(0).cast("int")
    sw = stored["words"].select(*words.columns)
    merged_words = store.upsert(sw.withColumn("updated_at", ts), words.withColumn("updated_at", ts),
                                ["user_id", "japanese"], ("updated_at",)).drop("updated_at")
    merged_chats = store.dedupe_chats(stored["chats"].select(*chats.columns).unionByName(chats))
    ss = stored["settings"].select(*settings.columns)
    merged_settings = store.upsert(ss.withColumn("updated_at", ts), settings.withColumn("updated_at", ts),
                                   ["user_id", "setting_key"], ("updated_at",)).drop("updated_at")
    if "reviews" in stored:
        reviews = stored["reviews"].select(*reviews.columns).unionByName(reviews).dropDuplicates(keys)
    return {"words": with_review_state(merged_words, reviews), "chats": merged_chats, "settings": merged_settings,
            "reviews": reviews}


def load_words(words: DataFrame, *then: str) -> DataFrame:
    """S5 — stored words with review_sequence JSON text decoded (empty or
    NULL → []), newest added first, then the word (and ``then``)."""
    arr = T.ArrayType(REVIEW_ENTRY)
    seq = F.coalesce(F.from_json(F.nullif(F.col("review_sequence"), F.lit("")), arr), F.array().cast(arr))
    return (words.withColumn("review_sequence", seq)
                 .orderBy(F.col("added_date").desc_nulls_last(), F.col("japanese"), *then))


def save_tables(tables: dict, base: str, fmt: str = "parquet") -> dict:
    """S8 / S12 — write each table in full to ``base/<name>`` (a new,
    versioned folder — never overwrite a folder that is being read) and return
    the paths."""
    out = {}
    for name, df in tables.items():
        p = f"{base.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(p)
        out[name] = p
    return out


def snapshot_backup(spark: SparkSession, tables: dict, base: str, at: _dt.datetime) -> dict:
    """S12 — timestamped snapshot of the whole store; returns the read-back
    tables."""
    paths = save_tables(tables, f"{base.rstrip('/')}/snapshot={at.strftime('%Y%m%d_%H%M%S')}")
    return {n: spark.read.parquet(p) for n, p in paths.items()}


def export_vocab_csv(view: DataFrame, path: str) -> str:
    """S9 — the (filtered, sorted) vocabulary view as CSV with a header."""
    cols = [F.to_json(F.col(c)).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)
            for c, t in view.dtypes]
    view.select(*cols).write.mode("overwrite").option("header", True).csv(path)
    return path
