"""Store maintenance: upserts, de-duplication, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangoflow import params as P
from tangoflow.functions.text import decode_setting, quote_json


def upsert(existing: DataFrame, incoming: DataFrame, keys, order_cols) -> DataFrame:
    """Insert-or-replace by key: the row with the greatest ``order_cols`` wins,
    an incoming row beats a stored one on ties (last writer wins).

    ``max_by`` is partially aggregated map-side, so a key with millions of
    versions is reduced per task before the shuffle.
    """
    cols = existing.columns
    u = (existing.select(*cols, F.lit(0).alias("_src"))
         .unionByName(incoming.select(*cols, F.lit(1).alias("_src"))))
    rank = F.struct(*[F.col(c) for c in order_cols], F.col("_src"))
    payload = F.struct(*[F.col(c) for c in cols if c not in keys])
    best = u.groupBy(*keys).agg(F.max_by(payload, rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*cols)


def upsert_words(existing: DataFrame, incoming: DataFrame, order_cols=("updated_at",)) -> DataFrame:
    """U1 — words by (user_id, japanese)."""
    return upsert(existing, incoming, ["user_id", "japanese"], order_cols)


def upsert_settings(existing: DataFrame, incoming: DataFrame, order_cols=("updated_at",)) -> DataFrame:
    """U3 — settings by (user_id, setting_key)."""
    return upsert(existing, incoming, ["user_id", "setting_key"], order_cols)


def dedupe_chats(chats: DataFrame) -> DataFrame:
    """U4 — exact-duplicate removal after a merge import (all columns)."""
    return chats.dropDuplicates()


def from_backup_chats(chats: DataFrame) -> DataFrame:
    """U2 helper — backup/app field names (user, ai) to stored names."""
    return chats.withColumnRenamed("user", "user_message").withColumnRenamed("ai", "ai_response")


def json_kind(json_text: F.Column) -> F.Column:
    """JSON kind from canonical JSON text: string / array / object / boolean /
    null / number."""
    first = F.substring(json_text, 1, 1)
    return (F.when(json_text.isNull(), "null").when(first == '"', "string").when(first == "[", "array").when(first == "{", "object")
            .when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number"))


def load_settings(settings: DataFrame, users: DataFrame, defaults=P.SETTING_DEFAULTS) -> DataFrame:
    """S7 — stored (user_id, setting_key, setting_value) decoded to canonical
    JSON (JSON text decoded, anything else is a raw string), plus the default
    for every (user, default key) that has no stored row.

    The defaults are a fixed list, expanded per user as a projection
    (``inline``), then an anti-join removes the keys the user has stored.
    """
    stored = settings.select("user_id", "setting_key", decode_setting(F.col("setting_value")).alias("value_json"))
    rows = F.array(*[F.struct(F.lit(k).alias("setting_key"), F.lit(v).alias("value_json")) for k, v in defaults])
    missing = (users.select("user_id").distinct()
               .select("user_id", F.inline(rows))
               .join(stored.select("user_id", "setting_key"), ["user_id", "setting_key"], "left_anti"))
    out = stored.unionByName(missing.select("user_id", "setting_key", "value_json"))
    return out.withColumn("kind", json_kind(F.col("value_json")))


def encode_setting(value_json: F.Column) -> F.Column:
    """H10 — canonical JSON -> stored text: strings are stored raw, everything
    else as JSON text."""
    is_str = F.substring(value_json, 1, 1) == '"'
    return F.when(is_str, F.try_parse_json(value_json).cast("string")).otherwise(value_json)


def erase_users(table: DataFrame, user_ids: DataFrame) -> DataFrame:
    """S13 — remove every row of the listed learners (anti-join; no broadcast
    hint because the erase list has no size bound)."""
    return table.join(user_ids.select("user_id").distinct(), "user_id", "left_anti")


def clear_users(tables: dict, user_ids: DataFrame) -> dict:
    """S13 — every table of the store without the listed learners."""
    return {name: erase_users(df, user_ids) for name, df in tables.items()}


__all__ = ["upsert", "upsert_words", "upsert_settings", "dedupe_chats", "from_backup_chats", "load_settings",
           "encode_setting", "erase_users", "clear_users", "json_kind", "quote_json"]
