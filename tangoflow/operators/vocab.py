"""Vocabulary operators (P2, O1, P4, P5, P7, J1) and quiz grading."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangoflow.functions.text import normalize_answer
from tangoflow.params import DEFAULT, Params

WORD_KEY = ("user_id", "japanese")
SORT_COLUMNS = {"Added Date": "added_date", "Japanese": "japanese", "English": "english",
                "Practice Count": "practice_count"}


def search_mask(term: str, *cols: str) -> F.Column:
    """P2 predicate: ``term`` is a regex, case-insensitive (Unicode aware);
    NULL never matches; OR over the columns."""
    pat = "(?iu)" + term
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.col(c).rlike(pat), F.lit(False))
    return out


def vocab_search(words: DataFrame, term: str | None) -> DataFrame:
    """P2 — words whose japanese or english matches ``term``; no term → all."""
    if not term:
        return words
    return words.where(search_mask(term, "japanese", "english"))


def vocab_sort(words: DataFrame, by: str = "Added Date", newest_first: bool = True) -> DataFrame:
    """O1 — per learner, sort by one column, descending for "Newest First"
    whatever the column type; missing values last both ways; the word breaks
    ties.  A global range-partitioned sort: a learner's words spread over as
    many tasks as the sort needs."""
    col = SORT_COLUMNS.get(by, by)
    key = F.col(col).desc_nulls_last() if newest_first else F.col(col).asc_nulls_last()
    return words.orderBy(F.col("user_id"), key, F.col("japanese"))


def words_with_reviews(words: DataFrame) -> DataFrame:
    """P4 — words that have at least one review (array form: non-empty
    review_sequence; table form: review_count > 0)."""
    if "review_sequence" in words.columns:
        return words.where(F.coalesce(F.size("review_sequence"), F.lit(0)) > 0)
    return words.where(F.col("review_count") > 0)


def delete_words(words: DataFrame, keys: DataFrame) -> DataFrame:
    """P5 — drop words by (user_id, japanese).  Anti-join; the planner picks
    broadcast only when the key list is small at run time."""
    return words.join(keys.select(*WORD_KEY), list(WORD_KEY), "left_anti")


def new_word_defaults(candidates: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """P7 — word rows with initial values from (user_id, japanese, english)
    candidates; both texts must be non-empty."""
    today = F.lit(params.today if isinstance(params.today, _dt.date) else None).cast("date")
    return (candidates.where((F.length("japanese") > 0) & (F.length("english") > 0))
            .select("user_id", "japanese", "english",
                    today.alias("added_date"),
                    F.lit(0).alias("practice_count"),
                    F.lit(None).cast("date").alias("last_reviewed"),
                    F.date_format(today, "yyyy-MM-dd").alias("next_review"),
                    F.lit(0).cast("bigint").alias("review_count"),
                    F.lit(0).cast("bigint").alias("correct_count"),
                    F.lit(0.0).alias("success_rate"),
                    F.lit(0).alias("streak")))


def add_words_anti(words: DataFrame, candidates: DataFrame, params: Params = DEFAULT,
                   order_cols: tuple = ("conv_id", "item_no")) -> DataFrame:
    """J1 — add only words whose key is not present yet.

    The batch is first reduced to one candidate per key (the earliest by
    ``order_cols``; a partially aggregated ``min_by``), then anti-joined with the
    stored words.  Returns the rows to add.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    ok = (F.length("japanese") > 0) & (F.length("english") > 0)
    first = (candidates.where(ok).groupBy(*WORD_KEY)
             .agg(F.min_by(F.col("english"), order).alias("english")))
    fresh = new_word_defaults(first, params)
    return fresh.join(words.select(*WORD_KEY), list(WORD_KEY), "left_anti")


def grade_answers(answers: DataFrame, words: DataFrame, jp_to_en: bool = True) -> DataFrame:
    """J6 — typed answers joined with the words; lower+strip both sides and
    compare exactly.  Blank answers are not graded (not recorded)."""
    expected = "english" if jp_to_en else "japanese"
    w = words.select("user_id", F.col("japanese").alias("word"), F.col(expected).alias("expected"))
    a = answers.withColumn("given", normalize_answer(F.col("answer"))).where(F.length("given") > 0)
    j = a.join(w, ["user_id", "word"], "inner")
    return j.select("user_id", "word", "seq", "given",
                    (F.col("given") == normalize_answer(F.col("expected"))).alias("is_correct"))
