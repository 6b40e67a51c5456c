"""Review replay and per-word learning state.

Skew design
-----------
The replay is a running computation per (user, word), so a plain window puts
every review of a key into one task.  Its state is an associative summary
(count, right answers, whether all were right, trailing run), so the reviews
of a hot key are cut into blocks of near equal size along time
(``operators.split``) and the replay is a two-level prefix scan:

1. one shuffle on (user, word, block); a running window *inside* the block
   gives the local count / correct count / last wrong position;
2. the blocks' summaries (one row per block) are composed along the key;
3. what a block inherits is joined back to its rows on (user, word, block):
   the big side is already partitioned that way, only the summaries move.

Where no key is hot there is one block per key and steps 2 and 3 fall away.
The final word state needs the summaries only, i.e. it never re-reads rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangoflow.functions.schedule import calendar_day_after, ladder_interval, next_review_date, review_interval
from tangoflow.operators import split
from tangoflow.params import DEFAULT, Params

KEYS = ("user_id", "word")
_RUN = (Window.unboundedPreceding, Window.currentRow)


def _prepared(reviews: DataFrame, params: Params) -> tuple[DataFrame, list[str]]:
    """Key columns, order columns and correct flag (missing = wrong), and the
    columns that name a block: the key, and ``_block`` if some key is hot."""
    rows = reviews.select(*KEYS, "reviewed_at", "seq", F.coalesce(F.col("correct"), F.lit(False)).alias("correct"))
    cut = split.blocks(rows, KEYS, split.seconds(F.col("reviewed_at")), params.split_rows)
    if cut is None:
        return rows, list(KEYS)
    # Non-nullable block: keeps the optimizer from adding a null filter on one
    # branch only, so both consumers of the shuffled rows share one exchange.
    return cut.withColumn(split.BLOCK, F.coalesce(split.BLOCK, F.lit(0))), [*KEYS, split.BLOCK]


def _local_scan(r: DataFrame, by: list[str]) -> DataFrame:
    """Running state inside each block."""
    w = Window.partitionBy(*by).orderBy("reviewed_at", "seq")
    run = w.rowsBetween(*_RUN)
    c = r.select("*", F.row_number().over(w).cast("bigint").alias("ln"),
                 F.sum(F.col("correct").cast("bigint")).over(run).alias("lok"))
    return c.select("*", F.max(F.when(~F.col("correct"), F.col("ln"))).over(run).alias("llw"))


def _summaries(local: DataFrame, by: list[str]) -> DataFrame:
    """One row per block.  Totals are read off the running columns (max of a
    running count = the block's total): both consumers of ``local`` then
    compute the same window columns, so their shuffle can be reused."""
    return local.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cnt"), F.max("lok").alias("ok"), F.max("llw").alias("lw"),
        F.min("reviewed_at").alias("first_ts"), F.max("reviewed_at").alias("last_ts"))


def _composed(s: DataFrame) -> DataFrame:
    """The blocks' summaries composed along each key: the state at a block's
    end and the trailing run before it."""
    ws = Window.partitionBy(*KEYS).orderBy(split.BLOCK)
    run = ws.rowsBetween(*_RUN)
    trail = F.col("cnt") - F.coalesce(F.col("lw"), F.lit(0))
    cum_cnt = F.sum("cnt").over(run)
    s = s.select("*", cum_cnt.alias("cum_cnt"), F.sum("ok").over(run).alias("cum_ok"),
                 # last block (so far) that had a miss: its cumulative count and trailing run
                 F.last(F.when(F.col("lw").isNotNull(), F.struct(cum_cnt.alias("c"), trail.alias("t"))),
                        ignorenulls=True).over(run).alias("lwb"))
    streak_end = F.when(F.col("lwb").isNull(), F.col("cum_cnt")).otherwise(
        F.col("lwb.t") + F.col("cum_cnt") - F.col("lwb.c"))
    s = s.select(*[c for c in s.columns if c != "lwb"], streak_end.alias("streak_end"))
    return s.select("*", F.coalesce(F.lag("streak_end").over(ws), F.lit(0)).alias("prior_streak"))


def _finish(df: DataFrame, n: Column, ok: Column, streak: Column, at: Column, keep) -> DataFrame:
    """Rate, interval and next review from (n, ok, streak) in two projections."""
    out = df.select(*keep, n.alias("review_no"), ok.alias("correct_count"),
                    (ok.cast("double") / n.cast("double")).alias("success_rate"),
                    streak.cast("int").alias("streak"), at.alias("_at"))
    interval = review_interval(F.col("success_rate"), F.col("streak"))
    return out.select(*[c for c in out.columns if c != "_at"], interval.alias("interval_days"),
                      next_review_date(F.col("_at"), interval).alias("next_review"))


def review_replay(reviews: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """W3 — the learning state after *every* review.

    Columns: user_id, word, seq, reviewed_at, correct, review_no,
    correct_count, success_rate, streak, interval_days, next_review.
    """
    r, by = _prepared(reviews, params)
    local = _local_scan(r, by)
    if split.BLOCK not in by:
        rows = local.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("prior_cnt", "prior_ok", "prior_streak")])
    else:
        inherited = _composed(_summaries(local, by)).select(
            *by, (F.col("cum_cnt") - F.col("cnt")).alias("prior_cnt"), (F.col("cum_ok") - F.col("ok")).alias("prior_ok"),
            "prior_streak")
        rows = local.join(inherited, by, "inner")
    n = F.col("prior_cnt") + F.col("ln")
    ok = F.col("prior_ok") + F.col("lok")
    streak = F.when(F.col("llw").isNotNull(), F.col("ln") - F.col("llw")).otherwise(F.col("prior_streak") + F.col("ln"))
    return _finish(rows, n, ok, streak, F.col("reviewed_at"), (*KEYS, "seq", "reviewed_at", "correct"))


def word_state(reviews: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """W4 — final state per (user, word), computed from block summaries only.

    Columns: user_id, word, review_count, correct_count, success_rate, streak,
    interval_days, first_reviewed, last_reviewed, next_review.
    """
    r, by = _prepared(reviews, params)
    s = _summaries(_local_scan(r, by), by)
    dates = lambda first, last: (*KEYS, F.to_date(first).alias("first_reviewed"), F.to_date(last).alias("last_reviewed"))
    if split.BLOCK not in by:
        out = _finish(s, F.col("cnt"), F.col("ok"), F.col("cnt") - F.coalesce(F.col("lw"), F.lit(0)), F.col("last_ts"),
                      dates("first_ts", "last_ts"))
    else:
        last = _composed(s).groupBy(*KEYS).agg(
            F.max_by(F.struct("cum_cnt", "cum_ok", "streak_end", "last_ts"), F.col(split.BLOCK)).alias("e"),
            F.min("first_ts").alias("first_ts"))
        out = _finish(last, F.col("e.cum_cnt"), F.col("e.cum_ok"), F.col("e.streak_end"), F.col("e.last_ts"),
                      dates("first_ts", "e.last_ts"))
    return out.select(*KEYS, F.col("review_no").alias("review_count"), "correct_count", "success_rate", "streak",
                      "interval_days", "first_reviewed", "last_reviewed", "next_review")


def late_keys(new_reviews: DataFrame, history: DataFrame) -> DataFrame:
    """Keys of the batch with a review that is not after all of the key's
    applied ones: late, or delivered again.  Two partially aggregated minima
    and maxima; no key's reviews are gathered."""
    at = F.struct("reviewed_at", "seq")
    first = new_reviews.groupBy(*KEYS).agg(F.min(at).alias("first_new"))
    last = history.join(first.select(*KEYS), list(KEYS), "left_semi").groupBy(*KEYS).agg(F.max(at).alias("last_old"))
    return first.join(last, list(KEYS)).where(F.col("first_new") <= F.col("last_old")).select(*KEYS)


def apply_review_updates(words: DataFrame, new_reviews: DataFrame, params: Params = DEFAULT,
                         how: str = "left", history: DataFrame | None = None) -> DataFrame:
    """J2 — continue each stored word's state with a batch of new reviews.

    ``words`` carries (user_id, word, review_count, correct_count, streak,
    last_reviewed, next_review, ...).  Stored state plays the part of the
    "prior blocks" of the replay, so the batch is replayed per key on top of
    it; keys without new reviews keep their stored values (left join), keys
    without stored state are not words of the learner and are ignored
    (``how="full"`` adds them with the batch's own state — the streaming
    merge).

    A review that repeats in the batch (same ``seq``) counts once.  With
    ``history``, the reviews applied so far, keys that get late or repeated
    reviews are replayed from their history and the batch, so the result is
    the state of all reviews in order.  Without it such reviews can only be
    counted, and ``last_reviewed`` never moves back.
    """
    new_reviews = new_reviews.dropDuplicates([*KEYS, "seq"])
    if history is None:
        return _continued(words, new_reviews, params, how)
    late = late_keys(new_reviews, history)
    fresh = new_reviews.join(late, list(KEYS), "left_anti")
    columns = [c for c in ("seq", "reviewed_at", "correct") if c in history.columns]
    both = history.select(*KEYS, *columns).unionByName(new_reviews.select(*KEYS, *columns))
    again = word_state(both.join(late, list(KEYS), "left_semi").dropDuplicates([*KEYS, "seq"]), params)
    rest = _continued(words, fresh, params, how)
    state = [c for c in again.columns if c not in KEYS and c in rest.columns]
    r = again.select(*KEYS, F.lit(True).alias("_again"), *[F.col(c).alias(f"_r_{c}") for c in state])
    j = rest.join(r, list(KEYS), "left")
    return j.select(*[F.when(F.col("_again"), F.col(f"_r_{c}").cast(rest.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                      if c in state else F.col(c) for c in rest.columns])


def _continued(words: DataFrame, new_reviews: DataFrame, params: Params, how: str) -> DataFrame:
    batch = word_state(new_reviews, params)
    b = batch.select(*KEYS, F.col("review_count").alias("b_cnt"), F.col("correct_count").alias("b_ok"),
                     F.col("streak").alias("b_streak"), F.col("last_reviewed").alias("b_last"),
                     F.col("first_reviewed").alias("b_first"))
    # Per-key: the batch's trailing run covers the whole batch iff it had no miss.
    j = words.join(b, list(KEYS), how)
    has = F.col("b_cnt").isNotNull()
    n = F.coalesce(F.col("review_count"), F.lit(0)) + F.coalesce(F.col("b_cnt"), F.lit(0))
    ok = F.coalesce(F.col("correct_count"), F.lit(0)) + F.coalesce(F.col("b_ok"), F.lit(0))
    stored_streak = F.coalesce(F.col("streak"), F.lit(0))
    streak = F.when(~has, F.col("streak")).when(F.col("b_streak") == F.col("b_cnt"),
                                                stored_streak + F.col("b_cnt")).otherwise(F.col("b_streak"))
    j = j.select("*", n.alias("_n"), ok.alias("_ok"), streak.cast("int").alias("_streak"),
                 F.greatest("b_last", "last_reviewed").alias("_last"))
    j = (j.withColumn("review_count", F.col("_n")).withColumn("correct_count", F.col("_ok"))
          .withColumn("success_rate", F.when(F.col("_n") > 0, F.col("_ok").cast("double") / F.col("_n").cast("double"))
                      .otherwise(F.lit(0.0)))
          .withColumn("streak", F.col("_streak")))
    interval = review_interval(F.col("success_rate"), F.col("streak"))
    return (j.withColumn("interval_days", F.when(has, interval).otherwise(F.col("interval_days")))
             .withColumn("next_review", F.when(has, F.date_add(F.col("_last"), interval)).otherwise(F.col("next_review")))
             .withColumn("last_reviewed", F.col("_last"))
             .transform(lambda d: d.withColumn("first_reviewed", F.least(F.col("first_reviewed"), F.col("b_first")))
                        if "first_reviewed" in words.columns else d)
             .drop("b_cnt", "b_ok", "b_streak", "b_last", "b_first", "_n", "_ok", "_streak", "_last"))


def success_rate(reviews: DataFrame) -> DataFrame:
    """A1 — correct / total per word (partial aggregation, skew-safe)."""
    ok = F.coalesce(F.col("correct"), F.lit(False))
    return (reviews.groupBy(*KEYS)
            .agg(F.count(F.lit(1)).alias("review_count"), F.count_if(ok).alias("correct_count"))
            .withColumn("success_rate", F.col("correct_count").cast("double") / F.col("review_count").cast("double")))


def word_streak(reviews: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """W1 — trailing run of correct answers per word."""
    return word_state(reviews, params).select(*KEYS, "streak")


def streak_of_flags(flags: Column) -> Column:
    """W1 array form: trailing run of true values in an array of booleans
    (NULL entries count as wrong)."""
    rev = F.reverse(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))))
    p = F.array_position(rev, F.lit(False))
    return F.when(p == 0, F.size(flags)).otherwise(p - 1).cast("int")


def review_stats(words: DataFrame) -> DataFrame:
    """A2 — per learner: total words, words with reviews, macro-average
    success rate over reviewed words (0 when none), total reviews."""
    reviewed = F.col("review_count") > 0
    return words.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_words"),
        F.count_if(reviewed).alias("words_with_reviews"),
        F.round(F.coalesce(F.avg(F.when(reviewed, F.col("success_rate"))), F.lit(0.0)), 9).alias("average_success_rate"),
        F.sum("review_count").cast("bigint").alias("total_reviews"),
    )


def ladder_schedule(reviews: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """H11 — the documented ladder schedule over the review log: the number of
    correct answers stored before each review picks the step.  Uses the same
    scan as the replay (correct_count before = running count − this)."""
    rp = review_replay(reviews, params)
    before = F.col("correct_count") - F.col("correct").cast("bigint")
    days = ladder_interval(before, F.col("correct"))
    return rp.select(*KEYS, "seq", "correct", before.alias("correct_before"), days.alias("ladder_days"),
                     calendar_day_after(F.to_date("reviewed_at"), days).alias("ladder_next_review"))
