"""Spaced-repetition scalar expressions (H1, H2, H11) — all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tangoflow import params as P


def review_interval(rate: Column, streak: Column) -> Column:
    """(success rate, current streak) -> days until the next review, 1..30.

    Missing inputs count as 0.  Thresholds are inclusive.
    """
    r = F.coalesce(rate.cast("double"), F.lit(0.0))
    s = F.coalesce(streak.cast("int"), F.lit(0))
    base = F.lit(P.RATE_BASE_FLOOR)
    for threshold, days in reversed(list(zip(P.RATE_THRESHOLDS, P.RATE_BASES))):
        base = F.when(r >= F.lit(threshold), F.lit(days)).otherwise(base)
    return F.least(base * (F.lit(1) + F.floor(s / F.lit(2)).cast("int")), F.lit(P.MAX_INTERVAL_DAYS)).cast("int")


def next_review_date(reviewed_at: Column, interval_days: Column) -> Column:
    """Calendar day of the review plus the interval (a DATE)."""
    return F.date_add(F.to_date(reviewed_at), interval_days)


def ladder_interval(correct_before: Column, correct: Column) -> Column:
    """Documented ladder schedule: a hit steps through the ladder by the number
    of correct answers stored before this review; a miss is one day."""
    ladder = F.array(*[F.lit(d) for d in P.LADDER_DAYS])
    n = F.coalesce(correct_before.cast("int"), F.lit(0))
    last = len(P.LADDER_DAYS)
    # Doubling stops after LADDER_MAX_DOUBLINGS steps: beyond that the day is out of the calendar anyway.
    doublings = F.least(n - F.lit(last - 1), F.lit(P.LADDER_MAX_DOUBLINGS))
    beyond = (F.lit(P.LADDER_DAYS[-1]) * F.pow(F.lit(2.0), doublings.cast("double"))).cast("bigint")
    hit = F.when(n < F.lit(last), F.element_at(ladder, n + F.lit(1)).cast("bigint")).otherwise(beyond)
    return F.when(F.coalesce(correct, F.lit(False)), hit).otherwise(F.lit(P.LADDER_MISS_DAYS).cast("bigint"))


def calendar_day_after(day: Column, days: Column) -> Column:
    """``day`` plus ``days``; NULL where that is after the year 9999."""
    room = F.datediff(F.lit("9999-12-31").cast("date"), day)
    return F.when(days <= room, F.date_add(day, F.least(days, room.cast("bigint")).cast("int")))


def strict_day(text: Column) -> Column:
    """Parse 'yyyy-m-d' text the way a strict day parser does; NULL when it
    does not parse (month/day may be unpadded, no blanks, 4-digit year)."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
