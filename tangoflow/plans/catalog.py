"""All registered queries (importing the plan modules registers them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangoflow.plans import conversation, corpus, learning, streams, vocabulary  # noqa: F401  (registers queries)
from tangoflow.plans.registry import ORACLE, QUERIES


def queries():
    return QUERIES


def oracle():
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due words of every learner today, weakest first, with the learner's
    overall statistics attached."""
    from tangoflow.operators import due, reviews as rv
    from tangoflow.params import DEFAULT
    from tangoflow.sources import fixtures as fx

    words = fx.words(spark, sf_dir, DEFAULT)
    stats = rv.review_stats(words)
    d = due.due_words(words, DEFAULT).select("user_id", "japanese", "english", "success_rate", "streak",
                                            "next_review")
    return d.join(stats, "user_id", "left").orderBy("user_id", F.col("success_rate"), "japanese")
