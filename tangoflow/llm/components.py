"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangoflow.llm.common import materialise


def _is_star(edges: DataFrame) -> bool:
    """Whether every node hangs directly below exactly one root."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")),
        F.struct(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))))
    per = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return per.where((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("root") > 0))).isEmpty()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node that
    has a link.  Large-star and small-star rounds alternate: each hangs nodes
    below smaller ones, at most doubling nothing but the reach, so the number
    of rounds is logarithmic.  Minima are partially aggregated, so a node with
    very many links is no hot task; every round is written."""
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialise(e, "links")
    for _ in range(max_rounds):
        if _is_star(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        e = materialise(small.where("u <> v").distinct(), "links")
    else:
        if not _is_star(e):
            raise RuntimeError(f"components unfinished after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
