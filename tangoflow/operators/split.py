"""Ordered work inside groups, any of which may be hot.

A running count, a rank or a look at the next row needs a group in order, and
a plain window puts a whole group into one task.  Groups of more than
``limit`` rows are therefore cut into blocks of near equal size along their
order: their quantiles, sketched with partial aggregation, are the cuts.
Blocks are windows of their own; what crosses a block's border is a summary of
one row per block.  Where no group is hot, and that is looked up first with
one aggregation over the key columns, the plan is the plain window.

Rows that share a position (the same second, the same turn) stay in one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangoflow.session import scratch_path

BLOCK = "_block"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so Spark knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seconds(ts: Column) -> Column:
    """A long that grows with a local timestamp, in any session time zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def same(a: DataFrame, b: DataFrame, keys) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def blocks(rows: DataFrame, keys, at: Column, limit: int | None) -> DataFrame | None:
    """``rows`` with ``_block`` (null for the rows of groups that are not
    hot), or None if no group has more than ``limit`` rows."""
    if not limit:
        return None
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= limit:
        return None
    n = -(-most // limit)
    hot = written(sizes.where(F.col("_n") > limit).select(*keys), "hot-groups")
    placed = rows.withColumn("_at", at)
    cuts = (placed.join(hot, same(placed, hot, keys), "left_semi").groupBy(*keys)
            .agg(F.percentile_approx("_at", [i / n for i in range(1, n)], 20 * n).alias("_cuts")))
    cuts = written(cuts, "hot-cuts")
    cuts = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cuts")
    on = [placed[k].eqNullSafe(cuts[f"_k{i}"]) for i, k in enumerate(keys)]
    block = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda x: x < F.col("_at"))))
    return placed.join(cuts, on, "left").select(*rows.columns, block.alias(BLOCK))


def numbered(rows: DataFrame, keys, order: list[Column], at: Column, limit: int | None, name: str = "_rn") -> DataFrame:
    """``rows`` with their rank (from 1) in their group by ``order``; ``at``
    is a long that grows with the order."""
    keys = list(keys)
    cut = blocks(rows, keys, at, limit)
    if cut is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    local = cut.withColumn(name, F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order)))
    sizes = cut.where(F.col(BLOCK).isNotNull()).groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("_b"), "_before")
    on = [local[k].eqNullSafe(offset[f"_k{i}"]) for i, k in enumerate(keys)] + [local[BLOCK] == offset["_b"]]
    return local.join(offset, on, "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def with_next(rows: DataFrame, keys, order: list[str], at: Column, carried: dict[str, str], limit: int | None) -> DataFrame:
    """``rows`` with columns of the next row of their group: ``carried`` maps
    a column to the name its next value gets.  The last row of a block looks
    at the first row of the next block, carried over as one row per block."""
    keys = list(keys)
    cut = blocks(rows, keys, at, limit)
    by = keys if cut is None else [*keys, BLOCK]
    w = Window.partitionBy(*by).orderBy(*order)
    lead = {new: F.lead(old).over(w) for old, new in carried.items()}
    if cut is None:
        return rows.withColumns(lead)
    hot = cut.where(F.col(BLOCK).isNotNull())
    first = hot.groupBy(*keys, BLOCK).agg(F.min_by(F.struct(*carried), F.struct(*order)).alias("_first"))
    nxt = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("_b"),
                       F.lead("_first").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_first"))
    local = cut.withColumns(lead | {"_end": F.lead(F.lit(False), 1, True).over(w)})
    on = [local[k].eqNullSafe(nxt[f"_k{i}"]) for i, k in enumerate(keys)] + [local[BLOCK] == nxt["_b"]]
    out = local.join(nxt, on, "left")
    return out.select(*rows.columns, *[F.when(F.col("_end"), F.col(f"_first.{old}")).otherwise(F.col(new)).alias(new)
                                       for old, new in carried.items()])


def positions(rows: DataFrame, keys, name: str = "position") -> DataFrame:
    """``rows``, which are sorted, with their place (from 1) in their group in
    the order in which they come: a global sort's partitions are in order."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    w = Window.partitionBy(*keys).orderBy("_at")
    return placed.withColumn(name, F.row_number().over(w).cast("bigint")).drop("_at")
