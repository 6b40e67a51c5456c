"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangoflow.session import scratch_path

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a fresh folder under the shared checkpoint
    folder and read it back: the lineage is cut, and a lost executor costs a
    re-read of shared files only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only the making of a result needs: written like
    ``materialise``, and freed once the result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Overwrites the tables with nothing, through Spark's committer, so on
        any file system."""
        for path in self.paths:
            self.spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
        self.paths = []


def words_of(text: Column) -> Column:
    """All words of a text in order; null texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, also where ``body`` uses
    it inside a lambda and the optimizer inlines columns."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunked(xs: Column) -> Column:
    """An array as an array of its consecutive parts, their size the square
    root of its own (256 at least)."""

    def cut(v):
        size = F.greatest(F.lit(256), F.ceil(F.sqrt(2.0 * F.size(v))).cast("int"))
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.slice(v, at, size))

    return let(xs, cut)


def scanned(xs: Column, zero: Column, step, emitted: str) -> Column:
    """Runs over an array with a state: ``step(state, x)`` is a struct (state,
    out).  A struct of the last state and ``out``, the array of all outs (of
    type ``emitted``).  A fold that appends copies what it has; here it copies
    chunks, then a list of chunks: n ** 1.5 steps instead of n ** 2."""
    none = F.array().cast(f"array<{emitted}>")

    def inner(state, chunk):
        return F.aggregate(chunk, F.struct(state.alias("state"), none.alias("out")), lambda acc, x: let(step(acc["state"], x), lambda y: F.struct(
            y["state"].alias("state"), F.concat(acc["out"], F.array(y["out"])).alias("out"))))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{emitted}>>").alias("out"))
    done = F.aggregate(chunked(xs), start, lambda acc, chunk: let(inner(acc["state"], chunk), lambda y: F.struct(
        y["state"].alias("state"), F.concat(acc["out"], F.array(y["out"])).alias("out"))))
    return let(done, lambda d: F.struct(d["state"].alias("state"), F.flatten(d["out"]).alias("out")))


def keep_after(df: DataFrame, condition: Column) -> DataFrame:
    """Filter that stays above the projection that made its columns: pushed
    below, it would evaluate their expressions a second time."""
    at = "__at"
    return df.withColumn(at, F.monotonically_increasing_id()).where(condition & (F.col(at) >= 0)).drop(at)


def ordered_spans(spans) -> Column:
    """Spans (start, stop, k) by start, then kind."""
    return F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["k"].alias("k"), s["stop"].alias("stop"))))


def spans_text(spans, kinds: tuple[str, ...]) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kind, s["k"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def span_digest(df: DataFrame, held: list[str], kinds: tuple[str, ...], base: str = "base", spans: str = "spans") -> DataFrame:
    """``held``, the number of base spans of each kind, their SHA-256 and all
    spans as text.  Both span columns are ordered."""
    number = lambda k: F.size(F.filter(base, lambda s: s["k"] == k)).cast("long").alias(f"n_{kinds[k]}")
    return df.select(*held, *[number(k) for k in range(len(kinds))],
                     F.sha2(spans_text(base, kinds).cast("binary"), 256).alias("base_sha256"),
                     spans_text(spans, kinds).alias("spans"))
