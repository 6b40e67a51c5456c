"""Indexed vocabulary search (P2 at scale): character trigrams as postings.

A regular expression is reduced to the literal runs that every match must
contain, and these to trigrams.  The postings of the trigrams (a Parquet table
sorted by trigram, so a lookup reads few row groups) are intersected, and the
expression itself runs on the rows that are left.  An expression that demands
no trigram is searched by a full scan; results are equal either way.

The index is two tables under one folder: ``words`` (the rows, sorted by text,
with a row number and its ``slice``, by which scans are pruned) and
``postings`` (gram, field, row, slice), range partitioned by (gram, row), so
a trigram that a third of all rows have is many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangoflow.operators.vocab import search_mask

FIELDS = ("japanese", "english")
GRAM = 3
SLICE_BITS = 12
PRUNED_SLICES = 1000  # slices a scan is pruned to by value; beyond, the join alone decides
# Letters beyond ASCII that match an ASCII letter when case is ignored: dotless and dotted i, long s, Kelvin sign.
ALIKE, ASCII = "\u0131\u0130\u017f\u212a", "iisk"


def folded(text: Column) -> Column:
    """Text by which letters that match each other ignoring case are equal, as
    far as demanded runs go (see ``_plain``)."""
    return F.lower(F.translate(text, ALIKE, ASCII))


def grams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    f = folded(F.coalesce(text, F.lit("")))
    starts = F.when(F.length(f) >= GRAM, F.sequence(F.lit(1), F.length(f) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(f, i, F.lit(GRAM))))


# ---- what an expression demands ----------------------------------------

ZERO_OR_CLASS = frozenset("dDwWsSbBAzZGhHvVRXtnrfea")


def _class_end(p: str, i: int) -> int | None:
    """Behind the character class that begins at ``i``."""
    i += 2 if p[i + 1:i + 2] == "^" else 1
    if p[i:i + 1] == "]":
        i += 1
    while i < len(p):
        if p[i] == "\\":
            i += 2
        elif p[i] == "[":
            return None  # nested classes: not looked into
        elif p[i] == "]":
            return i + 1
        else:
            i += 1
    return None


def _plain(c: str) -> bool:
    """Characters whose case folding is simple: ASCII, and those without case."""
    return c.isascii() or c.upper() == c == c.lower()


def literal_runs(pattern: str) -> list[list[str]] | None:
    """Per top-level alternative, runs of literal characters that every match
    contains; None if the expression has parts that are not understood."""
    out: list[list[str]] = [[]]
    run, i, depth = "", 0, 0

    def end() -> None:
        nonlocal run
        if run:
            out[-1].append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1:i + 2]
            if not nxt or (nxt.isalnum() and nxt not in ZERO_OR_CLASS):
                return None
            if not depth:
                if nxt.isalnum() or not _plain(nxt):
                    end()
                else:
                    run += nxt
            i += 2
        elif c == "[":
            end() if not depth else None
            if (i := _class_end(pattern, i)) is None:
                return None
        elif depth:
            depth += (c == "(") - (c == ")")
            i += 1
        elif c == "(":
            if pattern[i:i + 2] == "(?" and pattern[i:i + 3] != "(?:":
                return None
            end()
            depth, i = 1, i + 1
        elif c == "|":
            end()
            out.append([])
            i += 1
        elif c in "*?+{":
            if c == "{" and "}" not in pattern[i:]:
                return None
            run = run if c == "+" else run[:-1]
            end()
            i = pattern.index("}", i) + 1 if c == "{" else i + 1
            while pattern[i:i + 1] in ("?", "+"):
                i += 1
        elif c in ".^$)" or not _plain(c):
            end()
            i += 1
        else:
            run += c
            i += 1
    end()
    return None if depth else out


def required_grams(pattern: str) -> list[list[str]] | None:
    """Per alternative the trigrams that a matching text has; None: any text may match."""
    runs = literal_runs(pattern)
    if runs is None:
        return None
    out = [sorted({f[k:k + GRAM] for r in alternative for f in [r.lower()] for k in range(len(f) - GRAM + 1)}) for alternative in runs]
    return out if all(out) else None


# ---- the index ---------------------------------------------------------

def build_index(words: DataFrame, path: str) -> str:
    """Write the index of ``words`` to a new folder."""
    spark = words.sparkSession
    rows = (words.repartitionByRange("english", "japanese").sortWithinPartitions("english", "japanese")
            .withColumn("row", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("row", SLICE_BITS)))
    rows.write.parquet(f"{path}/words")
    stored = spark.read.parquet(f"{path}/words")
    parts = [stored.select(F.explode(grams(F.col(f))).alias("gram"), F.lit(k).alias("field"), "row", "slice") for k, f in enumerate(FIELDS)]
    postings = parts[0].unionByName(parts[1])
    postings.repartitionByRange("gram", "row").sortWithinPartitions("gram", "row").write.parquet(f"{path}/postings")
    return path


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """Rows (row, slice) one of whose fields has all trigrams of an alternative; None: all rows."""
    need = required_grams(term)
    if need is None:
        return None
    c = F.col
    found = spark.read.parquet(f"{path}/postings").where(c("gram").isin(sorted({g for a in need for g in a})))
    per = found.groupBy("row", "slice", "field").agg(*[F.count_if(c("gram").isin(a)).alias(f"n{k}") for k, a in enumerate(need)])
    whole = [c(f"n{k}") == len(a) for k, a in enumerate(need)]
    hit = whole[0]
    for w in whole[1:]:
        hit = hit | w
    return per.where(hit).select("row", "slice").distinct()


def search_index(spark: SparkSession, path: str, term: str | None) -> DataFrame:
    """P2 over an index: the words whose japanese or english matches ``term``."""
    words = spark.read.parquet(f"{path}/words")
    if not term:
        return words.drop("row", "slice")
    found = candidates(spark, path, term)
    if found is not None:
        slices = [r[0] for r in found.select("slice").distinct().limit(PRUNED_SLICES + 1).collect()]
        if len(slices) <= PRUNED_SLICES:
            words = words.where(F.col("slice").isin(slices))
        words = words.join(found.select("row"), "row", "left_semi")
    return words.where(search_mask(term, *FIELDS)).drop("row", "slice")
