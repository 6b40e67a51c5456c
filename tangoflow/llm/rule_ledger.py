"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; the ledger keeps the measurements
and one ``long`` whose bit *k* says that rule *k* failed.  Policies are
versioned sets of rules: applying another policy, or asking what a policy
would keep without one of its rules, reads the ledger's bits and never the
texts again.

Cases: null and empty texts have zero words (and fail ``few_words``);
repeated rows are judged one by one; every text is read whole; an empty table
gives an empty ledger; other columns of the input are ignored, so their names
can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangoflow.llm.common import WORD, keep_after, let, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")


#: The rules in bit order.
RULES = ("few_words", "repeated_windows", "symbols", "shouting", "exclamations", "duplicate_lines", "word_length")
BIT = {name: 1 << k for k, name in enumerate(RULES)}


def rules() -> dict[str, Column]:
    """Rule name -> condition under which it FAILS.  Conditions compare
    integers, so every engine agrees on them."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "shouting": 2 * c("n_upper") > c("word_chars"),
        "exclamations": 10 * c("n_shouts") > 3 * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "word_length": (c("n_words") > 0) & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
    }


@dataclass(frozen=True)
class Policy:
    """A versioned policy: the documents that fail any of ``names`` go."""

    version: str
    names: tuple[str, ...] = field(default_factory=lambda: tuple(BIT))

    @property
    def mask(self) -> int:
        return sum(BIT[n] for n in self.names)


BASE_POLICY = Policy("base-1", ("few_words", "repeated_windows"))
FULL_POLICY = Policy("full-1")


def measure(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns plus ``MEASURES``, one row per input row, no shuffle.

    Windows are compared by their 64-bit hashes: sorted with their places,
    equal ones are neighbours (two different windows of one text share a hash
    with probability n^2 / 2^65, 3e-8 for a million words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    keys = [F.col(k) for k in key]
    base = docs.select(
        *keys, words_of(t).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("l"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_shouts"))
    hashes = let(F.col("w"), lambda w: F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    hashed = base.select(
        *keys, "n_symbols", "n_upper", "n_shouts", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), hashes.alias("h"))
    places = F.slice(F.sequence(F.lit(0), F.size("h")), 1, F.size("h")).alias("i")
    ordered = hashed.withColumn("s", F.sort_array(F.arrays_zip(F.col("h").alias("h"), places))).drop("h")
    twice = let(F.col("s"), lambda s: F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))
                                               | F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))))
    starts = ordered.withColumn("p", twice["i"]).drop("s")
    covered = F.array_distinct(F.concat("p", F.transform("p", lambda i: i + 1), F.transform("p", lambda i: i + 2)))
    return starts.withColumn("n_repeat_words", F.size(covered).cast("long")).select(*keys, *MEASURES)


def ledger(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key``, measurements and ``fail_bits``."""
    m = measure(docs, key, text)
    bits = sum((F.when(cond, F.lit(BIT[n])).otherwise(F.lit(0)).cast("long") for n, cond in rules().items()),
               F.lit(0).cast("long"))
    return m.withColumn("fail_bits", bits)


def fails(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """``kept`` and ``policy`` version added to a ledger."""
    return led.withColumns({"kept": ~fails(policy), "policy": F.lit(policy.version)})


def ablations(led: DataFrame, policies: list[Policy]) -> DataFrame:
    """One row per policy and rule in it: documents that fail the rule, that
    only this rule of the policy rejects (so what dropping it would bring
    back), and which other rules any of its failures also broke (bitwise or).
    One aggregation over the ledger: map-side partial, one row per pair."""
    pairs = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"),
                               F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit"))
                      for p in policies for n in p.names])
    x = led.select("fail_bits", F.inline(pairs))
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    held = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return x.groupBy("policy", "rule", "bit", "mask").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count(F.when(hit, 1)).alias("n_failed"),
        F.count(F.when(held == F.col("bit"), 1)).alias("n_only_this"),
        F.count(F.when(held == 0, 1)).alias("n_kept"),
        F.coalesce(F.bit_or(F.when(hit, held)), F.lit(0)).alias("failed_together"))


def keep_good(docs: DataFrame, policy: Policy = FULL_POLICY, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that the policy keeps, no shuffle."""
    row = "__row"
    led = ledger(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), docs[text].alias("__text")),
                 [row], "__text")
    return keep_after(led, ~fails(policy)).select(f"{row}.*")
