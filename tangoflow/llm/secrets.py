"""Secret scanning with character Markov models (DataFrame functions only).

Three fixed kinds of base spans are found by pattern.  Their values are the
labelled samples of *random strings*; every other long run of token
characters is a sample of an *ordinary identifier*.  A first-order character
Markov model is counted for each class over the distinct samples of the whole
corpus, and a run outside the base spans is a ``markov`` secret if its
log-likelihood ratio (random against ordinary) is at least ``min_llr`` nats.

Spans are code points, end exclusive.  Cases: null texts are empty; empty
tables train nothing (both models are then their priors, random = uniform);
repeated rows are scanned one by one and don't weigh in training (samples are
distinct); texts are scanned whole, in time nearly linear in their length and
matches; other input columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangoflow.llm.common import let, ordered_spans, scanned, span_digest

# The base patterns, the value group and least length of each.
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge: this many token characters or more, with a letter.
MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
MIN_LLR = 12.0

#: Model alphabet: the token characters in code point order; states are 1-based,
#: 0 stands for the start of a string and for characters outside the alphabet.
ALPHABET = "+-./0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
STATES = len(ALPHABET) + 1
SPAN = "struct<start:int,stop:int,k:int,value:string>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _located(text: str, pattern: str, k: int, group: int, least: int) -> Column:
    """Spans of all leftmost non-overlapping matches, with the group's text.
    The text between matches (split) and the matches give the positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("m"), value.alias("v"))

    def step(at, x):
        start = at + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(stop.cast("int").alias("state"), F.struct(
            start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(k).alias("k"), x["v"].alias("value")).alias("out"))

    spans = F.filter(scanned(parts, F.lit(0), step, SPAN)["out"], lambda x: F.coalesce(F.length(x["value"]), F.lit(0)) >= least)
    return F.when(F.col(text).rlike(pattern), spans).otherwise(_none())


EVENT = "struct<at:int,kind:int,start:int,stop:int,value:string>"


def _apart(base: str, runs: str) -> Column:
    """The runs that touch no base span.  A run touches one if, of the spans
    that begin before its end, the largest end is beyond its start: one scan
    over the spans' starts and the runs' ends, in order."""
    events = lambda xs, at, kind: F.transform(xs, lambda x: F.struct(
        x[at].alias("at"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))
    # at one place a run's end comes before a span's start: they don't touch
    both = F.sort_array(F.concat(events(F.col(base), "start", 1), events(F.col(runs), "stop", 0)))
    step = lambda far, e: F.struct(
        F.when(e["kind"] == 1, F.greatest(far, e["stop"])).otherwise(far).alias("state"),
        F.when((e["kind"] == 0) & (far <= e["start"]), F.struct(
            e["start"].alias("start"), e["stop"].alias("stop"), F.lit(3).alias("k"), e["value"].alias("value"))).alias("out"))
    return F.filter(scanned(both, F.lit(0), step, SPAN)["out"], lambda x: x.isNotNull())


def scan(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key``, ``base`` (base spans) and ``runs`` (long runs of token
    characters with a letter that touch no base span).  No shuffle; the time
    is nearly linear in a text's matches."""
    t = docs.select(*key, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    found = t.select(*key, _located("__t", ASSIGN, 0, 2, 6).alias("__a"), _located("__t", ACCESS, 1, 0, 20).alias("__k"),
                     _located("__t", HEX, 2, 0, 24).alias("__h"), _located("__t", RUN, 3, 0, MIN_RUN).alias("__r"))
    based = found.select(*key, F.concat("__a", "__k", "__h").alias("base"),
                         F.filter("__r", lambda r: r["value"].rlike("[A-Za-z]")).alias("__r"))
    free = (F.size("base") == 0) | (F.size("__r") == 0)
    return based.select(*key, "base", F.when(free, F.col("__r")).otherwise(_apart("base", "__r")).alias("runs"))


def train(found: DataFrame, backoff: float = 20.0) -> list[float]:
    """Log-likelihood ratios by transition code ``from * STATES + to``.

    Counts cover the distinct samples of the whole corpus; what reaches the
    driver is at most ``2 * STATES ** 2`` (under 10,000) counts, whatever the
    input's size.  Random strings back off to the uniform distribution.
    Ordinary identifiers back off to their character frequencies, and one is
    taken off each of their counts: the runs that are judged are samples
    themselves, and a run must not vouch for its own transitions."""
    labelled = found.select(F.explode_outer(F.concat(
        F.transform("base", lambda s: F.struct(s["value"].alias("value"), F.lit(1).alias("c"))),
        F.transform("runs", lambda s: F.struct(s["value"].alias("value"), F.lit(0).alias("c"))))).alias("s"))
    samples = labelled.where(F.col("s").isNotNull()).groupBy(F.col("s.value").alias("value")).agg(F.max("s.c").alias("c"))
    chars = let(F.filter(F.split("value", ""), lambda x: x != ""), lambda cs: F.transform(
        cs, lambda x, i: F.struct(F.get(cs, i - 1).alias("frm"), x.alias("to"))))
    moved = samples.select("c", F.explode(chars).alias("x")).select("c", F.instr(F.lit(ALPHABET), F.col("x.to")).alias("to"), F.when(
        F.col("x.frm").isNull(), F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), F.col("x.frm"))).alias("frm"))
    counts = moved.groupBy("c", "frm", "to").count().collect()
    n = {(r["c"], r["frm"], r["to"]): r["count"] for r in counts}
    states = range(STATES)
    plain = {(f, t): max(0, n.get((0, f, t), 0) - 1) for f in states for t in states}
    often = [max(0, sum(n.get((0, f, t), 0) for f in states) - 1) + 0.5 for t in states]
    random_, ordinary = ([sum(n.get((1, f, t), 0) for t in states) for f in states],
                         [sum(plain[f, t] for t in states) for f in states])

    def ratio(f: int, t: int) -> float:
        as_random = (n.get((1, f, t), 0) + backoff / STATES) / (random_[f] + backoff)
        as_ordinary = (plain[f, t] + backoff * often[t] / sum(often)) / (ordinary[f] + backoff)
        return math.log(as_random / as_ordinary)

    return [ratio(f, t) for f in states for t in states]


def llr(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token under the two models."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")
    step = lambda acc, ch: F.struct(
        F.instr(F.lit(ALPHABET), ch).alias("s"),
        (acc["x"] + F.coalesce(F.get(table, acc["s"] * STATES + F.instr(F.lit(ALPHABET), ch)), F.lit(0.0))).alias("x"))
    zero = F.struct(F.lit(0).alias("s"), F.lit(0.0).alias("x"))
    return F.aggregate(F.split(token, ""), zero, step)["x"]


def judge(found: DataFrame, model: list[float], min_llr: float = MIN_LLR) -> DataFrame:
    """``base`` and ``spans`` (base and accepted runs, by start, then kind)."""
    held = [c for c in found.columns if c not in ("base", "runs")]
    accepted = F.filter("runs", lambda r: llr(r["value"], model) >= min_llr)
    return found.select(*held, ordered_spans("base").alias("base"),
                          ordered_spans(F.concat("base", accepted)).alias("spans"))


def digest(judged: DataFrame) -> DataFrame:
    """Counts per kind, the base spans' digest and all spans as text."""
    held = [c for c in judged.columns if c not in ("base", "spans")]
    found = F.size(F.filter("spans", lambda s: s["k"] == KINDS.index("markov"))).cast("long")
    return span_digest(judged.withColumn("__n", found), [*held, "__n"], KINDS).drop("n_markov").withColumnRenamed(
        "__n", "n_markov")


BLOCK = 4096  # characters
MARK = "struct<from:int,to:int,new:boolean>"


def _cut(blocks: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to ``stop`` of a text cut into blocks."""
    first, last = (start / BLOCK).cast("int"), (stop / BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), start % BLOCK + 1, F.lit(BLOCK))
    tail = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), stop % BLOCK), F.lit(""))
    several = F.concat(head, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
    one = F.substring(F.get(blocks, first), start % BLOCK + 1, stop - start)
    return F.when(start >= stop, "").when(first == last, one).otherwise(several)


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each (merged) span replaced by ``mark``.  ``spans`` are
    ordered.  Pieces are cut from blocks of the text and joined once."""
    step = lambda at, s: F.struct(F.greatest(at, s["stop"]).alias("state"), F.struct(
        at.alias("from"), s["start"].alias("to"), (s["start"] >= at).alias("new")).alias("out"))

    def put(blocks, done):
        pieces = F.transform(F.filter(done["out"], lambda m: m["new"]), lambda m: F.concat(_cut(blocks, m["from"], m["to"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), _cut(blocks, done["state"], F.length(text)))

    cut = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: let(
        scanned(F.col(spans), F.lit(0), step, MARK), lambda done: put(blocks, done)))
    return F.when(F.size(spans) > 0, cut).otherwise(F.col(text))


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced; no row goes.  ``length``, if it is
    a column, is set to the new number of characters of changed texts.  The
    texts are scanned twice: to train, and to replace."""
    model = train(scan(docs, [], text))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"),
                      F.coalesce(docs[text], F.lit("")).alias("__text"))
    judged = judge(scan(row, ["__row", "__text"], "__text"), model)
    cleaned = judged.select("__row", F.size("spans").alias("__n"), redacted("__text", "spans").alias("__clean"))
    changed = F.col("__n") > 0
    new = {text: F.when(changed, F.col("__clean")).otherwise(F.col(f"__row.{text}"))}
    if length in docs.columns:
        new[length] = F.when(changed, F.length("__clean").cast(docs.schema[length].dataType)).otherwise(
            F.col(f"__row.{length}"))
    return cleaned.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
