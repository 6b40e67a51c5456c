"""Personal data by bootstrapped contextual extraction.

Base spans of four kinds come from fixed patterns and are the seeds.  Every
seed and every looser candidate (a phone number without its plus, an address
with "(at)", a card number that fails its check digit, an IPv6 address, ...)
is an *instance*; the words around it are its *lexical patterns* (two
words before it; a word on each side; the word before, alone or with the
value's shape; the word behind with the shape).  Spark scores the bipartite
graph iteratively:

* a pattern's confidence for a kind is the score of its instances of the kind
  over the number of all its instances, of whatever kind, plus ``SMOOTH`` (so
  that a few instances alike by chance don't make a pattern);
* a seed's score is 1, a candidate's the largest confidence among its
  patterns, of which ``DAMPING`` goes back into theirs; rounds end when no
  confidence changes by more than ``SETTLED``.  So a pattern may surround about
  two candidates for each of its seeds, and not any number.

Patterns that end with at least ``MIN_CONFIDENCE`` and that at least
``MIN_SEEDS`` different seeds support discover the candidates they surround.

The texts are read once: what the graph needs, a few instances of few
documents, is written.  Patterns and instances are aggregated partially, so a
pattern around a third of all instances is no hot task.

Spans are code points, end exclusive.  Cases: null texts are empty; repeated
rows are scanned one by one and count once in the graph (instances are
distinct values); texts are scanned whole in time linear in their length; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangoflow.llm.common import materialise, ordered_spans

KINDS = ("email", "ip", "card", "phone")
MIN_CONFIDENCE = 0.8
MIN_SEEDS = 3
SMOOTH = 2
DAMPING = 0.9  # of what instances give back to their patterns
SETTLED = 1e-3  # the largest change of a confidence after which the scores stand

# The base patterns, written so that each is searched in linear time.
EMAIL_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Looser forms, by kind: candidates that only a learnt pattern can confirm.
LOOSE_EMAIL = re.compile(r"(?:\[at\]|\(at\)|@)", re.I)
LOOSE_EMAIL_AFTER = re.compile(r"\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]+)*", re.I)
LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]+(?:[\x20().-]{1,2}[0-9]+)*(?![0-9A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _local_start(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out, floor = [], 0
    if "@" in text:
        for m in EMAIL_AT.finditer(text):
            start = _local_start(text, m.start(), floor)
            if start < m.start():
                out.append((start, 0, m.end()))
                floor = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser spans that touch no base span."""
    found, floor = [], 0
    for m in LOOSE_EMAIL.finditer(text):
        before = m.start() - (m.start() > 0 and text[m.start() - 1] == " " and m[0] != "@")
        start = _local_start(text, before, floor)
        after = LOOSE_EMAIL_AFTER.match(text, m.end())
        if start < before and after:
            found.append((start, 0, after.end()))
            floor = after.end()
    if DIGIT.search(text):
        if ":" in text:
            found += [(m.start(), 1, m.end()) for m in LOOSE_IP.finditer(text)]
        for m in LOOSE_PHONE.finditer(text):
            n = len(DIGIT.findall(m[0]))
            if 7 <= n <= 11:
                found.append((m.start(), 3, m.end()))
            elif 12 <= n <= 19:
                found.append((m.start(), 2, m.end()))
    out, taken, at = [], sorted((s, e) for s, _, e in base), 0
    for s, k, e in sorted(found):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at == len(taken) or taken[at][0] >= e:  # the spans behind this one begin later still
            out.append((s, k, e))
    return out


STRIP = ".,;:!?\"'()[]{}<>*#$%&|="


def _word(w: str) -> str:
    w = DIGIT.sub("0", w.lower()).strip(STRIP)
    return w if len(w) <= 40 else "#" + hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()


def _before(text: str, at: int, n: int) -> list[str]:
    """The ``n`` words that end before ``at``, whole, however long they are."""
    width = 64
    while True:
        lo = max(0, at - width)
        ws = text[lo:at].split()
        if lo == 0 or len(ws) > n:
            return ws[-n:]
        width *= 4


def _after(text: str, at: int) -> str:
    """The word that begins behind ``at``."""
    width = 64
    while True:
        ws = text[at:at + width].split(None, 1)
        if at + width >= len(text) or len(ws) > 1:
            return ws[0] if ws else ""
        width *= 4


def shape(value: str) -> str:
    """A value's characters by class, runs as one."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z]", "a", DIGIT.sub("0", value)))[:40]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span, from narrow to general: two words
    before; a word on each side; the word before and the value's shape; the
    word before; the word behind and the shape."""
    left = [_word(w) for w in _before(text, start, 2)]
    right, form = _word(_after(text, end)), shape(text[start:end])
    out = [f"_ {right} / {form}"] if right else []
    if left:
        out += [" ".join(left) + " _", f"{left[-1]} _ {right}", f"{left[-1]} _ / {form}"]
        if left[-1]:
            out.append(f"{left[-1]} _ *")
    return out


SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("k", pa.int32())])
INSTANCE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("k", pa.int32()), ("seed", pa.bool_()),
                      ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: row number, key, base spans, instances."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                spans, instances = [], []
                for t in part.column(1).to_pylist():
                    t = t or ""
                    base = base_spans(t)
                    spans.append([{"start": s, "stop": e, "k": k} for s, k, e in base])
                    instances.append([
                        {"start": s, "stop": e, "k": k, "seed": seed, "patterns": contexts(t, s, e),
                         "value": hashlib.md5(t[s:e].lower().encode("utf-8", "surrogatepass")).hexdigest()}
                        for seed, some in ((True, base), (False, candidates(t, base))) for s, k, e in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + part.num_rows), pa.int64()), part.column(0),
                     pa.array(spans, pa.list_(SPAN)), pa.array(instances, pa.list_(INSTANCE))],
                    names=["row", "key", "base", "instances"])
                row += part.num_rows

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(
        run, f"row long, key {kind}, base array<struct<start:int,stop:int,k:int>>, "
             "instances array<struct<start:int,stop:int,k:int,seed:boolean,value:string,patterns:array<string>>>")


def learn(scanned: DataFrame) -> DataFrame:
    """Accepted patterns: pattern, k, confidence, seeds."""
    c = F.col
    seen = scanned.select(F.explode("instances").alias("i")).select("i.k", "i.value", "i.seed", F.explode("i.patterns").alias("pattern"))
    edges = materialise(seen.groupBy("pattern", "k", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    kinds = F.array(*[F.lit(k) for k in range(len(KINDS))])
    # per pattern: all its instances, and its seeds by kind
    known = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(c("seed") & (c("k") == k), 1)).alias(f"s{k}") for k in range(len(KINDS))])
    known = known.select("pattern", "n", F.explode(F.arrays_zip(kinds.alias("k"), F.array(*[
        f"s{k}" for k in range(len(KINDS))]).alias("seeds"))).alias("x")).select("pattern", "n", "x.k", "x.seeds")
    known = materialise(known.where(c("seeds") >= MIN_SEEDS), "pii-patterns")
    # the graph's loose part: candidates that some pattern with seeds surrounds
    loose = edges.where(~c("seed")).select("pattern", "k", "value").join(known.select("pattern", "k"), ["pattern", "k"])
    loose = materialise(loose, "pii-loose")
    confidence = known.withColumn("confidence", c("seeds") / (c("n") + SMOOTH)).withColumn("change", F.lit(1.0))
    while True:  # confidences only grow, and each is at most seeds / (seeds + SMOOTH + (1 - DAMPING) * loose)
        score = loose.join(confidence, ["pattern", "k"]).groupBy("k", "value").agg(F.max("confidence").alias("score"))
        gained = loose.join(score, ["k", "value"]).groupBy("pattern", "k").agg(F.sum("score").alias("gain"))
        new = (c("seeds") + DAMPING * F.coalesce("gain", F.lit(0.0))) / (c("n") + SMOOTH)
        confidence = materialise(confidence.join(gained, ["pattern", "k"], "left").select(
            "pattern", "n", "k", "seeds", new.alias("confidence"), F.abs(new - c("confidence")).alias("change")), "pii-confidence")
        if confidence.where(c("change") > SETTLED).isEmpty():
            return confidence.where(c("confidence") >= MIN_CONFIDENCE).drop("change")


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans (base and discovered), both ordered."""
    c = F.col
    scanned = materialise(scan(docs, key, text), "pii-scan")
    accepted = materialise(learn(scanned).select("pattern", "k"), "pii-accepted")
    loose = scanned.select("row", F.explode(F.filter("instances", lambda i: ~i["seed"])).alias("i")).select(
        "row", "i.start", "i.stop", "i.k", F.explode("i.patterns").alias("pattern"))
    new = loose.join(accepted, ["pattern", "k"]).groupBy("row").agg(
        F.collect_set(F.struct("start", "stop", "k")).alias("new"))
    return scanned.join(new, "row", "left").select(
        c("key").alias(key), ordered_spans("base").alias("base"),
        ordered_spans(F.concat("base", F.coalesce("new", F.array().cast("array<struct<start:int,stop:int,k:int>>")))).alias("spans"))
