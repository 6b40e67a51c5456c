"""Quality classifier: a sparse ensemble of rules.

Statistics of the whole text (column expressions) feed a small forest; every
path of its trees is a conjunction of bounds on statistics, that is a rule.
A lasso logistic regression weighs the rules (most weights become zero), and
the rules that are left compile into one Spark column: scoring needs neither
a model object nor Python.

Training is distributed: the forest reads the labelled rows' statistics, and
the regression reads one weighted row per distinct combination of rule
outcomes and label.

Cases: null and empty texts have all-zero statistics and a score like any
other; documents without a label are scored only; labels that are neither 0
nor 1 are ignored; repeated label rows count repeatedly; with no labels, or
labels of one class, every score is the smoothed share of label 1; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangoflow.llm.common import materialise
from tangoflow.llm.rule_ledger import measure

TREES, DEPTH, SEED = 16, 3, 7
LASSO = 0.0005
THRESHOLD = 0.3


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def statistics() -> dict[str, Column]:
    """Statistics over the measurements of a text; none has the row's id,
    labels, language or source."""
    return {
        "words": F.log1p(F.col("n_words").cast("double")),
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "n_words"),
        "upper": _share("n_upper", "word_chars"),
        "shouts": _share("n_shouts", "n_words"),
        "duplicate_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "line_words": _share("n_words", "n_lines"),
    }


NAMES = ("words", "word_length", "symbols", "upper", "shouts", "duplicate_lines", "repeated_words", "line_words")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return measure(docs, [key], text).select(key, *[x.alias(n) for n, x in statistics().items()])


def in_fold(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key's text leaves remainder 0: the held-out fold."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Bounds ``low < statistic <= high`` that must all hold."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low != float("-inf"):
                out = out & (F.col(name) > low)
            if high != float("inf"):
                out = out & (F.col(name) <= high)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{low:g} < {n} <= {high:g}" for n, low, high in self.bounds)


def paths(description: str) -> set[Rule]:
    """The rules of a tree from its printed form: one for every node below
    the root, as tight bounds per statistic."""
    found, stack = set(), []
    for line in description.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not m:
            continue
        deep = len(m[1])
        while stack and stack[-1][0] >= deep:
            stack.pop()
        stack.append((deep, int(m[3]), m[4], float(m[5])))
        bounds: dict[str, tuple[float, float]] = {}
        for _, f, sign, value in stack:
            low, high = bounds.get(NAMES[f], (float("-inf"), float("inf")))
            bounds[NAMES[f]] = (low, min(high, value)) if sign == "<=" else (max(low, value), high)
        found.add(Rule(tuple((n, *bounds[n]) for n in sorted(bounds))))
    return found


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(train: DataFrame, label: str = "label") -> Ensemble:
    """``train``: the statistics and a 0/1 label."""
    n = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # two rows
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Ensemble(math.log((n1 + 1) / (n0 + 1)), ())
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(
        train.withColumn(label, F.col(label).cast("double")))
    forest = RandomForestClassifier(labelCol=label, numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird",
                                    bootstrap=False, seed=SEED, maxBins=64).fit(vectors)
    rules = sorted(set().union(*[paths(t.toDebugString) for t in forest.trees]), key=str)
    if not rules:
        return Ensemble(math.log((n1 + 1) / (n0 + 1)), ())
    outcomes = train.select(label, F.array(*[r.column().cast("double") for r in rules]).alias("o"))
    table = outcomes.groupBy(label, "o").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = materialise(table.select(F.col(label).cast("double").alias(label), "o", "weight"), "rule-outcomes")
    rows = rows.select(label, array_to_vector("o").alias("features"), "weight")
    model = LogisticRegression(labelCol=label, weightCol="weight", elasticNetParam=1.0, regParam=LASSO,
                               standardization=False, maxIter=60).fit(rows)
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w)
    return Ensemble(float(model.intercept), kept)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted for every document; only labels outside
    the held-out fold are learnt from."""
    stats = materialise(measured(docs, key, text), "rule-statistics")
    known = labels.select(labels[key].alias("__k"), labels[label].alias("label")).where(
        F.col("label").isin(0, 1) & ~in_fold(F.col("__k")))
    train = materialise(stats.join(known, stats[key] == known["__k"]).select(*NAMES, F.col("label").cast("int").alias("label")),
                        "rule-training")
    score = fit(train).score()
    return stats.select(key, in_fold(F.col(key)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
