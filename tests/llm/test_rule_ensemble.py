import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from tangoflow.llm import rule_ensemble as E

from conftest_llm import prose


def labelled(spark, docs_of, n=200):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        text = prose(rng, rng.randint(30, 200))
        rows.append((i, text if good else " ".join(w + "$$$" for w in text.split())))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(n, None), (n + 1, ""), (0, rows[0][1])]
    return rows, docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_contract(spark, docs_of):
    rows, docs, labels = labelled(spark, docs_of)
    got = E.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [r for r in got if r.held_out and r.doc_id < 200]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in out) == len(out) > 20


def test_held_out_labels_change_nothing(spark, docs_of):
    _, docs, labels = labelled(spark, docs_of)
    rows = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, 0) for r in labels.collect()]
    other = spark.createDataFrame(rows + [(5, None, 0), (None, 1, 0), (7, 9, 0)], labels.schema)
    score = lambda t: {r.doc_id: r.score for r in E.classify(docs, t).collect()}
    assert score(labels) == pytest.approx(score(other), abs=1e-5)


def test_paths_become_bounds():
    text = ("DecisionTree\n  If (feature 2 <= 0.5)\n   If (feature 0 <= 4.0)\n    Predict: 1.0\n   Else (feature 0 > 4.0)\n"
            "    Predict: 0.0\n  Else (feature 2 > 0.5)\n   Predict: 0.0\n")
    assert {str(r) for r in E.paths(text)} == {
        "-inf < symbols <= 0.5", "0.5 < symbols <= inf", "-inf < symbols <= 0.5 and -inf < words <= 4",
        "-inf < symbols <= 0.5 and 4 < words <= inf"}


def test_no_labels_one_class_and_empty_table(spark, docs_of):
    docs = docs_of([(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in E.classify(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], none.schema)
    assert all(r.score > 0.5 for r in E.classify(docs, ones).collect())
    assert E.classify(docs.where("false"), ones).count() == 0


def by_hand(text):
    """The statistics of a text, computed anew."""
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    chars = sum(map(len, ws))
    share = lambda a, b: a / b if b else 0.0
    return {"words": math.log1p(len(ws)), "word_length": share(chars, len(ws)), "symbols": share(sum(c in "#*$%&|<>" for c in t), len(ws)),
            "upper": share(sum(unicodedata.category(c) == "Lu" for c in t), chars), "shouts": share(t.count("!"), len(ws)),
            "duplicate_lines": share(len(lines) - len(set(lines)), len(lines)), "repeated_words": share(len(repeated), len(ws)),
            "line_words": share(len(ws), len(lines))}


def test_scores_are_the_rules_applied_by_hand(spark, docs_of):
    """Every rule of the fitted ensemble, evaluated in Python on statistics
    recomputed from the texts, a very long one and odd ones among them."""
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate([None, "", "ÄÖ É\n\nÄÖ É\nx! !", "word " * 60_000, "$" * 5000, "\n".join(["a line"] * 40)])]
    rows += [(10 + i, (prose(rng, rng.randint(5, 150)) + rng.choice(["", " $#!", "\nsame\nsame", " LOUD!"])) * rng.choice((1, 1, 2))) for i in range(120)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, int("$" not in (t or "$"))) for i, t in rows], "k long, label int")
    stats = E.measured(docs)
    ensemble = E.fit(stats.join(labels, stats["doc_id"] == labels["k"]).select(*E.NAMES, "label"))
    assert ensemble.rules
    text = dict(rows)
    for r in stats.select("*", ensemble.score().alias("score")).collect():
        own = by_hand(text[r.doc_id])
        for name, value in own.items():
            assert r[name] == pytest.approx(value, abs=1e-12), (r.doc_id, name)
        total = ensemble.intercept + sum(w for rule, w in ensemble.rules if all(low < own[n] <= high for n, low, high in rule.bounds))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
