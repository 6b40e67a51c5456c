import math
import random
import re

from pyspark.sql import functions as F
from tangoflow.llm import mixing as M

from conftest_llm import prose


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def corpus():
    rng = random.Random(8)
    rows = []
    for s, n in [("a", 40), ("b", 300), ("é", 25), (None, 60), ("zz", 5), ("c", 30)]:
        rows += [(len(rows) + i, prose(rng, rng.choice([0, 5, 40, 200, 800])), s) for i in range(n)]
    return rows + [(5000, None, "a"), (5001, "", None), (5002, " \t", "empty"), (rows[3][0], rows[3][1], rows[3][2])]


def test_mix_against_brute_force(docs_of):
    rows = corpus()
    got = M.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {i: s for i, _, s in rows}
    sizes, taken = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= 45, (s, words, want[s])  # about one short document
    again = {(r.doc_id, r.taken) for r in M.mix(docs_of(rows).repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_rates_tilt_and_meet_targets(docs_of):
    rows = corpus()
    sizes, _ = M.plan_mix(docs_of(rows))
    solved = M.solve(sizes, M.targets(sizes))
    rated = sizes.join(solved, "__s").withColumn("rate", M._rate(F.col("lam"), F.col("size"), F.col("mean"), 3))
    for r in rated.groupBy("__s").agg(F.sum(F.col("rate") * F.col("size")).alias("w"), F.max("target").alias("t")).collect():
        assert abs(r.w - r.t) <= 1e-3 * max(r.t, 1)


def test_one_source_takes_everything_once(docs_of):
    rows = [(i, "a b c") for i in range(9)]
    assert all(r.copies == 1 for r in M.mix(docs_of(rows)).collect())


def test_copies_keep_rows_and_columns(docs_of):
    rows = corpus()
    docs = docs_of(rows)
    out = M.mix_documents(docs)
    copies = {}
    for r in M.mix(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}


def test_empty_table(docs_of):
    none = docs_of([(1, "")]).where("false")
    assert M.mix(none).count() == 0 and M.mix_documents(none).count() == 0


def test_words_a_very_long_document_leaves_are_filled_until_nothing_fits(docs_of):
    rng = random.Random(3)
    size = {i: 60_000 if i < 5 else rng.randint(20, 100) for i in range(4000)}
    rows = [(i, "w " * n, "z") for i, n in size.items()]
    rows += [(5000 + i, "w " * 50, "b") for i in range(18360)]  # so that "z" is to give 1.8 x its size
    got = [r for r in M.mix(docs_of(rows)).collect() if r.doc_id < 5000]
    missing = got[0].target - sum(r.taken for r in got)
    # short documents by the thousand fit: none is left that could have one more copy
    assert -1e-6 <= missing < 100


def test_repeated_rows_are_filled_together(docs_of):
    rows = [(0, "w " * 9000, "z"), *[(i, "w " * 7, "z") for i in range(1, 300) for _ in range(1 + i % 3)],
            *[(1000 + i, "w " * 50, "b") for i in range(300)]]
    copies = {}
    for r in M.mix(docs_of(rows)).collect():
        copies.setdefault(r.doc_id, set()).add(r.copies)
    assert all(len(c) == 1 for c in copies.values())


def test_null_ids_are_mixed_like_others(docs_of):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i, prose(rng, 20), "ab"[i % 2]) for i in range(120)]
    got = M.mix(docs_of(rows)).collect()
    assert len(got) == 120 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert len({(r.source_size, r.taken) for r in got if r.doc_id is None}) <= 2  # rounded alike in a source
