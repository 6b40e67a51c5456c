import math
import random
from collections import Counter

import numpy as np
import pytest
from tangoflow.llm import bagminhash as B
from tangoflow.llm import vector_dedup as V
from tangoflow.llm.components import components

from conftest_llm import prose


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def bag(t):
    w = (t or "").split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    bags, f = [(i, bag(t)) for i, t in rows], Forest()
    for n, (i, a) in enumerate(bags):
        f.find(i)
        for j, b in bags[:n]:
            if a and b and 10 * sum((a & b).values()) >= 8 * sum((a | b).values()):
                f.join(i, j)
    return {i: f.find(i) for i, _ in rows}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
    return " ".join(w)


def near_rows():
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "one"), (5, "one two three"), (6, "one  two\tthree"), (7, "x " * 3000)]
    for _ in range(12):
        base = prose(rng, rng.randint(60, 300))
        rows += [(len(rows) + i, edited(rng, base, i)) for i in range(4)] + [(len(rows) + 4, base)]
    hub = prose(rng, 200)  # copies that are like the original, not like one another
    rows += [(len(rows) + i, edited(rng, hub, 4)) for i in range(40)] + [(len(rows) + 40, hub)]
    chain = prose(rng, 150)  # each is like the next only
    for _ in range(10):
        chain = edited(rng, chain, 2)
        rows.append((len(rows), chain))
    rows += [(len(rows) + i, "lorem ipsum dolor " * 40 + prose(rng, 20)) for i in range(6)]  # weights matter
    return rows + rows[-3:]


def test_signatures_estimate_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(1)
    for _ in range(3):
        a = {int(x): int(rng.integers(1, 40)) for x in rng.integers(0, 2**63, 60)}
        b = {k: (v if rng.random() < 0.7 else int(rng.integers(1, 60))) for k, v in a.items() if rng.random() < 0.9}
        true = sum(min(v, b.get(k, 0)) for k, v in a.items()) / sum(max(v, b.get(k, 0)) for k, v in a.items())
        flat = lambda x: np.repeat(np.array(list(x), dtype=np.uint64), list(x.values()))
        r = B.signatures([flat(a), flat(b), flat(a)], registers=4000)
        assert abs((r[0] == r[1]).mean() - true) < 0.04 and (r[0] == r[2]).all()


def test_near_classes_match_brute_force(docs_of):
    rows = near_rows()
    want = brute_classes(rows)
    got = B.classes(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got} == want
    assert len({want[i] for i, _ in rows}) < len(rows) / 2


def test_keep_one_of_each_class(docs_of):
    rows = near_rows()
    docs = docs_of(rows)
    out = B.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute_classes(rows).values()))


def test_repeated_and_null_ids_are_told_by_their_text(docs_of):
    rng = random.Random(8)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, prose(rng, 90)), (7, None), (7, b)]
    got = sorted((r.doc_id or 0, r.class_id) for r in B.classes(docs_of(rows)).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1), (3, 1), (7, 1), (7, 7)]
    kept = sorted(((r.doc_id or 0), r.text or "") for r in B.keep_one(docs_of(rows)).collect())
    assert len(kept) == 4 and kept[0] == (0, rows[4][1]) and (7, "") in kept  # one of (1, a), (1, b) by digest
    assert sum(r[0] == 1 for r in kept) == 2  # a and b are not near each other
    rows = [(None, a), (5, a + " x"), (None, a), (9, a)]
    assert {r.class_id for r in B.classes(docs_of(rows)).collect()} == {5}
    assert [r.doc_id for r in B.keep_one(docs_of(rows)).collect()] == [5]
    rows = [(None, a), (None, a + " x"), (None, a)]
    assert B.keep_one(docs_of(rows)).count() == 1
    assert sorted(r.doc_id for r in B.keep_one(docs_of([(4, a), (4, a), (4, None), (4, None)])).collect()) == [4, 4, 4]


def test_links_between_strays_of_a_hot_group(docs_of, monkeypatch):
    """Many copies that are under the similarity to their original, some of
    them near one another: only the strays' comparisons can link these."""
    monkeypatch.setattr(B, "BLOCK", 40)
    rng = random.Random(9)
    hub, rows = prose(rng, 120), []
    for i in range(150):
        far = edited(rng, hub, rng.choice((1, 2, 4, 5, 6)))
        rows.append((i, far))
        if i % 10 == 0:
            rows.append((1000 + i, edited(rng, far, 1)))
    rows.append((999, hub))
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in B.classes(docs_of(rows)).collect()}
    assert got == want and len(set(want.values())) > 3


def test_signature_filters_pass_similar_pairs():
    rng = random.Random(10)
    passed = links = 0
    for _ in range(60):
        base = prose(rng, 150)
        texts = [base, edited(rng, base, 3)]
        bags = [B.shingles(B.words(t)) for t in texts]
        if B.similar(*[B._tokens(x) for x in bags]):
            links += 1
            sig = B.short(B.signatures(bags, B.LONG_REGISTERS))
            passed += len(B._candidates(np.array([len(x) for x in bags]), np.array([0, 1]), np.array([True, False]), np.zeros(2), False, sig))
    assert links > 20 and passed == links


def test_batches_are_bounded():
    texts = ["x" * 10] * 600 + [None, "y" * (B.BATCH_BYTES + 5), "z"]
    parts = list(B._bounded(texts))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(texts)))
    assert all(p.stop - p.start <= 512 for p in parts) and any(p.stop - p.start == 1 for p in parts)
    assert list(B._bounded([])) == []


def test_near_empty_table(docs_of):
    none = docs_of([(1, "")]).where("false")
    assert B.classes(none).count() == 0 and B.keep_one(none).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 300: 200}


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(25):
            v = rng.standard_normal(24)
            for noise in (0, 0, 0.2, 0.3, 0.4):
                rows.append((len(rows), [float(x) for x in v + noise * rng.standard_normal(24)], label))
    hot = rng.standard_normal(24)
    rows += [(len(rows) + i, [float(x) for x in hot + 0.15 * rng.standard_normal(24)], 2) for i in range(700)]
    rows += [(len(rows), None, 0), (len(rows) + 1, [0.0] * 24, 0), (len(rows) + 2, [float("nan")] + [1.0] * 23, 0),
             (len(rows) + 3, [None] + [1.0] * 23, 0), (len(rows) + 4, rows[0][1], None), (len(rows) + 5, rows[0][1][:10], 0),
             (len(rows) + 6, [3 * x for x in rows[0][1][:10]], 0), (len(rows) + 7, [], 0), (len(rows) + 8, [math.inf] * 24, 0),
             (len(rows) + 9, [-0.0, 1.0], 5), (len(rows) + 10, [0.0, 1.0], 5)]
    return rows


def test_near_vectors_match_brute_force(spark):
    rows = vectors()
    good, f, links = {}, Forest(), Counter()
    for i, v, label in rows:
        f.find(i)
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v) / np.linalg.norm(v))
    ids = list(good)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            (a, x), (b, y) = good[i], good[j]
            if a == b and len(x) == len(y) and x @ y >= 0.93:
                links[i] += 1
                links[j] += 1
                f.join(i, j)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, copies int, rep string")
    got = V.near_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], f.find(r.vec_id), r.vec_id == f.find(r.vec_id))
    assert V.near_vectors(df.where("false")).count() == 0


def test_miss_probability():
    assert V.miss() < 3e-4 and V.miss(0.95) < V.miss()


@pytest.mark.parametrize("n", [1, 5, 30, 400])
def test_pairs_of_short_and_long_runs(n):
    rng = np.random.default_rng(n)
    x = V._unit(rng.standard_normal((n, 2)))
    run_of = np.sort(rng.integers(0, 3, n))
    got = set(zip(*[c.tolist() for c in V._pairs(x, run_of)], strict=True))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if run_of[i] == run_of[j] and x[i] @ x[j] >= V.LEAST_COSINE}
    assert got == want


def test_unfinished_components_are_an_error(spark):
    import pytest
    from tangoflow.llm.components import components

    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="unfinished"):
        components(path, "a", "b", max_rounds=1)


def test_vectors_with_a_null_id_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (3, [1.0, 0.02], 0)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(str, got)) == sorted([
        "Row(vec_id=1, n_links=1, component_id=1, kept=True)", "Row(vec_id=3, n_links=1, component_id=1, kept=False)",
        "Row(vec_id=None, n_links=0, component_id=None, kept=True)", "Row(vec_id=None, n_links=0, component_id=None, kept=True)"])
