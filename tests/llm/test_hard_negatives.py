import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tangoflow.llm import hard_negatives as H


def floored(v):
    return [math.floor(256 * float(x)) for x in v]


def brute(rows, every, k=5):
    """rows of (id, vector, label) -> sorted result rows, all in Python integers."""
    fine, seen = [], set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        z = tuple(floored(v))
        if (i, label, z) not in seen:
            seen.add((i, label, z))
            fine.append((i, label, z))
    out = []
    for a in fine:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b) for b in fine if b is not a and len(b[2]) == len(a[2])]
        scored.sort(key=lambda s: (s[0], s[1][0]))
        for p, pos in [s for s in scored if s[1][1] == a[1]][:k]:
            some = [s for s in scored if s[1][1] != a[1] and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(a[0], pos[0], n, b[0], -p, -s) for n, (s, b) in enumerate(some, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, label int, row int, dim string, score double, rank int"


def mined(spark, rows, every):
    df = spark.createDataFrame([(*r, 1, "x", 2.0, 3) for r in rows], SCHEMA)
    got = H.mine(df, every=every)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(40) * 0.2], int(rng.integers(0, 4))) for i in range(1200)]
    hot = [float(x) for x in rng.standard_normal(40) * 0.2]
    rows += [(2000 + i, hot, i % 2) for i in range(300)]  # ties
    rows += [(10, None, 1), (20, [None] + hot[1:], 1), (30, [math.nan] + hot[1:], 1), (40, [math.inf] + hot[1:], 1), (50, hot, None),
             (None, hot, 1), (60, [0.0] * 40, 0), (70, [-0.0] * 40, 1), (80, hot[:7], 0), (90, hot[:7], 1), (91, [x * 0.9 for x in hot[:7]], 0),
             (92, [x * 0.95 for x in hot[:7]], 1), (100_000, [], 0), (100_001, [], 0), (100_002, [], 1)]
    return rows + rows[:30] + [(0, hot, 3), (0, hot, 2)]


def test_hard_negatives_match_brute_force(spark):
    rows = vectors()
    want = brute(rows, 10)
    assert mined(spark, rows, 10) == want and len(want) > 1000


def test_huge_components_are_scored_exactly(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) * 10.0 ** (6 + i % 4) for x in rng.standard_normal(8)], i % 3) for i in range(150)]
    limit = (1 << 63) - 1
    want = [(*r[:4], *(max(-limit, min(limit, x)) for x in r[4:])) for r in brute(rows, 5)]
    assert mined(spark, rows, 5) == want
    rows = [(i, [float(x) * 1e200 for x in rng.standard_normal(4)], i % 2) for i in range(30)]
    assert len(mined(spark, rows, 5)) == len(brute(rows, 5))


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [-1.0, 0.5], 1), (3, [1.0, 0.1], 1), (5, [1.0, 1.0], 2)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows, 1) == brute(rows, 1)


def test_intervals_hold_the_scores_and_the_filter_filters():
    rng = np.random.default_rng(7)
    for dim in (1, 5, 64, 100):
        x, q = (rng.integers(-200, 200, (n, dim)) for n in (500, 40))
        codes, along, rest = H.encode(x.astype(float))
        low, high = H.Anchors(q).intervals(slice(0, 40), codes, along, rest)
        true = q @ x.T
        assert (low <= true).all() and (true <= high).all()
        if dim >= 64:  # five codes leave 8 % of a vector, so intervals are narrow against the norms
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
            assert ((high - low) / norms).mean() < 0.3


def test_most_pairs_are_not_scored():
    rng = np.random.default_rng(8)
    z = np.floor(256 * rng.standard_normal((3000, 64)) * 0.125).astype(np.int64)
    codes, along, rest = H.encode(z.astype(float))
    b = object.__new__(H.Rows)
    b.n, b.dim, b.ids, b.rows, b.labels, b.z = 3000, 64, np.arange(3000), np.arange(3000), np.arange(3000) % 10, z
    b.codes, b.along, b.rest = codes, along, rest
    q = z[:50]
    score = np.where(b.labels[:50, None] == b.labels[None, :], q @ z.T, -10**9)
    windows = [[int(x) for x in np.sort(np.where(np.arange(3000) == i, -10**9, score[i]))[-5:]] for i in range(50)]
    asked = {"labels": b.labels[:50], "rows": b.rows[:50], "windows": windows}
    pairs, scored = H._meet(asked, q, H.Anchors(q), b, H.Best(5), False, 5)
    assert scored < pairs / 4


def test_label_can_be_a_column_expression(spark):
    rows = vectors()[:300]
    df = spark.createDataFrame([(*r, 1, "x", 2.0, 3) for r in rows], SCHEMA)
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    label = F.when(df["vec_id"] % 7 == 0, (df["label"] + 1) % 10).otherwise(df["label"])
    assert sorted(tuple(r) for r in H.mine(df, every=20, label=label).collect()) == brute(moved, 20)
