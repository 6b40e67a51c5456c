import random
import zlib
from collections import Counter, defaultdict

import pytest
from tangoflow.llm import kd_shards as K

from conftest_llm import prose


def collect(df):
    return df.collect()


def check_laws(rows, got, shards):
    """Columns, whole sizes and gapless slots; the shards' bytes."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, total = defaultdict(list), [0] * shards
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    return total


def many_rows(seed=1, n=3000):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 60)), "hot" if i % 3 == 0 else f"s{i % 17}") for i in range(n)]
    return rows + [(None, None, None), (n + 1, "", "s1"), (n + 2, None, "s2"), *rows[:20]]


def test_shards_are_near_equal_and_whole(docs_of):
    rows = many_rows()
    got = collect(K.shards(docs_of(rows)))
    total = check_laws(rows, got, 16)
    longest = max(len((t or "").encode()) for _, t, *_ in rows)
    assert max(total) - min(total) <= 4 * longest + 0.01 * sum(total) / 16


def test_every_cut_is_a_weighted_median_of_the_widest_dimension(docs_of):
    rows = many_rows(2, 1500)
    found, dims = K.points(K.sized(docs_of(rows)))
    placed, nodes = K.tree(found, dims, 6)
    placed, points = placed.collect(), found.collect()
    leaf = {(r.key, r.t1, r.t2): r.node for r in placed}
    assert len(leaf) == len(points)

    def visit(first, shards, some):
        """Brute force: sort the node's points by split key along its widest dimension and cut at the median."""
        if shards == 1:
            assert all(leaf[r.key, r.t1, r.t2] == first for r in some)
            return
        width = [max(r[f"x{k}"] for r in some) - min(r[f"x{k}"] for r in some) for k in range(dims)]
        node = next(n for n in nodes if (n.first, n.shards) == (first, shards))
        assert width[node.dim] == max(width)
        some = sorted(some, key=lambda r: (r[f"x{node.dim}"], r.t1, r.t2))
        right = [leaf[r.key, r.t1, r.t2] >= first + shards // 2 for r in some]
        assert right == sorted(right)  # one cut along the split key
        at = right.index(True)
        left, whole, want = sum(r.size for r in some[:at]), sum(r.size for r in some), sum(r.size for r in some) * (shards // 2) / shards
        near = max(some[at - 1].size, some[at].size) / 2
        assert abs(left - want) <= max(near, K.SLACK * whole) + 1
        visit(first, shards // 2, some[:at])
        visit(first + shards // 2, shards - shards // 2, some[at:])

    visit(0, 6, points)


def test_equal_texts_share_a_shard_unless_they_are_too_heavy(docs_of):
    rng = random.Random(3)
    copies = [prose(rng, 30) for _ in range(40)]
    rows = [(i, rng.choice(copies) if i % 4 == 0 else prose(rng, 40), f"s{rng.randrange(9)}") for i in range(8000)]
    shards = defaultdict(set)
    for r, text in zip(sorted(collect(K.shards(docs_of(rows))), key=lambda r: r.doc_id), (t for _, t, _ in rows), strict=True):
        shards[text].add(r.shard)
    assert sum(len(x) > 1 for x in shards.values()) <= 15  # at most one group a cut


def test_a_group_of_a_third_of_all_rows_is_spread(docs_of):
    rng = random.Random(4)
    rows = [(i, "the same text again " * 3 if i % 3 == 0 else prose(rng, 12), "a") for i in range(3000)]
    rows += [(9999, "one row many times " * 3, "b")] * 1000
    total = check_laws(rows, collect(K.shards(docs_of(rows))), 16)
    assert max(total) - min(total) <= 0.02 * sum(total)


@pytest.mark.parametrize("rows", [[], [(1, "one")], [(1, "one"), (2, "two")], [(1, None)] * 40])
def test_few_rows(docs_of, rows):
    docs = docs_of(rows or [(1, "")])
    check_laws(rows, collect(K.shards(docs if rows else docs.where("false"))), 16)


def test_target_bytes_set_the_number_of_shards(docs_of):
    rows = [(i, "x" * 99) for i in range(500)]
    total = check_laws(rows, collect(K.shards(docs_of(rows), target_bytes=7000)), 8)
    assert all(abs(t - 6250) <= 300 for t in total)
