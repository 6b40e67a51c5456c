import hashlib
import zlib

import pytest
from tangoflow.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def record(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Levels of one tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, i):
    for level in levels[:-1]:
        lo = i // 16 * 16
        yield level[lo:i], level[i + 1:lo + 16]
        i //= 16


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, record(*r)))
        levels[s] = climb([record(*r) for r in trees[s]])
    top = climb([levels[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node, seen = record(*r[:4], text), ""
            for left, right in [*path(levels[s], i), *path(top, n)]:
                seen += "".join(left + right)
                node = h("".join([*left, node, *right]))
            out.append((r[0], record(*r), levels[s][-1][0], top[-1][0], h(seen), node, node == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, i int, m string, key int"


def run(spark, rows):
    got = M.tampered_proofs(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def small_rows():
    rows = [(i, f"s{i % 7}", "en", 3, f"Text {i} ÄB") for i in range(300)]
    rows += [(1000 + i, None, None, None, None) for i in range(17)]
    rows += [(None, "s1", "en", 1, "A"), (None, None, "en", None, ""), (5, "s5", "de", 0, "AB" * 200_000), (3, "é", "", 0, "")]
    return rows + rows[:40] + [(7, "s0", "en", 3, "other text of the same id")] * 3


@pytest.mark.parametrize("rows", [small_rows(), [(4, "a", "en", 1, "Lone LEAF")], [(4, "a", "en", 1, "X"), (5, "a", "en", 1, "Y")]])
def test_proofs_match_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_trees_of_several_blocks(spark):
    rows = [(i, "big", "en", i, f"T{i}") for i in range(9000)] + [(i, f"one{i}", "en", i, "T") for i in range(20)]
    got = run(spark, rows)
    assert got == brute(rows)
    flagged = [r for r in got if not r[6]]
    assert {r[0] for r in flagged} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_layout_is_a_permutation_that_keeps_subtrees_together():
    for height in (1, 2, 3, 4):
        where = M.addresses(height)
        assert sorted(a for level in where for a in level) == list(range(M.full_size(height)))
    where = M.addresses(4)  # top half: root and its 16 children; then 256 subtrees of 17 nodes each
    assert where[0][0] == 0 and sorted(where[1]) == list(range(1, 17))
    for n in (0, 5, 255):
        own = [where[2][n], *where[3][16 * n:16 * n + 16]]
        assert sorted(own) == list(range(17 + 17 * n, 34 + 17 * n))


def test_block_paths_fold_to_the_root():
    digests = [M.sha(bytes([i % 256, i // 256])) for i in range(4000)]
    b = M.Block.build(3, digests)
    runs = b.runs()
    for i in (0, 15, 16, 3999, 2048):
        p = M.siblings(runs, i)
        assert M.unpack_path(M.pack_path(p)) == p
        assert M.fold(digests[i], p).decode() == b.get(3, 0).hex()
