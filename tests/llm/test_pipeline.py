import random

import corpus_pipeline as C
import pytest
from tangoflow.llm import mixing, packing

from conftest_llm import prose
from test_near import bag, edited
from test_packing import PATH


@pytest.fixture
def folder(docs_of, tmp_path):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        base = prose(rng, rng.randint(60, 200)) + f" unique{i} token=abcdef{i:04d} end"
        rows += [(3 * i, base, "abc"[i % 3]), (3 * i + 1, edited(rng, base, 1), "a"), (3 * i + 2, base, None)]
    rows += [(1000, None), (1001, "short"), (1002, "LOUD!! " * 90), (1003, "$$$ " * 99)]
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_stages_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, text = docs.columns, {r[0]: r[1] for r in rows}
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "pack_tokens"]
    out = {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, path).cache()
        assert name == names[-1] or docs.columns == columns
        out[name] = docs.collect()
    assert sorted(r.doc_id for r in out["quality_rules"]) == list(range(180))
    kept = sorted(r.doc_id for r in out["near_dedup"])
    assert kept == [3 * i for i in range(60)]  # each base document, of its copies
    assert all(sum((bag(text[a]) & bag(text[a + 1])).values()) for a in kept[:3])
    for r in out["secret_scan"]:
        assert "abcdef" not in r.text and r.text == text[r.doc_id].split("token=")[0] + "[SECRET] end"
        assert r.n_chars == len(r.text)
    copies = {}
    for r in out["mix_sources"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    cleaned = {r.doc_id: r.text for r in out["secret_scan"]}
    ids = {i: [*packing.encode(t, PATH), 1] for i, t in cleaned.items()}
    packed = {}
    for r in out["pack_tokens"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == len(ids[r.doc_id])
    assert packed == {i: n * len(ids[i]) for i, n in copies.items()}
    words = sum(len(t.split()) for t in cleaned.values())
    taken = sum(n * len(cleaned[i].split()) for i, n in copies.items())
    assert abs(taken - words) < 0.05 * words and mixing.CAP == 3


def test_run_is_the_stages_in_order(spark, folder):
    path, _ = folder
    out = C.run(spark, path)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0 and C.ORACLE_SQL is None


def test_stages_take_odd_tables(spark, docs_of):
    """Nulls in every column, repeated rows, extra columns with the names the
    operators use, and no rows at all, through every stage."""
    rng = random.Random(13)
    good = prose(rng, 80)
    full = docs_of([(1, good, "a"), (1, good, "a"), (2, prose(rng, 90), None), (None, prose(rng, 70), "b"), (3, None), (4, "")])
    full = full.withColumn("digest", full["text"]).withColumn("id", full["doc_id"]).withColumn("__row", full["size"])
    for docs, last in ((full, 3), (full.where("false"), 0)):
        columns, types = docs.columns, docs.dtypes
        for name, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, "").cache()
            assert docs.columns == columns and docs.dtypes == types, name
            if name == "near_dedup":
                assert docs.count() == last
        out = C.STAGES[-1][1](spark, docs, "").collect()
        assert bool(out) == bool(last)
