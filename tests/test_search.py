"""The trigram index: what expressions demand, equal results, fewer rows."""

import pytest
from pyspark.sql import functions as F

from tangoflow.operators import search, vocab
from tangoflow.session import scratch_path


@pytest.mark.parametrize("pattern, want", [
    ("ring", [["ring"]]), ("a.b", [["a", "b"]]), ("abc|def", [["abc"], ["def"]]), ("colou?r", [["colo", "r"]]),
    ("ab*cd", [["a", "cd"]]), ("ab+cd", [["ab", "cd"]]), ("x(yz|w)abc", [["x", "abc"]]), ("[abc]def", [["def"]]),
    (r"a\.bcd", [["a.bcd"]]), (r"\bword\b", [["word"]]), ("ab{2,3}cde", [["a", "cde"]]), ("^start", [["start"]]),
    (r"\p{L}abc", None), ("(?i)abc", None), ("(abc", None), (r"\Qabc\E", None), ("", [[]]), ("(?:abc)+def", [["def"]]),
    ("[]a]bcd", [["bcd"]]), ("größe", [["gr", "e"]]), ("日本語", [["日本語"]])])
def test_literal_runs(pattern, want):
    assert search.literal_runs(pattern) == want


def test_required_grams():
    assert search.required_grams("Ring") == [["ing", "rin"]]
    assert search.required_grams("ab|cdef") is None and search.required_grams("a.c") is None
    assert search.required_grams("abcd|xyz") == [["abc", "bcd"], ["xyz"]]


def _words(spark):
    base = ["spring water", "Earring", "STRING theory", "wing", "brıng it", "fİring line", "ſpring", "Kring", "colour", "color", None, "", "ab",
            "日本語 text", "largest ring of all", "rin g", "ri̇ng"]
    rows = [(u, f"w{u}-{k}", t) for u in range(40) for k, t in enumerate(base)] + [(99, f"plain {i}", f"filler text {i}") for i in range(20_000)]
    return spark.createDataFrame(rows, "user_id long, japanese string, english string")


def test_indexed_search_equals_the_scan_and_reads_less(spark):
    words = _words(spark)
    path = search.build_index(words, scratch_path(spark, "trigrams"))
    total = words.count()
    for term in ("ring", "RING", "spring", "colou?r", "ear|wing", "string.*theory", "日本語", "w3-1", "filler text 19\\d\\d$", "zzzz", "in", ".", None,
                 "K?ring", "firing|bring"):
        got = sorted(map(str, search.search_index(spark, path, term).select(*words.columns).collect()))
        assert got == sorted(map(str, vocab.vocab_search(words, term).collect())), term
    assert search.candidates(spark, path, "ring").count() < total / 20
    assert search.candidates(spark, path, "zzzz").count() == 0 and search.candidates(spark, path, "in") is None
    plan = search.search_index(spark, path, "string.*theory")._jdf.queryExecution().executedPlan().toString()
    assert "slice" in plan[plan.index("PushedFilters"):]
    postings = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin("rin"))
    assert "In(gram" in str(postings._jdf.queryExecution().executedPlan()) or "EqualTo(gram" in str(postings._jdf.queryExecution().executedPlan())
