import random
import re

from pyspark.sql import functions as F
from tangoflow.llm import rule_ledger as R

from conftest_llm import prose


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    at = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(at)


def cases():
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "a b"), (6, "a a a a"), (7, "a b a b a b c"),
            (8, "x\ny\nx\n\n \nx"), (9, "é b  c"), (10, "# * $ % & | < >"), (11, "one two three\n" * 40)]
    rows += [(20 + i, prose(rng, rng.randint(1, 150)).replace(" w7ab ", "\n")) for i in range(30)]
    rows += [(60, " ".join(rng.choice("abc") for _ in range(300))), (61, "THE!! END!! " * 60)]
    return rows + rows[3:6]


def test_measures_match_brute_force(docs_of):
    rows = cases()
    got = R.ledger(docs_of(rows), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted((i, *brute(t)) for i, t in rows)


def test_very_long_text_and_empty_table(docs_of):
    text = " ".join(str(i % 50_000) for i in range(120_000))
    r = R.ledger(docs_of([(1, text)]), ["doc_id"]).first()
    assert (r.n_words, r.n_repeat_words) == (120_000, brute_long(text))
    empty = R.apply_policy(R.ledger(docs_of([(1, "")]).where("false"), ["doc_id"]), R.FULL_POLICY)
    assert empty.count() == 0 and R.ablations(empty, [R.FULL_POLICY]).count() == 0


def brute_long(text):
    w = text.split()
    first, again = {}, set()
    for i in range(len(w) - 2):
        g = tuple(w[i:i + 3])
        if g in first:
            again.update((i, first[g]))
        else:
            first[g] = i
    return len({i + k for i in again for k in range(3)})


def test_policies_bits_and_ablations(docs_of):
    good, junk = " ".join(f"word{i}" for i in range(80)), "WORD!! " * 60
    led = R.ledger(docs_of([(1, good), (2, junk), (3, "few words"), (4, None)]), ["doc_id"])
    kept = {r.doc_id: r.kept for r in R.apply_policy(led, R.FULL_POLICY).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert {r.doc_id for r in led.where(R.fails(R.BASE_POLICY)).collect()} == {2, 3, 4}
    ab = {(r.policy, r.rule): r for r in R.ablations(led, [R.BASE_POLICY, R.FULL_POLICY]).collect()}
    assert ab["base-1", "few_words"].n_only_this == 2 and ab["base-1", "few_words"].n_kept == 1
    assert ab["full-1", "shouting"].n_failed == 1 and ab["full-1", "shouting"].n_only_this == 0
    assert ab["full-1", "shouting"].failed_together & R.BIT["exclamations"]


def test_keep_good_keeps_all_columns_and_clean_rows(docs_of):
    good = " ".join(f"word{i}" for i in range(80))
    docs = docs_of([(1, good), (1, good), (2, "bad"), (3, None)])
    out = R.keep_good(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1, 1]
    plan = R.keep_good(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(coalesce") <= 6  # measured once, not again inside the filter
    assert out.select(F.max("n_chars")).first()[0] == len(good)
