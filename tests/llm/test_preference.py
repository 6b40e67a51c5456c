from tangoflow.llm import preference as P

S = "conv_id long, turn long, role string, text string, part string, loss int"


def turns(spark, rows):
    return P.neighbours(spark.createDataFrame([(*r, "x", 1) for r in rows], S))


def conv(i, *texts):
    return [(i, n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(texts)]


def test_common_prefix_once_and_masked_completions(spark):
    rows = conv(0, "hi", "hello", "why", "because") + conv(1, "hi", "hello", "why", "no idea", "ok", "bye")
    (r,) = P.records(P.preference_turns(turns(spark, rows + rows[:2]))).collect()
    say = lambda role, t: f"<|im_start|>{role}\n{t}<|im_end|>\n"
    assert r.prompt == say("user", "hi") + say("assistant", "hello") + say("user", "why")
    assert r.chosen == say("assistant", "because") and [tuple(s) for s in r.chosen_loss] == [(0, len(r.chosen))]
    assert r.rejected == say("assistant", "no idea") + say("user", "ok") + say("assistant", "bye")
    assert [r.rejected[a:b] for a, b in r.rejected_loss] == [say("assistant", "no idea"), say("assistant", "bye")]


def test_prefixes_identical_and_unpaired(spark):
    rows = (conv(2, "a", "b") + conv(3, "a", "b", "c") + conv(4, "x", "y") + conv(5, "x", "y") + conv(6, "lone", "one")
            + [(None, 0, "user", "nobody"), (8, None, None, None), (9, None, None, None), (8, 0, "user", "q"), (9, 0, "user", "r")])
    got = P.preference_turns(turns(spark, rows)).collect()
    part = {}
    for r in got:
        part.setdefault(r.pair_id, []).append((r.part, r.turn, r.loss, r.paired))
    assert sorted(part[1]) == [("prompt", 0, False, True), ("prompt", 1, False, True), ("rejected", 2, False, True)]
    assert sorted(part[2]) == [("prompt", 0, False, True), ("prompt", 1, False, True)]
    assert sorted(part[3]) == [("chosen", 0, False, False), ("chosen", 1, True, False)]
    assert part[None] == [("chosen", 0, False, False)]
    assert len(part[4]) == 4 and {p[0] for p in part[4]} == {"chosen", "rejected"}
    assert "<|im_start|>unknown\n<|im_end|>\n" in {r.rendered for r in got}


def test_long_hot_conversation_and_empty_table(spark):
    rows = [(0, n, "user", "same") for n in range(3000)] + [(1, n, "user", "same") for n in range(2999)]
    got = P.preference_turns(turns(spark, rows))
    assert {r.part: r["count"] for r in got.groupBy("part").count().collect()} == {"prompt": 2999, "chosen": 1}
    assert P.preference_turns(turns(spark, rows[:1]).where("false")).count() == 0


def test_neighbours_of_large_and_negative_ids(spark):
    ids = [2**54 + 2, 2**54 + 3, -1, -2, -3, None]
    got = P.neighbours(spark.createDataFrame([(i,) for i in ids], "conv_id long")).collect()
    assert [r.pair_id for r in got] == [2**53 + 1, 2**53 + 1, -1, -1, -2, None]
    assert [r.side for r in got][:4] == ["chosen", "rejected", "rejected", "chosen"]
