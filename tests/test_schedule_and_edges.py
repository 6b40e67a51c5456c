"""Hand-computed edge cases (FIXTURES.md part C) for scalar and small operators."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from tangoflow.functions.schedule import ladder_interval, review_interval, strict_day
from tangoflow.functions.text import normalize_answer, sentences_of
from tangoflow.operators import chats as ch, corpus as cp, due, progress as pg, reviews as rv, store, trainprep as tp
from tangoflow.operators import vocab
from tangoflow.params import Params


def test_review_interval_golden_points(spark):
    pts = [(1.0, 1, 7), (1.0, 2, 14), (1.0, 6, 28), (1.0, 8, 30), (0.9, 0, 7), (0.7, 2, 6), (0.5, 3, 4),
           (0.49, 0, 1), (None, None, 1)]
    df = spark.createDataFrame([(r, s) for r, s, _ in pts], "rate double, streak int")
    got = [r[0] for r in df.select(review_interval(F.col("rate"), F.col("streak"))).collect()]
    assert got == [e for _, _, e in pts]


def test_ladder_interval(spark):
    df = spark.createDataFrame([(0, True), (1, True), (5, True), (6, True), (7, True), (3, False)],
                               "n int, ok boolean")
    got = [r[0] for r in df.select(ladder_interval(F.col("n"), F.col("ok"))).collect()]
    assert got == [1, 3, 90, 180, 360, 1]


def test_one_correct_review_gives_next_week(spark):
    df = spark.createDataFrame([(1, "Kuruma", dt.datetime(2025, 8, 14, 1, 3, 19), 1, True)],
                               "user_id long, word string, reviewed_at timestamp_ntz, seq long, correct boolean")
    s = rv.word_state(df).collect()[0]
    assert s.next_review == dt.date(2025, 8, 21) and s.streak == 1 and s.success_rate == 1.0


def test_due_date_parsing(spark):
    texts = ["2025-08-21", "2025-8-1", "2025-08-22", "2025-13-01", " 2025-09-01", "", None, "25-09-01"]
    w = spark.createDataFrame([(1, f"w{i}", t) for i, t in enumerate(texts)],
                              "user_id long, japanese string, next_review string")
    got = {r.japanese for r in due.due_words(w, Params(today=dt.date(2025, 8, 21))).collect()}
    expect = {f"w{i}" for i, d in enumerate([True, True, False, True, True, True, True, True]) if d}
    assert got == expect
    assert spark.range(1).select(strict_day(F.lit("2025-8-1"))).collect()[0][0] == dt.date(2025, 8, 1)


def test_streak_of_flags(spark):
    df = spark.createDataFrame([([True, True, False, True, True],), ([False],), ([True, None],), ([],)],
                               "f array<boolean>")
    assert [r[0] for r in df.select(rv.streak_of_flags(F.col("f"))).collect()] == [2, 0, 0, 0]


def test_review_stats_macro_average(spark):
    words = spark.createDataFrame([(1, "a", 2, 0.5), (1, "b", 1, 1.0), (1, "c", 0, 0.0)],
                                  "user_id long, japanese string, review_count long, success_rate double")
    r = rv.review_stats(words).collect()[0]
    assert (r.total_words, r.words_with_reviews, r.average_success_rate, r.total_reviews) == (3, 2, 0.75, 3)


def test_practice_day_streak_cases(spark):
    d = dt.date(2024, 1, 30)
    cases = {1: [-2, -1, 0], 2: [-3, -2, -1], 3: [0], 4: [-1], 5: [-4, -1, 0]}
    rows = [(u, (d + dt.timedelta(days=o)).strftime("%Y-%m-%d") + " 10:00") for u, offs in cases.items() for o in offs]
    chats = spark.createDataFrame(rows, "user_id long, timestamp string")
    got = {r.user_id: r.day_streak for r in pg.practice_day_streak(chats, Params(today=d)).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 0, 5: 2}


def test_breakdowns_count_every_value(spark):
    """No value list: a level or topic that nobody foresaw is counted, so the
    breakdown adds up to the chats that have one."""
    chats = spark.createDataFrame([(1, "2024-01-01 10:00", "Beginner", "Travel"), (1, "2024-01-01 11:00", None, "Hobbies"),
                                   (1, "2024-01-01 12:00", "Expert", None), (1, "2024-01-02 10:00", None, "Travel")],
                                  "user_id long, timestamp string, level string, topic string")
    assert {(str(r.day), r.level, r.conversations) for r in pg.daily_by_level(chats).collect()} == {
        ("2024-01-01", "Beginner", 1), ("2024-01-01", "Expert", 1)}
    assert {(str(r.day), r.topic, r.conversations) for r in pg.daily_by_topic(chats).collect()} == {
        ("2024-01-01", "Travel", 1), ("2024-01-01", "Hobbies", 1), ("2024-01-02", "Travel", 1), ("2024-01-02", "Hobbies", 0)}


def test_ladder_survives_long_histories(spark):
    from tangoflow.operators.reviews import ladder_schedule

    start = dt.datetime(2020, 1, 1)
    rows = [(1, "w", start + dt.timedelta(days=i), i, True) for i in range(100)]
    got = ladder_schedule(spark.createDataFrame(rows, "user_id long, word string, reviewed_at timestamp_ntz, seq long, correct boolean"))
    by = {r.seq: r for r in got.collect()}
    assert by[5].ladder_days == 90 and by[6].ladder_days == 180 and by[6].ladder_next_review == dt.date(2020, 1, 7) + dt.timedelta(180)
    assert by[99].ladder_days == 90 * 2**40 and by[99].ladder_next_review is None
    assert all((r.ladder_next_review is None) == (r.ladder_days > 2_950_000) for r in by.values() if not 2e6 < r.ladder_days < 3e6)


def test_two_rules_of_one_error_type_stay_two_pairs(spark):
    from tangoflow.operators import corpus as cp, trainprep as tp

    s = spark.createDataFrame([(1, "en", 0, "he is in the house and so on."), (2, "xx", 0, "he is in"), (3, "de", 0, "a in b")],
                              "doc_id long, lang string, pos int, sentence string")
    rules = [("en", "particle", " is ", " are ", 1), ("en", "particle", " in ", " on ", 2), ("de", "particle", " in ", " auf ", 2)]
    raw = cp.inject_errors(s, rules)
    assert sorted(r.pair_id for r in raw.collect()) == ["injected#1#0#0", "injected#1#0#1", "injected#3#0#2"]
    pairs = cp.format_pairs(raw)
    enc = tp.encode_pairs(pairs, tp.fit_vocab(pairs, 50), 50, 16).collect()
    assert len(enc) == 3 and all(len(r[c]) == 16 for r in enc for c in ("input_ids", "attention_mask", "labels"))
    # one id twice: two rows, not one longer one
    twice = tp.encode_pairs(pairs.union(pairs), tp.fit_vocab(pairs, 50), 50, 4).collect()
    assert len(twice) == 6 and all(len(r.input_ids) == 4 for r in twice)


def test_search_is_case_insensitive_unicode(spark):
    w = spark.createDataFrame([(1, "ÉCOLE", "x"), (1, "école", "y"), (1, None, None)],
                              "user_id long, japanese string, english string")
    assert [r.japanese for r in vocab.vocab_search(w, "éc").collect()] == ["ÉCOLE", "école"]


def test_delete_removes_first_equal_chat(spark):
    row = (1, "hi", "yo", "2024-01-01 10:00", None, None)
    chats = spark.createDataFrame([(*row, i, dt.datetime(2024, 1, 1, 10, 0, i)) for i in range(3)],
                                  "user_id long, user_message string, ai_response string, timestamp string, "
                                  "level string, topic string, conv_id long, created_at timestamp_ntz")
    req = spark.createDataFrame([row], "user_id long, user_message string, ai_response string, timestamp string, "
                                       "level string, topic string")
    left = ch.delete_chats(chats, req).collect()
    assert sorted(r.conv_id for r in left) == [1, 2]


def test_settings_decode_and_defaults(spark):
    s = spark.createDataFrame([(1, "preferred_level", "Advanced"), (1, "daily_goal", "5"),
                               (1, "favorite_topics", "[]")], "user_id long, setting_key string, setting_value string")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = {(r.user_id, r.setting_key): (r.value_json, r.kind) for r in store.load_settings(s, users).collect()}
    assert got[(1, "preferred_level")] == ('"Advanced"', "string")
    assert got[(1, "daily_goal")] == ("5", "number")
    assert got[(1, "favorite_topics")] == ("[]", "array")
    assert got[(2, "preferred_level")] == ('"Beginner"', "string") and got[(2, "daily_goal")] == ("5", "number")
    enc = store.load_settings(s, users).select(store.encode_setting(F.col("value_json")).alias("v"))
    assert "Advanced" in {r.v for r in enc.collect()}


def test_normalize_answer_unicode_whitespace(spark):
    assert spark.range(1).select(normalize_answer(F.lit("\tÉCOLE　\n"))).collect()[0][0] == "école"


def test_confidence_by_level(spark):
    raw = spark.createDataFrame([("a", "x", "y", "t", "s", lv) for lv in (1, 2, 3, None)],
                                "pair_id string, incorrect_text string, correct_text string, error_type string, "
                                "source string, difficulty_level int")
    assert [r.confidence_score for r in cp.format_pairs(raw).collect()] == [1.0, 1.0, 0.8, 0.8]


def test_exact_split_sizes(spark):
    pairs = spark.createDataFrame([(f"p{i}",) for i in range(11)], "pair_id string")
    s = {r.split: r.n for r in tp.train_val_split(pairs).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert s == {"val": 3, "train": 8}


def test_extract_vocab_reply_shapes(spark):
    replies = ["車 (くるま) (car)", "駅はどこですか？ (Where is the train station?)", "plain (x)"]
    c = spark.createDataFrame([(1, i, t) for i, t in enumerate(replies)], "user_id long, conv_id long, ai_response string")
    got = {(r.conv_id, r.expression, r.reading, r.meaning) for r in ch.extract_vocab(c).collect()}
    assert (0, "車", "くるま", "car") in got
    assert (1, "駅はどこですか？", None, "Where is the train station?") in got
    assert not any(r[0] == 2 for r in got)


def test_sentences_keep_unterminated_ones(spark):
    cases = {"One. Two!\nThree? four\nno end": ["One.", " Two!", "Three?", " four", "no end"], "..a.": ["a."],
             "x" * 200_000 + "\n": ["x" * 200_000], "": [], "a!b?c.": ["a!", "b?", "c."], "\n\n": []}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.s for r in df.select("t", sentences_of(F.col("t")).alias("s")).collect()} == cases


def test_template_grid_size(spark):
    assert cp.template_grid(spark).count() == 512 + 512 + 48 + 8 + 288 + 288


def test_template_draws_shape(spark):
    f = cp.template_pairs(spark).collect()
    assert len(f) == 60 and all("{" not in r.incorrect_text and "{" not in r.correct_text for r in f)
    assert {r.difficulty_level for r in f} == {2}


def test_proficiency_difficulty(spark):
    df = spark.createDataFrame([("N5",), ("N1",), ("N9",), (None,)], "l string")
    assert [r[0] for r in df.select(cp.proficiency_to_difficulty(F.col("l"))).collect()] == [1, 5, 3, 3]


def test_upsert_last_writer_wins(spark):
    ex = spark.createDataFrame([(1, "a", "old", 1), (1, "b", "keep", 1)], "user_id long, japanese string, english string, updated_at int")
    inc = spark.createDataFrame([(1, "a", "new", 2), (1, "c", "add", 1)], "user_id long, japanese string, english string, updated_at int")
    got = {r.japanese: r.english for r in store.upsert_words(ex, inc).collect()}
    assert got == {"a": "new", "b": "keep", "c": "add"}


def test_quiz_session_caps(spark):
    w = spark.createDataFrame([(1, f"w{i:02d}", "e", dt.date(2024, 1, 1), None) for i in range(30)],
                              "user_id long, japanese string, english string, added_date date, next_review string")
    s = due.quiz_session(w, Params(), max_words=50).collect()
    assert len(s) == 20 and max(r.position for r in s) == 20 and {r.session_size for r in s} == {20}


def test_encode_lengths(spark):
    pairs = spark.createDataFrame([("p1", "grammar: a b c", "a b"), ("p2", "x " * 300, "y")],
                                  "pair_id string, input_text string, target_text string")
    v = tp.fit_vocab(pairs, 10)
    e = {r.pair_id: r for r in tp.encode_pairs(pairs, v, 10, max_len=16).collect()}
    assert all(len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 16 for r in e.values())
    assert e["p1"].attention_mask[:5] == [1] * 5 and e["p1"].attention_mask[5] == 0  # grammar : a b c
    assert e["p1"].labels[2:] == [-100] * 14


def test_pairs_from_an_array_file(spark, tmp_path):
    import json

    from tangoflow.operators.trainprep import load_pairs_json

    (tmp_path / "pairs.json").write_text(json.dumps(
        [{"input_text": "grammar: 本が", "target_text": "本を", "error_category": "particle", "confidence": 1.0},
         {"input_text": "a", "target_text": "b"}], ensure_ascii=False, indent=2), encoding="utf-8")
    got = load_pairs_json(spark, str(tmp_path / "pairs.json"), array=True).collect()
    assert [(r.target_text, r.error_category) for r in got] == [("本を", "particle"), ("b", "unknown")]


def test_files_without_learner_are_quarantined_or_mapped(spark, tmp_path):
    import json

    from tangoflow.sources import backups as bk

    body = {"learned_words": [], "conversation_history": [{"user": "hi", "ai": "yo"}], "user_settings": {}}
    (tmp_path / "backup_a.json").write_text(json.dumps(body))
    (tmp_path / "backup_b.json").write_text(json.dumps(body))
    env = bk.read_envelopes(spark, str(tmp_path))
    valid, bad = bk.validate_backups(env)
    assert valid.count() == 0 and {r.reason for r in bad.collect()} == {"no learner"}
    named = spark.createDataFrame([("backup_a.json", 7)], "file_name string, user_id long")
    valid, bad = bk.validate_backups(bk.read_envelopes(spark, str(tmp_path), learners=named))
    assert [r.user_id for r in bk.backup_chats(valid).collect()] == [7] and bad.count() == 1


def test_null_setting_stays_null(spark):
    s = spark.createDataFrame([(1, "k", None), (1, "j", "raw")], "user_id long, setting_key string, setting_value string")
    got = {r.setting_key: r.value_json for r in store.load_settings(s, s).collect()}
    assert got["k"] is None and got["j"] == '"raw"'


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from tangoflow import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        session.scratch_path(Session(), "x")


def test_vocabulary_by_a_small_summary_is_exact(spark):
    """Far more different tokens than the summary holds: error, recount, and
    widening where the proof fails; the same ids as by counting all."""
    import random
    from collections import Counter

    from tangoflow.operators import trainprep as tp

    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    rows = [(" ".join([*rng.choices(common, weights=range(40, 10, -1), k=20), *[f"rare{rng.randrange(10**6)}" for _ in range(6)]]), f"t{i % 7}") for i in range(900)]
    df = spark.createDataFrame([*rows, (None, "")], "input_text string, target_text string").repartition(3)
    counts = Counter(t for r in rows for text in r for t in text.split())
    want = [(t, k, n) for k, (t, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20], 1)]
    for capacity in (None, 400, 40, 8):
        assert [tuple(r) for r in tp.fit_vocab(df, 20, capacity=capacity).orderBy("id").collect()] == want
    summary = {r.token: r.low for r in tp.token_summary(df, ("input_text", "target_text"), 40).collect()}
    error = summary.pop(None)
    assert error > 0 and len(summary) <= 3 * 40
    assert all(summary.get(t, 0) <= n <= summary.get(t, 0) + error for t, n in counts.items())


def test_a_vocabulary_reads_its_pairs_once(spark):
    """Also when the summary is widened and its candidates are recounted."""
    from tangoflow.operators import trainprep as tp

    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [(f"a a a b b c r{i}", f"b a s{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "input_text string, target_text string").mapInArrow(passed, "input_text string, target_text string")
    got = [tuple(r) for r in tp.fit_vocab(df, 3, capacity=2).orderBy("id").collect()]
    assert got == [("a", 1, 800), ("b", 2, 600), ("c", 3, 200)]
    assert read.value == len(rows)


def test_pairs_are_encoded_from_token_slices(spark, monkeypatch):
    """All blanks, control and joined characters, characters of one to four
    bytes, empty and null texts, large strings, slices of any size: the tokens
    of the column expression, their ids, cut and padded."""
    import random

    import pyarrow as pa

    from tangoflow.operators import trainprep as tp

    rng = random.Random(2)
    texts = ["".join(rng.choices("aZ09 \t\n\x0b\x0c\r\x1c.é日𝒳İΣ-_\u3000", k=rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, texts[-(i % 300)]) for i, t in enumerate([*texts, "", None])], "pair_id long, input_text string, target_text string")
    rows = df.select("pair_id", tp.lowered("input_text"), tp.tokens(F.col("input_text")), tp.tokens(F.col("target_text"))).orderBy("pair_id").collect()
    for size in (1 << 22, 40, 1):
        monkeypatch.setattr(tp, "SLICE_BYTES", size)
        for kind in (pa.string(), pa.large_string()):
            low = pa.array([r[1] for r in rows], kind)
            for some, want in ((low, rows), (low.slice(5, 90), rows[5:95]), (low.slice(0, 0), [])):
                got = [found.to_pylist()[a:b] for found, at in tp.token_slices(some) for a, b in zip(at[:-1], at[1:])]
                assert got == [r[2] or [] for r in want]
    vocab = tp.fit_vocab(df, 8)
    ids = {r.token: r.id for r in vocab.collect()}
    cut = lambda ts, fill: ([ids.get(t, 9) for t in ts or []] + [fill] * 12)[:12]
    got = {r.pair_id: r for r in tp.encode_pairs(df, vocab, 8, max_len=12).collect()}
    for no, _, source, target in rows:
        assert (got[no].input_ids, got[no].labels) == (cut(source, 0), cut(target, -100))
        assert got[no].attention_mask == ([1] * len(source or []) + [0] * 12)[:12]


def test_many_error_rules_by_one_automaton(spark, monkeypatch):
    """Overlapping and repeated right forms, several languages, null texts:
    the automaton and the column expression give the same pairs."""
    from tangoflow.operators import corpus as cp

    rules = [("en", "a", " the ", " a ", 1), ("en", "b", "he", "she", None), ("en", "c", " the ", " an ", 2), ("de", "d", "the", "x", 3),
             ("en", "e", "there is", "there are", 2), ("fr", "f", "é", "e", 1), ("en", "g", "here", "hear", 1)]
    rows = [(1, 0, "en", "over there is the the end"), (1, 1, "de", "the the"), (2, 0, "en", None), (2, 1, "fr", "été"), (3, 0, "xx", "the"), (3, 1, "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, lang string, sentence string")
    plain = sorted(map(str, cp.inject_errors(df, rules).collect()))
    monkeypatch.setattr(cp, "COLUMN_RULES", 0)
    assert sorted(map(str, cp.inject_errors(df, rules).collect())) == plain and len(plain) == 7
    many = rules + [("en", "z", f"never {i} seen", "x", 1) for i in range(1000)]
    assert sorted(map(str, cp.inject_errors(df, many).collect())) == plain
