"""Sentence-pair corpus.

Raw pair schema: pair_id, incorrect_text, correct_text, error_type, source,
difficulty_level.  Processed pair schema: pair_id, input_text, target_text,
error_category, confidence_score.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangoflow import params as P
from tangoflow.functions.text import seeded_bucket
from tangoflow.params import DEFAULT, Params
from tangoflow.sources import corpus_seed as seed

RAW_COLS = ("pair_id", "incorrect_text", "correct_text", "error_type", "source", "difficulty_level")
_SLOT = re.compile(r"\{(\w+)\}")


def _literal_pairs(spark: SparkSession, rows, source: str) -> DataFrame:
    data = [(f"{source}#{i}", inc, cor, et, lvl) for i, (inc, cor, et, lvl) in enumerate(rows)]
    df = spark.createDataFrame(data, "pair_id string, incorrect_text string, correct_text string, "
                                     "error_type string, difficulty_level int")
    # Fixed reference data: one partition (no empty tasks per union branch).
    return df.coalesce(1).withColumn("source", F.lit(source)).select(*RAW_COLS)


def expert_pairs(spark: SparkSession, rows=seed.EXPERT_PAIRS) -> DataFrame:
    """C1 — curated pairs, source 'expert_curated'."""
    return _literal_pairs(spark, rows, seed.SOURCES["expert"])


def learner_pairs(spark: SparkSession, rows=seed.LEARNER_PAIRS) -> DataFrame:
    """C3 — learner-style pairs, source 'lang8_style'."""
    return _literal_pairs(spark, rows, seed.SOURCES["learner"])


def proficiency_to_difficulty(level: Column) -> Column:
    """J4 — N5..N1 → 1..5, anything else → 3."""
    m = F.create_map(*[x for k, v in P.PROFICIENCY_DIFFICULTY for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, level), F.lit(P.PROFICIENCY_UNKNOWN)).cast("int")


def proficiency_pairs(spark: SparkSession, rows=seed.PROFICIENCY_PAIRS) -> DataFrame:
    """C4 — level-graded pairs: difficulty from the level (J4), source
    'jlpt_<level>'; includes identity pairs labelled 'correct'."""
    data = [(f"jlpt#{i}", inc, cor, et, lvl) for i, (inc, cor, et, lvl) in enumerate(rows)]
    df = spark.createDataFrame(data, "pair_id string, incorrect_text string, correct_text string, "
                                     "error_type string, level string")
    return df.coalesce(1).select("pair_id", "incorrect_text", "correct_text", "error_type",
                                 F.concat(F.lit(P.PROFICIENCY_SOURCE_PREFIX), F.col("level")).alias("source"),
                     proficiency_to_difficulty(F.col("level")).alias("difficulty_level"))


def _template_slots(templates) -> list[list[str]]:
    out = []
    for correct, faulty, _ in templates:
        names = []
        for n in _SLOT.findall(correct) + _SLOT.findall(faulty):
            if n not in names:
                names.append(n)
        out.append(names)
    return out


def _fill(text: Column, values: dict[str, Column]) -> Column:
    for name, v in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), v)
    return text


def template_grid(spark: SparkSession, templates=seed.TEMPLATES, slots=seed.SLOTS) -> DataFrame:
    """J5 — every (template, slot values) combination, built as a projection
    over an index range (mixed-radix digits pick the slot values) rather than a
    join of the slot lists."""
    frames = []
    for ti, ((correct, faulty, et), names) in enumerate(zip(templates, _template_slots(templates))):
        sizes = [len(slots[n]) for n in names]
        total = 1
        for s in sizes:
            total *= s
        i = F.col("id")
        values, radix = {}, 1
        for n, s in zip(names, sizes):
            digit = (i / F.lit(radix)).cast("bigint") % F.lit(s)
            values[n] = F.element_at(F.array(*[F.lit(x) for x in slots[n]]), (digit + 1).cast("int"))
            radix *= s
        frames.append(spark.range(total).select(
            F.lit(ti).alias("template_no"), F.col("id").alias("combo"),
            _fill(F.lit(correct), values).alias("correct_text"),
            _fill(F.lit(faulty), values).alias("incorrect_text"),
            F.lit(et).alias("error_type")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fill_templates(spark: SparkSession, draws: int = P.TEMPLATE_DRAWS, templates=seed.TEMPLATES,
                   slots=seed.SLOTS, params: Params = DEFAULT) -> DataFrame:
    """H8 — ``draws`` fillings per template, each slot drawn independently
    with replacement by a seeded md5 hash of (template, draw, slot)."""
    n = len(templates)
    tpl_ok = F.array(*[F.lit(t[0]) for t in templates])
    tpl_bad = F.array(*[F.lit(t[1]) for t in templates])
    types = F.array(*[F.lit(t[2]) for t in templates])
    ti = (F.col("id") / F.lit(draws)).cast("bigint")
    draw = F.col("id") % F.lit(draws)
    values = {}
    for name, options in slots.items():
        idx = seeded_bucket(params.seed, ti, draw, F.lit(name)) % F.lit(len(options))
        values[name] = F.element_at(F.array(*[F.lit(x) for x in options]), (idx + 1).cast("int"))
    pos = (ti + 1).cast("int")
    return spark.range(0, n * draws, 1, 1).select(
        ti.cast("int").alias("template_no"), draw.cast("int").alias("draw"),
        _fill(F.element_at(tpl_bad, pos), values).alias("incorrect_text"),
        _fill(F.element_at(tpl_ok, pos), values).alias("correct_text"),
        F.element_at(types, pos).alias("error_type"))


def template_pairs(spark: SparkSession, draws: int = P.TEMPLATE_DRAWS, params: Params = DEFAULT) -> DataFrame:
    """C2 — template fillings as raw pairs (level 2, source 'synthetic')."""
    f = fill_templates(spark, draws, params=params)
    src = seed.SOURCES["template"]
    return f.select(F.concat_ws("#", F.lit(src), F.col("template_no"), F.col("draw")).alias("pair_id"),
                    "incorrect_text", "correct_text", "error_type", F.lit(src).alias("source"),
                    F.lit(P.TEMPLATE_LEVEL).alias("difficulty_level"))


COLUMN_RULES = 64  # so many rules are tested one by one in a column expression


def _matched(sentences: DataFrame, rules) -> DataFrame:
    """``sentences`` with ``rule_nos``, the rules of their language whose right
    form they contain: one pass of an automaton over all right forms, whatever
    the number of rules."""
    columns = sentences.columns
    lang, text = columns.index("lang"), columns.index("sentence")

    def run(batches):
        import ahocorasick

        nos: dict[tuple, list[int]] = {}
        for no, (language, _, right, _, _) in enumerate(rules):
            if right:
                nos.setdefault((language, right), []).append(no)
        automata = {}
        for (language, right), some in nos.items():
            automata.setdefault(language, ahocorasick.Automaton()).add_word(right, some)
        for a in automata.values():
            a.make_automaton()
        for batch in batches:
            found = [sorted({no for _, some in automata[x].iter(t) for no in some}) if t and x in automata else []
                     for x, t in zip(batch.column(lang).to_pylist(), batch.column(text).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*columns, "rule_nos"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema.fields)
    return sentences.mapInArrow(run, f"{fields}, rule_nos array<int>")


def _injected_by_automaton(sentences: DataFrame, rules) -> DataFrame:
    hits = _matched(sentences.select("doc_id", "pos", "lang", "sentence"), rules).select(
        "doc_id", "pos", F.col("sentence").alias("correct_text"), F.explode("rule_nos").alias("rule_no"))
    of = lambda k, kind="string": F.get(F.array(*[F.lit(r[k]).cast(kind) for r in rules]), F.col("rule_no"))
    return hits.select("doc_id", "pos", "correct_text", "rule_no", of(1).alias("error_type"),
                       F.replace("correct_text", of(2), of(3)).alias("incorrect_text"), of(4, "int").alias("difficulty_level"))


def _injected_by_columns(sentences: DataFrame, rules) -> DataFrame:
    cands = F.array_compact(F.array(*[
        F.when((F.col("lang") == lang) & F.col("sentence").contains(right),
               F.struct(F.lit(no).alias("rule_no"), F.lit(et).alias("error_type"),
                        F.replace(F.col("sentence"), F.lit(right), F.lit(wrong)).alias("incorrect_text"),
                        F.lit(level).cast("int").alias("difficulty_level")))
        for no, (lang, et, right, wrong, level) in enumerate(rules) if right]))
    return sentences.select("doc_id", "pos", F.col("sentence").alias("correct_text"), F.inline(cands))


def inject_errors(sentences: DataFrame, rules) -> DataFrame:
    """C5 — apply (language, error_type, right form, wrong form, level) rules
    to the sentences of their language: every sentence containing a rule's
    right form yields a pair with all its occurrences replaced, identified by
    document, position and rule.  Per row, no join, no shuffle: a column
    expression (``array`` of conditional structs + ``inline``) for few rules,
    an automaton for many."""
    out = (_injected_by_columns if len(rules) <= COLUMN_RULES else _injected_by_automaton)(sentences, rules)
    src = seed.SOURCES["injected"]
    return out.select(F.concat_ws("#", F.lit(src), "doc_id", "pos", "rule_no").alias("pair_id"),
                      "incorrect_text", "correct_text", "error_type", F.lit(src).alias("source"),
                      "difficulty_level")


def union_sources(spark: SparkSession, sentences: DataFrame, rules, params: Params = DEFAULT) -> DataFrame:
    """D2 — the four reference sources plus the corpus-derived pairs, one
    table, source tag kept."""
    parts = [expert_pairs(spark), template_pairs(spark, params=params), learner_pairs(spark),
             proficiency_pairs(spark), inject_errors(sentences, rules)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*RAW_COLS))
    return out


def identity_pairs(raw: DataFrame) -> DataFrame:
    """C6 — flag pairs whose incorrect text equals the correct text."""
    return raw.withColumn("is_identity", F.col("incorrect_text") == F.col("correct_text"))


def format_pairs(raw: DataFrame) -> DataFrame:
    """H7 — model-input formatting; confidence 1.0 for levels ≤ 2, else 0.8
    (a missing level gets 0.8)."""
    conf = F.when(F.col("difficulty_level") <= P.CONFIDENCE_MAX_EASY_LEVEL, F.lit(P.CONFIDENCE_HIGH)) \
        .otherwise(F.lit(P.CONFIDENCE_LOW))
    return raw.select("pair_id", F.concat(F.lit(P.PAIR_PREFIX), F.col("incorrect_text")).alias("input_text"),
                      F.col("correct_text").alias("target_text"), F.col("error_type").alias("error_category"),
                      conf.alias("confidence_score"))


def error_type_distribution(raw: DataFrame) -> DataFrame:
    """A8 — pairs per error type, most frequent first."""
    return raw.groupBy("error_type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "error_type")


def difficulty_distribution(raw: DataFrame) -> DataFrame:
    """A9 — pairs per difficulty level, by level."""
    return raw.groupBy("difficulty_level").agg(F.count(F.lit(1)).alias("count")).orderBy("difficulty_level")


def training_totals(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """A10 — counts of raw and processed pairs in one row: both inputs are
    tagged, unioned and counted in a single global aggregate (partial counts
    per task, no join)."""
    r = raw.select(F.lit(1).alias("_r"), F.lit(0).alias("_p"))
    p = processed.select(F.lit(0).alias("_r"), F.lit(1).alias("_p"))
    u = r.unionByName(p)
    return u.agg(F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("total_raw"),
                 F.coalesce(F.sum("_p"), F.lit(0)).cast("bigint").alias("total_processed"))
