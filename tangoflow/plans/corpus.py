"""Registered queries: sentence-pair corpus and model-input preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tangoflow import params as P
from tangoflow.operators import corpus as cp, trainprep as tp
from tangoflow.params import DEFAULT
from tangoflow.plans.oracle_fixtures import with_fixtures
from tangoflow.plans.registry import query
from tangoflow.session import scratch_path
from tangoflow.sources import corpus_seed as seed, fixtures as fx

VOCAB_SIZE = 2000


def _q(s):
    return "'" + str(s).replace("'", "''") + "'"


def _lit_rows(rows, source):
    vals = ", ".join(f"({_q(source + '#' + str(i))}, {_q(a)}, {_q(b)}, {_q(c)}, {_q(source)}, {int(d)})"
                     for i, (a, b, c, d) in enumerate(rows))
    return f"SELECT * FROM (VALUES {vals}) t(pair_id, incorrect_text, correct_text, error_type, source, difficulty_level)"


def _jlpt_rows():
    m = dict(P.PROFICIENCY_DIFFICULTY)
    vals = ", ".join(f"({_q('jlpt#' + str(i))}, {_q(a)}, {_q(b)}, {_q(c)}, {_q('jlpt_' + lv)}, "
                     f"{m.get(lv, P.PROFICIENCY_UNKNOWN)})" for i, (a, b, c, lv) in enumerate(seed.PROFICIENCY_PAIRS))
    return f"SELECT * FROM (VALUES {vals}) t(pair_id, incorrect_text, correct_text, error_type, source, difficulty_level)"


def _list(xs):
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _template_sql(draws=P.TEMPLATE_DRAWS):
    vals = {}
    for name, opts in seed.SLOTS.items():
        h = (f"('0x' || substr(md5(concat_ws('|', '42', CAST(ti AS VARCHAR), CAST(d AS VARCHAR), {_q(name)})), 1, 8))"
             f"::BIGINT % {len(opts)}")
        vals[name] = f"list_extract({_list(opts)}, CAST({h} + 1 AS INTEGER))"

    def fill(expr):
        for name, v in vals.items():
            expr = f"replace({expr}, {_q('{' + name + '}')}, {v})"
        return expr

    ok = f"list_extract({_list([t[0] for t in seed.TEMPLATES])}, CAST(ti + 1 AS INTEGER))"
    bad = f"list_extract({_list([t[1] for t in seed.TEMPLATES])}, CAST(ti + 1 AS INTEGER))"
    types = f"list_extract({_list([t[2] for t in seed.TEMPLATES])}, CAST(ti + 1 AS INTEGER))"
    return (f"SELECT concat_ws('#', 'synthetic', ti, d) AS pair_id, {fill(bad)} AS incorrect_text, "
            f"{fill(ok)} AS correct_text, {types} AS error_type, 'synthetic' AS source, 2 AS difficulty_level "
            f"FROM (SELECT range // {draws} AS ti, range % {draws} AS d FROM range({len(seed.TEMPLATES) * draws}))")


_CORPUS = {
    "injected": "SELECT concat_ws('#', 'injected', s.doc_id, s.pos, r.rule_no) AS pair_id, "
                "replace(s.sentence, r.right_form, r.wrong_form) AS incorrect_text, s.sentence AS correct_text, "
                "r.error_type, 'injected' AS source, r.level AS difficulty_level "
                "FROM sentences s JOIN rules r ON r.lang = s.lang AND contains(s.sentence, r.right_form)",
    "raw": f"{_lit_rows(seed.EXPERT_PAIRS, 'expert_curated')} UNION ALL {_template_sql()} UNION ALL "
           f"{_lit_rows(seed.LEARNER_PAIRS, 'lang8_style')} UNION ALL {_jlpt_rows()} UNION ALL "
           "SELECT * FROM injected",
    "processed": "SELECT pair_id, 'grammar: ' || incorrect_text AS input_text, correct_text AS target_text, "
                 "error_type AS error_category, CASE WHEN difficulty_level <= 2 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END "
                 "AS confidence_score FROM raw",
}


def _raw(spark, sf_dir):
    return cp.union_sources(spark, fx.sentences(spark, sf_dir), fx.ERROR_RULES, DEFAULT)


def _processed(spark, sf_dir):
    return cp.format_pairs(_raw(spark, sf_dir))


def _corpus_sql(sql, *extra_fixtures, extra=None, once=()):
    return with_fixtures(sql, "sentences", "rules", *extra_fixtures, extra={**_CORPUS, **(extra or {})}, once=once)


_RAW_COLS = ", ".join(cp.RAW_COLS)


@query("inject_errors", _corpus_sql(f"SELECT {_RAW_COLS} FROM injected"))
def q_inject_errors(spark, sf_dir):
    return cp.inject_errors(fx.sentences(spark, sf_dir), fx.ERROR_RULES)


@query("union_sources", _corpus_sql(f"SELECT {_RAW_COLS} FROM raw"))
def q_union_sources(spark, sf_dir):
    return _raw(spark, sf_dir)


@query("identity_pairs", _corpus_sql(
    "SELECT pair_id, source, incorrect_text = correct_text AS is_identity FROM raw"))
def q_identity_pairs(spark, sf_dir):
    return cp.identity_pairs(_raw(spark, sf_dir)).select("pair_id", "source", "is_identity")


_PROC_COLS = "pair_id, input_text, target_text, error_category, confidence_score"


@query("format_pairs", _corpus_sql(f"SELECT {_PROC_COLS} FROM processed"))
def q_format_pairs(spark, sf_dir):
    return _processed(spark, sf_dir)


@query("pair_corpus", _corpus_sql(
    "SELECT pair_id, input_text, target_text, error_category, confidence_score AS confidence FROM processed"))
def q_pair_corpus(spark, sf_dir):
    """Collect → format → export, rebuilt deterministically on every run
    (overwrite, never append), then read back from the export."""
    path = tp.export_pairs_json(_processed(spark, sf_dir), scratch_path(spark, "pairs-json"))
    return spark.read.schema(tp.PAIR_JSON).json(path).select(
        "pair_id", "input_text", "target_text", "error_category", "confidence")


@query("export_pairs_json", _corpus_sql(
    "SELECT input_text, target_text, error_category, confidence_score AS confidence FROM processed"))
def q_export_pairs_json(spark, sf_dir):
    path = tp.export_pairs_json(_processed(spark, sf_dir), scratch_path(spark, "pairs-export"))
    return spark.read.schema(tp.PAIR_JSON).json(path).select("input_text", "target_text", "error_category",
                                                             "confidence")


@query("load_pairs_json", _corpus_sql(
    "SELECT pair_id, input_text, target_text, COALESCE(error_category, 'unknown') AS error_category FROM processed"))
def q_load_pairs_json(spark, sf_dir):
    path = tp.export_pairs_json(_processed(spark, sf_dir), scratch_path(spark, "pairs-load"))
    return tp.load_pairs_json(spark, path)


@query("error_type_distribution", _corpus_sql("SELECT error_type, count(*) AS count FROM raw GROUP BY ALL"))
def q_error_type_distribution(spark, sf_dir):
    return cp.error_type_distribution(_raw(spark, sf_dir))


@query("difficulty_distribution", _corpus_sql(
    "SELECT difficulty_level, count(*) AS count FROM raw GROUP BY ALL"))
def q_difficulty_distribution(spark, sf_dir):
    return cp.difficulty_distribution(_raw(spark, sf_dir))


@query("training_totals", _corpus_sql(
    "SELECT (SELECT count(*) FROM raw) AS total_raw, (SELECT count(*) FROM processed) AS total_processed"))
def q_training_totals(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return cp.training_totals(raw, cp.format_pairs(raw))


@query("sample_pairs", _corpus_sql(f"SELECT {_PROC_COLS} FROM processed ORDER BY pair_id LIMIT 3"))
def q_sample_pairs(spark, sf_dir):
    return tp.sample_pairs(_processed(spark, sf_dir), 3)


_MD5 = "md5(concat_ws('|', '42', pair_id))"


@query("train_val_split", _corpus_sql(
    "SELECT pair_id, CASE WHEN rk <= ceil(0.2 * n) THEN 'val' ELSE 'train' END AS split FROM ("
    f"SELECT pair_id, row_number() OVER (ORDER BY {_MD5}, pair_id) AS rk, count(*) OVER () AS n FROM processed)"))
def q_train_val_split(spark, sf_dir):
    return tp.train_val_split(_processed(spark, sf_dir)).select("pair_id", "split")


_TOK = tp.TOKEN_PATTERN.replace("'", "''")
_VOCAB = {
    "tok": f"SELECT unnest(regexp_extract_all(lower(input_text), '{_TOK}')) AS token FROM processed UNION ALL "
           f"SELECT unnest(regexp_extract_all(lower(target_text), '{_TOK}')) FROM processed",
    "vocab": "SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) AS INTEGER) AS id, count FROM ("
             f"SELECT token, count(*) AS count FROM tok GROUP BY token ORDER BY count DESC, token LIMIT {VOCAB_SIZE})",
}


@query("fit_vocab", _corpus_sql("SELECT token, id, count FROM vocab", extra=_VOCAB))
def q_fit_vocab(spark, sf_dir):
    return tp.fit_vocab(_processed(spark, sf_dir), VOCAB_SIZE)


_ENC = {
    **_VOCAB,
    "etok": f"SELECT pair_id, 'src' AS side, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token FROM "
            f"(SELECT pair_id, regexp_extract_all(lower(input_text), '{_TOK}') AS t FROM processed) UNION ALL "
            f"SELECT pair_id, 'tgt', unnest(generate_series(0, len(t) - 1)), unnest(t) FROM "
            f"(SELECT pair_id, regexp_extract_all(lower(target_text), '{_TOK}') AS t FROM processed)",
    "eids": f"SELECT pair_id, side, list(COALESCE(v.id, {VOCAB_SIZE + 1}) ORDER BY pos) AS ids FROM etok "
            "LEFT JOIN vocab v USING (token) WHERE pos < 128 GROUP BY ALL",
}


@query("encode_pairs", _corpus_sql(
    "SELECT p.pair_id, array_to_string(list_resize(COALESCE(s.ids, []), 128, 0), ' ') AS input_ids, "
    "array_to_string(list_resize(list_resize([]::INTEGER[], len(COALESCE(s.ids, [])), 1), 128, 0), ' ') AS attention_mask, "
    "array_to_string(list_resize(COALESCE(t.ids, []), 128, -100), ' ') AS labels "
    "FROM processed p LEFT JOIN eids s ON s.pair_id = p.pair_id AND s.side = 'src' "
    "LEFT JOIN eids t ON t.pair_id = p.pair_id AND t.side = 'tgt'", extra=_ENC,
    once=("processed", "tok", "vocab", "etok", "eids")))
def q_encode_pairs(spark, sf_dir):
    proc = _processed(spark, sf_dir)
    enc = tp.encode_pairs(proc, tp.fit_vocab(proc, VOCAB_SIZE), VOCAB_SIZE)
    return enc.select("pair_id", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "attention_mask", "labels")])


SHARD_ROWS = 4096


@query("assign_batches", _corpus_sql(
    f"SELECT pair_id, CAST((rn - 1) // {SHARD_ROWS} AS INTEGER) AS shard, "
    f"CAST(((rn - 1) % {SHARD_ROWS}) // 2 AS INTEGER) AS batch_no, "
    f"CAST(((rn - 1) % {SHARD_ROWS}) % 2 AS INTEGER) AS pos_in_batch "
    f"FROM (SELECT pair_id, row_number() OVER (ORDER BY {_MD5}, pair_id) AS rn FROM processed)"))
def q_assign_batches(spark, sf_dir):
    return tp.assign_batches(_processed(spark, sf_dir), P.TRAIN_BATCH, SHARD_ROWS).select(
        "pair_id", "shard", "batch_no", "pos_in_batch")


_MICRO = "CAST(round(loss * 1000000) AS BIGINT)"


def _mean_sql(s, n):
    return f"CAST(({s} * 2000 + {n}) // (2 * {n}) AS DOUBLE) / 1000000000.0"


@query("epoch_loss", with_fixtures(
    f"SELECT run, epoch, phase, {_mean_sql('CAST(sum(' + _MICRO + ') AS BIGINT)', 'count(*)')} AS mean_loss, "
    "count(*) AS batches FROM loss_log GROUP BY ALL", "loss_log"))
def q_epoch_loss(spark, sf_dir):
    return tp.epoch_loss(fx.loss_log(spark, sf_dir))


@query("best_epoch", with_fixtures(
    "SELECT run, arg_min(epoch, (mean_loss, epoch)) AS best_epoch, min(mean_loss) AS best_val_loss FROM ("
    f"SELECT run, epoch, {_mean_sql('CAST(sum(' + _MICRO + ') AS BIGINT)', 'count(*)')} AS mean_loss "
    "FROM loss_log WHERE phase = 'val' GROUP BY ALL) GROUP BY run", "loss_log"))
def q_best_epoch(spark, sf_dir):
    return tp.best_epoch(fx.loss_log(spark, sf_dir))


@query("running_loss", with_fixtures(
    f"SELECT run, epoch, phase, step, loss, {_mean_sql('s', 'n')} AS running_loss FROM ("
    f"SELECT *, CAST(sum({_MICRO}) OVER w AS BIGINT) AS s, count(*) OVER w AS n FROM loss_log "
    "WINDOW w AS (PARTITION BY run, epoch, phase ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "loss_log"))
def q_running_loss(spark, sf_dir):
    return tp.running_loss(fx.loss_log(spark, sf_dir), chunk_steps=1000)
