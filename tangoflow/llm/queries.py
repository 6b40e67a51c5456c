"""The registered queries of the training-data operators, one per operator,
over whole tables; ``ORACLE`` holds the DuckDB twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangoflow.llm import bagminhash, hard_negatives, kd_shards, merkle, mixing, packing, pii, preference, rule_ensemble, rule_ledger, secrets, vector_dedup, warc
from tangoflow.llm.common import materialise, span_digest, table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return deco


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT
    >> (5 * (3 - k % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest FROM h),
f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM d GROUP BY ALL)
SELECT page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
FROM d JOIN f ON f.payload_digest = d.payload_digest AND f.payload_bytes = d.payload_bytes
"""


@query("op1_warc", WARC_SQL)
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"), "verified")


@query("op2_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    found = found.withColumn("n_found", F.size("spans").cast("long"))  # base and discovered
    return span_digest(found, ["doc_id", "n_found"], pii.KINDS)


@query("op3_mix_sources")
def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


VECTOR_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, len(v) AS dim, sqrt(list_inner_product(v, v)) AS norm FROM e WHERE label IS NOT NULL
  AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op4_near_vectors", VECTOR_SQL)
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_bagminhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


@query("op6_pack_tokens")
def pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_rule_ensemble")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


PREFERENCE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 1 THEN 'rejected' ELSE 'chosen' END AS side,
  coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT pair_id, turn, role, text, bool_or(side = 'chosen') AS l, bool_or(side = 'rejected') AS r FROM t GROUP BY ALL),
p AS (SELECT pair_id, min(CASE WHEN NOT (l AND r) THEN turn END) AS first,
  bool_or(l) AND bool_or(r) AND pair_id IS NOT NULL AS paired FROM s GROUP BY pair_id),
j AS (SELECT t.*, paired, (first IS NULL OR turn < first) AND paired AS prompt
  FROM t JOIN p ON t.pair_id IS NOT DISTINCT FROM p.pair_id)
SELECT pair_id, CASE WHEN prompt THEN 'prompt' ELSE side END AS part, nullif(turn, 9223372036854775807) AS turn, role,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
  NOT prompt AND role = 'assistant' AS loss, paired
FROM j WHERE NOT prompt OR side = 'chosen'
"""


@query("op8_preference_format", PREFERENCE_SQL)
def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_turns(preference.neighbours(table(spark, sf_dir, "conversations")))


@query("op9_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = materialise(secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"]), "secret-spans")
    return secrets.digest(secrets.judge(scanned, secrets.train(scanned)))


LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper, len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts
  FROM b LEFT JOIN p ON p.doc_id = b.doc_id),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
  + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_upper > word_chars)::BIGINT
  + 16 * (10 * n_shouts > 3 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
  + 64 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
  fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM f
"""


@query("op10_rule_ledger", LEDGER_SQL)
def rule_ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rule_ledger.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
                      rule_ledger.fails(rule_ledger.BASE_POLICY).alias("base_failed"),
                      (~rule_ledger.fails(rule_ledger.FULL_POLICY)).alias("kept"))


NEGATIVES_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other, e.label = a.label AS same, list_inner_product(a.z, e.z)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id AND len(a.z) = len(e.z) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negative_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, label=label)


@query("op12_kd_shards")
def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: the shards are near equal in bytes."""
    put = kd_shards.shards(table(spark, sf_dir, "documents"))
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _merkle_sql(levels: int = 5, top_levels: int = 3) -> str:
    """Trees of up to 16 ** levels rows a source and 16 ** top_levels sources."""
    enc = lambda *cols: "sha256(" + " || ".join(
        f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in cols) + ")"
    crc = ("xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384::UBIGINT * (r & 1)))), 4294967295::UBIGINT)")
    plain = enc("doc_id", "source", "lang", "n_chars", "text")
    low = enc("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    ctes = [f"d AS (SELECT doc_id, source, coalesce('1' || source, '0') AS t, {plain} AS leaf, "
            f"CASE WHEN {crc} % 5 = 0 THEN {low} END AS bad FROM documents)",
            "p0 AS (SELECT doc_id, t, leaf, coalesce(bad, leaf) AS f, '' AS s, "
            "row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
            "a0 AS (SELECT t, i, leaf AS h, count(*) OVER (PARTITION BY t) AS m FROM p0)"]

    def climb(name: str, rows: str, n: int) -> None:
        """name0 has the nodes (t, i, h, m), rows0 the paths so far (t, i, f, s, ...)."""
        for k in range(n):
            ctes.append(f"{name}r{k} AS (SELECT t, i // 16 AS i, string_agg(h, '' ORDER BY i) AS run, any_value(m) AS m FROM {name}{k} GROUP BY ALL)")
            ctes.append(f"{name}{k + 1} AS (SELECT t, i, CASE WHEN m > 1 THEN sha256(run) ELSE run END AS h, (m + 15) // 16 AS m FROM {name}r{k})")
            left, right = "substr(run, 1, 64 * (x.i % 16))", "substr(run, 65 + 64 * (x.i % 16))"
            ctes.append(f"{rows}{k + 1} AS (SELECT x.* REPLACE (x.i // 16 AS i, CASE WHEN m > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, "
                        f"CASE WHEN m > 1 THEN s || {left} || {right} ELSE s END AS s) FROM {rows}{k} x JOIN {name}r{k} r "
                        f"ON r.t = x.t AND r.i = x.i // 16)")

    climb("a", "p", levels)
    ctes += [f"b0 AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, h, count(*) OVER () AS m, t AS sub FROM a{levels})",
             f"q0 AS (SELECT doc_id, '' AS t, leaf, f, s, b0.i AS i, b0.h AS subroot FROM p{levels} p JOIN b0 ON b0.sub = p.t)"]
    climb("b", "q", top_levels)
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, z.h AS root, sha256(s) AS proof_sha256, f AS folded_root, "
            f"f = z.h AS verified FROM q{top_levels}, b{top_levels} z")


@query("op13_merkle_manifest", _merkle_sql())
def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_proofs(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
