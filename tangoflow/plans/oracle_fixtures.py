"""The learner tables of ``tangoflow.sources.fixtures`` written as DuckDB SQL.

Each entry is a CTE body over the pre-registered views (events, part,
customer, conversations, documents, ...).  ``with_fixtures(sql, *names)``
prefixes the needed CTEs in dependency order.  The replay here is the plain
window form (one partition per key) — an independent formulation of the
bucketed scan used on Spark.
"""

from __future__ import annotations

from tangoflow.sources.fixtures import ERROR_RULES

TODAY = "DATE '2024-01-30'"

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

_INTERVAL = """LEAST(CASE WHEN {r} >= 0.9 THEN 7 WHEN {r} >= 0.7 THEN 3 WHEN {r} >= 0.5 THEN 2 ELSE 1 END
      * (1 + {s} // 2), 30)"""


def interval_sql(rate: str, streak: str) -> str:
    return "CAST(" + _INTERVAL.format(r=f"COALESCE({rate}, 0.0)", s=f"COALESCE({streak}, 0)") + " AS INTEGER)"


FIX: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}


def _def(name: str, body: str, deps: tuple[str, ...] = ()):
    FIX[name] = body
    DEPS[name] = deps


_def("reviews", f"""
SELECT user_id, 'w' || CAST({_K} % 20 AS VARCHAR) AS word, CAST({_K} % 20 AS INTEGER) AS wn,
       ts AS reviewed_at, event_id AS seq, event_type <> 'error' AS correct
FROM events""")

_def("replay0", """
SELECT *, n - COALESCE(MAX(CASE WHEN NOT correct THEN n END) OVER (
            PARTITION BY user_id, word ORDER BY reviewed_at, seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak0
FROM (SELECT user_id, word, wn, reviewed_at, seq, COALESCE(correct, false) AS correct,
             ROW_NUMBER() OVER w AS n,
             SUM(CASE WHEN COALESCE(correct, false) THEN 1 ELSE 0 END) OVER w AS ok
      FROM reviews
      WINDOW w AS (PARTITION BY user_id, word ORDER BY reviewed_at, seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", ("reviews",))

_def("replay", f"""
SELECT user_id, word, wn, seq, reviewed_at, correct,
       CAST(n AS BIGINT) AS review_no, CAST(ok AS BIGINT) AS correct_count,
       CAST(ok AS DOUBLE) / n AS success_rate, CAST(streak0 AS INTEGER) AS streak,
       {interval_sql('CAST(ok AS DOUBLE) / n', 'streak0')} AS interval_days,
       CAST(reviewed_at AS DATE) + {interval_sql('CAST(ok AS DOUBLE) / n', 'streak0')} AS next_review
FROM replay0""", ("replay0",))

_def("word_state", """
SELECT user_id, word, wn, review_no AS review_count, correct_count, success_rate, streak, interval_days,
       first_reviewed, CAST(reviewed_at AS DATE) AS last_reviewed, next_review
FROM (SELECT *, MIN(CAST(reviewed_at AS DATE)) OVER (PARTITION BY user_id, word) AS first_reviewed,
             ROW_NUMBER() OVER (PARTITION BY user_id, word ORDER BY reviewed_at DESC, seq DESC) AS rk
      FROM replay) WHERE rk = 1""", ("replay",))

_def("words", """
SELECT s.user_id, s.word AS japanese, p.p_name AS english, s.first_reviewed AS added_date,
       0 AS practice_count, s.last_reviewed,
       CASE (s.user_id + s.wn) % 10
            WHEN 0 THEN NULL WHEN 1 THEN 'bad'
            WHEN 2 THEN CAST(year(s.next_review) AS VARCHAR) || '-' || CAST(month(s.next_review) AS VARCHAR)
                        || '-' || CAST(day(s.next_review) AS VARCHAR)
            ELSE strftime(s.next_review, '%Y-%m-%d') END AS next_review,
       s.review_count, s.correct_count, s.success_rate, s.streak, s.wn
FROM word_state s LEFT JOIN part p ON p.p_partkey = s.wn
UNION ALL
SELECT u.user_id, n.japanese, n.english, DATE '2024-01-01', 0, CAST(NULL AS DATE), '2024-02-15',
       CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0, 0, CAST(NULL AS INTEGER)
FROM (SELECT DISTINCT user_id FROM reviews) u,
     (VALUES ('new1', 'new word one'), ('new2', 'new word two')) n(japanese, english)""", ("word_state",))

_def("chats", f"""
SELECT e.user_id, e.event_id AS conv_id, 'ask ' || CAST(e.k AS VARCHAR) AS user_message,
       CASE WHEN e.k % 3 = 0 THEN p.p_name || ' [' || p.p_brand || '] (' || p.p_type || ')'
            ELSE 'no vocabulary' END AS ai_response,
       strftime(e.ts, '%Y-%m-%d %H:%M') AS timestamp,
       CASE WHEN e.event_type IN ('click', 'error') THEN 'Beginner' WHEN e.event_type = 'view' THEN 'Intermediate'
            WHEN e.event_type = 'purchase' THEN 'Advanced' END AS level,
       CASE WHEN e.k % 10 <> 9 THEN 'topic' || CAST(e.k % 6 AS VARCHAR) END AS topic,
       date_trunc('second', e.ts) AS created_at
FROM (SELECT event_id, ts, user_id, event_type, {_K} AS k FROM events) e
LEFT JOIN part p ON p.p_partkey = e.k""")

_def("settings_kv", """
SELECT c_custkey AS user_id, 'preferred_level' AS setting_key, 'Advanced' AS setting_value
FROM customer WHERE c_custkey % 3 <> 0
UNION ALL
SELECT c_custkey, 'daily_goal', CAST(c_custkey % 9 + 1 AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0
UNION ALL
SELECT c_custkey, 'favorite_topics', '["topic1"]' FROM customer WHERE c_custkey % 5 = 0""")

_def("answers", """
SELECT r.user_id, r.word, r.seq, r.reviewed_at AS answered_at,
       CASE r.seq % 4 WHEN 0 THEN p.p_name WHEN 1 THEN '  ' || upper(p.p_name) || ' '
                      WHEN 2 THEN 'wrong' ELSE '   ' END AS answer
FROM reviews r LEFT JOIN part p ON p.p_partkey = r.wn""", ("reviews",))

_def("loss_log", f"""
SELECT user_id % 5 AS run, CAST(1 + floor((day(ts) - 1) / 10) AS INTEGER) AS epoch,
       CASE WHEN {_K} % 5 = 0 THEN 'val' ELSE 'train' END AS phase,
       event_id AS step, value AS loss
FROM events""")

_def("turns", "SELECT conv_id, turn, role, text FROM conversations")

_def("sentences", """
SELECT doc_id, lang, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS pos, unnest(l) AS sentence
FROM (SELECT doc_id, lang, regexp_extract_all(text, '[^.!?\\n]+[.!?]?') AS l FROM documents)""")

_def("rules", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{lang}', '{kind}', '{right}', '{wrong}', {'CAST(NULL AS INTEGER)' if level is None else level})"
    for i, (lang, kind, right, wrong, level) in enumerate(ERROR_RULES))
    + ") t(rule_no, lang, error_type, right_form, wrong_form, level)")


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_fixtures(sql: str, *names: str, extra: dict | None = None, once: tuple[str, ...] = ()) -> str:
    """Prefix the named fixture CTEs (and their dependencies), then any extra
    CTEs (name -> body, in order) to ``sql``; those in ``once`` are
    materialised."""
    ctes = [f"{n} AS ({FIX[n]}\n)" for n in _order(names)]
    ctes += [f"{n} AS {'MATERIALIZED ' if n in once else ''}({b}\n)" for n, b in (extra or {}).items()]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def word_state_ctes(src: str, suffix: str) -> dict:
    """replay0/replay/word_state over another reviews-shaped CTE ``src``; CTE
    names get ``suffix``."""
    out = {}
    for name in ("replay0", "replay", "word_state"):
        body = FIX[name]
        body = body.replace("FROM reviews", f"FROM {src}").replace("FROM replay0", f"FROM replay0{suffix}")
        body = body.replace("FROM replay)", f"FROM replay{suffix})")
        out[name + suffix] = body
    return out
