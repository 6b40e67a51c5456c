"""The driver's correctness gate, in the test suite: Spark query vs its
DuckDB oracle SQL on sf0.001 (one query per area; tools/check_oracle.py runs
all of them)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E
from check_oracle import TABLES, rows_of

from data_dirs import SF_SMALL

SAMPLE = ["review_replay", "word_state", "due_words", "review_stats", "practice_day_streak", "recent_chats",
          "daily_by_level", "extract_vocab", "grade_answers", "load_settings", "upsert_words", "inject_errors",
          "train_val_split", "running_loss", "read_backups", "stream_daily_counts"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows, s_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(E.oracle_sql()[name])
    d_rows, d_cols = rows_of([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows) and s_rows == d_rows
