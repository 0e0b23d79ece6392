"""The session store: keys that share a state, and the timers of their sessions."""

import duckdb
import pytest

from curalake.catalog import ORACLE_SQL, QUERIES
from curalake.streaming import sessions

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_keys_share_states(spark, monkeypatch, buckets):
    """Answers and sweeps are those of SQL, however many keys share a state."""
    monkeypatch.setattr(sessions, "BUCKETS", buckets)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
        expected = con.execute(ORACLE_SQL["session_store"]).fetchall()
    got = QUERIES["session_store"](spark, SF).select("key", "pos", "at", "answer", "revision").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_calls_do_not_grow_with_keys(spark):
    """Python is called for buckets: the stream is grouped by them, not by keys."""
    stream = spark.readStream.format("rate").load().selectExpr("value AS user_id", "timestamp AS ts", "value AS event_id", "value AS base")
    with sessions.state_in_rocksdb(spark):
        plan = sessions.stored_sessions(stream, "user_id", "ts", "event_id", "base", 1000, "0 seconds")._jdf.queryExecution().analyzed().toString()
    grouped = next(line for line in plan.splitlines() if "TransformWithState" in line)
    assert "bucket" in grouped
