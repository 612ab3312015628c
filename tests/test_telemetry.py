"""Literal cases: a fixed clock, exact counters, order and limits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docops.functions import telemetry as t
from docops.operators import telemetry as op
from docops.sources import readers

NOW = "2026-07-23 15:30:00"


def events(spark):
    now = dt.datetime(2026, 7, 23, 15, 30)
    at = lambda m: now - dt.timedelta(minutes=m)
    rows = [
        (1, at(16), "request", "/api/merge", "200", None, None, None),
        (2, at(5), "request", "/api/merge", "200", None, None, None),
        (3, at(4), "request", "/api/merge", "404", "gone", None, None),
        (4, at(3), "request", "/api/split", "500", "", None, None),
        (5, None, "request", "/api/split", "200", None, None, None),
        (6, now + dt.timedelta(seconds=1), "request", "/api/split", "200", None, None, None),
    ]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, path string, status string, message string, tool string, ok boolean")


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_range(spark):
    e = events(spark)
    assert op.totals(e, "15m", NOW).collect()[0] == (3, 0)
    assert pairs(op.by_status(e, "15m", NOW)) == {"2xx": 1, "4xx": 1, "5xx": 1}
    assert pairs(op.by_tool_outcome(e, None, NOW)) == {"merge_ok": 1, "merge_err": 1, "split_err": 1}
    minutes = op.requests_per_minute(e, "15m", NOW).collect()
    assert len(minutes) == 15 and sum(r.n for r in minutes) == 3
    assert op.requests_per_minute(e, "24h", NOW).count() == 1440


def test_range_tokens():
    assert [t.range_minutes(x) for x in (None, "", "15m", "1h", "24h")] == [15, 15, 15, 60, 1440]
    with pytest.raises(ValueError):
        t.range_minutes("7d")


def test_errors_newest_first_and_messages(spark):
    rows = op.recent_errors(events(spark), "15m", NOW).collect()
    assert [(r.event_id, r.message) for r in rows] == [(4, None), (3, "gone")]


def test_empty(spark):
    none = events(spark).limit(0)
    assert op.trend_summary(op.requests_per_minute(none, "15m", NOW)).collect() == []
    assert op.status_shares(op.by_status(none, "15m", NOW)).collect()[0].success_rate == 0.0
    assert '"requests":0' in op.snapshot(none, "15m", NOW).collect()[0].snapshot


def test_times(spark):
    raw = ["2026-07-23T15:30:00Z", "2026-07-23 15:30:00", "1784820600", "1784820600.5", "12:30", "2026", "soon", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(F.date_format(t.norm_ts(F.col("x")), "yyyy-MM-dd HH:mm:ss")).collect()]
    # a year alone is a number of seconds, not a date
    assert got == ["2026-07-23 15:30:00"] * 4 + [None, "1970-01-01 00:33:46", None, None, None]


def test_feedback_limits(spark):
    rows = spark.createDataFrame([(i, "home", "duvida", f"message {i}", f"req-{i}") for i in range(120)], "arrival int, page string, type string, message string, request_id string")
    got = op.latest_feedback(rows, 999).collect()
    assert len(got) == 100 and got[0].request_id == "req-119" and got[-1].request_id == "req-20"
    assert op.latest_feedback(rows, 0).count() == 1


def test_feedback_lines(spark):
    good = '{"ts":"t","page":"p","type":"duvida","message":"hello there","request_id":"req-%d"}'
    lines = spark.createDataFrame([(0, good % 1), (1, ""), (2, "xx"), (3, "[1]"), (4, "null"), (5, good % 2)], "arrival int, value string")
    assert [r.request_id for r in op.latest_feedback(readers.parse_feedback(lines)).collect()] == ["req-2", "req-1"]


def test_validation(spark):
    cases = [("outro", "long enough", "type"), (" Duvida ", "  ", "missing"), ("duvida", "oi", "short"), ("duvida", "x" * 2001, "long"), ("problema", " a\tb \x00 c d ", None), (None, None, "type")]
    rows = spark.createDataFrame([(i, None, k, m, "r") for i, (k, m, _) in enumerate(cases)], "arrival int, page string, type string, message string, request_id string")
    got = {r.arrival: r for r in op.validate_feedback(rows).collect()}
    assert [got[i].reject_reason for i in range(len(cases))] == [c[2] for c in cases]
    assert got[4].message == "a b c d" and got[4].page == "desconhecida"


def test_logs(spark):
    lines = spark.createDataFrame([(0, "2026 | INFO  | m:f:1 | req=1 | a | b"), (1, "short"), (2, "x | ERROR | m | r | boom")], "arrival int, value string")
    logs = readers.parse_logs(lines)
    assert [tuple(r)[1:] for r in logs.orderBy("arrival").collect()][:2] == [("2026", "INFO", "m:f:1", "req=1", "a | b"), ("short", "", "", "", "")]
    assert op.log_tail(logs, 1, "info").count() == 0  # the tail comes first, then the level
    with pytest.raises(ValueError):
        op.log_tail(logs, 1, "loud")
