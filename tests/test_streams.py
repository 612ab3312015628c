"""Streams that stop and start again, late uses, ranges by the minute, bounded buffers."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docops.functions import telemetry as t
from docops.streaming import errors, ranges
from docops.streaming import telemetry as st

ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
STATUS = {"200": "2xx", "404": "4xx", "500": "5xx", "302": "other", None: "other"}
PATHS = {"/api/merge": "merge", " /API/split/x": "split", "/viewer": None}


def requests(n, seed, span):
    """(event_id, user_id, ts, kind, path, status, message, tool, ok) over so many minutes, in order of time."""
    r = random.Random(seed)
    times = sorted(ZERO + dt.timedelta(seconds=r.randrange(60 * span)) for _ in range(n))
    return [(i, 1, at, r.choice(["request", "request", "job"]), r.choice(list(PATHS)), r.choice(list(STATUS)), r.choice([None, "", "m" * 300]), None, None) for i, at in enumerate(times)]


def write(spark, rows, path):
    spark.createDataFrame(rows, st.EVENTS).write.mode("append").parquet(path)


def read(spark, path, **options):
    return spark.readStream.schema(st.EVENTS).options(**options).parquet(path)


def trailing(rows, minutes, slide):
    """Every whole-minute range that holds a request, event by event."""
    out = Counter()
    for _, _, ts, kind, path, status, *_ in rows:
        if kind == "request":
            m = int(ts.timestamp()) // 60
            out.update((u, STATUS[status], PATHS[path]) for u in range(m + 1, m + minutes + 1) if u % slide == 0)
    return out


@pytest.mark.parametrize("token, slide", [("15m", 1), ("1h", 7), ("24h", 1), ("24h", 60)])
def test_trailing_sums(spark, token, slide):
    rows = requests(150, 4, 5000)
    events = spark.createDataFrame(rows, st.EVENTS).where("kind = 'request'")
    buckets = events.groupBy(F.expr("unix_timestamp(ts) div 60").alias("minute"), t.status_class(F.col("status")).alias("status_class"), t.tool_of(F.col("path")).alias("tool")).agg(F.count("*").alias("n"))
    got = ranges.trailing_sums(buckets, t.range_minutes(token), slide).collect()
    assert len(got) == len({r[:3] for r in got})
    assert {(r.until, r.status_class, r.tool): r.n for r in got} == trailing(rows, t.range_minutes(token), slide)


def test_ranges_of_a_stream_that_starts_again(spark, tmp_path):
    """Three starts, late events among the later ones; each start goes on with what the last one knew."""
    rows = requests(400, 5, 300)
    late = [rows[i] for i in range(0, 300, 10)]
    parts = [[x for x in rows[:200] if x not in late], [x for x in rows[200:] if x not in late], late]
    for k, part in enumerate(parts):
        write(spark, part, f"{tmp_path}/in")
        out = ranges.run_ranges(read(spark, f"{tmp_path}/in"), f"{tmp_path}/work", "1h")
        if k == 0:
            first = {(int(r.until.replace(tzinfo=dt.timezone.utc).timestamp()) // 60, r.status_class, r.tool): r.n for r in out.collect()}
            assert first == trailing(parts[0], 60, 1)
    got = {(int(r.until.replace(tzinfo=dt.timezone.utc).timestamp()) // 60, r.status_class, r.tool): r.n for r in out.collect()}
    assert got == trailing(rows, 60, 1)
    kept = [x for x in os.listdir(f"{tmp_path}/work") if x.startswith("buckets-")]
    assert len(kept) <= 2  # older tables of buckets are gone


def test_buckets_are_bounded(spark, tmp_path):
    """After a day only the last hours' buckets are held."""
    for day in range(3):
        rows = [(i, 1, ZERO + dt.timedelta(days=day, minutes=i), "request", "/api/merge", "200", None, None, None) for i in range(100)]
        write(spark, rows, f"{tmp_path}/in")
        ranges.run_ranges(read(spark, f"{tmp_path}/in"), f"{tmp_path}/work", "15m", keep="2 hours")
    last = max((x for x in os.listdir(f"{tmp_path}/work") if x.startswith("buckets-")), key=lambda x: int(x[8:]))
    assert 0 < spark.read.parquet(f"{tmp_path}/work/{last}").count() <= 136


def test_no_requests(spark, tmp_path):
    write(spark, [(1, 1, ZERO, "job", "/x", "200", None, None, None)], f"{tmp_path}/in")
    assert ranges.run_ranges(read(spark, f"{tmp_path}/in"), f"{tmp_path}/work", "1h").collect() == []


def wanted_errors(rows, n):
    bad = [r for r in rows if r[3] == "request" and r[5] in ("404", "500")]
    return [(r[0], r[4], int(r[5]), (r[6] or "")[:200] or None) for r in sorted(bad, key=lambda r: (r[2], r[0]), reverse=True)[:n]]


def test_error_buffer_after_a_restart(spark, tmp_path):
    """Stopped in mid-stream and started again, with repeated and late events: the same n errors, and no files pile up."""
    rows = requests(300, 6, 60)
    for k, part in enumerate([rows[100:200], rows[150:], rows[:120]]):
        write(spark, part, f"{tmp_path}/in")
        out = errors.run_error_buffer(read(spark, f"{tmp_path}/in", maxFilesPerTrigger=3), f"{tmp_path}/work", 10)
        done = {0: rows[100:200], 1: rows[100:], 2: rows}[k]
        assert [(r.event_id, r.path, r.code, r.message) for r in out.collect()] == wanted_errors(done, 10)
        shards = [x for x in os.listdir(f"{tmp_path}/work/buffer") if x.startswith("shard=")]
        files = [f for s in shards for f in os.listdir(f"{tmp_path}/work/buffer/{s}") if f.startswith("part-")]
        assert len(shards) <= 16 and len(files) <= 2 * len(shards)
    assert spark.conf.get(errors.PROVIDER) != errors.ROCKS


def test_no_errors(spark, tmp_path):
    write(spark, [(1, 1, ZERO, "request", "/x", "200", None, None, None)], f"{tmp_path}/in")
    assert errors.run_error_buffer(read(spark, f"{tmp_path}/in"), f"{tmp_path}/work").collect() == []


def test_sessions_with_their_files(spark, tmp_path):
    """A later use sets the timer back and changes the file; an earlier one that comes late does neither."""
    at = lambda seconds: ZERO + dt.timedelta(seconds=seconds)
    inventory = spark.createDataFrame([(10, "in/10.pdf"), (11, "in/11.pdf"), (12, "in/12.pdf")], "file_id long, path string")
    starts = [
        [(1, 10, at(0)), (2, 11, at(100)), (3, 99, at(50)), (4, None, at(60))],
        [(2, 12, at(3000)), (2, 10, at(2000)), (5, 10, at(3100)), (5, 11, at(3100))],
        [(6, 10, at(3700))],  # 1, 3 and 4 are over; 2 is in use since
        [(7, 10, at(6600))],  # exactly 3,600 seconds after session 2's last use
        [(8, 10, at(6700))],
        [(9, 10, at(9000))],
    ]
    seen = []
    for rows in starts:
        spark.createDataFrame(rows, "session_id long, file_id long, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
        out = st.purged_files(st.expired_sessions(spark.readStream.schema("session_id long, file_id long, ts timestamp").parquet(f"{tmp_path}/in")), inventory)
        st.run(out, f"{tmp_path}/work", lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), "append")
        got = {(r.session_id, r.file_id, r.path) for r in spark.read.schema("session_id long, file_id long, path string").parquet(f"{tmp_path}/out/*").collect()}
        seen.append(got)
    assert seen[0] == seen[1] == set()
    assert seen[2] == {(1, 10, "in/10.pdf"), (3, 99, None), (4, None, None)} == seen[3]
    assert seen[4] == seen[2] | {(2, 12, "in/12.pdf")}
    assert seen[5] == seen[4] | {(5, 11, "in/11.pdf"), (6, 10, "in/10.pdf")}


@pytest.mark.parametrize("together", [True, False])
def test_a_session_used_after_it_expired(spark, tmp_path, together):
    """Two rows, whether both uses come in one batch or not; a use at exactly the ttl goes on with the session, one without a time is none."""
    at = lambda seconds: None if seconds is None else ZERO + dt.timedelta(seconds=seconds)
    uses = [(1, 10, 0), (1, 11, 5000), (2, 12, 0), (2, 13, 3600), (3, 14, None), (4, 15, 8601)]
    seen = "session_id long, file_id long, ts timestamp"
    for rows in [uses, [(9, 19, 9000)]] if together else [*([u] for u in sorted(uses[:4], key=lambda u: u[2])), uses[4:], [(9, 19, 9000)]]:
        spark.createDataFrame([(i, f, at(s)) for i, f, s in rows], seen).write.mode("append").parquet(f"{tmp_path}/in")
        out = st.expired_sessions(spark.readStream.schema(seen).parquet(f"{tmp_path}/in"))
        st.run(out, f"{tmp_path}/work", lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), "append")
    got = [(r.session_id, r.file_id) for r in spark.read.schema(seen).parquet(f"{tmp_path}/out/*").collect()]
    assert sorted(got) == [(1, 10), (1, 11), (2, 13)]
    # the stream keeps sessions in Spark's own state, without a call of Python for each
    assert "Python" not in out._jdf.queryExecution().analyzed().toString() and "Pandas" not in out._jdf.queryExecution().analyzed().toString()
