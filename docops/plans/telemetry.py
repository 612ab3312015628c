"""Telemetry, feedback and log queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import telemetry as t
from ..functions.governance import sniff_type
from ..operators import telemetry as op
from ..sources import readers
from ..sources.checkpoints import shared_folder
from ..sources.log_tail import read_log_tail
from ..streaming import telemetry as st
from .fixtures import NOW, query

RANGE = f"(SELECT * FROM request_events WHERE ts >= date_trunc('minute', TIMESTAMP '{NOW}') - INTERVAL 1439 MINUTE AND ts <= TIMESTAMP '{NOW}')"
CODE = "coalesce(TRY_CAST(trim(status) AS INT), 0)"
CLASS = f"CASE WHEN {CODE} BETWEEN 200 AND 299 THEN '2xx' WHEN {CODE} BETWEEN 400 AND 499 THEN '4xx' WHEN {CODE} >= 500 THEN '5xx' ELSE 'other' END"
PATH = "lower(trim(path))"
TOOL = "CASE " + " ".join(f"WHEN starts_with({PATH}, '{p}') THEN '{n}'" for p, n in t.TOOL_PREFIXES) + " END"
BOTH = f"CASE WHEN kind = 'request' THEN {TOOL} ELSE nullif(lower(trim(tool)), '') END"
OK = f"CASE WHEN kind = 'request' THEN {CODE} < 400 ELSE coalesce(ok, false) END"
OUTCOME = f"SELECT concat({BOTH}, CASE WHEN {OK} THEN '_ok' ELSE '_err' END) AS outcome, CAST(count(*) AS BIGINT) AS n FROM {RANGE} r WHERE {BOTH} IS NOT NULL GROUP BY 1"
STATUS = f"SELECT {CLASS} AS status_class, CAST(count(*) AS BIGINT) AS n FROM {RANGE} r WHERE kind = 'request' GROUP BY 1"
SPINE = f"SELECT unnest(generate_series(date_trunc('minute', TIMESTAMP '{NOW}') - INTERVAL 1439 MINUTE, date_trunc('minute', TIMESTAMP '{NOW}'), INTERVAL 1 MINUTE)) AS minute"
MINUTES = f"SELECT s.minute, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM ({SPINE}) s LEFT JOIN (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM {RANGE} r WHERE kind = 'request' GROUP BY 1) c USING (minute)"
CLEAN = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '[\x00-\x1f\x7f\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g'))"


def stamp(c, name):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(f"SELECT event_id, user_id, kind, path, status, message, tool, ok, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM request_events", "request_events")
def s4_read_events(load):
    rows = load("request_events")
    path = f"{shared_folder(rows.sparkSession)}/events-{uuid.uuid4().hex}"
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return readers.read_events(rows.sparkSession, path).select("event_id", "user_id", "kind", "path", "status", "message", "tool", "ok", stamp("ts", "at"))


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM request_events GROUP BY kind", "request_events")
def s4_stream_events(load):
    """The same events as a stream, counted by kind."""
    rows = load("request_events")
    folder = st.work_folder(rows.sparkSession, "s4")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    counts = readers.stream_events(rows.sparkSession, f"{folder}/in").groupBy("kind").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return rows.sparkSession.read.parquet(st.run(counts, folder, mode="complete")).select("kind", "n", stamp("last", "last"))


@query(f"SELECT event_id, {CLASS} AS status_class, {CODE} AS code FROM request_events", "request_events")
def p1_status_class(load):
    s = F.col("status")
    return load("request_events").select("event_id", t.status_class(s).alias("status_class"), t.status_code(s).alias("code"))


@query(f"SELECT event_id, {TOOL} AS tool FROM request_events", "request_events")
def p2_tool_of(load):
    return load("request_events").select("event_id", t.tool_of(F.col("path")).alias("tool"))


@query(f"SELECT event_id, nullif(lower(trim(coalesce({TOOL}, split_part(split_part(concat(event_type, '_', CAST(user_id AS STRING)), '_', 1), '-', 1)))), '') AS tool FROM (SELECT r.*, event_type FROM request_events r JOIN events USING (event_id)) x", "request_events")
def p3_job_tool(load):
    df = load("request_events").join(load("events").select("event_id", "event_type"), "event_id")
    return df.select("event_id", t.job_tool(F.col("path"), F.concat("event_type", F.lit("_"), F.col("user_id").cast("string"))).alias("tool"))


@query(f"SELECT event_id, concat({BOTH}, CASE WHEN {OK} THEN '_ok' ELSE '_err' END) AS outcome FROM request_events WHERE {BOTH} IS NOT NULL", "request_events")
def p4_outcome_key(load):
    df = load("request_events")
    request = F.col("kind") == "request"
    tool = F.when(request, t.tool_of(F.col("path"))).otherwise(F.nullif(F.lower(F.trim("tool")), F.lit("")))
    ok = F.when(request, t.status_code(F.col("status")) < 400).otherwise(F.coalesce("ok", F.lit(False)))
    return df.select("event_id", t.outcome_key(tool, ok).alias("outcome")).where("outcome IS NOT NULL")


RAW_TS = """CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN CAST(CAST(epoch(ts) AS BIGINT) AS STRING)
    WHEN 3 THEN '12:30' WHEN 4 THEN 'soon' ELSE '' END"""


@query("SELECT event_id, CASE WHEN event_id % 6 <= 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def p5_norm_ts(load):
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 6
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.unix_timestamp(ts).cast("string")).when(k == 3, "12:30").when(k == 4, "soon").otherwise("")
    return load("events").select("event_id", stamp(t.norm_ts(raw), "at"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 1440 WHEN 3 THEN 15 WHEN 4 THEN 15 END AS minutes, event_id % 7 > 4 AS error FROM events")
def p6_minutes_of_range(load):
    k = F.col("event_id") % 7
    token = F.when(k == 0, "15m").when(k == 1, " 1H ").when(k == 2, "24h").when(k == 3, " ").when(k == 5, "7d").when(k == 6, "15")
    return load("events").select("event_id", t.minutes_of_range(token).alias("minutes")).withColumn("error", F.col("minutes").isNull())


@query(f"SELECT event_id FROM {RANGE} r", "request_events")
def p7_in_range(load):
    return op.in_range(load("request_events"), "24h", NOW).select("event_id")


@query("SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, strftime(ts, '%H:%M') AS hhmm, strftime(ts, '%H:%M:%S') AS hhmmss FROM events")
def p8_time_labels(load):
    ts = F.col("ts").cast("timestamp")
    return load("events").select("event_id", stamp(t.minute_of(ts), "minute"), t.hhmm(ts).alias("hhmm"), t.hhmmss(ts).alias("hhmmss"))


@query("SELECT conv_id, turn, nullif(substr(text, 1, 200), '') AS message FROM conversations")
def p9_short_message(load):
    return load("conversations").select("conv_id", "turn", t.short_message(F.col("text")).alias("message"))


LOGS = """logs AS (SELECT event_id AS arrival, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'WARNING' END AS level,
    concat('mod:fn:', CAST(user_id AS STRING)) AS place, concat('req=', CAST(event_id AS STRING)) AS request, concat(props, ' | ', event_type) AS message FROM events)"""


def log_lines(load):
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "INFO").when(F.col("event_type") == "click", "DEBUG").otherwise("WARNING")
    line = F.concat_ws(" | ", ts, F.rpad(level, 5, " "), F.concat(F.lit("mod:fn:"), F.col("user_id")), F.concat(F.lit("req="), F.col("event_id")), "props", "event_type")
    return load("events").select(F.col("event_id").alias("arrival"), F.when(F.col("event_id") % 50 == 7, "cut short").otherwise(line).alias("value"))


CUT = "CASE WHEN arrival % 50 = 7 THEN {} ELSE {} END AS {}"
PARSED = "SELECT arrival, " + ", ".join(CUT.format("'cut short'" if c == "ts" else "''", ("trim(substr(rpad(level, 5, ' '), 1, 5))" if c == "level" else c), c) for c in ("ts", "level", "place", "request", "message")) + " FROM logs"


@query(f"WITH {LOGS} {PARSED}")
def s3_read_logs(load):
    return readers.parse_logs(log_lines(load))


@query(f"WITH {LOGS}, p AS ({PARSED}), tail AS (SELECT * FROM p ORDER BY arrival DESC LIMIT 400) SELECT * FROM tail")
def l4_log_tail(load):
    return op.log_tail(readers.parse_logs(log_lines(load)))


@query(f"WITH {LOGS}, p AS ({PARSED}), tail AS (SELECT * FROM p ORDER BY arrival DESC LIMIT 700) SELECT ts, level, place, request, message, CAST(row_number() OVER (ORDER BY arrival) AS INT) AS place_in_tail FROM tail")
def l4_log_tail_of_file(load):
    """The lines written to files and the tail read from their ends: it comes in the files' order."""
    lines = log_lines(load)
    path = f"{shared_folder(lines.sparkSession)}/log-{uuid.uuid4().hex}"
    lines.orderBy("arrival").select("value").write.text(path)  # files in the order of their names
    tail = op.log_tail(readers.parse_logs(read_log_tail(lines.sparkSession, path, 700, "name")), 700)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("arrival"))  # at most 5,000 rows
    return tail.withColumn("place_in_tail", place).drop("arrival")


@query(f"WITH {LOGS}, p AS ({PARSED}), tail AS (SELECT * FROM p ORDER BY arrival DESC LIMIT 400) SELECT * FROM tail WHERE level = 'ERROR'")
def p10_filter_level(load):
    return op.log_tail(readers.parse_logs(log_lines(load)), level="error")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/api/edit/file/<edit_session_id>' WHEN 1 THEN '/api/edit/page-image/<edit_session_id>/3' WHEN 2 THEN concat('/api/edit/file/', md5(CAST(event_id AS STRING)), 'a') ELSE concat('/viewer/', md5(CAST(event_id AS STRING))) END AS path FROM events")
def p11_mask_session_path(load):
    h, k = F.md5(F.col("event_id").cast("string").cast("binary")), F.col("event_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/api/edit/file/"), h)).when(k == 1, F.concat(F.lit("/api/edit/page-image/"), h, F.lit("/3"))).when(k == 2, F.concat(F.lit("/api/edit/file/"), h, F.lit("a"))).otherwise(F.concat(F.lit("/viewer/"), h))
    return load("events").select("event_id", t.mask_session_path(path).alias("path"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '<upload>.pdf' WHEN 1 THEN '-sOutputFile=<flat>.pdf' WHEN 2 THEN '<ghostscript>' WHEN 3 THEN '-dNOPAUSE' ELSE '/data/report.pdf' END AS argument FROM events")
def p12_mask_temp_path(load):
    n, k = F.col("event_id"), F.col("event_id") % 5
    argument = F.when(k == 0, F.concat(F.lit("/tmp/upload_"), n, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("-sOutputFile=/x/flat_"), n, F.lit(".pdf"))).when(k == 2, "/usr/bin/gs").when(k == 3, "-dNOPAUSE").otherwise("/data/report.pdf")
    return load("events").select("event_id", t.mask_temp_path(argument).alias("argument"))


@query(f"SELECT CAST(count(*) FILTER (kind = 'request') AS BIGINT) AS requests, CAST(count(*) FILTER (kind = 'job') AS BIGINT) AS jobs FROM {RANGE} r", "request_events")
def a1_totals(load):
    return op.totals(load("request_events"), "24h", NOW)


@query(STATUS, "request_events")
def a2_by_status(load):
    return op.by_status(load("request_events"), "24h", NOW)


@query(OUTCOME, "request_events")
def a3_by_tool_outcome(load):
    return op.by_tool_outcome(load("request_events"), "24h", NOW)


@query(f"""x AS (SELECT CASE WHEN kind = 'request' THEN 'requests_total' ELSE 'jobs_total' END AS counter FROM request_events
    UNION ALL SELECT concat('status:', {CLASS}) FROM request_events WHERE kind = 'request'
    UNION ALL SELECT concat({BOTH}, CASE WHEN {OK} THEN '_ok' ELSE '_err' END) FROM request_events WHERE {BOTH} IS NOT NULL
    UNION ALL SELECT concat('endpoint:', {TOOL}) FROM request_events WHERE kind = 'request' AND {TOOL} IS NOT NULL)
    SELECT counter, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY counter""", "request_events")
def a4_lifetime_counters(load):
    return op.lifetime_counters(load("request_events"))


@query(f"SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, n FROM ({MINUTES}) m", "request_events")
def a5_requests_per_minute(load):
    return op.requests_per_minute(load("request_events"), "24h", NOW).select(stamp("minute", "minute"), "n")


@query(f"SELECT strftime(s.minute, '%Y-%m-%d %H:%M:%S') AS minute, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM ({SPINE}) s LEFT JOIN (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM request_events GROUP BY 1) c USING (minute)", "request_events")
def j2_fill_minutes(load):
    counts = load("request_events").groupBy(t.minute_of(F.col("ts").cast("timestamp")).alias("minute")).agg(F.count("*").alias("n"))
    return op.fill_minutes(counts, "24h", NOW).select(stamp("minute", "minute"), "n")


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM file_inventory", "file_inventory")
def a6_folder_usage(load):
    return op.folder_usage(load("file_inventory"))


@query(f"""s AS ({STATUS}), x AS (SELECT CAST(coalesce(sum(n) FILTER (status_class = '2xx'), 0) AS BIGINT) AS ok, CAST(coalesce(sum(n) FILTER (status_class = '4xx'), 0) AS BIGINT) AS client, CAST(coalesce(sum(n) FILTER (status_class = '5xx'), 0) AS BIGINT) AS server FROM s)
    SELECT ok + client + server AS total, coalesce(100.0::DOUBLE * ok / nullif(ok + client + server, 0), 0) AS share_2xx, coalesce(100.0::DOUBLE * client / nullif(ok + client + server, 0), 0) AS share_4xx, coalesce(100.0::DOUBLE * server / nullif(ok + client + server, 0), 0) AS share_5xx, coalesce(100.0::DOUBLE * ok / nullif(ok + client + server, 0), 0) AS success_rate FROM x""", "request_events")
def a7_status_shares(load):
    return op.status_shares(op.by_status(load("request_events"), "24h", NOW))


@query(f"""o AS ({OUTCOME}), x AS (SELECT regexp_replace(outcome, '_(ok|err)$', '') AS tool, CAST(coalesce(sum(n) FILTER (NOT ends_with(outcome, '_err')), 0) AS BIGINT) AS ok, CAST(coalesce(sum(n) FILTER (ends_with(outcome, '_err')), 0) AS BIGINT) AS errors FROM o GROUP BY 1)
    SELECT tool, ok, errors, ok + errors AS total, CAST(floor(100.0::DOUBLE * ok / (ok + errors) + 0.5) AS BIGINT) AS rate FROM x WHERE ok + errors > 0""", "request_events")
def a8_tool_success(load):
    return op.tool_success(op.by_tool_outcome(load("request_events"), "24h", NOW))


@query(f"m AS ({MINUTES}) SELECT CAST(count(*) AS BIGINT) AS points, greatest(max(n), 1) AS peak, strftime(min(minute), '%H:%M') AS first_label, strftime(max(minute), '%H:%M') AS last_label FROM m HAVING sum(n) > 0", "request_events")
def a9_trend_summary(load):
    return op.trend_summary(op.requests_per_minute(load("request_events"), "24h", NOW))


@query("j AS (SELECT CASE file_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'split' ELSE 'convert' END AS action, length, file_id FROM file_inventory) SELECT action, CAST(sum(length) AS BIGINT) AS bytes_in, CAST(sum(CAST(floor(length / 2) AS BIGINT)) AS BIGINT) AS bytes_out, CAST(sum(1 + file_id % 4) AS BIGINT) AS files_out, CAST(count(*) AS BIGINT) AS jobs FROM j GROUP BY action", "file_inventory")
def a31_batch_totals(load):
    k = F.col("file_id") % 3
    jobs = load("file_inventory").select(F.when(k == 0, "merge").when(k == 1, "split").otherwise("convert").alias("action"), F.col("length").alias("bytes_in"), F.floor(F.col("length") / 2).alias("bytes_out"), (1 + F.col("file_id") % 4).alias("files_out"))
    return op.batch_totals(jobs)


@query(f"SELECT event_id, strftime(ts, '%H:%M:%S') AS at, path, {CODE} AS code, nullif(substr(message, 1, 200), '') AS message FROM {RANGE} r WHERE kind = 'request' AND {CODE} >= 400 ORDER BY ts DESC, event_id LIMIT 5", "request_events")
def l1_recent_errors(load):
    return op.recent_errors(load("request_events"), "24h", NOW)


@query(f"SELECT event_id, path, {CODE} AS code, nullif(substr(message, 1, 200), '') AS message FROM request_events WHERE kind = 'request' AND {CODE} >= 400 ORDER BY ts DESC, event_id DESC LIMIT 100", "request_events")
def l2_error_buffer(load):
    return op.error_buffer(load("request_events"))


@query(f"SELECT event_id, {TOOL} AS tool FROM request_events", "request_events")
def j1_join_tool_prefix(load):
    events = load("request_events")
    prefixes = events.sparkSession.createDataFrame([(i, p, n) for i, (p, n) in enumerate(t.TOOL_PREFIXES)], "ord int, prefix string, tool string")
    return op.join_tool_prefix(events, prefixes)


@query("x AS (SELECT user_id % 5 AS client, lower(trim(path)) AS endpoint, date_trunc('day', ts) AS minute, count(*) AS n FROM request_events WHERE kind = 'request' GROUP BY 1, 2, 3) SELECT CAST(client AS BIGINT) AS client, endpoint, strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, CAST(n AS BIGINT) AS n, CASE endpoint WHEN '/api/merge' THEN 12 WHEN '/viewer/raw' THEN 8 ELSE 10 END AS quota FROM x WHERE n > CASE endpoint WHEN '/api/merge' THEN 12 WHEN '/viewer/raw' THEN 8 ELSE 10 END", "request_events")
def st8_quota_violations(load):
    # events a day stand in for events a minute, which are too few here to break a quota
    events = load("request_events").withColumn("user_id", F.col("user_id") % 5).withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp")))
    limits = events.sparkSession.createDataFrame([("/api/merge", 12), ("/viewer/raw", 8)], "endpoint string, quota int")
    return op.quota_violations(events, limits).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm:ss"))


@query(f"""t AS (SELECT count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'job') AS jobs FROM {RANGE} r),
    e AS (SELECT strftime(ts, '%H:%M:%S') AS at, path, {CODE} AS code, nullif(substr(message, 1, 200), '') AS message, ts, event_id FROM {RANGE} r WHERE kind = 'request' AND {CODE} >= 400 ORDER BY ts DESC, event_id LIMIT 5)
    SELECT CAST(to_json({{'requests': requests, 'jobs': jobs, 'by_status': (SELECT list({{'key': status_class, 'n': n}} ORDER BY status_class) FROM ({STATUS}) s), 'by_outcome': (SELECT list({{'key': outcome, 'n': n}} ORDER BY outcome) FROM ({OUTCOME}) o),
    'series': (SELECT list({{'ts': strftime(minute, '%H:%M'), 'count': n}} ORDER BY minute) FROM ({MINUTES}) m), 'errors': (SELECT list({{'at': e."at", 'path': path, 'code': code, 'message': message}} ORDER BY ts DESC, event_id) FROM e)}}) AS VARCHAR) AS snapshot FROM t""", "request_events")
def s10_snapshot_json(load):
    return op.snapshot(load("request_events"), "24h", NOW)


@query(f"SELECT event_id, (ts IS NULL OR ts > TIMESTAMP '{NOW}') AS dropped FROM request_events", "request_events")
def st5_split_bad_events(load):
    good, bad = op.split_bad_events(load("request_events"), NOW)
    return good.select("event_id", F.lit(False).alias("dropped")).unionByName(bad.select("event_id", F.lit(True).alias("dropped")))


# feedback

VALID = f"""v AS (SELECT arrival, request_id, lower({CLEAN('type')}) AS type, substr(coalesce(nullif({CLEAN('page')}, ''), 'desconhecida'), 1, 80) AS page, {CLEAN('message')} AS message FROM feedback),
    w AS (SELECT *, CASE WHEN type NOT IN ('problema', 'sugestao', 'duvida') THEN 'type' WHEN message = '' THEN 'missing' WHEN length(message) < 5 THEN 'short' WHEN length(message) > 2000 THEN 'long' END AS reject_reason FROM v)"""
PUBLIC = f"""p AS (SELECT arrival, '' AS timestamp, substr({CLEAN('page')}, 1, 80) AS page, substr({CLEAN('type')}, 1, 32) AS type, substr({CLEAN('message')}, 1, 2000) AS message, '' AS app_version, substr({CLEAN('request_id')}, 1, 64) AS request_id FROM feedback),
    q AS (SELECT * FROM p WHERE type IN ('problema', 'sugestao', 'duvida') AND message <> '')"""


@query(f"SELECT conv_id, turn, {CLEAN('text')} AS text FROM conversations")
def p31_clean_text(load):
    return load("conversations").select("conv_id", "turn", t.clean_text(F.col("text")).alias("text"))


@query(f"{VALID} SELECT * FROM w", "feedback")
def p32_validate_feedback(load):
    return op.validate_feedback(load("feedback"))


@query(f"{PUBLIC} SELECT * FROM q", "feedback")
def p52_public_feedback(load):
    return op.public_feedback(load("feedback"))


@query(f"{PUBLIC} SELECT * FROM q ORDER BY arrival DESC LIMIT 50", "feedback")
def l3_latest_feedback(load):
    return op.latest_feedback(load("feedback"))


@query(f"{PUBLIC} SELECT page, type, message, request_id FROM q ORDER BY arrival DESC LIMIT 100", "feedback")
def l3_latest_feedback_of_file(load):
    """The records written to files in their order and read back: the last ones are the newest."""
    rows = load("feedback")
    path = f"{shared_folder(rows.sparkSession)}/feedback-{uuid.uuid4().hex}"
    readers.write_feedback(rows.orderBy("arrival").select("page", "type", "message", "request_id"), path)
    return op.latest_feedback(readers.read_feedback(rows.sparkSession, path, "name"), 1000).select("page", "type", "message", "request_id")


@query("SELECT arrival, page, type, message, request_id FROM feedback WHERE arrival % 7 > 2", "feedback")
def s1_read_feedback(load):
    k = F.col("arrival") % 7
    line = F.to_json(F.struct("page", "type", "message", "request_id"))
    lines = load("feedback").select("arrival", F.when(k == 0, "").when(k == 1, "not json").when(k == 2, "[1]").otherwise(line).alias("value"))
    return readers.parse_feedback(lines).select("arrival", "page", "type", "message", "request_id")


@query("SELECT page, type, message, request_id FROM feedback", "feedback")
def s2_write_feedback(load):
    rows = load("feedback")
    path = f"{shared_folder(rows.sparkSession)}/feedback-{uuid.uuid4().hex}"
    half = F.col("arrival") % 2 == 0
    for part in (rows.where(half), rows.where(~half)):  # the second is appended
        readers.write_feedback(part.select("page", "type", "message", "request_id"), path)
    return readers.read_feedback(rows.sparkSession, path).select("page", "type", "message", "request_id")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'corrigido' ELSE 'adicionado' END AS tag, concat('Pedido ', CAST(o_orderkey AS STRING)) AS title, CASE WHEN o_orderkey % 5 > 0 THEN concat('a \"b\" ', o_orderstatus) END AS desc FROM orders WHERE o_custkey % 10 > 0")
def s11_parse_updates(load):
    """A change feed a customer, every third a bare list, every tenth no JSON."""
    k = F.col("o_orderkey")
    item = F.struct(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("date"), F.when(k % 2 == 0, "corrigido").otherwise("adicionado").alias("tag"), F.concat(F.lit("Pedido "), k).alias("title"), F.when(k % 5 > 0, F.concat(F.lit('a "b" '), "o_orderstatus")).alias("desc"))
    feeds = load("orders").groupBy("o_custkey").agg(F.collect_list(item).alias("recent"))
    text = F.when(F.col("o_custkey") % 10 == 0, "[{").when(F.col("o_custkey") % 3 == 0, F.to_json("recent")).otherwise(F.to_json(F.struct("recent")))
    return readers.parse_updates(feeds.select(text.alias("value")))


@query()
def s6_read_documents(load):
    """The tables' own files as documents; a type needs a file's header only."""
    files = load("events").inputFiles()
    return readers.read_headers(load("events").sparkSession, files[0].rsplit("/", 1)[0]).select("path", "length", sniff_type(F.col("header")).alias("type"))


@query("SELECT conv_id, turn, lower(trim(role)) IN ('1', 'true', 'yes', 'on') OR turn % 2 = 0 AS flag FROM conversations")
def p51_to_bool(load):
    raw = F.when(F.col("turn") % 4 == 0, " TRUE ").when(F.col("turn") % 4 == 2, "on").otherwise(F.col("role"))
    return load("conversations").select("conv_id", "turn", t.to_bool(raw).alias("flag"))
