"""Streaming queries: the events as a stream, processed to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import telemetry as st
from ..streaming.errors import run_error_buffer
from ..streaming.ranges import run_ranges
from .fixtures import query
from .telemetry import CLASS, TOOL, VALID, stamp


def stream(load, folder):
    """The stand-in events, written as files and read as a stream in several batches."""
    events = load("request_events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.select(*[c.split()[0] for c in st.EVENTS.split(", ")]).repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    return events.sparkSession.readStream.schema(st.EVENTS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


def counts(load, name, make, keys):
    folder = st.work_folder(load("events").sparkSession, name)
    return st.run_counts(make(stream(load, folder)), folder, keys)


def trailing(load, name, token, slide):
    folder = st.work_folder(load("events").sparkSession, name)
    return run_ranges(stream(load, folder), folder, token, slide, "60 days").select(stamp("until", "until"), "status_class", "tool", "n")


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, CAST(count(*) AS BIGINT) AS n FROM request_events WHERE kind = 'request' GROUP BY 1", "request_events")
def st1_minute_counts(load):
    # files come in no order of time: the watermark is wide enough that none is late
    return counts(load, "st1", lambda s: st.minute_counts(s, "60 days"), ["minute"]).select(stamp("minute", "minute"), "n")


@query(f"""w AS (SELECT unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS until, status, path FROM request_events WHERE kind = 'request')
    SELECT strftime(until, '%Y-%m-%d %H:%M:%S') AS until, {CLASS} AS status_class, {TOOL} AS tool, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL""", "request_events")
def st2_range_counts(load):
    return trailing(load, "st2", "24h", 60)


@query(f"""w AS (SELECT unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 60 MINUTE, INTERVAL 1 MINUTE)) AS until, status, path FROM request_events WHERE kind = 'request')
    SELECT strftime(until, '%Y-%m-%d %H:%M:%S') AS until, {CLASS} AS status_class, {TOOL} AS tool, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL""", "request_events")
def st2_ranges_by_minute(load):
    return trailing(load, "st2m", "1h", 1)


# The events come in three batches.  The first moves the watermark, which holds for late events from the third on: of that
# one, events in minutes that ended 24 hours before the first batch's last event are late.
@query("""e AS (SELECT date_trunc('minute', ts) AS minute, event_id % 3 = 0 AS third FROM request_events WHERE kind = 'request'), w AS (SELECT max(ts) - INTERVAL 24 HOUR AS mark FROM request_events WHERE kind = 'request' AND event_id % 3 = 1)
    SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, CAST(count(*) AS BIGINT) AS n FROM e, w WHERE NOT third OR minute + INTERVAL 1 MINUTE > mark GROUP BY 1""", "request_events")
def st3_retention(load):
    events = load("request_events").withColumn("ts", F.col("ts").cast("timestamp"))
    spark = events.sparkSession
    folder = st.work_folder(spark, "st3")
    rows = events.select(*[c.split()[0] for c in st.EVENTS.split(", ")])
    for part in (1, 2, 0):  # files are read in the order they are written
        rows.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(st.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return st.run_counts(st.minute_counts(source), folder, ["minute"]).select(stamp("minute", "minute"), "n")


@query("SELECT event_id, path, CAST(status AS INT) AS code FROM request_events WHERE kind = 'request' AND status IN ('404', '500') ORDER BY ts DESC, event_id DESC LIMIT 100", "request_events")
def st4_error_buffer(load):
    spark = load("events").sparkSession
    folder = st.work_folder(spark, "st4")
    return run_error_buffer(stream(load, folder), folder).select("event_id", "path", "code")


@query(f"{VALID} SELECT arrival, type, page, message, reject_reason FROM w", "feedback")
def st9_ingest_feedback(load):
    spark = load("events").sparkSession
    folder = st.work_folder(spark, "st9")
    rows = load("feedback")
    rows.write.parquet(f"{folder}/in")
    st.ingest_feedback(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/good", f"{folder}/rejected", f"{folder}/checkpoint").awaitTermination()
    cols = ["arrival", "type", "page", "message"]
    good = spark.read.parquet(f"{folder}/good").select(*cols, F.lit(None).cast("string").alias("reject_reason"))
    return good.unionByName(spark.read.parquet(f"{folder}/rejected").select(*cols, "reject_reason"))


def expired(load, folder, each):
    """The expired sessions, worked on by ``each`` and read back.

    The earlier half of the uses is there when the stream starts first, the other when it starts again.
    """
    used = load("sessions").select("session_id", "file_id", F.col("ts").cast("timestamp").alias("ts"))
    spark, half = used.sparkSession, used.agg(F.timestamp_seconds(F.avg(F.unix_timestamp("ts")))).scalar()
    for part in (used.where(F.col("ts") < half), used.where(F.col("ts") >= half)):
        part.write.mode("append").parquet(f"{folder}/in")
        out = each(st.expired_sessions(spark.readStream.schema("session_id long, file_id long, ts timestamp").parquet(f"{folder}/in")))
        st.run(out, folder, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), "append")
    return spark.read.schema("session_id long, file_id long, path string").parquet(f"{folder}/out/*")


@query("m AS (SELECT max(ts) AS m FROM sessions) SELECT session_id FROM sessions, m WHERE epoch_ms(ts) + 3600000 < epoch_ms(m)", "sessions")
def st6_stream_expired_sessions(load):
    spark = load("events").sparkSession
    folder = st.work_folder(spark, "st6")
    return expired(load, folder, lambda out: out).select("session_id")


@query("""m AS (SELECT max(ts) AS m FROM sessions), x AS (SELECT session_id, file_id FROM sessions, m WHERE epoch_ms(ts) + 3600000 < epoch_ms(m))
    SELECT session_id, x.file_id, path FROM x LEFT JOIN file_inventory USING (file_id)""", "sessions file_inventory")
def st6_purged_files(load):
    folder = st.work_folder(load("events").sparkSession, "st6f")
    return expired(load, folder, lambda out: st.purged_files(out, load("file_inventory"))).select("session_id", "file_id", "path")
