"""Service health from request and job events, feedback and logs.

``now`` is always an argument, so results can be repeated.  Ranges are whole minutes: N minutes end with the one of now.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import telemetry as t


def _bounds(token: str | None, now: str):
    end = F.lit(now).cast("timestamp")
    return F.date_trunc("minute", end) - F.expr(f"INTERVAL {t.range_minutes(token) - 1} MINUTES"), end


def in_range(events: DataFrame, token: str | None, now: str) -> DataFrame:
    """Events from the range's first minute up to now; rows without a time or of the future go."""
    start, end = _bounds(token, now)
    ts = F.col("ts").cast("timestamp")
    return events.where((ts >= start) & (ts <= end))


def split_bad_events(events: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(good, dropped): dropped have no time or one after now."""
    bad = F.col("ts").isNull() | (F.col("ts").cast("timestamp") > F.lit(now).cast("timestamp"))
    return events.where(~bad), events.where(bad)


def totals(events: DataFrame, token: str | None, now: str) -> DataFrame:
    return in_range(events, token, now).agg(F.count_if(F.col("kind") == "request").alias("requests"), F.count_if(F.col("kind") == "job").alias("jobs"))


def by_status(events: DataFrame, token: str | None, now: str) -> DataFrame:
    return in_range(events, token, now).where("kind = 'request'").groupBy(t.status_class(F.col("status")).alias("status_class")).agg(F.count("*").alias("n"))


def outcomes(events: DataFrame) -> DataFrame:
    """(tool, ok) of every event that has a tool: a request's by its path and code, a job's by its own fields."""
    request = F.col("kind") == "request"
    tool = F.when(request, t.tool_of(F.col("path"))).otherwise(F.nullif(F.lower(F.trim("tool")), F.lit("")))
    ok = F.when(request, t.status_code(F.col("status")) < 400).otherwise(F.coalesce(F.col("ok"), F.lit(False)))
    return events.select(tool.alias("tool"), ok.alias("ok")).where("tool IS NOT NULL")


def by_tool_outcome(events: DataFrame, token: str | None, now: str) -> DataFrame:
    out = outcomes(in_range(events, token, now))
    return out.groupBy(t.outcome_key(F.col("tool"), F.col("ok")).alias("outcome")).agg(F.count("*").alias("n"))


def lifetime_counters(events: DataFrame) -> DataFrame:
    """All counters ever: totals, status classes, outcomes, endpoints, by name."""
    request = F.col("kind") == "request"
    tool = F.when(request, t.tool_of(F.col("path"))).otherwise(F.nullif(F.lower(F.trim("tool")), F.lit("")))
    ok = F.when(request, t.status_code(F.col("status")) < 400).otherwise(F.coalesce(F.col("ok"), F.lit(False)))
    names = F.array(
        F.when(request, F.lit("requests_total")).otherwise(F.lit("jobs_total")),
        F.when(request, F.concat(F.lit("status:"), t.status_class(F.col("status")))),
        F.when(tool.isNotNull(), t.outcome_key(tool, ok)),
        F.when(request & tool.isNotNull(), F.concat(F.lit("endpoint:"), tool)),
    )
    return events.select(F.explode(F.array_compact(names)).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def requests_per_minute(events: DataFrame, token: str | None, now: str) -> DataFrame:
    """(minute, n) for every minute of the range, 0 where there is none: counted first, then joined to the spine."""
    counts = in_range(events, token, now).where("kind = 'request'").groupBy(t.minute_of(F.col("ts").cast("timestamp")).alias("minute")).agg(F.count("*").alias("n"))
    return fill_minutes(counts, token, now)


def fill_minutes(counts: DataFrame, token: str | None, now: str) -> DataFrame:
    start, end = _bounds(token, now)
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(start, F.date_trunc("minute", end), F.expr("INTERVAL 1 MINUTE"))).alias("minute"))
    return spine.join(counts, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def status_shares(counts: DataFrame) -> DataFrame:
    """Shares of 2xx, 4xx, 5xx and the success rate in percent, without ``other``; 0 where nothing is counted."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col("status_class") == c, F.col("n"))), F.lit(0))
    sums = counts.agg(of("2xx").alias("ok"), of("4xx").alias("client"), of("5xx").alias("server"))
    total = F.col("ok") + F.col("client") + F.col("server")
    share = lambda c: F.coalesce(100.0 * F.col(c) / F.nullif(total, F.lit(0)), F.lit(0.0))
    return sums.select(total.alias("total"), share("ok").alias("share_2xx"), share("client").alias("share_4xx"), share("server").alias("share_5xx"), F.least(F.greatest(share("ok"), F.lit(0.0)), F.lit(100.0)).alias("success_rate"))


def tool_success(outcomes_: DataFrame) -> DataFrame:
    """ok, errors, total and rate (half up) by tool, from outcome counts."""
    err = F.col("outcome").endswith("_err")
    tool = F.regexp_replace("outcome", "_(ok|err)$", "")
    sums = outcomes_.groupBy(tool.alias("tool")).agg(F.sum(F.when(~err, F.col("n")).otherwise(0)).alias("ok"), F.sum(F.when(err, F.col("n")).otherwise(0)).alias("errors"))
    total = F.col("ok") + F.col("errors")
    return sums.where(total > 0).select("tool", "ok", "errors", total.alias("total"), F.floor(100.0 * F.col("ok") / total + 0.5).cast("long").alias("rate"))


def trend_summary(minutes: DataFrame) -> DataFrame:
    """Points, peak (1 at least), first and last label; no row when every minute is 0."""
    out = minutes.agg(F.count("*").alias("points"), F.greatest(F.max("n"), F.lit(1)).alias("peak"), t.hhmm(F.min("minute")).alias("first_label"), t.hhmm(F.max("minute")).alias("last_label"), F.sum("n").alias("s"))
    return out.where("s > 0").drop("s")


def recent_errors(events: DataFrame, token: str | None, now: str, n: int = 5) -> DataFrame:
    """The newest n events of code >= 400; of one time, earlier arrivals first."""
    code = t.status_code(F.col("status"))
    ok = in_range(events, token, now).where("kind = 'request'").where(code >= 400)
    return ok.orderBy(F.desc("ts"), "event_id").limit(n).select("event_id", t.hhmmss(F.col("ts").cast("timestamp")).alias("at"), "path", code.alias("code"), t.short_message(F.col("message")).alias("message"))


def error_buffer(events: DataFrame, n: int = 100) -> DataFrame:
    """The last n errors by arrival, newest first."""
    code = t.status_code(F.col("status"))
    errors = events.where("kind = 'request'").where(code >= 400)
    return errors.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).select("event_id", "path", code.alias("code"), t.short_message(F.col("message")).alias("message"))


def join_tool_prefix(events: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each event with the tool of its first matching prefix (prefixes: ord, prefix, tool).

    The beginnings of each distinct path are joined to the prefixes by equality, so that a table of any size will do.
    """
    paths = events.select("path").distinct().withColumn("p", F.lower(F.trim("path")))
    begin = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.length("p")), lambda n: F.substring("p", F.lit(1), n))).alias("prefix"))
    found = begin.join(prefixes, "prefix").groupBy("path").agg(F.min_by("tool", "ord").alias("tool"))
    return events.select("event_id", "path").join(found, "path", "left").select("event_id", "tool")


def folder_usage(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def batch_totals(jobs: DataFrame) -> DataFrame:
    """bytes in and out and files out by action."""
    return jobs.groupBy("action").agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.sum("files_out").alias("files_out"), F.count("*").alias("jobs"))


def quota_violations(events: DataFrame, limits: DataFrame, default: int = 10) -> DataFrame:
    """(client, endpoint, minute) with more requests than the endpoint's limit (limits: endpoint, quota)."""
    counts = events.where("kind = 'request'").groupBy(F.col("user_id").alias("client"), F.lower(F.trim("path")).alias("endpoint"), t.minute_of(F.col("ts").cast("timestamp")).alias("minute")).agg(F.count("*").alias("n"))
    quota = F.coalesce("quota", F.lit(default))
    return counts.join(limits, "endpoint", "left").where(F.col("n") > quota).select("client", "endpoint", "minute", "n", quota.alias("quota"))


TALLY = "what string, key string, n long, error struct<us: long, event_id: long, at: string, path: string, code: int, message: string>"
_TALLY = pa.schema([("what", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("error", pa.struct([("us", pa.int64()), ("event_id", pa.int64()), ("at", pa.string()), ("path", pa.string()), ("code", pa.int32()), ("message", pa.string())]))])


def _newest(errors: pa.Table, n: int) -> pa.Table:
    return errors.take(pc.sort_indices(errors, [("us", "descending"), ("event_id", "ascending")])[:n])


def tally(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(what, key, n, error): in one pass, how often each value of the key columns occurs, and the newest n ``error`` structs.

    What leaves a task is its distinct values with their counts and n errors, whatever it read: no built-in aggregate
    keeps the n first rows by an order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        newest = pa.Table.from_batches([], pa.schema(list(_TALLY.field("error").type)))
        for b in batches:
            for what in keys:
                for x in pc.value_counts(b[what].drop_null()):
                    counts[what, x["values"].as_py()] += x["counts"].as_py()
            found = b["error"].drop_null()
            if len(found):
                newest = _newest(pa.concat_tables([newest, pa.Table.from_arrays(found.flatten(), schema=newest.schema)]), n)
        rows = [(what, key, m, None) for (what, key), m in counts.items()] + [("error", None, 0, e) for e in newest.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TALLY)], schema=_TALLY)

    return rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "error").mapInArrow(count, TALLY)


def snapshot(events: DataFrame, token: str | None, now: str, recent: int = 5) -> DataFrame:
    """One row of JSON with totals, status counts, outcomes, minutes and recent errors, from one pass over the events.

    Tasks count what they read and keep their newest errors; these few rows are added up by key, and the sums put in
    one row: as many as the range has minutes, and some dozens.
    """
    start, end = _bounds(token, now)
    ts, code, request = F.col("ts").cast("timestamp"), t.status_code(F.col("status")), F.col("kind") == "request"
    tool = F.when(request, t.tool_of(F.col("path"))).otherwise(F.nullif(F.lower(F.trim("tool")), F.lit("")))
    ok = F.when(request, code < 400).otherwise(F.coalesce(F.col("ok"), F.lit(False)))
    error = F.struct(F.unix_micros(ts).alias("us"), F.col("event_id").cast("long").alias("event_id"), t.hhmmss(ts).alias("at"), "path", code.cast("int").alias("code"), t.short_message(F.col("message")).alias("message"))
    minute = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    rows = in_range(events, token, now).select("kind", F.when(request, t.status_class(F.col("status"))).alias("status"), t.outcome_key(tool, ok).alias("outcome"), F.when(request, minute(ts)).alias("minute"), F.when(request & (code >= 400), error).alias("error"))
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(start, F.date_trunc("minute", end), F.expr("INTERVAL 1 MINUTE"))).alias("m"))
    zeros = spine.select(F.lit("minute").alias("what"), minute(F.col("m")).alias("key"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(TALLY.split("error ")[1]).alias("error"))
    sums = tally(rows, ["kind", "status", "outcome", "minute"], recent).unionByName(zeros).groupBy("what", "key").agg(F.sum("n").alias("n"), F.collect_list("error").alias("errors"))

    listed = lambda what: F.sort_array(F.collect_list(F.when(F.col("what") == what, F.struct("key", "n"))))
    total = lambda kind: F.coalesce(F.sum(F.when((F.col("what") == "kind") & (F.col("key") == kind), F.col("n"))), F.lit(0)).cast("long")
    newest = F.sort_array(F.transform(F.flatten(F.collect_list("errors")), lambda e: F.struct((-e["us"]).alias("us"), e["event_id"].alias("event_id"), e.alias("e"))))
    one = sums.agg(total("request").alias("requests"), total("job").alias("jobs"), listed("status").alias("by_status"), listed("outcome").alias("by_outcome"), listed("minute").alias("minutes"), F.slice(newest, 1, recent).alias("newest"))
    series = F.transform("minutes", lambda x: F.struct(F.substring(x["key"], 12, 5).alias("ts"), x["n"].alias("count")))
    errors = F.transform("newest", lambda x: F.struct(*[x["e"][c].alias(c) for c in ("at", "path", "code", "message")]))
    return one.select(F.to_json(F.struct("requests", "jobs", "by_status", "by_outcome", series.alias("series"), errors.alias("errors"))).alias("snapshot"))


# feedback and logs


def validate_feedback(rows: DataFrame) -> DataFrame:
    """Cleaned fields and reject_reason, the first failure: type, missing, short (< 5), long (> 2000); null if none."""
    message, kind, page = (t.clean_text(F.coalesce(F.col(c), F.lit(""))) for c in ("message", "type", "page"))
    kind = F.lower(kind)
    reason = F.when(~kind.isin(t.FEEDBACK_TYPES), "type").when(message == "", "missing").when(F.length(message) < 5, "short").when(F.length(message) > 2000, "long")
    return rows.select("arrival", "request_id", kind.alias("type"), F.substring(F.coalesce(F.nullif(page, F.lit("")), F.lit("desconhecida")), 1, 80).alias("page"), message.alias("message"), reason.alias("reject_reason"))


def public_feedback(rows: DataFrame) -> DataFrame:
    """Bounded fields of records with a valid type and a message; the time falls back to ``timestamp``."""
    have = set(rows.columns)
    field = lambda c, n: F.substring(t.clean_text(F.coalesce(F.col(c) if c in have else F.lit(None).cast("string"), F.lit(""))), 1, n)
    stamp = F.coalesce(F.nullif(field("ts", 64), F.lit("")), field("timestamp", 64))
    out = rows.select("arrival", stamp.alias("timestamp"), field("page", 80).alias("page"), field("type", 32).alias("type"), field("message", 2000).alias("message"), field("app_version", 120).alias("app_version"), field("request_id", 64).alias("request_id"))
    return out.where(F.col("type").isin(t.FEEDBACK_TYPES) & (F.col("message") != ""))


def latest_feedback(rows: DataFrame, n: int = 50) -> DataFrame:
    """The last n (1..100) valid records, newest arrival first."""
    return public_feedback(rows).orderBy(F.desc("arrival")).limit(min(max(n, 1), 100))


def log_tail(logs: DataFrame, n: int = 400, level: str | None = None) -> DataFrame:
    """The last n (1..5000) log rows by arrival, in that order; a level filters what the tail holds."""
    name = (level or "").strip().upper()
    if name and name not in t.LOG_LEVELS:
        raise ValueError(f"level must be one of {', '.join(t.LOG_LEVELS)}")
    tail = logs.orderBy(F.desc("arrival")).limit(min(max(n, 1), 5000))
    return (tail.where(F.upper(F.trim("level")) == name) if name else tail).orderBy("arrival")
