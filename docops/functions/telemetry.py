"""Telemetry and feedback columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path prefixes of the six tools, in order of precedence.
TOOL_PREFIXES = [("/api/convert", "convert"), ("/api/merge", "merge"), ("/api/split", "split"), ("/api/compress", "compress"), ("/api/organize", "organize"), ("/api/edit", "edit")]
#: Range tokens and their minutes.
RANGES = {"15m": 15, "1h": 60, "24h": 1440}
FEEDBACK_TYPES = ["problema", "sugestao", "duvida"]
LOG_LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def status_code(status: Column) -> Column:
    """The integer code; 0 where it can't be read."""
    return F.coalesce(F.trim(status.cast("string")).try_cast("int"), F.lit(0))


def status_class(status: Column) -> Column:
    code = status_code(status)
    return F.when(code.between(200, 299), "2xx").when(code.between(400, 499), "4xx").when(code >= 500, "5xx").otherwise("other")


def tool_of(path: Column) -> Column:
    """The tool of a request path, null if none."""
    p = F.lower(F.trim(path))
    out = F  # F.when first, then Column.when
    for prefix, tool in TOOL_PREFIXES:
        out = out.when(p.startswith(prefix), tool)
    return out


def job_tool(route: Column, action: Column) -> Column:
    """The route's tool, else the action up to its first ``_`` or ``-``; null if empty."""
    word = F.split(F.split(action, "_")[0], "-")[0]
    return F.nullif(F.lower(F.trim(F.coalesce(tool_of(route), word))), F.lit(""))


def outcome_key(tool: Column, ok: Column) -> Column:
    return F.concat(tool, F.when(ok, "_ok").otherwise("_err"))


def norm_ts(value: Column) -> Column:
    """A timestamp from an ISO text (``Z``, offset or none: UTC) or epoch seconds; anything else is null."""
    text = F.trim(value.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    epoch = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_micros((text.try_cast("double") * 1000000).cast("long")))
    return F.coalesce(iso, epoch)


def range_minutes(token: str | None) -> int:
    """Minutes of a range token; none or blank is 15m."""
    key = (token or "").strip().lower() or "15m"
    if key not in RANGES:
        raise ValueError(f"range must be one of {', '.join(RANGES)}")
    return RANGES[key]


def minutes_of_range(token: Column) -> Column:
    """The same of a column of tokens; null where ``range_minutes`` would raise an error."""
    key = F.coalesce(F.nullif(F.lower(F.trim(token)), F.lit("")), F.lit("15m"))
    return F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in RANGES.items()]), lambda x: x["k"] == key), 0)["n"]


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def hhmm(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def hhmmss(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def short_message(message: Column, size: int = 200) -> Column:
    return F.nullif(F.substring(message, 1, size), F.lit(""))


def mask_session_path(path: Column) -> Column:
    """Session ids in the edit routes' paths give way to a placeholder."""
    return F.regexp_replace(path, r"(/api/edit/(?:file|download|page-image)/)[0-9a-f]{32}(?=/|$)", "$1<edit_session_id>")


#: What marks a path as temporary, and the names of the program.
TEMP_MARKERS = "upload|flat|sanitized|rot|extracted|rotated|comprimido|tmp|temp"
PROGRAMS = ["gs", "gs.exe", "gswin32c.exe", "gswin64c.exe"]


def mask_temp_path(argument: Column) -> Column:
    """Temporary paths in command arguments become ``<prefix>.ext``, the program a fixed token; an output option keeps its name."""
    option = F.when(argument.startswith("-sOutputFile="), F.lit("-sOutputFile=")).otherwise(F.lit(""))
    bare = F.when(argument.startswith("-sOutputFile="), F.substring(argument, 14, 1 << 20)).otherwise(argument)
    is_path = bare.rlike(r"[\\/]") | bare.startswith(".")
    name = F.regexp_extract(bare, r"([^\\/]*)$", 1)
    extension = F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    masked = F.concat(F.lit("<"), F.regexp_extract(name, r"^([^_.]*)", 1), F.lit(">"), extension)
    program = is_path & F.lower(name).isin(PROGRAMS)
    return F.concat(option, F.when(program, F.lit("<ghostscript>")).when(is_path & F.lower(bare).rlike(TEMP_MARKERS), masked).otherwise(bare))


def clean_text(text: Column) -> Column:
    """Control characters and runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\x00-\x1f\x7f\s]+", " "))


def to_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))
