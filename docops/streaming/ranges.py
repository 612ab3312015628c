"""Trailing ranges over a stream: minute buckets as state, range sums as differences of running sums.

The stream is counted by minute, class and tool, so an event is one row of one bucket and the state holds minutes x
classes x tools.  A bucket adds its count to a range from its own minute's end on and takes it away when the range has
left it; the running sum of these steps is the range's count, which stays as it is from one step to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import telemetry as t
from .telemetry import run, with_retention

KEYS = ["status_class", "tool"]
BUCKET = "minute long, status_class string, tool string, n long"
#: Minutes of a span; running sums begin anew with each, so that no window holds more than its steps.
SPAN = 1440


def minute_buckets(stream: DataFrame, keep: str = "24 hours") -> DataFrame:
    """(minute, status_class, tool, n): requests by minute (counted from 1970), class and tool."""
    counts = with_retention(stream.where("kind = 'request'"), keep).groupBy(F.window("ts", "1 minute"), t.status_class(F.col("status")).alias("status_class"), t.tool_of(F.col("path")).alias("tool")).agg(F.count("*").alias("n"))
    return counts.select(F.expr("unix_timestamp(window.start) div 60").alias("minute"), *KEYS, "n")


def trailing_sums(buckets: DataFrame, minutes: int, slide: int = 1) -> DataFrame:
    """(until, status_class, tool, n) at every ``slide``-th minute at which a range of so many minutes holds a request.

    ``until`` is the minute at which the range ends; it holds the buckets of the ``minutes`` before.
    """
    first, after = F.col("minute") + 1, F.col("minute") + minutes + 1
    spans = F.sequence(F.expr(f"(minute + 1) div {SPAN}"), F.expr(f"(minute + {minutes}) div {SPAN}"))
    cut = buckets.select(*KEYS, "n", first.alias("first"), after.alias("after"), F.explode(spans).alias("span"))
    begin, end = F.greatest("first", F.col("span") * SPAN), F.least("after", (F.col("span") + 1) * SPAN)
    steps = cut.select(*KEYS, "span", F.explode(F.array(F.struct(begin.alias("at"), F.col("n").alias("d")), F.struct(end.alias("at"), (-F.col("n")).alias("d")))).alias("s"))
    steps = steps.groupBy(*KEYS, "span", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy(*KEYS, "span").orderBy("at")
    held = steps.select(*KEYS, "at", F.sum("d").over(w).alias("n"), F.lead("at").over(w).alias("next")).where("n > 0")
    held = held.withColumn("at", F.expr(f"(at + {slide} - 1) div {slide} * {slide}")).where("at < next")
    return held.select(F.explode(F.sequence(F.col("at"), F.col("next") - 1, F.lit(slide).cast("long"))).alias("until"), *KEYS, "n")


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Buckets with the newer counts where there are some."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return both.groupBy("minute", *KEYS).agg(F.max_by("n", "age").alias("n"))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_ranges(stream: DataFrame, folder: str, token: str, slide: int = 1, keep: str = "24 hours") -> DataFrame:
    """Process what is there and read the ranges: (until timestamp, status_class, tool, n).

    Each batch merges the buckets that it changed into ``folder``/buckets-<batch>, which holds the last ``keep`` and a
    range before that, and writes the ranges that those reach into; a range's count is that of the last batch that
    has it.  A batch that runs again replaces what it wrote, and a stream that starts again goes on from there.
    """
    minutes, spark = t.range_minutes(token), stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/changed")
        changed = session.read.schema(BUCKET).parquet(f"{folder}/changed")
        low, high = changed.agg(F.min("minute"), F.max("minute")).first()
        known = session.read.schema(BUCKET).parquet(f"{folder}/buckets-{number - 1}") if number else changed.limit(0)
        merged = _merged(known, changed)
        oldest = merged.agg(F.expr(f"unix_timestamp(timestamp_seconds(max(minute) * 60) - INTERVAL {keep}) div 60 - {minutes}")).scalar()
        merged.where(F.col("minute") >= oldest).write.mode("overwrite").parquet(f"{folder}/buckets-{number}")
        low, high = (0, -minutes) if low is None else (low, high)  # a batch without requests reaches into none
        reached = session.read.schema(BUCKET).parquet(f"{folder}/buckets-{number}").where(F.col("minute").between(low - minutes, high + minutes))
        sums = trailing_sums(reached, minutes, slide).where(F.col("until").between(low + 1, high + minutes))
        sums.write.mode("overwrite").parquet(f"{folder}/ranges/batch={number}")
        _remove(session, f"{folder}/buckets-{number - 2}")

    run(minute_buckets(stream, keep), folder, step, "update")
    rows = spark.read.schema("until long, status_class string, tool string, n long, batch long").parquet(f"{folder}/ranges")
    last = rows.groupBy("until", *KEYS).agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.timestamp_seconds(F.col("until") * 60).alias("until"), *KEYS, "n")
