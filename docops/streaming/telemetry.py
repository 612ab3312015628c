"""Telemetry over streams.  Each function takes a streaming DataFrame of events with a timestamp ``ts``.

Windows keep state for the watermark's 24 hours, as long as the widest range that is asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import telemetry as t
from ..operators import telemetry as op

EVENTS = "event_id long, user_id long, ts timestamp, kind string, path string, status string, message string, tool string, ok boolean"


def with_retention(stream: DataFrame, keep: str = "24 hours") -> DataFrame:
    """Events later than ``keep`` behind the newest are dropped, and their state with them."""
    return stream.withWatermark("ts", keep)


def minute_counts(stream: DataFrame, keep: str = "24 hours") -> DataFrame:
    """(minute, n): requests by minute."""
    return with_retention(stream.where("kind = 'request'"), keep).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "n")


def run_counts(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Process what is there in update mode, so that windows behind the watermark leave the state, and read the counts.

    Each batch writes the counts that it changed to a folder of its own, which it replaces if it runs again; a key's
    count is that of the last batch that has it.
    """
    run(stream, folder, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}"), "update")
    spark = stream.sparkSession
    rows = spark.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(f"{folder}/result")
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def run(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "complete") -> str:
    """Process what is there and stop; the last batch's result is written to ``folder``/result."""
    target = f"{folder}/result"
    write = each or (lambda batch, _: batch.write.mode("overwrite").parquet(target))
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return target


def ingest_feedback(stream: DataFrame, good: str, rejected: str, checkpoint: str):
    """Validate a stream of feedback; each batch is appended to the good or the rejected records.  A batch that runs again replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        rows = op.validate_feedback(batch)
        rows.where("reject_reason IS NULL").drop("reject_reason").write.mode("overwrite").parquet(f"{good}/batch={number}")
        rows.where("reject_reason IS NOT NULL").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired_sessions(stream: DataFrame, ttl: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """(session_id, file_id, ts) of sessions whose last use lies more than ttl seconds behind the stream's time.

    ``stream`` has session_id, file_id and ts; uses without a time are left out.  A session is a window of its own that
    every use makes longer and that ends when ttl is over; its row has the last use and that use's file (of equal times the
    larger id), which an earlier one that comes late does not change.  A use more than ttl after the last one finds the
    session expired and begins it anew: either is a row, however the uses fall into batches.  Late uses count as long as
    they are not ttl behind themselves.
    """
    used = stream.withWatermark("ts", delay)
    over = F.session_window("ts", f"{ttl} seconds 1 microsecond")  # a session of exactly ttl is still in use
    last = used.groupBy("session_id", over).agg(F.max(F.struct("ts", "file_id")).alias("last"))
    return last.select("session_id", "last.file_id", "last.ts")


def purged_files(expired: DataFrame, inventory: DataFrame) -> DataFrame:
    """Expired sessions with the path of their file, null where the inventory (file_id, path) has none any more.

    A join of the stream with a table, which is read anew for every batch.
    """
    return expired.join(inventory.select("file_id", "path"), "file_id", "left").select("session_id", "file_id", "ts", "path")


def work_folder(spark: SparkSession, name: str) -> str:
    from ..sources.checkpoints import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
