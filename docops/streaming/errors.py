"""The last errors of a stream as keyed state: bounded lists, whatever the stream holds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import telemetry as t
from .telemetry import run

ERROR = "event_id long, ts timestamp, path string, code int, message string"
COLUMNS = [c.split()[0] for c in ERROR.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """List state needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _newest(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n newest by time, then by id; an event that comes again counts once, and one without a time comes last."""
    return rows.sort_values(["ts", "event_id"], ascending=False, na_position="last").drop_duplicates("event_id").head(n)


class LastErrors(StatefulProcessor):
    """Of each key, the n newest errors in a list state; a batch that changes it gives the whole list."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("errors", ERROR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        old = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=COLUMNS)
        for batch in rows:  # never more than the list and one batch at a time
            old = _newest(pd.concat([old, batch[COLUMNS]]) if len(old) else batch[COLUMNS], self.n)
        old = old.astype(object).where(old.notna(), None)
        self.held.put([tuple(r) for r in old.itertuples(index=False)])
        yield old.assign(shard=key[0])[["shard", *COLUMNS]]

    def close(self) -> None:
        pass


def error_buffer(stream: DataFrame, n: int = 100, shards: int = 16) -> DataFrame:
    """(shard, errors): each batch's shards with their n newest errors; the newest n of all are among the shards' lists."""
    code = t.status_code(F.col("status"))
    errors = stream.where("kind = 'request'").where(code >= 400).select(F.expr(f"pmod(xxhash64(event_id), {shards})").alias("shard"), "event_id", "ts", "path", code.alias("code"), t.short_message(F.col("message")).alias("message"))
    return errors.groupBy("shard").transformWithStateInPandas(LastErrors(n), f"shard long, {ERROR}", "update", "none")


def run_error_buffer(stream: DataFrame, folder: str, n: int = 100) -> DataFrame:
    """Process what is there and read the newest n errors.

    A batch replaces the lists of the shards that it changed, so that there is a file or two a shard whatever came
    before, and a batch that runs again writes the same.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{folder}/buffer")

    with rocks_state(stream.sparkSession):
        run(error_buffer(stream, n), folder, step, "update")
    return read_error_buffer(stream.sparkSession, folder, n)


def read_error_buffer(spark: SparkSession, folder: str, n: int = 100) -> DataFrame:
    rows = spark.read.schema(f"{ERROR}, shard long").parquet(f"{folder}/buffer")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).drop("shard")
