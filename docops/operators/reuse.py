"""A store of results by content: a bucketed table to which missing keys are appended.

Rows lie in buckets of (content_id, setting), so looking keys up shuffles the keys asked for and never the store.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoints import stored

KEYS = ["content_id", "setting"]


class ReuseStore:
    """Results (content_id string, setting int, result) under a folder that all executors share.

    The folder outlives the session: opened again, with the same number of buckets, it holds what it held.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, result: str = "long"):
        self.spark, self.buckets = spark, buckets
        self.name = f"reuse_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (content_id STRING, setting INT, result {result}, run STRING) USING parquet CLUSTERED BY (content_id, setting) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def rows(self) -> DataFrame:
        """One row a key: of keys that two runs appended at a time, one run's for all readers.  Buckets stay as they lie."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).groupBy(*KEYS).agg(F.min(F.struct("run", "result")).alias("r")).select(*KEYS, "r.*")

    def missing(self, requests: DataFrame) -> DataFrame:
        """A request (keys and payload) of every key that the store has no result of."""
        asked = requests.groupBy(*KEYS).agg(F.any_value("payload").alias("payload"))
        # an anti join would be pushed below the dealing, and both sides be shuffled
        return self._dealt(asked).join(self.rows().select(*KEYS, "run"), KEYS, "left").where("run IS NULL").drop("run")

    def _dealt(self, keys: DataFrame) -> DataFrame:
        """Distinct keys dealt as the store's buckets are, so that a join leaves the store where it is."""
        return keys.repartition(self.buckets, *KEYS)

    def append(self, results: DataFrame, run: str) -> None:
        """Add results in one write, whose files appear when all of its tasks are done; one that fails leaves none."""
        results.select(*KEYS, "result", F.lit(run).alias("run")).write.insertInto(self.name)

    def reuse(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Requests (request_id, content_id, setting, payload) with result and hit, whether the store had it before.

        ``compute`` gets (content_id, setting, payload), each missing key once, and adds ``result``; it is not called
        when nothing is missing.  Requests without a key get no row.
        """
        run = uuid.uuid4().hex
        named = requests.where("content_id IS NOT NULL AND setting IS NOT NULL")
        missing = stored(self.missing(named), "missing")
        if missing.limit(1).count():
            self.append(stored(compute(missing), "computed"), run)
        asked = self._dealt(named.select(*KEYS).distinct())
        known = asked.join(self.rows(), KEYS).select(*KEYS, "result", (F.col("run") != run).alias("hit"))
        # many requests may share a key: this join is of two shuffled sides, which Spark may split
        return named.select("request_id", *KEYS).join(known, KEYS).select("request_id", *KEYS, "result", "hit")
