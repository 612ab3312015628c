"""Partitions whose rows are bounded by the size of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of an input's files that one task should hold the rows of; columns of numbers pack some 100,000 rows into that.
PART = 1 << 20
#: From here on a size is the optimizer's word for not knowing.
UNKNOWN = 1 << 60


def dealt(df: DataFrame, key: str, part: int = PART) -> DataFrame:
    """``df`` by a key, in a partition for each ``part`` bytes of the files it reads; a small or unmeasured one as it is.

    Spark joins shuffled partitions by their compressed size, and rows that pack well then meet in a few tasks, whose
    memory grows with the table.  It keeps partitions whose number is given.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    n = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if n >= UNKNOWN or n // part <= 4 * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(n // part, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
