"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, set here only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='docops-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: lineage ends there, whatever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/docops-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of a file of a round of ``components``.
ROUND_ROWS = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges, each vertex with the smallest one it is connected to there."""
    root: dict[int, int] = {}
    for batch in batches:
        for ends in zip(*(c.to_pylist() for c in batch.columns)):
            top = []
            for v in ends:
                path = []
                while (r := root.setdefault(v, v)) != v:
                    path.append(v)
                    v = r
                root.update(dict.fromkeys(path, v))
                top.append(v)
            low, high = sorted(top)
            root[high] = low
    out = []
    for v in root:
        r = v
        while root[r] != r:
            r = root[r]
        if r != v:
            out.append((v, r))
    for i in range(0, len(out), 50_000):
        u, v = zip(*out[i : i + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: (id, component), the component being its smallest id.

    Edges are reduced to stars twice: as they lie, and after a shuffle by their larger end, when a vertex comes out of
    one partition only (but for the few that are roots elsewhere), however many partitions held its edges.  Then every
    vertex takes the smallest label of its neighbours and itself, and that label's label; each round is written to the
    shared folder.  Ids without an edge do not appear.  Nothing is gathered on the driver but whether a label moved.
    """
    spark = edges.sparkSession
    high, low = F.greatest(F.col(a), F.col(b)).cast("long").alias("u"), F.least(F.col(a), F.col(b)).cast("long").alias("v")
    stars = edges.where(F.col(a) != F.col(b)).select(high, low).mapInArrow(_forest, "u long, v long")
    stars = stored(stars.repartition(partitions(spark), "u").mapInArrow(_forest, "u long, v long").distinct(), "stars")
    # every round's table is dealt anew to as many files as its rows ask for; the joins before it use the whole cluster
    few = max(16, stars.count() // ROUND_ROWS)
    ways = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = stored(ways.groupBy("u").agg(F.min(F.least("u", "v")).alias("label")).withColumnRenamed("u", "id").repartition(few, "id"), "labels")
    while True:
        own = label.select(F.col("id").alias("u"), F.col("label").alias("low"), F.col("label").alias("own"))
        near = ways.join(label.withColumnRenamed("id", "v"), "v").select("u", F.col("label").alias("low"), F.lit(None).cast("long").alias("own"))
        near = near.unionByName(own).groupBy("u").agg(F.min("low").alias("low"), F.min("own").alias("own"))
        jump = label.select(F.col("id").alias("low"), F.col("label").alias("far"))
        moved = F.least("low", "far")
        step = stored(near.join(jump, "low").select(F.col("u").alias("id"), moved.alias("label"), (moved < F.col("own")).alias("moved")).repartition(few, "id"), "labels")
        discard(label)
        label = step.select("id", "label")
        if not step.where("moved").limit(1).count():
            discard(stars)
            return label.select("id", F.col("label").alias("component"))
