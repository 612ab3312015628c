"""Readers: schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .log_tail import filesystem

FEEDBACK = "ts string, page string, type string, message string, app_version string, request_id string"
EVENTS = "event_id long, user_id long, ts timestamp, kind string, path string, status string, message string, tool string, ok boolean"
#: Headers of a batch.
HEADERS = 1000


def parse_feedback(lines: DataFrame) -> DataFrame:
    """Records of JSON lines in column ``value``; blank and unparsable lines and those that are no object are dropped."""
    parsed = F.from_json("value", f"{FEEDBACK}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    good = lines.where(F.trim("value").startswith("{")).select("*", parsed.alias("r")).where("r IS NOT NULL AND r.broken IS NULL")
    return good.select(*[c for c in lines.columns if c != "value"], "r.*").drop("broken")


def read_lines(spark: SparkSession, path: str, order: str = "changed") -> DataFrame:
    """Lines of text files with their ``arrival``, which orders them as they stand: by file, part of the file and line.

    Files are in order of their change and then of their names (changed), or of their names alone (name), as those of
    one write of sorted rows are.
    """
    file = F.col("_metadata")
    fields = [file["file_path"].alias("file"), file["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("line")]
    place = F.struct(*([] if order == "name" else [file["file_modification_time"].alias("changed")]), *fields)
    return spark.read.text(path).select(place.alias("arrival"), "value")


def read_feedback(spark: SparkSession, path: str, order: str = "changed") -> DataFrame:
    return parse_feedback(read_lines(spark, path, order))


def write_feedback(rows: DataFrame, path: str) -> None:
    """Append one JSON object a line; nulls are left out, letters stay as they are."""
    rows.write.mode("append").json(path)


def parse_logs(lines: DataFrame) -> DataFrame:
    """ts, level, place, request, message of ``a | b | c | d | e`` lines; the last may hold the separator, missing ones are ''."""
    parts = F.split("value", r" \| ", 5)
    names = ("ts", "level", "place", "request", "message")
    fields = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) if i == 0 else F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)]
    return lines.select(*[c for c in lines.columns if c != "value"], *fields)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(read_lines(spark, path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def read_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder itself: path, length, modificationTime; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select("path", "length", "modificationTime")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files with their content and its first 8192 bytes."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime", "content", F.substring("content", 1, 8192).alias("header"))


def read_headers(spark: SparkSession, folder: str, size: int = 8192) -> DataFrame:
    """Files of a folder with their first ``size`` bytes: path, length, modificationTime, header.

    Spark lists the files, tasks open them and read no more than the header, so a file may be of any length (a content
    has to fit one array).  A mounted folder is resolved first; of a store that Arrow can't open, whole contents are read.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    named, real = store.makeQualified(top).toString(), store.resolvePath(top).toString()
    try:
        filesystem(quote(real, safe=":/@"))
    except (pa.ArrowInvalid, NotImplementedError, ImportError, OSError):
        return read_documents(spark, folder).select("path", "length", "modificationTime", F.substring("content", 1, size).alias("header"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(quote(real, safe=":/@"))
        for b in batches:
            for i in range(0, len(b), HEADERS):
                part = b.slice(i, HEADERS)
                head = []
                for path in part["path"].to_pylist():
                    with fs.open_input_file(place.rstrip("/") + path.removeprefix(named.rstrip("/"))) as file:
                        head.append(file.read(size))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(head, pa.binary())], [*part.schema.names, "header"])

    return read_inventory(spark, folder).mapInArrow(heads, "path string, length long, modificationTime timestamp, header binary")


UPDATE = "date: string, tag: string, title: string, desc: string"


def parse_updates(feeds: DataFrame) -> DataFrame:
    """date, tag, title, desc of change feeds in column ``value``: an object whose ``recent`` lists them, or a bare list.

    A feed that is neither has no rows; blank entries of a list go.
    """
    text = F.trim("value", F.lit(" \t\r\n"))
    listed = F.from_json(text, f"array<struct<{UPDATE}>>")
    inside = F.from_json(text, f"recent array<struct<{UPDATE}>>")["recent"]
    rows = feeds.select(F.explode(F.when(text.startswith("["), listed).otherwise(inside)).alias("u")).select("u.*")
    return rows.where("coalesce(date, tag, title, desc) IS NOT NULL")


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """The change feeds of files, one a file."""
    return parse_updates(spark.read.text(path, wholetext=True))


def target_labels(cells: DataFrame) -> DataFrame:
    """(table_id, labels): of each table's first row with two or more filled cells, in order of columns."""
    filled = cells.where("trim(value) <> ''").select("table_id", "row_pos", "col_pos", F.trim("value").alias("v")).repartition("table_id")
    table, row = Window.partitionBy("table_id"), Window.partitionBy("table_id").orderBy("row_pos", "col_pos", "v")
    # of sorted filled cells, one whose neighbour before it is of its row: the row has two
    second = F.when(F.lag("row_pos").over(row).eqNullSafe(F.col("row_pos")) & (F.row_number().over(row) > 1), F.col("row_pos"))
    first = filled.withColumn("_second", second).withColumn("_first", F.min("_second").over(table)).where("row_pos = _first")
    labels = F.sort_array(F.collect_list(F.struct("col_pos", "v")))
    return first.groupBy("table_id").agg(F.transform(labels, lambda c: c["v"]).alias("labels"))


def target_columns(cells: DataFrame, listed: str | None = None) -> list[str]:
    """Target labels of one schema table, else of a comma list, else none."""
    first = target_labels(cells).orderBy("table_id").limit(1).collect()
    return first[0].labels if first else [x.strip() for x in (listed or "").split(",") if x.strip()]
