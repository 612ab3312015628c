"""Logs read from their ends, and results kept by content."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docops.operators import telemetry as op
from docops.operators.reuse import ReuseStore
from docops.sources import log_tail, readers
from docops.sources.log_tail import planned, read_log_tail


def text_lines(data: bytes) -> list[str]:
    return [x.decode("utf-8", "ignore") for x in data.splitlines()]


def test_tails_against_whole_files(tmp_path):
    """Any block and any n: the lines of all files in order, and the last n of them."""
    r = random.Random(1)
    for k in range(30):
        folder = tmp_path / str(k)
        folder.mkdir()
        lines, ends = [], [b"\n", b"\r\n", b"\r"]
        for i in range(r.randrange(4)):
            data = b"".join(bytes(r.choice(b"ab\xc3\xa9\xff ") for _ in range(r.choice([0, 1, 5, 40]))) + r.choice(ends if k % 2 else ends[:1]) for _ in range(r.randrange(40)))
            data += b"open end" * r.randrange(2)
            (folder / f"{i}.log").write_bytes(data)
            os.utime(folder / f"{i}.log", (1000 + i, 1000 + i))
            lines += text_lines(data)
        for n in (1, 2, 7, 50, 10_000):
            for block in (1, 3, 16, 1 << 16):
                slices, _ = planned(str(folder), n, block=block)
                got = [x for s in slices for x in text_lines(open(s.path, "rb").read()[s.start : s.end])]
                assert got == lines[-min(n, log_tail.MOST) :]


def test_bytes_read_do_not_grow(tmp_path):
    line = b"2026-01-01 00:00:00 | INFO  | m:f:1 | req=1 | " + b"x" * 50 + b"\n"
    took = []
    for n in (1_000, 10_000, 100_000):
        (tmp_path / f"{n}.log").write_bytes(line * n)
        took.append(planned(str(tmp_path / f"{n}.log"), 400)[1])
    assert took[0] <= took[1] == took[2] <= 4 * 400 * len(line) + 2 * log_tail.BLOCK
    os.utime(tmp_path / "100000.log", (1, 1))  # the newest file has all: the others are not read
    os.utime(tmp_path / "1000.log", (2, 2))
    slices, read = planned(str(tmp_path), 400)
    assert [os.path.basename(s.path) for s in slices] == ["10000.log"] and read == took[1]


def test_tail_of_parsed_logs(spark, tmp_path):
    lines = [f"t{i} | {'ERROR' if i % 3 else 'INFO '} | m | req={i} | text | {i}" for i in range(300)]
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n")
    logs = readers.parse_logs(read_log_tail(spark, str(tmp_path / "app.log"), 50))
    got = op.log_tail(logs, 50, "info").collect()
    assert [r.message for r in got] == [f"text | {i}" for i in range(250, 300) if i % 3 == 0]
    every = op.log_tail(readers.read_logs(spark, str(tmp_path / "app.log")), 50).drop("arrival").collect()
    assert op.log_tail(logs, 50).drop("arrival").collect() == every
    assert read_log_tail(spark, str(tmp_path / "none"), 5).collect() == []
    (tmp_path / "empty.log").write_text("")
    assert read_log_tail(spark, str(tmp_path / "empty.log"), 5).collect() == []


def requests(spark, rows):
    return spark.createDataFrame([(i, k, s, f"{k}{s}") for i, (k, s) in enumerate(rows)], "request_id long, content_id string, setting int, payload string")


@pytest.fixture
def counted():
    seen = []

    def compute(df):
        seen.extend(sorted(r.payload for r in df.select("payload").collect()))
        return df.withColumn("result", F.concat("payload", F.lit("!")))

    return seen, compute


def test_a_second_run_computes_nothing(spark, tmp_path, counted):
    seen, compute = counted
    asked = requests(spark, [("a", 1), ("a", 1), ("b", 1), ("a", 2), (None, 1), ("c", None)])
    store = ReuseStore(spark, f"file://{tmp_path}/s", 4, "string")
    first = {(r.request_id, r.result, r.hit) for r in store.reuse(asked, compute).collect()}
    assert first == {(0, "a1!", False), (1, "a1!", False), (2, "b1!", False), (3, "a2!", False)} and seen == ["a1", "a2", "b1"]
    again = {(r.request_id, r.result, r.hit) for r in store.reuse(asked, compute).collect()}
    assert again == {(i, x, True) for i, x, _ in first} and len(seen) == 3
    # opened again from its folder, with a new key beside known ones
    spark.sql(f"DROP TABLE {store.name}")
    store = ReuseStore(spark, f"file://{tmp_path}/s", 4, "string")
    more = {(r.content_id, r.result, r.hit) for r in store.reuse(requests(spark, [("a", 1), ("d", 1)]), compute).collect()}
    assert more == {("a", "a1!", True), ("d", "d1!", False)} and seen[3:] == ["d1"]


def test_the_store_is_not_shuffled(spark, tmp_path, counted):
    _, compute = counted
    asked = requests(spark, [(f"k{i}", i % 3) for i in range(500)])
    store = ReuseStore(spark, f"file://{tmp_path}/s", 4, "string")
    store.reuse(asked, compute)
    store.append(requests(spark, [("k0", 0), ("new", 0)]).withColumn("result", F.lit("other")), "zz")  # a key twice: one result for all
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, exchanges in ((store.rows(), 0), (store.missing(asked), 2)):  # the two deal out the keys asked for
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == exchanges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert store.rows().count() == 501 and store.missing(asked).count() == 0


def test_hot_keys(spark, tmp_path, counted):
    """A third of all requests ask for one key; it is computed once."""
    seen, compute = counted
    asked = requests(spark, [("hot" if i % 3 == 0 else f"k{i}", 1) for i in range(900)])
    got = ReuseStore(spark, f"file://{tmp_path}/s", 4, "string").reuse(asked, compute)
    assert got.count() == 900 and seen.count("hot1") == 1 and len(seen) == 601


def test_headers_of_files_of_any_length(spark, tmp_path):
    """A file longer than an array can be has a header like the others; no more of it is read."""
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    for name, start, size in (("large.pdf", b"%PDF-1.7", 3 << 30), ("small.png", b"\x89PNG\r\n\x1a\n", 9000)):
        with open(folder / name, "wb") as f:
            f.write(start)
            f.truncate(size)  # a hole: it takes no room
    got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.header)) for r in readers.read_headers(spark, str(folder)).collect()}
    head = lambda start: start + bytes(8192 - len(start))
    assert got == {"large.pdf": (3 << 30, head(b"%PDF-1.7")), "small.png": (9000, head(b"\x89PNG\r\n\x1a\n"))}
    small = lambda df: df.where("length < 10000").select("path", "length", "modificationTime", "header").orderBy("path").collect()
    assert small(readers.read_headers(spark, str(folder))) == small(readers.read_documents(spark, str(folder)))
