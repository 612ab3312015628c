import hashlib
import random

import pytest
from common import SF
from docops.llm import warc
from docops.llm.queries import op11_warc_chain
from docops.llm.warc import ORACLE, candidates, ranges, reachable, records, resolved, warc_pages, write_warc
from docops.llm.shared import stored
from oracle import connect, differences

SCHEMA = "page_id long, url string, html string, offset long, key string, bytes int"


def fake(i, body, length=None):
    """A whole record, as a payload may hold one."""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body.encode()) if length is None else length}\r\n\r\n{body}\r\n\r\n"


def pages():
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abc <>/é日\r\n") for _ in range(n))
    long = text(1500)
    bodies = [long, long, None, "", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "é" * 500, "é" * 500, "é" * 499, "é" * 499]
    bodies += [fake(900 + i, text(40)) * r.randrange(1, 30) + text(10) for i in range(6)]  # chains of false records
    bodies += ["WARC/1.1\r\n" * 200, "WARC/1.1\r\nContent-Length: 9999999999\r\n\r\n", fake(950, "", 10**17), "a\r\n\r\n" + fake(951, text(2000)) + "\r\n\r\n"]
    bodies += [text(r.randrange(3000)) for _ in range(30)] + [text(20_000), long]
    return [(i * 2, r.choice([f"http://h/{i}", f"http://h/ é\r\nWARC/1.1\r\n{i}", None]), b) for i, b in enumerate(bodies)]


def brute(rows):
    last = {}
    for i, _, b in rows:
        b = (b or "").encode()
        if len(b) >= 1000:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, _, b in rows:
        b = (b or "").encode()
        to = last.get(b, i)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    return sorted(out, key=str)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 5, "k", 1) for r in rows], SCHEMA).repartition(parts, "page_id")


@pytest.mark.parametrize("few", [0, 100])
def test_pages(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    rows = pages()
    rows += [r for r in rows if r[0] % 6 == 0]  # repeated
    df = table(spark, rows + [(None, "http://h", "z" * 2000)])
    assert sorted(map(tuple, warc_pages(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("size", [700, 5000, 1 << 20])
def test_chain(spark, tmp_path, size):
    """Whatever the ranges, what is read is what was written, from files of several sizes."""
    rows = pages()
    files = write_warc(table(spark, rows), f"file://{tmp_path}/w", most_bytes=30_000)
    assert files.count() > 3 and files.agg({"n_records": "sum"}).first()[0] == len(rows)
    got = records(files, size=size).collect()
    assert sorted(r.record_id for r in got) == sorted(f"urn:page:{i}" for i, *_ in rows)
    bodies = {f"urn:page:{i}": (b or "").encode() for i, _, b in rows}
    assert all(bytes(r.payload) == bodies[r.record_id] for r in got if r.record_type == "response")
    assert all(r.target_uri is None or "\n" not in r.target_uri for r in got)
    found = stored(candidates(ranges(files, size), size), "test")
    assert found.count() > len(rows) + files.count() + 10  # false ones too
    true = {(r.path, r.offset) for r in got}
    entries = {(r.path, r.offset) for r in reachable(found).collect()}
    assert all(e in true or e[1] == 0 for e in entries)


def test_rounds_are_few(spark, tmp_path):
    """A file of 200 ranges is crossed in eight doublings."""
    files = write_warc(table(spark, [(i, None, f"{i}" * 40) for i in range(400)], 1), f"file://{tmp_path}/w")
    size = files.first().bytes // 200
    found = stored(candidates(ranges(files, size), size), "test")
    assert 150 < reachable(found).count() <= 201
    assert records(files, False, size).count() == 400


def test_broken_file(spark, tmp_path):
    files = write_warc(table(spark, pages(), 1), f"file://{tmp_path}/w")
    name = files.first().path[7:]
    data = open(name, "rb").read()
    open(name, "wb").write(data[:-300])
    cut = spark.createDataFrame([(files.first().path, len(data) - 300)], "path string, bytes long")
    with pytest.raises(ValueError, match="no chain"):
        records(cut)


def test_revisit_of_nothing(spark):
    rows = spark.createDataFrame([("a", "revisit", "b", 5, "00")], "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string")
    with pytest.raises(Exception, match="no such payload: a"):
        resolved(rows).collect()


def test_many_copies(spark):
    """A third of all rows have one payload."""
    rows = [(i, None, "same" * 300 if i % 3 == 0 else f"{i}" * 500) for i in range(600)]
    assert sorted(map(tuple, warc_pages(table(spark, rows)).collect()), key=str) == brute(rows)


def test_query(spark):
    assert differences(op11_warc_chain(spark, SF), connect(SF), ORACLE) == ""


def test_empty(spark):
    assert warc_pages(table(spark, []).limit(0)).collect() == []
    assert [tuple(r)[:2] for r in warc_pages(table(spark, [(1, None, None)])).collect()] == [(1, 0)]
