"""WARC archives of pages, and a reader that finds records by verified boundary chains.

Writing: pages of equal payload are found by their digests; the one of largest id is written whole (response), the
others as revisit records that refer to it.  Payloads are read where they lie and are never shuffled while the revisits
are few enough to be sent to all tasks.

Reading: archives are cut into byte ranges.  A task looks for the magic anywhere in its range, inside payloads too, and
gives each candidate with the offset of its successor (the end of the record that it would be) and the first offset
beyond the range that its chain reaches.  Pointer jumping over these, doubled every round, finds what is reachable from
the files' starts; only records on that chain are read.  So a payload may hold whole records and nothing is taken for
one but what the writer wrote.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, shared_dir, stored
from .token_files import filesystem

#: Bytes of a range, of a header at most, and of payloads sent to Spark at once.
RANGE, HEADER, SENT = 32 << 20, 64 << 10, 16 << 20
#: Revisits that are sent to all tasks at most (some 100 bytes each); more are joined by a shuffle.
FEW = 100_000
#: A key with more than one in so many rows is joined by itself: there are no more such keys than that.
HOT = 200
MANIFEST = "path string, bytes long, n_records long"
CANDIDATE = "path string, offset long, next long, leaves long"
RECORD = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")


def _record(fields: list[tuple[str, str]], block: list[bytes]) -> list[bytes]:
    size = sum(map(len, block))
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(size))])
    return [b"WARC/1.1\r\n", head.encode("utf-8", "surrogatepass"), b"\r\n", *block, b"\r\n\r\n"]


def _uri(url: str) -> str:
    """A URL as a header can hold it: no control characters and no white space."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


class _Archive:
    """A file that is written record by record."""

    def __init__(self, folder: str, date: str):
        self.fs, place = filesystem(folder)
        self.fs.create_dir(place, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc"
        self.path = f"{folder}/{name}"
        self.sink = self.fs.open_output_stream(f"{place}/{name}")
        self.bytes = self.records = 0
        self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], [b"format: WARC File Format 1.1\r\n"]))

    def add(self, parts: list[bytes]) -> None:
        data = b"".join(parts)
        self.sink.write(data)
        self.bytes += len(data)
        self.records += 1


def equal_payloads(pages: DataFrame, least: int) -> DataFrame:
    """(id, key, refers_to) of the rows whose payload of ``least`` bytes or more stands under a larger id too."""
    rows = stored(pages.select("id", F.octet_length("payload").cast("long").alias("size"), "key").where(F.col("size") >= least).select("id", "key"), "payloads")
    groups = rows.groupBy("key").agg(F.max("id").alias("refers_to"), F.count("*").alias("n"), F.min("id").alias("first"))
    groups = stored(groups.where("first < refers_to").drop("first"), "groups")
    return looked_up(rows, groups.select("key", "refers_to"), groups.select("key", "n"), rows.count()).where("id < refers_to").distinct()


def looked_up(rows: DataFrame, table: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """Inner join of n ``rows`` to the ``table`` by key; a key with a large share of the rows is joined without a shuffle.

    ``counts`` (key, n) says how many rows a key has; a key that it leaves out counts as rare.
    """
    hot = counts.where(F.col("n") > n // HOT).select("key")  # HOT keys at most, as all counts add up to n
    mine, others = (x.join(F.broadcast(hot), "key", how) for x in (rows,) for how in ("left_semi", "left_anti"))
    held = table.join(F.broadcast(hot), "key", "left_semi")
    return mine.join(F.broadcast(held), "key").unionByName(others.join(table, "key"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000, most_bytes: int = 1 << 30, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record of every page under ``folder``, which all executors share.  Returns the manifest, a row a file.

    Of pages with equal payloads of ``least`` bytes or more, those of the largest id are responses and the others refer
    to it; smaller ones are all responses.  A null payload is empty; a null URL has no header, control characters and
    white space in one are percent-encoded; payloads of any length are written whole; of rows that repeat an id with
    the same payload all have the same type; rows without an id are left out; an empty table gives no files; other
    columns are ignored.  A file ends after ``most_bytes``.  A task that runs again writes files of other names, and
    the manifest names those of the attempt that counts.
    """
    payload = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    revisits = stored(equal_payloads(rows, least), "revisits")
    if revisits.limit(FEW + 1).count() <= FEW:
        revisits = F.broadcast(revisits)
    rows = rows.join(revisits, ["id", "key"], "left").select("id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for b in batches:
            for page, url, body, refers_to in zip(*(b[c] for c in ("id", "url", "payload", "refers_to"))):
                page, url, body, refers_to = page.as_py(), url.as_py(), body.as_py(), refers_to.as_py()
                archive = archive or _Archive(folder, date)
                fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date)]
                if url is not None:
                    fields.append(("WARC-Target-URI", _uri(url)))
                if refers_to is not None:
                    fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", IDENTICAL)]
                fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()), ("Content-Type", "application/http; msgtype=response")]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                archive.add(_record(fields, [http] if refers_to is not None else [http, body]))
                if archive.bytes >= most_bytes:
                    done.append(archive)
                    archive.sink.close()
                    archive = None
        if archive:
            done.append(archive)
            archive.sink.close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [a.path for a in done], "bytes": pa.array([a.bytes for a in done], pa.int64()), "n_records": pa.array([a.records - 1 for a in done], pa.int64())})

    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class _File:
    """Bytes of a file by offset, some of them held."""

    def __init__(self, path: str, size: int):
        fs, place = filesystem(path)
        self.file, self.size = fs.open_input_file(place), size
        self.at, self.held = 0, b""

    def hold(self, at: int, size: int) -> bytes:
        self.at, self.held = at, self.file.read_at(max(0, min(size, self.size - at)), at)
        return self.held

    def read(self, at: int, size: int) -> bytes:
        size = max(0, min(size, self.size - at))
        i = at - self.at
        return self.held[i : i + size] if 0 <= i and i + size <= len(self.held) else self.file.read_at(size, at)


def _header(file: _File, at: int) -> tuple[dict[str, str], int, int] | None:
    """Fields, where the block begins, and its length, of a record that may begin there; None if none does."""
    head = file.read(at, 2048)
    if (end := head.find(b"\r\n\r\n")) < 0:
        head = file.read(at, HEADER)
        end = head.find(b"\r\n\r\n")
    if end < 0 or not _MAGIC.match(head):
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        return None
    return fields, at + end + 4, int(length)


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, bytes, start): the byte ranges of files (path, bytes), dealt over the cluster."""
    rows = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / size))).first()[0] or 0
    return rows.repartition(max(partitions(files.sparkSession), min(int(n), 1 << 16)), "path", "start")


def candidates(spans: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, offset, next, leaves): every place in a range where a record could begin, and where it would end.

    ``leaves`` is the first offset at or past the range's end on the candidate's chain, null if the chain breaks off.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, total, start in zip(*(b[c].to_pylist() for c in ("path", "bytes", "start"))):
                file, end, found = _File(path, total), min(start + size, total), {}
                for m in _MAGIC.finditer(file.hold(start, size + HEADER)):
                    if start + m.start() >= end:
                        break
                    if got := _header(file, start + m.start()):
                        after = got[1] + got[2] + 4
                        if after <= total and file.read(after - 4, 4) == b"\r\n\r\n":
                            found[start + m.start()] = after
                leaves = {}
                for at in reversed(found):  # successors first
                    leaves[at] = found[at] if found[at] >= end else leaves.get(found[at])
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(found), pa.string()), "offset": pa.array(list(found), pa.int64()), "next": pa.array(list(found.values()), pa.int64()), "leaves": pa.array([leaves[x] for x in found], pa.int64())})

    return spans.mapInArrow(scan, CANDIDATE)


def reachable(found: DataFrame) -> DataFrame:
    """(path, offset): of the ranges' entries, those that a chain from the file's start arrives at.

    ``found`` is a stored table of candidates.  Round k knows what 2^k ranges from the start hold: a file of a
    thousand ranges takes ten rounds, over one entry a range and those that false candidates lead to.
    """
    targets = found.where("leaves IS NOT NULL").select("path", F.col("leaves").alias("offset")).distinct()
    starts = found.where("offset = 0")
    jump = stored(found.join(targets, ["path", "offset"], "left_semi").unionByName(starts).select("path", "offset", "leaves"), "jumps")
    reach, n = stored(starts.select("path", "offset"), "reach"), -1
    while (now := reach.count()) != n:
        n = now
        entries = jump.select("path", "offset")
        there = jump.where("leaves IS NOT NULL").select("path", "offset", F.col("leaves").alias("to"))
        landed = reach.join(there, ["path", "offset"]).select("path", F.col("to").alias("offset")).join(entries, ["path", "offset"], "left_semi")
        reach = stored(reach.unionByName(landed).distinct(), "reach")
        # twice as far; an entry from which that leads nowhere stays as one that can be landed on
        twice = there.select("path", F.col("offset").alias("begin"), F.col("to").alias("offset")).join(jump, ["path", "offset"])
        twice = entries.join(twice.select("path", F.col("begin").alias("offset"), "leaves"), ["path", "offset"], "left")
        jump = stored(twice, "jumps")
    return reach


def broken(found: DataFrame, files: DataFrame, reach: DataFrame) -> DataFrame:
    """(path): files whose chain from the start does not arrive at their end."""
    ends = reach.join(found, ["path", "offset"]).select("path", F.col("leaves").alias("end"))
    return files.where("bytes > 0").select("path", F.col("bytes").alias("end")).join(ends, ["path", "end"], "left_anti").select("path")


def records(files: DataFrame, payloads: bool = True, size: int = RANGE) -> DataFrame:
    """Every record of the archives (path, bytes) that the chain from a file's start reaches, but for warcinfo.

    payload_bytes and payload_digest (SHA-1, lower-case hex) are of the payload itself for responses, whose declared
    digest has to agree, and as declared for revisits.  A file whose chain does not arrive at its end raises an error.
    """
    found = stored(candidates(ranges(files, size), size), "candidates")
    reach = reachable(found)
    bad = [r.path for r in broken(found, files, reach).limit(3).collect()]
    if bad:
        raise ValueError(f"no chain of records from start to end in {', '.join(bad)}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, total, at in zip(*(b[c].to_pylist() for c in ("path", "bytes", "offset"))):
                file, end, rows, held = _File(path, total), min(at - at % size + size, total), [], 0
                file.hold(at, end - at + HEADER)
                while at < end:
                    fields, begin, length = _header(file, at)
                    if fields.get("warc-type") != "warcinfo":
                        rows.append((path, at, *_parsed(fields, file.read(begin, length), payloads)))
                        held += length if payloads else 1024
                        if held >= SENT:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)
                            rows, held = [], 0
                    at = begin + length + 4
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)

    spans = reach.join(files.select("path", "bytes"), "path")
    n = max(partitions(files.sparkSession), min(reach.count(), 1 << 16))
    return spans.repartition(n, "path", "offset").mapInArrow(read, RECORD)


def _parsed(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = fields.get("warc-type")
    name = lambda k: (fields.get(k) or "").strip("<>") or None
    declared = fields.get("warc-payload-digest", "")
    declared = base64.b32decode(declared[5:]).hex() if declared.startswith("sha1:") else None
    http, split, payload = block.partition(b"\r\n\r\n")
    if not (split and "application/http" in fields.get("content-type", "")):
        http, payload = b"", block
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        return kind, name("warc-record-id"), name("warc-target-uri"), name("warc-refers-to"), int(size[1]) if size else None, declared, None
    digest = hashlib.sha1(payload).hexdigest()
    if declared not in (None, digest):
        raise ValueError(f"{name('warc-record-id')}: the payload's digest is {digest}, not {declared}")
    return kind, name("warc-record-id"), name("warc-target-uri"), name("warc-refers-to"), len(payload), digest, payload if payloads else None


def resolved(rows: DataFrame) -> DataFrame:
    """Records with a revisit's bytes and digest taken from the response it refers to; one that finds none raises an error."""
    rows = stored(rows.select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"), "records")
    own = rows.where("record_type <> 'revisit'")
    again = rows.where("record_type = 'revisit'").withColumn("key", F.struct("refers_to", "payload_digest"))
    answers = own.groupBy(F.struct(F.col("record_id").alias("refers_to"), "payload_digest").alias("key")).agg(F.max("payload_bytes").alias("found"))
    counts = again.groupBy("key").agg(F.count("*").alias("n"))
    n = again.count()
    # a revisit that finds nothing would be lost by the inner join: the null answer keeps it
    answers = answers.unionByName(counts.select("key", F.lit(None).cast("long").alias("found"))).groupBy("key").agg(F.max("found").alias("found"))
    size = F.when(F.col("found") == F.col("payload_bytes"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("no such payload: "), F.col("record_id"))).cast("long"))
    again = looked_up(again, answers, counts, n).withColumn("payload_bytes", size)
    return own.unionByName(again.select(own.columns))


def warc_pages(pages: DataFrame) -> DataFrame:
    """Write the pages under the shared folder, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write_warc(pages, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    rows = resolved(records(manifest.select("path", "bytes"), payloads=False))
    return rows.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
m AS (SELECT page_id, strlen(html) AS size, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN size >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN size >= 1000 AND page_id < last THEN last END AS refers_to FROM m
"""
