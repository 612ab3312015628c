"""Documents in compressed chunks, and hashed keys exchanged between chunks and key owners.

Operators that compare every position of every text cannot shuffle a row a position.  Here a chunk holds some
megabytes of whole documents; the work on its bytes is done with numpy on the joined texts.  A chunk has a packed row
of sorted keys for each key owner (``bucket``: a range of key values), and the owner has a packed answer for it.
Chunks travel in parts, and what a part's chunks send to one owner is one row, so rows are as many as parts times
buckets: with some parts to a shuffle partition that is no more than a shuffle's own blocks, at any size of the input.
A key that a third of the documents hold appears once a chunk, so no task gets more than its share.
"""

from __future__ import annotations

import ctypes
import io
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions

ROW = "part long, bucket int, payload binary"
_ROW = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
#: Chunks of a part at most, and parts to a shuffle partition from where on parts grow.
PART, PARTS = 64, 8
#: Bytes of text that one key owner should see the keys of.
OWNED = 64 << 20
#: From here on a size is the optimizer's word for not knowing.
UNKNOWN = 1 << 60
_SIZES: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WBASE = 0xD6E8FEB86659FD93
_CBASE = 0xE7037ED1A0B428DB
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[base] = (out[0], out[1])
    return _powers[base][0][:n], _powers[base][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads sums of powers over all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = the polynomial hash of data[i:j] times base**i."""
    h = np.zeros(len(data) + 1, np.uint64)
    v = _BYTE[data]
    v *= powers(_BASE, len(data))[0]
    np.cumsum(v, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(_BASE, len(h))[1]
    return mix((h[end] - h[start]) * inverse[start])


class Texts:
    """The documents of a chunk: ids, and all texts as bytes with a line feed after each (it belongs to none)."""

    def __init__(self, blob: bytes):
        table = pa.ipc.open_stream(pa.BufferReader(blob)).read_all()
        self.table = table
        self.ids = table["doc_id"].to_numpy()
        texts = table["text"].to_pylist()
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1].astype(np.int64)
        self.ends = self.starts + self.lengths


    @staticmethod
    def packed(table: pa.Table) -> bytes:
        sink = io.BytesIO()
        table = table.combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return sink.getvalue()


class Words:
    """Words of a chunk: start and end byte, number of the document, hash; first word and count by document."""

    def __init__(self, texts: Texts, lower: bool = False):
        data = LOWER[texts.data] if lower else texts.data
        solid = ~SPACE[data]
        edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, texts.starts)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts.ids)), self.count)
        self.hash = span_hash(prefix_hash(data), self.start, self.end)
        self.place = np.arange(len(self.start)) - self.first[self.doc]
        self.data = data
        p, _ = powers(_WBASE, len(self.start) + 1)
        self._sum = np.zeros(len(self.start) + 1, np.uint64)
        np.cumsum(self.hash * p[:-1], out=self._sum[1:])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of k words that lie in one document, and the windows' hashes."""
        at = np.flatnonzero(self.count[self.doc] - self.place >= k)
        return at, self.spans(at, k)

    def checks(self, at: np.ndarray, k: int) -> np.ndarray:
        """A second hash of windows, of 32 bits, from other hashes of their words at other powers."""
        p, inverse = powers(_CBASE, len(self._sum))
        total = np.zeros(len(self._sum), np.uint64)
        np.cumsum(mix(self.hash ^ np.uint64(0xA0761D6478BD642F)) * p[:-1], out=total[1:])
        return (mix((total[at + k] - total[at]) * inverse[at]) >> np.uint64(32)).astype(np.uint32)

    def spans(self, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        inverse = powers(_WBASE, len(self._sum))[1]
        return mix((self._sum[at + k] - self._sum[at]) * inverse[at] + np.asarray(k).astype(np.uint64))


def estimated(docs: DataFrame) -> int:
    """Bytes of a table's texts, about: what its files hold, or else a sum over its rows.  It sets costs, never results.

    The optimizer multiplies the sizes of a join's sides, so its leaves are added up; where one has no known size, as
    a table that was made from rows has not, the texts' lengths are summed.
    """
    if docs not in _SIZES:
        plan = docs.select("text")._jdf.queryExecution().optimizedPlan()
        size = lambda node: int(str(node.stats().sizeInBytes()))
        leaves = plan.collectLeaves()
        known = min(size(plan), sum(size(leaves.apply(i)) for i in range(leaves.size())))
        _SIZES[docs] = known if known < UNKNOWN else docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return _SIZES[docs]


def owners(docs: DataFrame) -> int:
    """Buckets: two to a shuffle partition, more where one would see the keys of more than ``OWNED`` bytes."""
    return max(2 * partitions(docs.sparkSession), min(estimated(docs) // OWNED, 1 << 20))


def key_bits(docs: DataFrame, least: int) -> int:
    """Bits of a probe's key: some 15 more than numbers of the input's bytes have, so that few keys meet by chance."""
    return min(64, max(least, estimated(docs).bit_length() + 15))


def chunked(docs: DataFrame, extra: tuple[str, ...] = (), size: int = 2 << 20, part: int | None = None) -> DataFrame:
    """(part, chunk, blob): whole documents in chunks of about ``size`` bytes of text, so many chunks a part.

    A null text is empty; rows without doc_id are left out, having no identity to report.  A longer document fills
    a chunk of its own.  Chunks are numbered by partition, whose rows are put in order first, so that a partition that
    is computed again gives the same chunks, whatever order its rows come in.
    """
    part = part or max(1, min(PART, estimated(docs) // size // (PARTS * partitions(docs.sparkSession))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = number = TaskContext.get().partitionId() << 24
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            lengths = np.fromiter((len(x) for x in table["text"].to_pylist()), np.int64, len(table))
            cuts = (np.cumsum(lengths + 1) - 1) // size
            bounds = [0, *(np.flatnonzero(np.diff(cuts)) + 1), len(table)]
            for a, b in zip(bounds, bounds[1:]):
                if b > a:
                    place, blob = first + (number - first) // part, Texts.packed(table.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([number], pa.int64()), pa.array([blob], pa.binary())], ["part", "chunk", "blob"])
                    number += 1

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *extra]
    rows = docs.where(F.col("doc_id").isNotNull()).select(*cols)
    return rows.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(pack, "part long, chunk long, blob binary")


def give_back() -> None:
    """Powers go, which are soon made again, and freed arrays go back to the system, where the C library can.

    Else an idle worker keeps some 100 MB of them.
    """
    _powers.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blobs(table: pa.Table) -> Iterator[tuple[int, Texts]]:
    for chunk, blob in zip(table["chunk"].to_pylist(), table["blob"].to_pylist()):
        yield chunk, Texts(blob)
        give_back()


def frame(parts: list[tuple[int, bytes]]) -> bytes:
    """Payloads of some chunks as one."""
    head = np.array([(c, len(b)) for c, b in parts], "<i8")
    return len(parts).to_bytes(4, "little") + head.tobytes() + b"".join(b for _, b in parts)


def unframe(payload: bytes) -> list[tuple[int, bytes]]:
    n = int.from_bytes(payload[:4], "little")
    head = np.frombuffer(payload, "<i8", 2 * n, 4).reshape(n, 2)
    ends = (4 + 16 * n + np.cumsum(head[:, 1])).tolist()
    return [(c, payload[e - s : e]) for (c, s), e in zip(head.tolist(), ends)]


def sent(part: int, out: list[tuple[int, int, bytes]]) -> pa.Table:
    """(chunk, bucket, payload) of a part's chunks as one row a bucket."""
    by: dict[int, list[tuple[int, bytes]]] = {}
    for chunk, bucket, payload in out:
        by.setdefault(bucket, []).append((chunk, payload))
    return pa.Table.from_arrays([pa.array([part] * len(by), pa.int64()), pa.array(list(by), pa.int32()), pa.array([frame(x) for x in by.values()], pa.binary())], schema=_ROW)


def by_chunk(chunks: DataFrame, fn: Callable[[int, Texts], list]) -> DataFrame:
    """``fn(chunk, texts)`` over every chunk; it returns a list of (chunk, bucket, payload)."""
    return chunks.groupBy("part").applyInArrow(lambda t: sent(t["part"][0].as_py(), [x for c, texts in blobs(t) for x in fn(c, texts)]), ROW)


def with_answers(chunks: DataFrame, answers: DataFrame, fn: Callable[[int, Texts, dict[int, bytes]], list], schema: str | None = None, table: Callable[[list], pa.Table] | None = None) -> DataFrame:
    """As by_chunk, with the chunk's answers by bucket; with a schema, ``table`` makes rows of it of each chunk's list."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, dict[int, bytes]] = {}
        for bucket, payload in zip(right["bucket"].to_pylist(), right["payload"].to_pylist()):
            for chunk, x in unframe(payload):
                got.setdefault(chunk, {})[bucket] = x
        if table is None:
            return sent(left["part"][0].as_py() if len(left) else 0, [x for c, texts in blobs(left) for x in fn(c, texts, got.pop(c, {}))])
        return table([x for c, texts in blobs(left) for x in fn(c, texts, got.pop(c, {}))])

    return chunks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(both, schema or ROW)


def by_owner(messages: DataFrame, fn: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``fn`` gets all payloads of a bucket and returns an answer to each."""

    def owner(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        framed = [unframe(x) for x in t["payload"].to_pylist()]
        answers = iter(fn([x for parts in framed for _, x in parts]))
        back = [frame([(c, next(answers)) for c, _ in parts]) for parts in framed]
        give_back()
        return pa.Table.from_arrays([t["part"].combine_chunks(), t["bucket"].combine_chunks(), pa.array(back, pa.binary())], schema=_ROW)

    return messages.groupBy("bucket").applyInArrow(owner, ROW)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed.  The high bytes of small numbers are all zero and take no room."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str}:{len(a)}:{a.shape[1] if a.ndim > 1 else 0}")
        body.append(a.tobytes() if a.ndim > 1 or a.itemsize == 1 else a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    top = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(top).to_bytes(4, "little") + top + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for part in raw[4 : 4 + n].decode().split(","):
        kind, size, width = part.split(":")
        dtype, size, width = np.dtype(kind), int(size), int(width)
        span = size * dtype.itemsize * max(width, 1)
        x = np.frombuffer(raw, np.uint8, span, at)
        at += span
        if width:
            out.append(x.view(dtype).reshape(size, width))
        elif dtype.itemsize == 1:
            out.append(x.view(dtype))
        else:
            out.append(np.ascontiguousarray(x.reshape(dtype.itemsize, size).T).view(dtype).reshape(size))
    return out


def deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def undeltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def cut(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket's range begins in sorted keys of so many bits: buckets + 1 places."""
    edges = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def groups(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in sorted keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
