"""Token ids in Arrow files of fixed-size-list batches.

Documents in ascending doc_id order are encoded, ended by ``end_id``, joined, and cut into sequences of ``length`` ids
with a mask that marks the ids from the padding at a file's end.  A file is an Arrow random-access file: sequence i is
in batch i // BATCH, and its ids and mask are views of the mapped file.  An index file beside it holds each document's
first id and count.  One task writes one range of doc_ids; files appear under their final name at once, so a task
that runs again replaces its own file by the same bytes.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SPACE
from .shared import partitions, shared_dir

BATCH = 256
#: Distinct words of a generation that a worker remembers.
REMEMBERED = 300_000
MANIFEST = "part int, path string, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
TAIL = b".,!?;:"
#: Of an 8-byte number, the first bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Encoder:
    """Encodes whole texts word by word, each distinct word once.

    The tokenizer drops white space and never joins across it, nor letters with other signs, so words (parted by
    ASCII white space, closing punctuation apart) can be encoded alone.  ASCII words are folded to lower case, as the
    tokenizer does.  Words of letters are encoded many at a time: each ends with the one token marked as a word's end.
    Words met lately are remembered in two generations of at most ``REMEMBERED``, the older one going when the younger
    is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _plain(self, words: list[bytes]) -> None:
        """Learn words of letters only."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                flat, size = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
                bounds = [0, *(cuts * size).tolist()]
                self.known.update((w, flat[a:b]) for w, a, b in zip(part, bounds, bounds[1:]))
            else:
                self._whole(part)

    def _whole(self, words: list[bytes]) -> None:
        got = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(words, got))

    def _learn(self, words: list[bytes]) -> None:
        known = self.known
        parts: list[tuple[bytes, bytes, bytes]] = []
        plain, whole = {}, {}
        for word in words:
            w = word.lower() if word.isascii() else word
            core = w.rstrip(TAIL)
            letters = core.isalpha() if core.isascii() else (c := core.decode()).isalpha() and c.lower().isalpha()
            if letters and core:
                tail = w[len(core) :]
                if tail and tail not in known:
                    whole[tail] = None
            else:
                core, tail, letters = w, b"", False
            parts.append((word, core, tail))
            if core not in known:
                (plain if letters else whole)[core] = None
        self._plain(list(plain))
        self._whole(list(whole))
        for word, core, tail in parts:
            known[word] = known[core] + known[tail] if tail else known[core]

    def words(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        known.update((w, before[w]) for w in new if w in before)
        self._learn([w for w in new if w not in known])
        return [known[w] for w in words]

    @staticmethod
    def _distinct(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and the number among them of each word.  Words of up to 8 bytes are compared as numbers."""
        short = (end - start <= 8) & (b"\0" not in raw)
        kind = np.empty(len(start), np.int64)
        at = start[short]
        eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
        _, first, kind[short] = np.unique(eight[at] & _MASKS[end[short] - at], return_index=True, return_inverse=True)
        words = [raw[a:b] for a, b in zip(at[first].tolist(), end[short][first].tolist())]
        number: dict[bytes, int] = {}
        long = [number.setdefault(raw[a:b], len(number)) for a, b in zip(start[~short].tolist(), end[~short].tolist())]
        kind[~short] = np.array(long, np.int64) + len(words)
        return [*words, *number], kind

    def texts(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id, and the number of ids of each text."""
        raw = b"\n".join([*texts, b""])
        data = np.frombuffer(raw, np.uint8)
        edge = np.diff((~SPACE[data]).view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = np.array([len(x) + 1 for x in texts])
        last = np.searchsorted(start, np.cumsum(n))
        words, kind = self._distinct(raw, start, end)
        tokens = self.words(words)
        flat = np.frombuffer(b"".join(tokens), self.dtype)
        size = np.array([len(t) for t in tokens], np.int64) // np.dtype(self.dtype).itemsize
        first = np.cumsum(size) - size
        count = size[kind] if len(kind) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(first[kind] - total[:-1], count) + np.arange(total[-1])] if len(kind) else np.zeros(0, self.dtype)
        by_text = np.diff(total[last], prepend=0) + 1
        out = np.full(int(by_text.sum()), end_id, self.dtype)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(by_text) - 1] = False
        out[keep] = ids
        return out, by_text


#: A worker keeps its encoders, and the words that they know, from task to task.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Writer:
    """Cuts a stream of ids into sequences and writes them in batches."""

    def __init__(self, sink, dtype, length: int):
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.waiting = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        self.written += len(ids)
        span = self.length * BATCH
        if self.waiting >= span:
            flat = np.concatenate(self.rest)
            full = len(flat) // span * span
            for i in range(0, full, span):
                self._batch(flat[i : i + span], span)
            self.rest, self.waiting = [flat[full:]], len(flat) - full

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.rest)
            ids = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            ids[: len(flat)] = flat
            self._batch(ids, len(flat))
        self.file.close()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a shared folder as Spark names it."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    uri = re.sub(r"^dbfs:/+", "file:///dbfs/", uri)
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"token files need a folder that Arrow can open (file, hdfs, viewfs, s3, gs or abfs), not {uri}") from e


class TokenFile:
    """Random access to the sequences of a file; the arrays are views of the mapped file where it is local."""

    def __init__(self, path: str):
        fs, local = filesystem(path)
        opened = lambda p: pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)
        self.file = pa.ipc.open_file(opened(local))
        self.index = pa.ipc.open_file(opened(local + ".index")).read_all()
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, i: int) -> tuple[np.ndarray, pa.Array]:
        got = self.file.get_batch(i)
        return got["ids"].values.to_numpy(zero_copy_only=True), got["mask"].values

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.file.get_batch(i // BATCH)
        at = i % BATCH * self.length
        return got["ids"].values.to_numpy(zero_copy_only=True)[at : at + self.length], got["mask"].values.slice(at, self.length).to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int, int, int, int]]:
        """doc_id, first id, number of ids, crc32 of the ids as little-endian 32-bit integers."""
        span, held, real = self.length * BATCH, -1, 0
        ids = np.zeros(0, np.uint16)
        for doc, start, n in zip(*(self.index[c].to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            crc, at, end = 0, start, start + n
            while at < end:
                if at // span != held:
                    held = at // span
                    ids, mask = self.batch(held)
                    real = mask.true_count
                stop = min(end, (held + 1) * span)
                if stop - held * span > real:
                    raise ValueError("a document reaches into padding")
                crc = zlib.crc32(ids[at - held * span : stop - held * span].astype("<u4").tobytes(), crc)
                at = stop
            yield doc, start, n, crc


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write all documents in ascending doc_id order; one file a range of doc_ids.  Returns the manifest, a row a file.

    ``path`` is a folder that all executors share.  A null or empty text has the end id alone; a text of any length is
    encoded whole; repeated rows are written as often as they stand, those of one doc_id in the order of their texts,
    so that a task that runs again writes the same bytes; rows without doc_id are left out; an empty table gives no
    files; other columns are ignored.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, folder = filesystem(path)
        final, passing = f"{folder}/part-{part:06d}.arrow", f"{folder}/.passing-{uuid.uuid4().hex}"
        own = writer = sink = None
        docs, starts, counts = [], [], []
        for b in batches:
            texts = b["text"].to_pylist()
            sizes, i = np.cumsum([len(x) for x in texts]), 0
            while i < len(texts):
                if writer is None:
                    own = encoder(tokenizer)
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(passing)
                    writer = _Writer(sink, own.dtype, length)
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + (4 << 20))))
                ids, n = own.texts(texts[i:j], end_id)
                docs += b["doc_id"][i:j].to_pylist()
                starts.append(writer.written + np.cumsum(n) - n)
                counts.append(n)
                writer.add(ids)
                i = j
        if writer is not None:
            writer.close()
            sink.close()
            index = pa.table({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(np.concatenate(starts), pa.int64()), "n_tokens": pa.array(np.concatenate(counts), pa.int64())})
            with fs.open_output_stream(passing + ".index") as out, pa.ipc.new_file(out, index.schema) as file:
                file.write_table(index)
            fs.move(passing + ".index", final + ".index")
            fs.move(passing, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{path}/part-{part:06d}.arrow"], "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([writer.written], pa.int64())})

    return rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    files = sorted(manifest.collect())  # a row a file
    if not files:
        return manifest.sparkSession.createDataFrame([], RESULT)
    base, table = 0, []
    for f in files:
        table.append((f.path, base))
        base += f.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b["path"].to_pylist(), b["base"].to_pylist()):
                cols = list(zip(*TokenFile(path).documents()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cols[0], np.array(cols[1]) + before, cols[2], cols[3])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.sparkSession.createDataFrame(table, "path string, base long").repartition(len(table)).mapInArrow(read, RESULT)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write the documents under the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, path, tokenizer, end_id, length))
