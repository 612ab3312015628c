"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF vectors over block-max inverted indexes.

The index is fitted on at most ``sample`` labelled documents (those of smallest hash), with all their terms; the bound
is a parameter, so what is broadcast is bounded.  A term's weight is its TF-IDF times 1 + chi-squared of term and
label: no word is dropped, and those that tell the labels apart weigh most.  Every document is scored against the index
with its whole vector, words that no example has included.  A search adds up the rare terms' postings first; the common
terms' postings stand in blocks of examples with each term's largest weight, and only blocks that can still reach the
k-th best by these maxima are opened.  The examples within reach are then added up in double precision, so the search
is exact.  Votes are weighted by closeness, with the label's rate as a prior of weight ``prior_weight``, and calibrated
by a logistic line fitted on the examples, each voted on by the others.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import pack, unpack

_LETTERS = re.compile(r"[^\W\d_]+")
BLOCK = 64
#: A term that more than one example in so many has is common.
COMMON = 16
#: Texts searched at a time.
BATCH = 64
RESULT = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>"


def terms(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each range, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _least_of(x: np.ndarray, k: int) -> float:
    """The k-th largest value, minus infinity if there are fewer."""
    return float(np.partition(x, -k)[-k]) if len(x) > k else -np.inf


class BlockMaxIndex:
    """Unit vectors of the examples as postings by term, in blocks of examples with every common term's largest weight.

    Postings of rare terms are lists, those of common terms (more than one example in ``COMMON``) rows of a block.
    idf: a term's factor; unseen: that of a term that no example has.  counts: a dict, or term numbers and counts.
    """

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, counts: list, labels: list[int], ids: list[int], prior: float, unseen: float = 0.0):
        pairs = [(np.array(sorted(c), np.int64), np.array([c[t] for t in sorted(c)])) if isinstance(c, dict) else c for c in counts]
        size = np.array([len(t) for t, _ in pairs], np.int64)
        term = np.concatenate([np.zeros(0, np.int32), *(t.astype(np.int32) for t, _ in pairs)])
        count = np.concatenate([np.zeros(0, np.int32), *(n.astype(np.int32) for _, n in pairs)])
        first = np.cumsum(size) - size
        # like examples stand together, for tight bounds: by the term that weighs most, then doc_id
        weight = (1 + np.log(count)) * idf[term]
        most = np.repeat(np.maximum.reduceat(weight, first), size) if len(size) else weight
        at = np.flatnonzero(weight == most)
        top = term[at[np.searchsorted(at, first)]] if len(size) else first
        order = np.lexsort((np.array(ids, np.int64), top))
        at = _ranges(first[order], size[order])
        self.vocabulary, self.idf, self.prior, self.unseen = vocabulary, idf, prior, unseen
        self.slope, self.shift = 1.0, 0.0  # of the calibration, on log odds
        self.labels, self.ids = np.array(labels, float)[order], np.array(ids, np.int64)[order]
        self._index(term[at], count[at], size[order])

    def _index(self, term: np.ndarray, count: np.ndarray, size: np.ndarray) -> None:
        self.own_term, self.own_count = term, count  # by example
        self.own_start = np.concatenate([[0], np.cumsum(size)])
        weight = (1 + np.log(count)) * self.idf[term]
        self.own_length = np.sqrt(np.add.reduceat(weight * weight, self.own_start[:-1])) if len(size) else np.zeros(0)
        weight /= np.repeat(self.own_length, size)
        self.blocks = -(-len(size) // BLOCK)
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        df = np.bincount(term, minlength=len(self.vocabulary))
        common = np.flatnonzero(df > max(BLOCK, len(size) // COMMON))
        self.place = np.full(len(self.vocabulary), -1, np.int32)
        self.place[common] = np.arange(len(common))
        place = self.place[term]
        often = place >= 0
        self.dense = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        self.dense[row[often] // BLOCK, place[often], row[often] % BLOCK] = weight[often]
        self.most = self.dense.max(axis=2, initial=0.0).T  # (common term, block)
        self.doubt = 2.0**-23 * (len(common) + 32)  # what single precision may add or lose
        order = np.flatnonzero(~often)
        order = order[np.argsort(term[order], kind="stable")]  # by term, then example
        self.row, self.weight = row[order], weight[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.scratch = np.zeros(len(self.vocabulary))

    def own(self, at: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Weights at places of the examples' vectors, so many of each example."""
        return (1 + np.log(self.own_count[at])) * self.idf[self.own_term[at]] / np.repeat(self.own_length[rows], size)

    def __getstate__(self) -> tuple:
        """Words and counts, compressed: what is broadcast is small, and each worker lays out the postings itself."""
        words = zstandard.compress("\n".join(sorted(self.vocabulary, key=self.vocabulary.get)).encode())
        arrays = pack(np.diff(self.own_term, prepend=np.int32(0)), self.own_count, np.diff(self.own_start), self.labels, self.ids, self.idf)
        return words, arrays, self.prior, self.unseen, self.slope, self.shift

    def __setstate__(self, state: tuple) -> None:
        words, arrays, self.prior, self.unseen, self.slope, self.shift = state
        listed = zstandard.decompress(words).decode()
        self.vocabulary = {w: i for i, w in enumerate(listed.split("\n") if listed else [])}
        term, count, size, self.labels, self.ids, self.idf = unpack(arrays)
        self._index(np.cumsum(term, dtype=np.int32), count, size)

    @property
    def weights(self) -> np.ndarray:
        """All weights, a row a term and a column an example."""
        out = np.zeros((len(self.vocabulary), self.blocks * BLOCK))
        rows, size = np.arange(len(self.ids)), np.diff(self.own_start)
        out[self.own_term, np.repeat(rows, size)] = self.own(np.arange(len(self.own_term)), rows, size)
        return out

    def vector(self, counts: dict[int, int] | tuple[np.ndarray, np.ndarray], beyond: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit vector; beyond: what unseen terms add to its squared length."""
        t, n = (np.array(sorted(counts), np.int64), [counts[i] for i in sorted(counts)]) if isinstance(counts, dict) else counts
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt((w * w).sum() + beyond)

    def nearest(self, counts: dict[int, int], k: int, beyond: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of positive cosine and their cosines, nearest first; of equal ones the first in the index."""
        return self.search([self.vector(counts, beyond)], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, leave: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """As nearest, for unit vectors; leave: an example to pass over, of each query."""
        out = []
        for i in range(0, len(queries), BATCH):
            out += self._search(queries[i : i + BATCH], k, None if leave is None else leave[i : i + BATCH])
        return out

    def _search(self, queries: list, k: int, leave: np.ndarray | None) -> list:
        common = np.zeros((len(queries), self.most.shape[0]), np.float32)
        part = np.zeros((len(queries), self.blocks * BLOCK))  # what the rare terms add
        part[:, len(self.ids) :] = -1.0
        for i, (t, w) in enumerate(queries):
            place = self.place[t]
            often = place >= 0
            common[i, place[often]] = w[often]
            rare = t[~often]
            first, size = self.start[rare], self.start[rare + 1] - self.start[rare]
            at = _ranges(first, size)
            part[i, : len(self.ids)] += np.bincount(self.row[at], self.weight[at] * np.repeat(w[~often], size), minlength=len(self.ids))
            if leave is not None:
                part[i, leave[i]] = -1.0
        bound = common @ self.most  # by block: what the common terms can add
        most = part.reshape(len(queries), self.blocks, BLOCK).max(axis=2)
        least = np.array([_least_of(p, k) for p in part]) - self.doubt
        alive = most + bound >= least[:, None]
        wide = np.flatnonzero(alive.sum(axis=1) > self.blocks // 4)
        sums = dict(zip(wide.tolist(), (common[wide] @ self.dense).transpose(1, 0, 2).reshape(len(wide), -1))) if len(wide) else {}
        return [self._exact(t, w, self._reach(part[i], sums.get(i), common[i], np.flatnonzero(alive[i]), k), k) for i, (t, w) in enumerate(queries)]

    def _reach(self, part: np.ndarray, sums: np.ndarray | None, common: np.ndarray, blocks: np.ndarray, k: int) -> np.ndarray:
        """Examples that may be among the k nearest: all sums of the open blocks, in single precision."""
        if sums is None:
            rows = _ranges(blocks * BLOCK, np.full(len(blocks), BLOCK))
            total = part[rows] + (common @ self.dense[blocks]).reshape(-1)
        else:
            rows, total = np.arange(len(part)), part + sums
        near = total >= max(_least_of(total, k) - 2 * self.doubt, 0.0)
        return rows[near & (part[rows] >= 0)]

    def _exact(self, t: np.ndarray, w: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        size = self.own_start[rows + 1] - self.own_start[rows]
        at = _ranges(self.own_start[rows], size)
        self.scratch[t] = w
        got = np.bincount(np.repeat(np.arange(len(rows)), size), self.scratch[self.own_term[at]] * self.own(at, rows, size), minlength=len(rows))
        self.scratch[t] = 0.0
        rows, got = rows[got > 0], got[got > 0]
        best = np.lexsort((rows, -got))[:k]
        return rows[best], got[best]

    def vote(self, found: np.ndarray, cosine: np.ndarray, prior_weight: float) -> float:
        near = cosine**2
        return float((near @ self.labels[found] + prior_weight * self.prior) / (near.sum() + prior_weight))

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        """Probabilities from votes: a line on log odds (without a fit, the votes themselves)."""
        if (self.slope, self.shift) == (1.0, 0.0):
            return vote
        odds = np.log(np.clip(vote, 1e-9, 1 - 1e-9) / np.clip(1 - vote, 1e-9, 1 - 1e-9))
        return 1 / (1 + np.exp(-(self.slope * odds + self.shift)))

    def scores(self, texts: list[str | None], k: int, prior_weight: float) -> list[tuple[float, list[int]]]:
        """Uncalibrated vote and nearest doc_ids of each text."""
        queries, of = [], []
        for i, text in enumerate(texts):
            known, n, beyond = [], [], 0.0
            for x, c in Counter(terms(text)).items():
                if (at := self.vocabulary.get(x)) is not None:
                    known.append(at)
                    n.append(c)
                else:
                    beyond += ((1 + math.log(c)) * self.unseen) ** 2
            if known and len(self.ids):
                queries.append(self.vector((np.array(known, np.int64), np.array(n)), beyond))
                of.append(i)
        out: list[tuple[float, list[int]]] = [(self.prior, [])] * len(texts)
        for i, (found, cosine) in zip(of, self.search(queries, k)):
            out[i] = (self.vote(found, cosine, prior_weight), self.ids[found[:3]].tolist())
        return out

    def score(self, text: str | None, k: int, prior_weight: float) -> tuple[float, list[int]]:
        return self.scores([text], k, prior_weight)[0]


_HELD: dict[str, BlockMaxIndex] = {}


def _shared(spark: SparkSession, index: BlockMaxIndex) -> Broadcast:
    return spark.sparkContext.broadcast((uuid.uuid4().hex, pickle.dumps(index)))


def _held(shared: Broadcast) -> BlockMaxIndex:
    """The index of a broadcast; a worker holds one, laid out, from task to task."""
    name, packed = shared.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = pickle.loads(packed)
        with contextlib.suppress(OSError, AttributeError):  # what laying it out took goes back to the system
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    return _HELD[name]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8192) -> BlockMaxIndex:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0; at most ``sample`` of them, with all their terms."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    totals = chosen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, pos = totals[0], totals[1]
    if not n or not pos:
        return BlockMaxIndex({}, np.zeros(0), [], [], [], pos / n if n else 0.0)
    # of repeated rows one is an example
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, y, *zip(*Counter(terms(x)).items())) for i, y, x in zip(*(b[c].to_pylist() for c in ("doc_id", "toxic", "text"))) if terms(x)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "toxic": pa.array([r[1] for r in rows], pa.int32()), "term": pa.array([r[2] for r in rows], pa.list_(pa.string())), "n": pa.array([r[3] for r in rows], pa.list_(pa.int32()))})

    counted = texts.mapInArrow(count, "doc_id long, toxic int, term array<string>, n array<int>")
    every = counted.select("toxic", F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("a")).toArrow().sort_by("term")
    df, a = every["df"].to_numpy().astype(float), every["a"].to_numpy().astype(float)
    b = df - a
    chi2 = n * (a * (n - pos - b) - b * (pos - a)) ** 2 / np.maximum(df * (n - df) * pos * (n - pos), 1)
    vocabulary = {x: i for i, x in enumerate(every["term"].to_pylist())}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for x in batches:
            t = pa.array([[of[w] for w in ws] for ws in x["term"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["toxic"], t, x["n"]], ["doc_id", "toxic", "term", "n"])

    rows = counted.mapInArrow(number, "doc_id long, toxic int, term array<int>, n array<int>").toArrow().sort_by("doc_id")  # at most ``sample`` rows of numbers
    shared.destroy()
    counts = []
    for t, c in zip(rows["term"], rows["n"]):
        t, c = t.values.to_numpy().astype(np.int64), c.values.to_numpy()
        order = np.argsort(t)
        counts.append((t[order], c[order]))
    return BlockMaxIndex(vocabulary, (np.log((1 + n) / (1 + df)) + 1) * (1 + chi2), counts, rows["toxic"].to_pylist(), rows["doc_id"].to_pylist(), pos / n, float(np.log(1 + n) + 1))


def calibrate(spark: SparkSession, index: BlockMaxIndex, k: int = 25, prior_weight: float = 0.5) -> BlockMaxIndex:
    """Fit the calibration on the examples themselves, each scored by the others; tasks search, the driver fits two numbers."""
    n = len(index.ids)
    if not n or index.labels.min() == index.labels.max():
        return index
    shared = _shared(spark, index)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _held(shared)
        for b in batches:
            rows = b["id"].to_numpy()
            parts = [slice(i, j) for i, j in zip(model.own_start[rows].tolist(), model.own_start[rows + 1].tolist())]
            got = model.search([model.vector((model.own_term[p].astype(np.int64), model.own_count[p])) for p in parts], k, rows)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([model.vote(f, c, prior_weight) for f, c in got], pa.float64())], ["id", "vote"])

    got = spark.range(0, n, 1, max(1, n // 256)).mapInArrow(votes, "id long, vote double").toArrow().sort_by("id")  # a number an example
    vote, label = got["vote"].to_numpy(), index.labels
    x = np.stack([np.log(np.clip(vote, 1e-9, 1) / np.clip(1 - vote, 1e-9, 1)), np.ones(n)], axis=1)
    target = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / (n - label.sum() + 2))  # never quite sure
    line = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's steps for a logistic line
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        line -= np.clip(step, -1, 1)
    shared.destroy()
    if line[0] > 0:
        index.slope, index.shift = float(line[0]), float(line[1])
    return index


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, k: int = 25, prior_weight: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours (doc_ids of the nearest examples) of every document.

    A text without a term of the index, null or empty, has the label's rate as its vote; repeated rows score alike; of
    equally near examples those of smaller doc_id vote, with no say of the scored row's own; rows without doc_id are
    left out; only the text makes the score; an empty table gives an empty result; other columns are ignored.
    """
    shared = _shared(docs.sparkSession, index)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _held(shared)
        for b in batches:
            got = []
            for i in range(0, len(b), BATCH):
                got += model.scores(b["text"][i : i + BATCH].to_pylist(), k, prior_weight)
            scores = model.calibrated(np.array([s for s, _ in got], float))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([e for _, e in got], pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "neighbours"])

    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.col("text").cast("string").alias("text")).mapInArrow(score, RESULT)
