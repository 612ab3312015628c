"""Substring dedup with fixed-block anchors.

Non-overlapping blocks of ``block`` words of every document are the index; every rolling window of as many words
probes it.  A window of ``window`` >= 2 * block - 1 words holds a whole block of any document that it also stands
in, so hits lead to all repeats.  Around the hits, the full windows are compared: the smallest doc_id that holds a
window's words owns it, and in every later document the run of such windows, extended over its length, goes.

Work: one pass to probe, one to compare the windows around hits, one to cut.  A key is sent once a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Texts, Words, by_chunk, by_owner, chunked, cut, deltas, groups, key_bits, owners, pack, undeltas, unpack, with_answers

#: Bits of a probe's key at least.  More bits, fewer false hits (which cost time, not exactness).
PROBE_BITS = 44
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _table(out: list) -> pa.Table:
    cols = zip(*out) if out else ((), (), (), ())
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _RESULT)], schema=_RESULT)


class _Probes:
    """All probes of a chunk by sorted key, with what the owner needs to know of each distinct key."""

    def __init__(self, texts: Texts, block: int, bits: int):
        self.words = w = Words(texts)
        at, key = w.windows(block)
        key >>= np.uint64(64 - bits)
        self.order = np.argsort(key, kind="stable")
        self.at, key = at[self.order], key[self.order]
        self.first = groups(key)
        self.key = key[self.first]
        if len(key):
            doc = w.doc[self.at]
            other = np.concatenate([[False], (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])])
            self.several = np.logical_or.reduceat(other, self.first)
            self.indexed = np.logical_or.reduceat(w.place[self.at] % block == 0, self.first)
        else:
            self.several = self.indexed = np.zeros(0, bool)


def dedup_blocks(docs: DataFrame, window: int = 13, block: int = 7) -> DataFrame:
    """Cut from each document the words covered by a window that a smaller doc_id also holds.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by a space).  A null or empty text has no words; texts under ``window`` words lose nothing; rows of one
    doc_id do not cut each other; rows without doc_id are left out; other columns are ignored; an empty table gives an
    empty result.  Windows are equal by 96 bits of two hashes: of 10**13 windows, a false pair is expected in one run of
    some thousand.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must be long enough to hold a whole block: window >= 2 * block - 1")
    buckets, bits_ = owners(docs), key_bits(docs, PROBE_BITS)
    chunks = chunked(docs)

    def probe(chunk: int, texts: Texts) -> list:
        p = _Probes(texts, block, bits_)
        c = cut(p.key, buckets, bits_)
        return [(chunk, b, pack(deltas(p.key[i:j]), np.packbits(p.several[i:j]), np.packbits(p.indexed[i:j]))) for b, (i, j) in enumerate(zip(c, c[1:])) if j > i]

    def hit(sent: list[bytes]) -> list[bytes]:
        parts = [unpack(x) for x in sent]
        sizes = [len(k) for k, *_ in parts]
        key = np.concatenate([undeltas(k) for k, *_ in parts])
        several, indexed = (np.concatenate([np.unpackbits(p[n], count=s).astype(bool) for p, s in zip(parts, sizes)]) for n in (1, 2))
        order = np.argsort(key, kind="stable")
        first = groups(key[order])
        run = np.diff(np.append(first, len(key)))
        good = ((run > 1) | np.logical_or.reduceat(several[order], first)) & np.logical_or.reduceat(indexed[order], first)
        found = np.empty(len(key), bool)
        found[order] = np.repeat(good, run)
        return [pack(np.packbits(x)) for x in np.split(found, np.cumsum(sizes)[:-1])]

    def around(texts: Texts, bits: dict[int, np.ndarray]):
        """Windows around hits by sorted hash and check: first word, the run of each distinct one, its smallest doc_id."""
        p = _Probes(texts, block, bits_)
        c = cut(p.key, buckets, bits_)
        found = np.zeros(len(p.key), bool)
        for b, x in bits.items():
            found[c[b] : c[b + 1]] = np.unpackbits(x, count=c[b + 1] - c[b])
        w = p.words
        hits = np.zeros(len(w.start) + window + 1, np.int32)
        hits[p.at[np.repeat(found, np.diff(np.append(p.first, len(p.at))))] + 1] = 1
        hits = np.cumsum(hits)
        at = np.flatnonzero(w.count[w.doc] - w.place >= window)
        at = at[hits[at + window - block + 1] > hits[at]]
        key = w.spans(at, window)
        doc = texts.ids[w.doc[at]]
        check = w.checks(at, window)
        order = np.lexsort((doc, check, key))
        at, key, check, doc = at[order], key[order], check[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])[: len(key)])
        return w, at, doc, key[first], check[first], first, doc[first]

    def compare(chunk: int, texts: Texts, got: dict[int, bytes]) -> list:
        bits = {b: unpack(x)[0] for b, x in got.items()}
        _, _, _, key, check, _, low = around(texts, bits)
        c = cut(key, buckets)
        none = np.zeros(0, np.uint8)
        return [(chunk, b, pack(deltas(key[c[b] : c[b + 1]]), check[c[b] : c[b + 1]], low[c[b] : c[b + 1]], bits.get(b, none))) for b in range(buckets) if b in bits and bits[b].any() or c[b + 1] > c[b]]

    def owned(sent: list[bytes]) -> list[bytes]:
        parts = [unpack(x) for x in sent]
        sizes = [len(k) for k, *_ in parts]
        key = np.concatenate([undeltas(k) for k, *_ in parts])
        check, doc = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        if not len(key):
            return [pack(np.zeros(0, np.uint8), p[3]) for p in parts]
        order = np.lexsort((doc, check, key))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)]))
        low = np.empty(len(key), np.int64)
        low[order] = np.repeat(doc[order][first], np.diff(np.append(first, len(key))))
        return [pack(np.packbits(x), p[3]) for x, p in zip(np.split(low < doc, np.cumsum(sizes)[:-1]), parts)]

    def finish(chunk: int, texts: Texts, got: dict[int, bytes]) -> list:
        answers = {b: unpack(x) for b, x in got.items()}
        w, at, doc, key, _, first, low = around(texts, {b: x[1] for b, x in answers.items() if len(x[1])})
        c = cut(key, buckets)
        taken = np.zeros(len(key), bool)
        for b, (x, _) in answers.items():
            taken[c[b] : c[b + 1]] = np.unpackbits(x, count=c[b + 1] - c[b])
        run = np.diff(np.append(first, len(at)))
        at = at[np.repeat(taken, run) | (doc > np.repeat(low, run))]
        cover = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        keep = np.zeros(len(w.data) + 1, np.int8)
        keep[w.start[~gone]] += 1
        keep[w.end[~gone] + 1] -= 1  # with the byte after the word, as its space
        keep = np.cumsum(keep, dtype=np.int8)[:-1] > 0
        data = w.data.copy()
        data[w.end] = 32
        places = np.concatenate([[0], np.cumsum(keep)])
        kept = data[keep].tobytes()
        lost = np.concatenate([[0], np.cumsum(gone)])
        begin, end = places[texts.starts].tolist(), places[texts.ends + 1].tolist()
        removed = (lost[w.first + w.count] - lost[w.first]).tolist()
        return [(d, n, r, hashlib.sha256(kept[i : max(i, j - 1)]).hexdigest()) for d, n, r, i, j in zip(texts.ids.tolist(), w.count.tolist(), removed, begin, end)]

    hits = by_owner(by_chunk(chunks, probe), hit)
    judged = by_owner(with_answers(chunks, hits, compare), owned)
    return with_answers(chunks, judged, finish, RESULT, _table)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM x JOIN m USING (g), range(13) AS r(k) WHERE first < doc_id),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
t AS (SELECT k.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY k.p) FILTER (c.p IS NULL) AS kept FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.p = c.p GROUP BY k.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)
"""
