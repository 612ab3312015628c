"""Suffix-array substring dedup by hash-compared suffix sort.

Suffixes are sorted where texts can repeat: at anchors, bytes whose 32-byte hash is the least of a window.  Any two
equal strings of ``length`` bytes hold the same anchor at the same place.  Anchors that stand once are dropped by an
exchange of packed hashes.  For the rest, the owner of an anchor's hash gets each chunk's distinct contexts and sorts
the suffixes on both sides of the anchor: a merge sort whose comparisons find the common extension by binary search
over prefix polynomial hashes, so each takes a logarithmic number of steps.  The extensions of sorted neighbours are
verified byte by byte.  Runs of sorted suffixes with long enough extensions on both sides are the equal strings; all
but the first of each are removed.

An anchor that stands more than ``hot`` times is not gathered by one owner.  Its windows of ``length`` bytes are sent by
their own hashes instead, each once a chunk with its bytes, so that such a group spreads over all buckets; they go
through the same sort, and windows are equal where all bytes are.  What a chunk knows by itself (equal contexts and
windows in it) is verified by bytes as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import _BASE, _BYTE, Texts, by_chunk, by_owner, chunked, cut, deltas, groups, key_bits, mix, owners, pack, powers, prefix_hash, span_hash, undeltas, unpack, with_answers

GRAM = 32
#: Bits of an anchor's key at least.
PROBE_BITS = 48
#: Occurrences up to which an anchor's contexts meet in one task; beyond it, its windows of ``length`` bytes are sorted apart.
HOT = 4096
#: Contexts sorted at a time.
SLICE = 16384
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _table(out: list) -> pa.Table:
    cols = zip(*out) if out else ((), (), (), (), ())
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _RESULT)], schema=_RESULT)


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over every window of so many values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return op(x[: len(x) - rest], x[rest:]) if rest else x


class Suffixes:
    """Suffixes of rows of bytes, compared by prefix polynomial hashes."""

    def __init__(self, text: np.ndarray, length: np.ndarray):
        n, m = text.shape
        self.text, self.length = text, length.astype(np.int64)
        self.hash = np.zeros((n, m + 1), np.uint64)
        np.cumsum(_BYTE[text] * powers(_BASE, m)[0], axis=1, out=self.hash[:, 1:])
        self.steps = int(m).bit_length()

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning, by binary search."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.length[a], self.length[b])
        for _ in range(self.steps):
            mid = (low + high + 1) // 2
            same = self.hash[a, mid] == self.hash[b, mid]
            low = np.where(same, mid, low)
            high = np.where(same, high, np.maximum(mid - 1, low))
        return low

    def below(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; ``equal`` where they are the same."""
        n = self.extension(a, b)
        at_end = n >= np.minimum(self.length[a], self.length[b])
        m = np.minimum(n, self.text.shape[1] - 1)
        less = np.where(at_end, self.length[a] < self.length[b], self.text[a, m] < self.text[b, m])
        return np.where(at_end & (self.length[a] == self.length[b]), equal, less)

    def order(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sorted order within each group [begin, end): a merge sort, all groups at once."""
        at = np.arange(len(begin))
        own = at - begin
        perm, width = at.copy(), 1
        while width < int((end - begin).max(initial=0)):
            run = own // width
            low = begin + (run ^ 1) * width
            start, high = low.copy(), np.minimum(low + width, end)
            second = (run & 1).astype(bool)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                right = self.below(perm[mid], perm[open_], second[open_])
                low[open_] = np.where(right, mid + 1, low[open_])
                high[open_] = np.where(right, high[open_], mid)
            place = begin + (run & ~1) * width + own % width + np.maximum(low - start, 0)
            merged = np.empty_like(perm)
            merged[place] = perm
            perm, width = merged, width * 2
        return perm

    def sorted(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and each suffix's verified extension in common with its predecessor (-1: first of a group)."""
        perm = self.order(begin, end)
        lcp = np.full(len(perm), -1, np.int64)
        later = np.flatnonzero(np.arange(len(perm)) > begin)
        a, b = perm[later - 1], perm[later]
        lcp[later] = self.extension(a, b)
        span = np.arange(self.text.shape[1])
        if ((self.text[a] != self.text[b]) & (span < lcp[later][:, None])).any():  # a collision of hashes: bytes decide
            keys = [*self.text.T[::-1].astype(np.int16), begin]
            past = span[:, None] >= self.length
            keys[:-1] = [np.where(p, -1, k) for p, k in zip(past[::-1], keys[:-1])]
            perm = np.lexsort(keys)
            a, b = perm[later - 1], perm[later]
            both = np.minimum(self.length[a], self.length[b])
            differs = (self.text[a] != self.text[b]) | (span >= both[:, None])
            lcp[later] = np.where(differs.any(axis=1), differs.argmax(axis=1), self.text.shape[1])
        return perm, lcp


def repeats(key: np.ndarray, left: np.ndarray, right: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in order of their places: how far left of its anchor a context's repeated strings begin, least and most.

    A string repeats if an earlier context of the same key holds it at the same distance.  255: none does.
    """
    side = length - GRAM
    least, most = np.full(len(key), 255, np.uint8), np.full(len(key), 255, np.uint8)
    order = np.argsort(key, kind="stable")
    first = groups(key[order])
    size = np.diff(np.append(first, len(key)))
    many = size > 1
    ends = np.cumsum(size[many])
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1), len(ends)] if len(ends) else [0]
    for i, j in zip(cuts, cuts[1:]):
        f, s = first[many][i:j], size[many][i:j]
        if not len(f):
            continue
        begin = np.repeat(np.cumsum(s) - s, s)
        end = begin + np.repeat(s, s)
        at = np.arange(len(begin))
        row = order[np.repeat(f, s) + at - begin]
        lav, rav = left[row].astype(np.int64), right[row].astype(np.int64)
        ro, rl = Suffixes(text[row][:, side:], rav).sorted(begin, end)
        lo, ll = Suffixes(np.ascontiguousarray(text[row][:, :side][:, ::-1]), lav).sorted(begin, end)
        low, high = np.full(len(row), 255, np.uint8), np.full(len(row), 255, np.uint8)
        # pairs: the second of a group repeats the first over one range
        second = np.flatnonzero((end - begin == 2) & (at > begin))
        a, b = np.maximum(0, length - rl[second]), np.minimum(side, ll[second])
        ok = a <= b
        low[second[ok]], high[second[ok]] = a[ok], b[ok]
        # larger groups: equal strings are runs of both orders
        big = np.flatnonzero(end - begin > 2)
        if len(big):
            n = len(row)
            for o in range(side + 1):
                ids = []
                for perm, lcp, need in ((ro, rl, length - o), (lo, ll, o)):
                    seg = np.empty(n, np.int64)
                    seg[perm] = np.cumsum(lcp < need)
                    ids.append(seg)
                both = (ids[0] * (n + 1) + ids[1])[big]
                by = np.argsort(both, kind="stable")
                earlier = np.concatenate([[False], both[by][1:] == both[by][:-1]])
                hit = big[by[earlier]]
                hit = hit[(lav[hit] >= o) & (rav[hit] >= length - o)]
                low[hit] = np.minimum(low[hit], o)
                high[hit] = o
        least[row], most[row] = low, high
    return least, most


class _Anchors:
    """Anchors of a chunk: place, key, document."""

    def __init__(self, texts: Texts, length: int, bits: int):
        self.texts, n, width = texts, len(texts.data), length - GRAM + 1
        self.hash = prefix_hash(texts.data)
        self.at = np.zeros(0, np.int64)
        if n >= length:
            gram = self.hash[GRAM:] - self.hash[:-GRAM]
            gram *= powers(_BASE, n + 1)[1][: len(gram)]
            gram = mix(gram)
            inside = np.zeros(n + 1, np.int8)
            long = texts.lengths >= length
            inside[texts.starts[long]] += 1
            inside[texts.ends[long] - length + 1] -= 1
            inside = np.cumsum(inside, dtype=np.int8)[: n - length + 1] > 0
            least = np.where(inside, sliding(np.minimum, gram, width), np.uint64(0))
            pad = np.zeros(width - 1, np.uint64)
            self.at = np.flatnonzero((gram == sliding(np.maximum, np.concatenate([pad, least, pad]), width)) & (gram > 0))
            self.key = mix(gram[self.at] ^ np.uint64(1)) >> np.uint64(64 - bits)  # least hashes are small: mixed again, keys spread over the owners
        else:
            self.key = np.zeros(0, np.uint64)
        order = np.argsort(self.key, kind="stable")
        self.at, self.key = self.at[order], self.key[order]
        self.first = groups(self.key)
        self.count = np.diff(np.append(self.first, len(self.key)))
        self.doc = np.searchsorted(texts.starts, self.at, "right") - 1


class _Repeated:
    """What a chunk sends of its repeated anchors, and what it knows itself."""

    def __init__(self, texts: Texts, codes: dict[int, np.ndarray], buckets: int, length: int, bits: int):
        side = length - GRAM
        a = _Anchors(texts, length, bits)
        c = cut(a.key[a.first], buckets, bits)
        code = np.zeros(len(a.first), np.uint8)
        for b, x in codes.items():
            code[c[b] : c[b + 1]] = x
        code = np.repeat(code, a.count)
        start, end = texts.starts[a.doc], texts.ends[a.doc]
        # contexts
        mine = code == 1
        at, key, start_, end_ = a.at[mine], a.key[mine], start[mine], end[mine]
        self.low, self.high = np.maximum(at - side, start_), np.minimum(at + length, end_)
        context = span_hash(a.hash, self.low, self.high) ^ ((at - self.low) * 256 + (self.high - at)).astype(np.uint64)
        ids, place = texts.ids[a.doc[mine]], at - start_
        order = np.lexsort((place, ids, context, key))
        self.at, self.key, self.low, self.high, self.ids, self.place = (x[order] for x in (at, key, self.low, self.high, ids, place))
        context = context[order]
        self.rep = np.concatenate([[True], (context[1:] != context[:-1]) | (self.key[1:] != self.key[:-1])])[: len(at)]
        copies = np.flatnonzero(~self.rep)
        before, span = self.at - self.low, self.high - self.low
        alike = (before[copies] == before[copies - 1]) & (span[copies] == span[copies - 1])
        self.rep[copies] = ~(alike & same_bytes(texts.data, self.low[copies], self.low[copies - 1], span[copies]))
        # windows of hot anchors
        hot = code == 2
        cover = np.zeros(len(texts.data) + 2, np.int32)
        np.add.at(cover, np.maximum(a.at[hot] - side, start[hot]), 1)
        np.add.at(cover, np.minimum(a.at[hot], end[hot] - length) + 1, -1)
        self.window = np.flatnonzero(np.cumsum(cover) > 0)
        doc = np.searchsorted(texts.starts, self.window, "right") - 1
        wkey = span_hash(a.hash, self.window, self.window + length)
        order = np.lexsort((self.window - texts.starts[doc], texts.ids[doc], wkey))
        self.window, self.wkey, doc = self.window[order], wkey[order], doc[order]
        self.wids, self.wplace = texts.ids[doc], self.window - texts.starts[doc]
        new = np.concatenate([[True], self.wkey[1:] != self.wkey[:-1]])[: len(self.wkey)]
        copies = np.flatnonzero(~new)
        new[copies] = ~same_bytes(texts.data, self.window[copies], self.window[copies - 1], np.full(len(copies), length))
        self.wfirst = np.flatnonzero(new)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b, so many each, are the same."""
    out = np.ones(len(a), bool)
    span = np.arange(int(size.max(initial=0)))
    for i in range(0, len(a), SLICE):
        x = slice(i, i + SLICE)
        inside = span < size[x, None]
        out[x] = ((data[np.where(inside, a[x, None] + span, 0)] == data[np.where(inside, b[x, None] + span, 0)]) | ~inside).all(axis=1)
    return out


def later_copies(key: np.ndarray, rank: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which rows of bytes have an equal one of the same key and smaller rank.

    Each key's rows are sorted as suffixes, and runs of neighbours that agree over the whole length, byte by byte, are
    equal.  Of a key with more rows than a slice holds, those equal to its first row are settled without a sort.
    """
    length = text.shape[1]
    later = np.zeros(len(key), bool)
    order = np.lexsort((rank, key))
    first = groups(key[order])
    size = np.diff(np.append(first, len(key)))
    rows = [order[np.repeat((size > 1) & (size <= SLICE), size)]]
    for f, s in zip(first[size > SLICE].tolist(), size[size > SLICE].tolist()):
        own = order[f : f + s]
        same = np.concatenate([(text[own[i : i + SLICE]] == text[own[0]]).all(axis=1) for i in range(0, s, SLICE)])
        later[own[same]] = True
        later[own[0]] = False
        rows.append(own[~same])
    row = np.concatenate(rows)
    begins = groups(key[row])
    ends = np.append(begins[1:], len(row))
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(ends)] if len(begins) else [0]
    for i, j in zip(cuts, cuts[1:]):
        if j == i:
            continue
        a, b = begins[i], ends[j - 1]
        n = ends[i:j] - begins[i:j]
        begin = np.repeat(begins[i:j] - a, n)
        perm, lcp = Suffixes(text[row[a:b]], np.full(b - a, length)).sorted(begin, begin + np.repeat(n, n))
        run = np.empty(b - a, np.int64)
        run[perm] = np.cumsum(lcp < length)
        by = np.argsort(run, kind="stable")
        later[row[a:b][by[np.concatenate([[False], run[by][1:] == run[by][:-1]])]]] = True
    return later


def _ranks(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    order = np.lexsort((place, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _deduped(docs: DataFrame, length: int, hot: int, extra: tuple[str, ...], report: Callable, schema: str, table: Callable) -> DataFrame:
    """``report(texts, removed)`` makes rows of each chunk and the mask of its removed bytes."""
    if not 2 * GRAM <= length <= 220:
        raise ValueError(f"length must be from {2 * GRAM} to 220")
    side = length - GRAM
    buckets, bits = owners(docs), key_bits(docs, PROBE_BITS)
    chunks = chunked(docs, extra)
    none = np.zeros(0, np.uint8)

    def probe(chunk: int, texts: Texts) -> list:
        a = _Anchors(texts, length, bits)
        key, n = a.key[a.first], np.minimum(a.count, 65535).astype(np.uint16)
        c = cut(key, buckets, bits)
        return [(chunk, b, pack(deltas(key[i:j]), n[i:j])) for b, (i, j) in enumerate(zip(c, c[1:])) if j > i]

    def count(sent: list[bytes]) -> list[bytes]:
        parts = [unpack(x) for x in sent]
        key = np.concatenate([undeltas(k) for k, _ in parts])
        n = np.concatenate([x for _, x in parts]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        first = groups(key[order])
        total = np.add.reduceat(n[order], first)
        code = np.empty(len(key), np.uint8)
        code[order] = np.repeat((total > 1).astype(np.uint8) + (total > hot), np.diff(np.append(first, len(key))))
        return [pack(x) for x in np.split(code, np.cumsum([len(k) for k, _ in parts])[:-1])]

    def contexts(chunk: int, texts: Texts, got: dict[int, bytes]) -> list:
        codes = {b: unpack(x)[0] for b, x in got.items()}
        r = _Repeated(texts, codes, buckets, length, bits)
        pick = np.flatnonzero(r.rep)
        key, at, low, high = r.key[pick], r.at[pick], r.low[pick], r.high[pick]
        wkey, wids, wplace = r.wkey[r.wfirst], r.wids[r.wfirst], r.wplace[r.wfirst]
        c, d = cut(key, buckets, bits), cut(wkey, buckets)
        span, out = np.arange(-side, length), []
        for b in range(buckets):
            s, t = slice(c[b], c[b + 1]), slice(d[b], d[b + 1])
            if c[b + 1] > c[b] or d[b + 1] > d[b] or b in codes and codes[b].any():
                where = at[s, None] + span
                inside = (where >= low[s, None]) & (where < high[s, None])
                text = np.where(inside, texts.data[np.where(inside, where, 0)], np.uint8(0))
                ids, place = r.ids[pick][s], r.place[pick][s]
                wtext = texts.data[r.window[r.wfirst[t]][:, None] + np.arange(length)]
                out.append((chunk, b, pack(deltas(key[s]), ids, place, (at[s] - low[s]).astype(np.uint8), (high[s] - at[s]).astype(np.uint8), text.reshape(-1), deltas(wkey[t]), wids[t], wplace[t], wtext.reshape(-1), codes.get(b, none))))
        return out

    def resolve(sent: list[bytes]) -> list[bytes]:
        parts = [unpack(x) for x in sent]
        key = np.concatenate([undeltas(p[0]) for p in parts])
        ids, place, left, right = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
        text = np.concatenate([p[5].reshape(-1, side + length) for p in parts])
        order = np.lexsort((place, ids))
        least, most = np.empty(len(key), np.uint8), np.empty(len(key), np.uint8)
        least[order], most[order] = repeats(key[order], left[order], right[order], text[order], length)
        wkey = np.concatenate([undeltas(p[6]) for p in parts])
        rank = _ranks(np.concatenate([p[7] for p in parts]), np.concatenate([p[8] for p in parts]))
        later = later_copies(wkey, rank, np.concatenate([p[9].reshape(-1, length) for p in parts]))
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        wcuts = np.cumsum([len(p[6]) for p in parts])[:-1]
        return [pack(a, b, np.packbits(w), p[10]) for a, b, w, p in zip(np.split(least, cuts), np.split(most, cuts), np.split(later, wcuts), parts)]

    def finish(chunk: int, texts: Texts, got: dict[int, bytes]) -> list:
        answers = {b: unpack(x) for b, x in got.items()}
        r = _Repeated(texts, {b: x[3] for b, x in answers.items() if len(x[3])}, buckets, length, bits)
        pick = np.flatnonzero(r.rep)
        c, d = cut(r.key[pick], buckets, bits), cut(r.wkey[r.wfirst], buckets)
        least, most = np.full(len(pick), 255, np.uint8), np.full(len(pick), 255, np.uint8)
        later = np.zeros(len(r.wfirst), bool)
        for b, (x, y, w, _) in answers.items():
            least[c[b] : c[b + 1]], most[c[b] : c[b + 1]] = x, y
            later[d[b] : d[b + 1]] = np.unpackbits(w, count=d[b + 1] - d[b])
        found = least < 255
        begin = r.at[pick][found] - most[found]
        end = r.at[pick][found] + length - least[found]
        copies = ~r.rep & (r.high - r.low >= length)
        size = np.diff(np.append(r.wfirst, len(r.window)))
        gone = np.repeat(later, size)
        gone[np.setdiff1d(np.arange(len(gone)), r.wfirst, assume_unique=True)] = True
        begin = np.concatenate([begin, r.low[copies], r.window[gone]])
        end = np.concatenate([end, r.high[copies], r.window[gone] + length])
        cover = np.zeros(len(texts.data) + 1, np.int32)
        np.add.at(cover, begin, 1)
        np.add.at(cover, end, -1)
        removed = np.cumsum(cover)[:-1] > 0
        return report(texts, removed)

    counts = by_owner(by_chunk(chunks, probe), count)
    found = by_owner(with_answers(chunks, counts, contexts), resolve)
    return with_answers(chunks, found, finish, schema, table)


def dedup_suffixes(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier in the corpus.

    Order: doc_id, then place; strings lie within one document and are judged on the input.  Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining UTF-8 bytes.  A null text is empty; texts
    under ``length`` bytes lose nothing; of repeated rows of one doc_id one counts as the earlier; rows without doc_id
    are left out; other columns are ignored; an empty table gives an empty result.
    """

    def report(texts: Texts, removed: np.ndarray) -> list:
        edges = np.concatenate([[0], np.cumsum(np.diff(removed.view(np.int8), prepend=np.int8(0)) == 1)])
        lost = np.concatenate([[0], np.cumsum(removed)])
        keep = ~removed
        keep[texts.ends] = False
        kept = texts.data[keep].tobytes()
        stay = np.concatenate([[0], np.cumsum(keep)])
        s, e = texts.starts, texts.ends
        cols = (texts.ids, texts.lengths, lost[e] - lost[s], edges[e] - edges[s], stay[s], stay[e])
        return [(i, n, m, k, hashlib.sha256(kept[x:y]).hexdigest()) for i, n, m, k, x, y in zip(*(v.tolist() for v in cols))]

    return _deduped(docs, length, hot, (), report, RESULT, _table)


def stripped(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """The documents without what dedup_suffixes removes, all columns kept; n_chars, if there, counts the new text.

    A character goes only if all its bytes do, so that texts stay valid.
    """
    schema = docs.select(*[F.col(c).cast("long").alias(c) if c in ("doc_id", "n_chars") else c for c in docs.columns]).schema
    extra = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))

    def report(texts: Texts, removed: np.ndarray) -> list:
        first = (texts.data & 0xC0) != 0x80
        begin = np.flatnonzero(first)
        gone = np.repeat(np.logical_and.reduceat(removed, begin), np.diff(np.append(begin, len(removed))))
        keep = ~gone
        keep[texts.ends] = False
        stay, chars = np.concatenate([[0], np.cumsum(keep)]), np.concatenate([[0], np.cumsum(keep & first)])
        s, e = texts.starts, texts.ends
        offsets = pa.py_buffer(np.append(0, np.cumsum(stay[e] - stay[s])).astype(np.int32).tobytes())
        text = pa.Array.from_buffers(pa.string(), len(texts.ids), [None, offsets, pa.py_buffer(texts.data[keep].tobytes())])
        new = {"doc_id": pa.array(texts.ids, pa.int64()), "text": text, "n_chars": pa.array(chars[e] - chars[s], pa.int64())}
        return [pa.table({c: new.get(c, texts.table[c] if c in extra else None) for c in schema.names})]

    return _deduped(docs, length, hot, extra, report, schema, pa.concat_tables)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(len(g))) AS i, unnest(g) AS g FROM (SELECT doc_id, [md5(substr(h, 2 * i + 1, 200)) for i in range(length(h) // 2 - 99)] AS g FROM d WHERE length(h) >= 200) x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w) x WHERE n > 1),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM o),
s AS (SELECT doc_id, s, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY doc_id, s),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM s),
t AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head, max(b) AS last FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(concat(coalesce(head, ''), substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT))))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
