"""N-gram Jaccard join: connected groups of documents whose word-shingle sets are alike.

1. Shingles are counted over the corpus (packed hashes, once a chunk).  A set with too many shingles of its own can
   link with no other and leaves.
2. The sets left, rarest shingles first, meet others on their prefix: two sets alike share one of its shingles.
   Each shingle gives star edges, so the edges are as many as the prefixes; their components bound where links are.
3. A component of at most ``tile`` sets is one tile.  A larger one is first cut by partition signatures, which sets
   that share no more than some passages do not have in common; what stays large is cut into size-banded tiles (only
   the same or the next band can link).  Within a tile, hashed bitmap signatures bound the overlap from above by bit
   counts, and what passes is decided by exact intersection of sorted arrays; sets already connected aren't compared.
4. A component of several tiles shares ``pivots`` sets among its tiles, which connects most of it.  The sets still
   apart from its largest group then meet all its other sets, a piece of about ``tile`` of them and a tile at a time.
   So no link is lost, no task gets more than about twice ``tile`` sets, and copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Texts, Words, by_chunk, by_owner, chunked, cut, deltas, groups, key_bits, mix, owners, pack, undeltas, unpack, with_answers
from .shared import components, stored

#: Bits of a probe's key at least.
PROBE_BITS = 44
SIGNATURE_BITS = 1024
SETS = "doc_id long, n long, s1 long, s2 long, prefix array<long>, tokens binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _table(out: list) -> pa.Table:
    cols = zip(*out) if out else ([],) * 6
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SETS)], schema=_SETS)


class _Sets:
    """Distinct shingles of each document of a chunk, sorted by document and hash."""

    def __init__(self, texts: Texts, k: int, bits: int):
        w = Words(texts, lower=True)
        at, key = w.windows(k)
        doc = w.doc[at]
        few = np.flatnonzero((w.count > 0) & (w.count < k))
        key = np.concatenate([key, w.spans(w.first[few], w.count[few])])
        doc = np.concatenate([doc, few])
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)]
        self.key, self.doc = key[new], doc[new]
        m = len(texts.ids)
        self.n = np.bincount(self.doc, minlength=m)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        full = np.flatnonzero(self.n)
        self.s1, self.s2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        if len(full):
            self.s1[full] = np.add.reduceat(self.key, self.first[full])
            self.s2[full] = np.add.reduceat(mix(self.key ^ np.uint64(0x5851F42D4C957F2D)), self.first[full])
        # of equal sets in the chunk, the smallest doc_id stands for all
        order = np.lexsort((texts.ids, self.s2, self.s1))
        self.rep = np.zeros(m, bool)
        same = np.concatenate([[False], (self.s1[order][1:] == self.s1[order][:-1]) & (self.s2[order][1:] == self.s2[order][:-1])])[:m]
        self.rep[order[~same]] = True
        self.rep &= self.n > 0
        mine = self.rep[self.doc]
        self.sorted = np.sort(self.key[mine] >> np.uint64(64 - bits))
        self.begin = groups(self.sorted)


def shingle_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Every document's set size and set hash; prefix and tokens of those that may link (once a chunk of equal sets)."""
    buckets, bits = owners(docs), key_bits(docs, PROBE_BITS)
    chunks = chunked(docs)

    def probe(chunk: int, texts: Texts) -> list:
        s = _Sets(texts, k, bits)
        key = s.sorted[s.begin]
        n = np.minimum(np.diff(np.append(s.begin, len(s.sorted))), 65535).astype(np.uint16)
        c = cut(key, buckets, bits)
        return [(chunk, b, pack(deltas(key[i:j]), n[i:j])) for b, (i, j) in enumerate(zip(c, c[1:])) if j > i]

    def count(sent: list[bytes]) -> list[bytes]:
        """How common each shingle is: 0 for one set only, else 1 + 8 times the logarithm of the count."""
        parts = [unpack(x) for x in sent]
        key = np.concatenate([undeltas(a) for a, _ in parts])
        n = np.concatenate([x for _, x in parts]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        first = groups(key[order])
        total = np.add.reduceat(n[order], first)
        code = np.empty(len(key), np.uint8)
        code[order] = np.repeat(np.minimum(np.where(total > 1, 1 + 8 * np.log2(total), 0), 255).astype(np.uint8), np.diff(np.append(first, len(key))))
        return [pack(x) for x in np.split(code, np.cumsum([len(a) for a, _ in parts])[:-1])]

    def sets(chunk: int, texts: Texts, got: dict[int, bytes]) -> list:
        s = _Sets(texts, k, bits)
        key = s.sorted[s.begin]
        c = cut(key, buckets, bits)
        code = np.zeros(len(key), np.uint8)
        for b, x in got.items():
            code[c[b] : c[b + 1]] = unpack(x)[0]
        own = np.zeros(len(s.key), np.uint8)
        mine = s.rep[s.doc]
        own[mine] = code[np.searchsorted(key, s.key[mine] >> np.uint64(64 - bits))]
        shared = np.concatenate([[0], np.cumsum(own > 0)])
        shared = shared[s.first[1:]] - shared[s.first[:-1]]
        linkable = s.rep & (100 * shared >= percent * s.n)
        out = []
        cols = (texts.ids, s.n, s.s1.view(np.int64), s.s2.view(np.int64), linkable, s.first[:-1])
        for i, n, a, b, link, f in zip(*(x.tolist() for x in cols)):
            prefix = tokens = None
            if link:
                t, rare = s.key[f : f + n], own[f : f + n]
                order = np.lexsort((t, rare))[: n - -(-percent * n // 100) + 1]
                prefix, tokens = t[order[rare[order] > 0]].view(np.int64), t.tobytes()
            out.append((i, n, a, b, prefix, tokens))
        return out

    return with_answers(chunks, by_owner(by_chunk(chunks, probe), count), sets, SETS, _table)


def _links(ids: np.ndarray, tokens: list[np.ndarray], active: np.ndarray, apart: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Star edges that connect all linked sets of a tile.  At least one of a compared pair is active; equal ``apart`` values are known to be connected."""
    m = len(ids)
    size = np.array([len(t) for t in tokens])
    order = np.lexsort((ids, size))
    size, tokens, ids, active, apart = size[order], [tokens[i] for i in order], ids[order], active[order], apart[order]
    bits = np.zeros((m, SIGNATURE_BITS // 64), np.uint64)
    for i, t in enumerate(tokens):
        flat = np.zeros(SIGNATURE_BITS, bool)
        flat[(t >> np.uint64(20)) % np.uint64(SIGNATURE_BITS)] = True
        bits[i] = np.packbits(flat).view(np.uint64)
    ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    root = np.arange(m)
    for group in pd.Series(range(m)).groupby(apart).indices.values():
        root[group] = group[0]
    for i in range(m):
        # sets before i are no larger; beyond the band they can't link
        low = np.searchsorted(100 * size, percent * size[i])
        js = np.arange(low, i)
        js = js[(root[js] != root[i]) & (active[js] | active[i])]
        if not len(js):
            continue
        both = np.bitwise_count(bits[js] & bits[i]).sum(axis=1).astype(np.int64)
        # shingles outside the intersection leave at least so many bits of their own
        most = np.minimum(size[js] - (ones[js] - both), size[i] - (ones[i] - both))
        js = js[100 * most >= percent * (size[js] + size[i] - most)]
        for j in js[::-1].tolist():
            if root[j] == root[i]:
                continue
            inter = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))
            if 100 * inter >= percent * (size[i] + size[j] - inter):
                root[root == root[j]] = root[i]
    low = pd.Series(ids).groupby(root).transform("min").to_numpy()
    return list(zip(ids[low < ids].tolist(), low[low < ids].tolist()))


def _tiled(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges within each tile of rows (tile, rid, tokens, active, apart)."""

    def one(t: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]
        edges = _links(t["rid"].to_numpy(), tokens, t["active"].to_numpy(zero_copy_only=False), t["apart"].to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return tiles.groupBy("tile").applyInArrow(one, "a long, b long")


def _signatures(percent: int):
    """(rid, component, sig) of rows (rid, component, band, tokens): sets that link share one.

    Of two linked sets, the smaller in band b, at most ``most`` shingles stand in only one.  Dealt by hash into more
    than so many parts, some part holds the same shingles in both.  A part is a signature by its number and contents;
    empty parts are signatures only of sets with more than ``spare`` of them, as some other part agrees else.
    """
    step = _step(percent)

    def one(band: int, tokens: np.ndarray) -> np.ndarray:
        most = int(np.exp((band + 1) * step) * (1 + 1e-6) * (100 - percent) / percent)
        spare = most // 50 + (most >= 4)
        parts = most + 1 + spare
        part = (mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        number = part[order]
        first = groups(number)
        number, content = number[first], np.add.reduceat(mix(tokens[order] ^ np.uint64(0x9FB21C651E98DF25)), first)
        if parts - len(number) > spare:
            empty = np.setdiff1d(np.arange(parts), number, assume_unique=True)
            number, content = np.concatenate([number, empty]), np.concatenate([content, np.zeros(len(empty), np.uint64)])
        return mix(content * np.uint64(0x9E3779B97F4A7C15) + (number + (band << 32)).astype(np.uint64))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, component, band, tokens in zip(*(batch[c].to_pylist() for c in ("rid", "component", "band", "tokens"))):
                t = np.frombuffer(tokens, np.uint64)
                sig = np.concatenate([one(b, t) for b in (band, band - 1) if b >= 0])
                ids = [pa.array(np.full(len(sig), x, np.int64)) for x in (rid, component)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(sig.view(np.int64))], ["rid", "component", "sig"])

    return every


def _step(percent: int) -> float:
    """Width of a band in log sizes: a link stays within a band or goes to the next."""
    return float(np.log(100 / percent)) * (1 + 1e-9)


def _split(large: DataFrame, percent: int) -> DataFrame:
    """Components of shared prefixes cut into components of shared signatures; sets that share none can't link and go."""
    sigs = stored(large.mapInArrow(_signatures(percent), "rid long, component long, sig long"), "signatures")
    roots = sigs.groupBy("component", "sig").agg(F.min("rid").alias("root"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = components(sigs.join(roots, ["component", "sig"]).where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    return large.drop("component").join(near, F.col("rid") == F.col("id")).select("rid", "component", "band", "tokens")


def _home_tiles(large: DataFrame, salts: DataFrame, tile: int, pivots: int) -> DataFrame:
    """Every set in the tile of its band and salt, and the pivots of a component in all tiles that they may link with."""
    cols = [F.concat_ws("/", "component", "to", "salt").alias("tile"), "rid", "tokens", F.lit(True).alias("active"), F.col("rid").alias("apart")]
    # the pivots of a band: those whose hash falls in a bounded share of it
    chosen = large.where(F.pmod(F.xxhash64("rid", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("salts") * tile / pivots))) == 0)
    other = salts.select("component", F.col("band").alias("to"), F.col("salts").alias("to_salts"))
    visits = chosen.drop("salt").withColumn("to", F.explode(_bands("band"))).join(other, ["component", "to"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("to_salts") - 1)))
    return large.withColumn("to", F.col("band")).select(*cols).unionByName(visits.select(*cols)).dropDuplicates(["tile", "rid"])


def _bands(band: str) -> Column:
    return F.array(*[F.col(band) + d for d in (-1, 0, 1)])


def _pair_tiles(labelled: DataFrame, salts: DataFrame, tile: int) -> DataFrame:
    """Tiles where the sets still apart from a component's main group meet every other set of it.

    Those sets are dealt into pieces of about ``tile``; a tile is one piece and one home tile, so it never holds more
    than about twice ``tile`` sets, however large the component is.
    """
    rest = labelled.where("group <> main")
    pieces = rest.groupBy("component", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("pieces"))
    name = F.concat_ws("/", "component", "to", "salt", "from", "piece").alias("tile")
    cols = [name, "rid", "tokens", "active", F.col("group").alias("apart")]
    visitors = rest.join(pieces, ["component", "band"]).withColumn("piece", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("pieces")).cast("int")).drop("salt", "salts")
    other = salts.select("component", F.col("band").alias("to"), F.col("salts").alias("to_salts"))
    visitors = visitors.withColumn("from", F.col("band")).withColumn("to", F.explode(_bands("band"))).join(other, ["component", "to"])
    visitors = visitors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("to_salts") - 1))).withColumn("active", F.lit(True))
    hosts = labelled.withColumn("to", F.col("band")).withColumn("from", F.explode(_bands("band"))).join(pieces.withColumnRenamed("band", "from"), ["component", "from"])
    hosts = hosts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("active", F.lit(False))
    both = hosts.select(*cols).unionByName(visitors.select(*cols))
    return both.groupBy("tile", "rid", "apart").agg(F.max("active").alias("active"), F.first("tokens").alias("tokens"))


def linked(docs: DataFrame, k: int = 5, percent: int = 80, tile: int = 512, pivots: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of Jaccard similarity >= percent / 100.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer than k words the whole sequence is the one
    shingle; a null, empty or blank text has an empty set, linked with nothing.  Repeated rows of one doc_id each give
    a row, and all of them the component of the smallest doc_id that any of the rows' sets is linked with; rows
    without doc_id are left out; other columns are ignored; an empty table gives an empty result.

    Shingles are 64-bit hashes and equal sets have equal pairs of 64-bit sums, so a false link needs a collision
    within one compared pair: for sets of n shingles a chance of about n**2 / 2**64.
    """
    sets = stored(shingle_sets(docs, k, percent), "sets")
    # one set for all equal ones
    reps = stored(sets.where("tokens IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rid")), "reps")
    own = sets.where("tokens IS NOT NULL").withColumnRenamed("doc_id", "rid").select("s1", "s2", "rid", "n", "prefix", "tokens")
    distinct = own.join(reps, ["s1", "s2", "rid"], "left_semi").dropDuplicates(["rid", "s1", "s2"])
    prefix = distinct.select("rid", F.explode("prefix").alias("token"))
    roots = prefix.groupBy("token").agg(F.min("rid").alias("root"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = components(prefix.join(roots, "token").where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    placed = stored(distinct.join(near, F.col("rid") == F.col("id")).select("rid", "component", F.floor(F.log(F.col("n")) / F.lit(_step(percent))).cast("int").alias("band"), "tokens"), "placed")
    over = lambda df: df.groupBy("component").count().where(F.col("count") > tile).select("component")
    single = lambda df: df.select(F.col("component").cast("string").alias("tile"), "rid", "tokens", F.lit(True).alias("active"), F.col("rid").alias("apart"))
    big = over(placed)
    tiles, large = single(placed.join(big, "component", "left_anti")), None
    if big.limit(1).count():
        fine = stored(_split(placed.join(big, "component", "left_semi"), percent), "split")
        tiles = tiles.unionByName(single(fine.join(over(fine), "component", "left_anti")))
        salts = fine.join(over(fine), "component", "left_semi").groupBy("component", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("salts"))
        large = fine.join(salts, ["component", "band"]).withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int"))
        tiles = tiles.unionByName(_home_tiles(large, salts, tile, pivots))
    edges = stored(_tiled(tiles, percent), "links")
    group = components(edges)
    if large is not None:
        named = stored(large.select("rid", "component").join(group.withColumnRenamed("component", "group"), F.col("rid") == F.col("id"), "left").select("rid", "component", F.coalesce("group", "rid").alias("group")), "groups")
        sizes = named.groupBy("component", "group").count()
        main = sizes.groupBy("component").agg(F.max(F.struct("count", "group")).alias("m")).select("component", F.col("m.group").alias("main"))
        labelled = large.join(named.select("rid", "group"), "rid").join(main, "component")
        if labelled.where("group <> main").limit(1).count():
            group = components(edges.unionByName(stored(_tiled(_pair_tiles(labelled, salts, tile), percent), "links")))
    # copies take what their set's representative has; empty sets stay out of the join on set hashes
    classes = reps.join(group, F.col("rid") == F.col("id"), "left").select("s1", "s2", F.coalesce("component", "rid").alias("root"))
    some = sets.where("n > 0").select("doc_id", "n", "s1", "s2")
    classes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("own")).join(classes, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("root", "own").alias("root"))
    out = some.join(classes, ["s1", "s2"]).select("doc_id", "n", F.col("root").alias("component_id"))
    out = out.unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
