"""Best-fit packing of documents into sequences, with conflicts.

A bin (one training sequence of ``capacity`` words) holds at most one piece of each source and at most one of each
duplicate cluster.  Bins stand in order of their residual room and carry a source and a cluster bitmap; each piece,
longest first, looks from the tightest bin that has room through its successors until a bin without conflict is found,
or opens a bin.  Pieces are dealt by hash into shards of about ``shard`` pieces, each packed by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .host_rules import SPACE_RE, SPACES
from .shared import stored

RESULT = "doc_id long, piece int, start long, n_words long, bin_id long, at long"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, place) of each piece; pieces are taken in the order given."""
    bit: dict = {}
    kind: dict = {}
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[list[int]] = []  # source and cluster bitmaps by bin
    out = []
    for n, s, c in zip(lengths, sources, clusters):
        sb, cb = 1 << bit.setdefault(s, len(bit)), 1 << kind.setdefault(c, len(kind))
        i = bisect_left(order, (n, -1))
        while i < len(order) and (held[order[i][1]][0] & sb or held[order[i][1]][1] & cb):
            i += 1
        if i < len(order):
            room, b = order.pop(i)
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= sb
        held[b][1] |= cb
        out.append((b, capacity - room))
        if room > n:
            insort(order, (room - n, b))
    return out


def packed(docs: DataFrame, capacity: int = 2048, shard: int = 4096, cluster: str | None = None, length: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start (first word), n_words, bin_id, at (place in the bin).

    A document of more than ``capacity`` words is cut into pieces, which never meet in a bin.  ``cluster`` names a
    column with the duplicate cluster; without it, documents of the same words (case and white space aside) are one.
    ``length`` names a column with each document's length, as of its tokens, which then is the unit of all places and
    of ``capacity``; without it, words are counted.
    A null source is a source of its own; a null, empty or blank text gives one piece of no words in no bin (null);
    repeated rows are packed as often as they stand, in different bins; rows without doc_id are left out; an empty
    table gives an empty result; other columns are ignored.
    """
    text = F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES))
    group = F.col(cluster).cast("string") if cluster else F.md5(F.regexp_replace(F.lower(text), SPACE_RE, " ").cast("binary"))
    count = F.coalesce(F.col(length), F.lit(0)).cast("long") if length else F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, SPACE_RE))).cast("long")
    lengths = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), group.alias("cluster"), count.alias("n"))
    pieces = lengths.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(capacity))).alias("piece", "start"))
    pieces = stored(pieces.select("doc_id", "source", "cluster", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).alias("n_words")), "pieces")
    shards = max(1, -(-pieces.where("n_words > 0").count() // shard))
    dealt = pieces.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)).cast("int"))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        number = t["shard"][0].as_py() << 32
        placed = best_fit(t["n_words"].to_pylist(), t["source"].to_pylist(), t["cluster"].to_pylist(), capacity)
        t = t.select(["doc_id", "piece", "start", "n_words"])
        return t.append_column("bin_id", pa.array([number + b for b, _ in placed], pa.int64())).append_column("at", pa.array([a for _, a in placed], pa.int64()))

    none = pieces.where("n_words = 0").select("doc_id", "piece", "start", "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("at"))
    return dealt.groupBy("shard").applyInArrow(one, RESULT).unionByName(none)
