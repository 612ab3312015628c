"""Fill-in-middle samples: texts cut at two unit boundaries and put together again in another order.

A unit is a run of A-Z, a-z or any other single code point.  A text is laid out in blocks of ``BLOCK`` bytes; a Fenwick
tree over the blocks holds how many units and how many code points begin in each.  A cut after u units goes down the
tree by binary lifting to the block in which unit u begins, and its byte is looked up among that block's units alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block, and bytes of text that are laid out at once.
BLOCK, SPAN = 2048, 4 << 20
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that begin a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80


class Fenwick:
    """Two counts by block: units and code points that begin there."""

    def __init__(self, units: list[int], points: list[int]):
        self.size = len(units)
        self.units, self.points = [0, *units], [0, *points]
        for i in range(1, self.size + 1):
            up = i + (i & -i)
            if up <= self.size:
                self.units[up] += self.units[i]
                self.points[up] += self.points[i]

    def descend(self, unit: int) -> tuple[int, int, int]:
        """The block in which that unit (counted from 0) begins, with the units and code points of the blocks before it."""
        at = units = points = 0
        step = 1 << self.size.bit_length()
        while step := step >> 1:
            below = at + step
            if below <= self.size and units + self.units[below] <= unit:
                at = below
                units += self.units[below]
                points += self.points[below]
        return at, units, points


class Layout:
    """Unit and code-point beginnings of some texts' joined bytes, counted by block; blocks never cross texts."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.starts = np.concatenate([[0], ends[:-1]])
        self.lengths = ends - self.starts
        letter = _LETTER[data]
        self.lead = _LEAD[data]
        goes_on = np.zeros(len(data), bool)
        goes_on[1:] = letter[1:] & letter[:-1]
        goes_on[self.starts[self.lengths > 0]] = False
        self.unit = self.lead & ~goes_on
        self.blocks = -(-self.lengths // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        place = np.arange(self.blocks.sum()) - np.repeat(self.first, self.blocks)
        edges = np.repeat(self.starts, self.blocks) + place * BLOCK
        counted = (np.add.reduceat(x.view(np.uint8), edges, dtype=np.int64).tolist() if len(edges) else [] for x in (self.unit, self.lead))
        self.units, self.points = counted

    def tree(self, i: int) -> Fenwick:
        own = slice(self.first[i], self.first[i] + self.blocks[i])
        return Fenwick(self.units[own], self.points[own])

    def cut(self, i: int, tree: Fenwick, unit: int) -> tuple[int, int]:
        """The byte of text i where that unit begins, and the code points before it; of a unit past the last, the end."""
        block, units, points = tree.descend(unit)
        if block == tree.size:
            return int(self.lengths[i]), points
        at = self.starts[i] + block * BLOCK
        here = self.unit[at : min(at + BLOCK, self.starts[i] + self.lengths[i])]
        within = int(np.flatnonzero(here)[unit - units])
        return block * BLOCK + within, points + int(np.count_nonzero(self.lead[at : at + within]))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prefix, suffix, middle = (m.encode() for m in MARKS)
    for batch in batches:
        texts = batch["text"].to_pylist()
        hashes = list(zip(*(batch[c].to_pylist() for c in ("h1", "h2", "form"))))
        sizes = np.cumsum([len(t) for t in texts])
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SPAN)))
            layout = Layout(np.frombuffer(b"".join(texts[i:j]), np.uint8), sizes[i:j] - (sizes[i - 1] if i else 0))
            rows = []
            for k, (text, (h1, h2, form)) in enumerate(zip(texts[i:j], hashes[i:j])):
                tree = layout.tree(k)
                n = tree.descend(len(text))[1]
                if form == "plain":
                    rows.append((n, form, None, None, text))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                (a, before), (b, until) = layout.cut(k, tree, low), layout.cut(k, tree, high)
                head, mid, tail = text[:a], text[a:b], text[b:]
                parts = [prefix, head, suffix, tail] if form == "psm" else [suffix, tail, prefix, head]
                rows.append((n, form, before, until - before, b"".join([*parts, middle, mid])))
            columns = [batch["doc_id"][i:j], *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_OUT)[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)
            i = j


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points) and output of each document.

    Cuts and form come from the SHA-256 of ``seed``:doc_id, so they are the same wherever and whenever a row is worked
    on.  A null text is empty; an empty text and one that holds a mark are plain, as are ``plain_percent`` of the rest;
    texts of any length are cut whole; repeated rows are cut alike; rows without doc_id are left out; an empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", h1.alias("h1"), h2.alias("h2"), form.alias("form"), F.col("text").cast("binary").alias("text"))
    cut = rows.mapInArrow(_samples, SCHEMA.replace("output string", "output binary"))
    return cut.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  No text with a mark is cut, so each mark's first place is the mark's own."""

    def cut(whole: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(whole, mark, 1)
        return head, F.substring(whole, F.length(head) + 1 + len(mark), F.length(whole))

    prefix, suffix, middle = MARKS
    body = F.substring(output, 1 + len(prefix), F.length(output))
    head, rest = cut(body, suffix)
    tail, mid = cut(rest, middle)
    psm = F.concat(head, mid, tail)
    tail, rest = cut(body, prefix)
    head, mid = cut(rest, middle)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(head, mid, tail)).otherwise(output)


def digests(samples: DataFrame) -> DataFrame:
    """The samples with hashes of output and restored text in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out, form = F.col("output"), F.col("form")
    return samples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(out).alias("output_sha256"), sha(restored(out, form)).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST(concat('0x', h[1:8]) AS UBIGINT) AS h1, CAST(concat('0x', h[9:16]) AS UBIGINT) AS h2,
    CAST(concat('0x', h[17:24]) AS UBIGINT) AS h3, CAST(concat('0x', h[25:32]) AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:len(u)], ''), '') AS s FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
WHERE doc_id IS NOT NULL
"""
