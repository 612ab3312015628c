"""Quality classifier: an interpolated modified Kneser-Ney model of byte 4-grams, trained on the trusted documents.

All trusted text is counted: a chunk sends its 4-grams' counts to their owners, and continuation counts, discounts and
back-off weights are DataFrame aggregations.  To score, each chunk asks the owners for its distinct 4-grams; sharded
joins of the tables give their probabilities.  A document's perplexity is held against a quantile of its language's
trusted documents of its length, as short texts' perplexities spread more; it is taken on a fold that a second model has
not seen.  Nothing of the models is broadcast or gathered but four counts of counts an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import ROW, Texts, blobs, by_chunk, chunked, cut, deltas, frame, give_back, groups, pack, sent, undeltas, unframe, unpack, with_answers
from .shared import partitions, stored

CHUNK = 4 << 20
#: 4-grams that are looked up at a time.
PIECE = 1 << 18
#: Rows of limits by language and length up to which they are broadcast.
LIMITS = 10_000
SCORES = "doc_id long, lang string, n_bytes long, bits double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("bits", pa.float64())])
#: An odd factor that spreads 4-grams evenly over the owners, and its inverse modulo 2**32.
SPREAD = 2654435769
UNSPREAD = pow(SPREAD, -1, 1 << 32)


def _scores(out: list) -> pa.Table:
    cols = zip(*out) if out else ([],) * 4
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SCORES)], schema=_SCORES)


def _grams(texts: Texts) -> np.ndarray:
    """The 4-gram that ends at each byte of a document (line feeds stand before its start), spread; 32 bits each.

    Bytes are shifted, never gathered by place: what a chunk takes is some ten times its text, not a hundred.
    """
    data = texts.data
    gram = data.astype(np.uint32)
    before = np.empty_like(data)
    for back in (1, 2, 3):
        before[:back], before[back:] = 10, data[:-back] if len(data) > back else 10
        for place in range(back):  # a document's first bytes; past a short one's end stand others' first bytes, or line feeds
            at = texts.starts + place
            before[at[at < len(data)]] = 10
        gram |= before.astype(np.uint32) << np.uint32(8 * back)
    gram *= np.uint32(SPREAD)  # modulo 2**32
    inside = np.ones(len(data), bool)
    inside[texts.ends] = False
    return gram[inside]


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of an order from its counts of counts."""
    n = table.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(int(x), 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounted(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, top): the discounted count; (h, total, freed): its context's total and what the discounts freed."""
    d = _discounts(table)
    cut_: Column = F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
    own = table.select("k", F.shiftright("k", 8).alias("h"), "c", cut_.alias("d"))
    return own.select("k", (F.col("c") - F.col("d")).alias("top")), own.groupBy("h").agg(F.sum("c").cast("double").alias("total"), F.sum("d").alias("freed"))


def _tables(grams: DataFrame) -> dict[int, DataFrame]:
    """(k, c) by order: counts of 4-grams, and of how many different bytes stand before shorter ones."""
    orders = {4: grams}
    for n in (3, 2, 1):
        orders[n] = stored(orders[n + 1].groupBy(F.col("k").bitwiseAND((1 << 8 * n) - 1).alias("k")).agg(F.count("*").alias("c")), "grams")
    return orders


def _scored(chunks: DataFrame, orders: dict[int, DataFrame], buckets: int) -> DataFrame:
    """doc_id, lang, n_bytes and bits a byte of every document of the chunks under the model of these counts."""

    def ask(chunk: int, texts: Texts) -> list:
        key = np.unique(_grams(texts)).astype(np.uint64)
        c = cut(key, buckets, 32)
        return [(chunk, b, pack(deltas(key[i:j]))) for b, (i, j) in enumerate(zip(c, c[1:])) if j > i]

    asked = by_chunk(chunks, ask)

    def distinct(t: pa.Table) -> pa.Table:
        key = np.unique(np.concatenate([undeltas(unpack(x)[0]) for p in t["payload"].to_pylist() for _, x in unframe(p)]))
        gram = (key * np.uint64(UNSPREAD) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        give_back()
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()] * len(key), pa.int32()), "spread": pa.array(key.astype(np.int64)), "k": pa.array(gram)})

    grams = asked.groupBy("bucket").applyInArrow(distinct, "bucket int, spread long, k long").withColumn("p", F.lit(1 / 256))
    for n in (1, 2, 3, 4):
        tops, contexts = _discounted(orders[n])
        own = F.col("k").bitwiseAND((1 << 8 * n) - 1)
        grams = grams.withColumn("own", own).join(tops.withColumnRenamed("k", "own"), "own", "left").withColumn("h", F.shiftright("own", 8)).join(contexts, "h", "left")
        grams = grams.withColumn("p", F.when(F.col("total") > 0, (F.coalesce("top", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total")).otherwise(F.col("p"))).drop("own", "h", "top", "total", "freed")
    probabilities = grams.select("bucket", "spread", (-F.log2("p")).cast("float").alias("bits"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        known, bits = right["spread"].to_numpy(), right["bits"].to_numpy()
        order = np.argsort(known)
        known, bits = known[order], bits[order]
        reply = lambda x: pack(bits[np.searchsorted(known, undeltas(unpack(x)[0]).astype(np.int64))])
        back = [frame([(c, reply(x)) for c, x in unframe(p)]) for p in left["payload"].to_pylist()]
        give_back()
        return pa.Table.from_arrays([left["part"].combine_chunks(), left["bucket"].combine_chunks(), pa.array(back, pa.binary())], ["part", "bucket", "payload"])

    def score(chunk: int, texts: Texts, got: dict[int, bytes]) -> list:
        gram = _grams(texts)
        key = np.unique(gram)
        c = cut(key.astype(np.uint64), buckets, 32)
        bits = np.zeros(len(key), np.float64)
        for b, x in got.items():
            bits[c[b] : c[b + 1]] = unpack(x)[0]
        total = np.zeros(len(gram) + 1)
        for i in range(0, len(gram), PIECE):
            total[i + 1 : i + 1 + PIECE] = bits[np.searchsorted(key, gram[i : i + PIECE])]
        np.cumsum(total, out=total)
        end = np.cumsum(texts.lengths)
        mean = (total[end] - total[end - texts.lengths]) / np.maximum(texts.lengths, 1)
        return [(i, lang, n, m if n else None) for i, lang, n, m in zip(texts.ids.tolist(), texts.table["lang"].to_pylist(), texts.lengths.tolist(), mean.tolist())]

    answers = asked.groupBy("bucket").cogroup(probabilities.groupBy("bucket")).applyInArrow(answer, ROW)
    return stored(with_answers(chunks, answers, score, SCORES, _scores), "scores")


def _length() -> Column:
    """Which length a text has: 0 under 256 bytes, 1 under four times that, and so on."""
    return F.greatest(F.lit(0), F.floor((F.length(F.bin("n_bytes")) - 1) / 2) - 3).cast("int")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, weight: float = 50.0, folds: int = 8) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a byte), threshold, kept of every document.

    The model is of all trusted documents (labels.quality = 1).  threshold: the ``quantile`` of the bits a byte of the
    trusted documents of one language and length in one fold in ``folds``, each under a model of the other folds; it is
    shrunk towards that of all languages of that length by ``weight`` documents, and this one likewise towards that of
    all documents, so a language or length without a document in that fold has the wider limit (a null language counts
    as one).  Lengths: under 256 bytes, under four times that, and so on by factors of four, so 29 at most.  A null or
    empty text has no perplexity and isn't kept; without trusted text in that
    fold every other one is.  Texts of any length are scored whole; repeated rows are judged alike; rows without doc_id
    are left out; an empty table gives an empty result; other columns are ignored.
    """
    buckets = partitions(docs.sparkSession)
    docs = docs.withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    chunks = chunked(docs, ("lang",), CHUNK)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part of each document: chunks stay where they are made, only ids are sent."""
        for b in batches:
            for part, blob in zip(b["part"].to_pylist(), b["blob"].to_pylist()):
                ids = Texts(blob).table["doc_id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int64()), ids], ["part", "doc_id"])

    listed = chunks.mapInArrow(listing, "part long, doc_id long")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(folds)) == 0).alias("held")
    trusted = stored(listed.join(good.select("doc_id", held), "doc_id"), "trusted")

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts of all 4-grams of trusted text and of those outside the held fold, by owner; at bucket -1 the held documents."""
        out = []
        ids, held = right["doc_id"].to_numpy(), right["held"].to_numpy(zero_copy_only=False)
        for chunk, texts in blobs(left):
            apart = np.isin(texts.ids, ids[held])
            gram = _grams(texts)
            mine, own = np.isin(texts.ids, ids), np.repeat(apart, texts.lengths)
            mine = np.repeat(mine, texts.lengths)
            key = np.sort(gram[mine])
            first = groups(key)
            key, n = key[first].astype(np.uint64), np.diff(np.append(first, len(key))).astype(np.uint32)
            rest = n.copy()
            away, times = np.unique(gram[own], return_counts=True)
            rest[np.searchsorted(key, away)] -= times.astype(np.uint32)
            c = cut(key, buckets, 32)
            out += [(chunk, b, pack(deltas(key[i:j]), n[i:j], rest[i:j])) for b, (i, j) in enumerate(zip(c, c[1:])) if j > i]
            if apart.any():
                out.append((chunk, -1, Texts.packed(texts.table.filter(pa.array(apart)))))
        return sent(left["part"][0].as_py() if len(left) else 0, out)

    def add(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for p in t["payload"].to_pylist() for _, x in unframe(p)]
        key = np.concatenate([undeltas(k) for k, *_ in parts])
        order = np.argsort(key, kind="stable")
        first = groups(key[order])
        gram = key[order][first] * np.uint64(UNSPREAD) & np.uint64(0xFFFFFFFF)
        sums = [np.add.reduceat(np.concatenate([p[i] for p in parts]).astype(np.int64)[order], first) for i in (1, 2)]
        give_back()
        return pa.table({"k": pa.array(gram.astype(np.int64)), "c": pa.array(sums[0]), "rest": pa.array(sums[1])})

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, payload in zip(b["part"].to_pylist(), b["payload"].to_pylist()):
                c, x = zip(*unframe(payload))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(c), pa.int64()), pa.array(c, pa.int64()), pa.array(x, pa.binary())], ["part", "chunk", "blob"])

    told = stored(chunks.groupBy("part").cogroup(trusted.groupBy("part")).applyInArrow(tell, ROW), "counts")
    grams = stored(told.where("bucket >= 0").groupBy("bucket").applyInArrow(add, "k long, c long, rest long"), "grams")
    scores = _scored(chunks, _tables(grams.select("k", "c")), buckets)
    chosen = told.where("bucket < 0").mapInArrow(apart, "part long, chunk long, blob binary")
    marks = _scored(chosen, _tables(grams.where("rest > 0").select("k", F.col("rest").alias("c"))), buckets)
    marks = marks.where("bits IS NOT NULL").withColumn("length", _length())
    found = (F.percentile_approx("bits", F.lit(quantile), 10000).alias("q"), F.count("*").alias("n"))
    overall = marks.agg(found[0]).scalar()
    towards = lambda wider: (F.col("n") * F.col("q") + weight * wider) / (F.col("n") + weight)
    by_length = stored(marks.groupBy("length").agg(*found), "limits").select("length", towards(overall).alias("length_limit"))
    own = marks.groupBy("lang", "length").agg(*found).join(F.broadcast(by_length), "length")
    own = stored(own.select("lang", "length", towards(F.col("length_limit")).alias("own_limit")), "limits")
    few = own.limit(LIMITS + 1).count() <= LIMITS
    judged = scores.withColumn("length", _length()).join(F.broadcast(by_length), "length", "left")
    judged = judged.join(F.broadcast(own) if few else own, ["lang", "length"], "left")
    judged = judged.withColumn("limit", F.coalesce("own_limit", "length_limit", overall))
    kept = F.col("bits").isNotNull() & (F.col("limit").isNull() | (F.col("bits") <= F.col("limit")))
    return judged.select("doc_id", "lang", "n_bytes", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "limit").alias("threshold"), kept.alias("kept"))
