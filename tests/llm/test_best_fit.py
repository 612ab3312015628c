import random

from common import SF, awkward, empty
from docops.llm.best_fit import best_fit, packed
from docops.llm.queries import op3_best_fit


def brute(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n and s not in b["s"] and c not in b["c"]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return out


def test_best_fit_against_plain_search():
    r = random.Random(2)
    for _ in range(30):
        n = r.randrange(1, 150)
        lengths = sorted((r.randrange(1, 101) for _ in range(n)), reverse=True)
        sources, clusters = [r.choice("aaabcdefgh") for _ in range(n)], [r.randrange(n) for _ in range(n)]
        assert best_fit(lengths, sources, clusters, 100) == brute(lengths, sources, clusters, 100)


def valid(rows, n_words, capacity):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.bin_id is not None:
            by_bin.setdefault(r.bin_id, []).append(r)
    for i, n in n_words.items():
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_words for r in got) == n and [r.start for r in got] == [k * capacity for k in range(len(got))]
    for b in by_bin.values():
        b.sort(key=lambda r: r.at)
        assert all(x.at + x.n_words == y.at for x, y in zip(b, b[1:])) and b[0].at == 0 and b[-1].at + b[-1].n_words <= capacity
        assert len({r.doc_id for r in b}) == len(b)
    return by_bin


def test_awkward(spark):
    df, texts = awkward(spark)
    rows = packed(df, capacity=250, shard=20).collect()
    bins = valid(rows, {i: len((t or "").split()) for i, t in texts.items()}, 250)
    source = {r.doc_id: r.source for r in df.collect()}
    for b in bins.values():
        assert len({source[r.doc_id] for r in b}) == len(b)
        assert len({" ".join((texts[r.doc_id] or "").lower().split()) for r in b}) == len(b)


def test_empty(spark):
    assert packed(empty(spark)).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    valid(op3_best_fit(spark, SF).collect(), {d.doc_id: len(d.text.split()) for d in docs}, 2048)
