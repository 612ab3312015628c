import random
from collections import Counter, defaultdict

import numpy as np
from common import awkward, empty
from docops.llm.queries import op6_quality_lm
from docops.llm.quality_lm import quality


def brute(trusted, text):
    """Bits a byte under a plain interpolated modified Kneser-Ney model."""
    grams = lambda t: [(b"\n\n\n" + t)[i : i + 4] for i in range(len(t))]
    tables = {4: Counter(g for t in trusted for g in grams(t))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    parts = {}
    for n, t in tables.items():
        c = Counter(t.values())
        n1, n2, n3, n4 = (max(c[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, freed = defaultdict(float), defaultdict(float)
        for g, k in t.items():
            total[g[:-1]] += k
            freed[g[:-1]] += d[min(k, 3) - 1]
        parts[n] = (d, total, freed)

    def p(g):
        if not g:
            return 1 / 256
        d, total, freed = parts[len(g)]
        low = p(g[1:])
        if g[:-1] not in total:
            return low
        k = tables[len(g)][g]
        return ((k - d[min(k, 3) - 1] if k else 0) + freed[g[:-1]] * low) / total[g[:-1]]

    return float(np.mean([-np.log2(p(g)) for g in grams(text)]))


def test_model_against_plain_one(spark):
    df, texts = awkward(spark)
    good = [i for i in texts if i % 2 == 0]
    labels = spark.createDataFrame([(i, 1, "x") for i in good] + [(i, 0, "x") for i in texts if i % 5 == 1] + [(None, 1, "x"), (good[0], None, "x")], "doc_id long, quality int, lang string")
    rows = quality(df, labels).collect()
    assert len(rows) == len(texts)
    trusted = [(texts[i] or "").encode() for i in good]
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(t) and (r.perplexity is None) == (not t) and (t or not r.kept)
        if t and len(t) < 500:
            assert abs(np.log2(r.perplexity) - brute(trusted, t)) < 1e-4


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality(empty(spark), labels).collect() == []
    df, texts = awkward(spark)
    assert all(r.kept == bool(texts[r.doc_id]) for r in quality(df, labels).collect())


def test_limits_are_quantiles_of_a_fold_not_seen(spark):
    """By language: the held fold's documents under a model of the rest, shrunk towards all by weight; others have the limit of all."""
    r = random.Random(2)
    words = {"en": [f"the{c}" for c in "abcdefgh"], "de": [f"das{c}" for c in "ijklmnop"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randrange(5, 40))), lang) for i in range(400) for lang in ("de" if i % 4 == 0 else "en",)]
    rows += [(1000 + i, "".join(r.choice("xyzw#0123456789") for _ in range(60)), lang) for i, lang in enumerate(["en", "de", "fr", None] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i < 400], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality(df, labels, quantile=0.9, weight=10.0).collect()}
    held = {x.doc_id for x in labels.where("pmod(xxhash64(doc_id, 17), 8) = 0").collect()}
    rest = [t.encode() for i, t, _ in rows if i < 400 and i not in held]
    bits = {lang: sorted(brute(rest, t.encode()) for i, t, x in rows if i in held and x == lang) for lang in ("en", "de")}
    at = lambda b: sorted(b)[int(np.ceil(0.9 * len(b))) - 1]
    overall = at(bits["en"] + bits["de"])
    for lang in ("en", "de"):
        n = len(bits[lang])
        want = (n * at(bits[lang]) + 10 * overall) / (n + 10)
        assert all(abs(np.log2(x.threshold) - want) < 1e-4 for x in got.values() if x.lang == lang)
    assert all(abs(np.log2(x.threshold) - overall) < 1e-4 for x in got.values() if x.lang in ("fr", "")) and not any(got[1000 + i].kept for i in range(12))
    assert all(got[i].kept == (got[i].perplexity <= got[i].threshold) for i in range(400))


def test_limits_by_length(spark):
    """By language and length, shrunk towards the length, and that towards all; a length without held documents has the limit of all."""
    r = random.Random(3)
    words = {"en": [f"the{c}" for c in "abcdefgh"], "de": [f"das{c}" for c in "ijklmnop"]}
    sizes = (10, 80, 300)
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.choice(sizes))), lang) for i in range(300) for lang in ("de" if i % 3 == 0 else "en",)]
    rows += [(1000, "thea " * 2000, "en"), (1001, "x" * 255, "fr"), (1002, "x" * 256, "fr"), (1003, "é" * 512, None), (1004, "y" * 10, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i < 300], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality(df, labels, quantile=0.9, weight=7.0).collect()}
    held = {x.doc_id for x in labels.where("pmod(xxhash64(doc_id, 17), 8) = 0").collect()}
    rest = [t.encode() for i, t, _ in rows if i < 300 and i not in held]
    length = lambda t: next(k for k in range(20) if len(t.encode()) < 256 * 4**k)
    marks = [(lang, length(t), brute(rest, t.encode())) for i, t, lang in rows if i in held]
    at = lambda b: sorted(b)[int(np.ceil(0.9 * len(b))) - 1]
    towards = lambda b, wider: (len(b) * at(b) + 7 * wider) / (len(b) + 7) if b else wider
    overall = at([b for *_, b in marks])
    assert {k for _, k, _ in marks} == {0, 1, 2} and length(rows[300][1]) == 3
    for i, t, lang in rows:
        k = length(t)
        want = towards([b for x, y, b in marks if (x, y) == (lang, k)], towards([b for _, y, b in marks if y == k], overall))
        assert abs(np.log2(got[i].threshold) - want) < 1e-4
        assert got[i].kept == (got[i].perplexity <= got[i].threshold)


def test_bad_documents_of_every_language_go(spark):
    sf = "/root/testdata/sf0.1"
    kept = {r.doc_id: r for r in op6_quality_lm(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert np.mean([kept[x.doc_id].kept for x in labels if x.quality == 1]) > 0.985
    for lang in ("de", "en", "es", "fr"):
        bad = [not kept[x.doc_id].kept for x in labels if x.quality == 0 and kept[x.doc_id].lang == lang]
        print(lang, len(bad), np.mean(bad))
        assert np.mean(bad) >= 0.9


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in op6_quality_lm(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good, bad = [kept[x.doc_id] for x in labels if x.quality == 1], [kept[x.doc_id] for x in labels if x.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_grams_take_little_memory():
    """4-grams begin anew in each document, and a chunk takes a small multiple of its text to make them."""
    import tracemalloc

    import pyarrow as pa
    from docops.llm.chunks import Texts
    from docops.llm.quality_lm import SPREAD, _grams

    made = lambda texts: Texts(Texts.packed(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.binary())})))
    texts = [b"", b"a", b"bc", b"", b"", b"def", b"\n\xffgh\x00", b"ijklm"]
    padded = [b"\n\n\n" + x for x in texts]
    want = [int.from_bytes(x[i : i + 4], "big") * SPREAD % 2**32 for x in padded for i in range(len(x) - 3)]
    assert _grams(made(texts)).tolist() == want
    large = made([bytes(range(200)) * 10] * 1000)
    tracemalloc.start()
    _grams(large)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * len(large.data)
