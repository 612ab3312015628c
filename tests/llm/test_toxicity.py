import math
import random
import zlib
from collections import Counter

import numpy as np
from common import awkward, empty
from docops.llm import toxicity
from docops.llm.queries import op4_toxicity


def test_index_is_exact():
    rng = np.random.default_rng(4)
    v = 40
    vocabulary = {f"t{i}": i for i in range(v)}
    counts = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(v, rng.integers(1, 6), replace=False)} for _ in range(700)]
    index = toxicity.BlockMaxIndex(vocabulary, rng.random(v) + 0.5, counts, rng.integers(0, 2, 700).tolist(), list(range(700)), 0.1)
    dense = index.weights[:, :700]
    for c in counts[:100]:
        t, w = index.vector(c)
        every = w @ dense[t]
        found, cosine = index.nearest(c, 25)
        want = np.sort(every[every > 0])[::-1][:25]
        assert np.allclose(cosine, want) and np.allclose(every[found], cosine)


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op4_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(rows[x.doc_id].predicted, x.toxic, rows[x.doc_id].score) for x in labels if rows[x.doc_id].held_out]
    assert len(held) > 40 and all(0 <= s <= 1 for *_, s in held)
    assert np.mean([p == y for p, y, _ in held]) > 0.9
    assert len(rows) == 1000


def test_awkward(spark):
    df, texts = awkward(spark)
    labels = spark.createDataFrame([(i, int("w7" in (t or "")), None) for i, t in texts.items()] + [(None, 1, None), (1, None, None)], "doc_id long, toxic int, text string")
    rows = toxicity.score_toxicity(df, toxicity.fit(df, labels)).collect()
    assert len(rows) == len(texts)
    none = toxicity.fit(df, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(df, none).collect()} == {0.0}
    assert toxicity.score_toxicity(empty(spark), none).collect() == []


def test_whole_vectors(spark):
    """All terms and labelled rows are in the index, rare ones too, and a search gives the cosines of whole vectors."""
    r = random.Random(3)
    # a toxic word stands in four toxic documents at most
    rows = [(i, " ".join(r.choice([f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]) for _ in range(40)), int(i % 10 == 0)) for i in range(400)]
    rows = [(i, t + (f" rare{chr(97 + i // 40)}x" * 3 if y else ""), y) for i, t, y in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(df, df.drop("text"))
    used = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    count = Counter(w for _, t, _ in used for w in set(t.split()))
    assert set(index.vocabulary) == set(count) and len(count) > 256 and sorted(index.ids.tolist()) == [i for i, *_ in used]
    n, pos = len(used), sum(y for *_, y in used)
    toxic = Counter(w for _, t, y in used for w in set(t.split()) if y)

    def vector(t):
        out = {}
        for w, c in Counter(t.split()).items():
            d, a = count[w], toxic[w]
            chi2 = n * (a * (n - pos - d + a) - (d - a) * (pos - a)) ** 2 / (d * (n - d) * pos * (n - pos)) if d else 0
            out[w] = (1 + math.log(c)) * (math.log((1 + n) / (1 + d)) + 1) * (1 + chi2)
        size = math.sqrt(sum(x * x for x in out.values()))
        return {w: x / size for w, x in out.items()}

    examples = [vector(t) for _, t, _ in used]
    rare = next(w for w, c in sorted(count.items()) if w.startswith("rare") and c <= 2)
    text = f"waa wab unheard unheard {rare} {rare}"
    own = vector(text)
    every = sorted((sum(x * e.get(w, 0) for w, x in own.items()) for e in examples), reverse=True)[:25]
    known = {index.vocabulary[w]: c for w, c in Counter(text.split()).items() if w in index.vocabulary}
    assert np.allclose(index.nearest(known, 25, ((1 + math.log(2)) * index.unseen) ** 2)[1], [x for x in every if x > 0])
    score, near = index.score(text, 25, 0.5)
    assert near and {y for i, _, y in used if i in near[: count[rare]]} == {1} and score >= 0.5


def test_search_with_common_terms_and_a_row_left_out():
    """Rare and common terms, open and closed blocks, more examples than one block: all against every cosine."""
    rng = np.random.default_rng(6)
    n, v = 900, 400
    often = [{int(t): int(rng.integers(1, 5)) for t in {*rng.choice(12, 6, replace=False), *rng.choice(np.arange(12, v), 4, replace=False)}} for _ in range(n)]
    idf = np.concatenate([rng.random(12) * 0.3 + 0.1, rng.random(v - 12) * 5 + 1])
    index = toxicity.BlockMaxIndex({f"t{i}": i for i in range(v)}, idf, often, rng.integers(0, 2, n).tolist(), list(range(n)), 0.1)
    assert 0 < index.most.shape[0] < v
    dense = index.weights[:, :n]
    queries = [index.vector(c) for c in often[:150]]
    leave = np.array([int(np.flatnonzero(index.ids == i)[0]) for i in range(150)])
    for (t, w), skip, (found, cosine), (kept, near) in zip(queries, leave, index.search(queries, 25), index.search(queries, 25, leave)):
        every = w @ dense[t]
        assert np.allclose(cosine, np.sort(every[every > 0])[::-1][:25]) and np.allclose(every[found], cosine) and skip in found
        every[skip] = 0
        assert np.allclose(near, np.sort(every[every > 0])[::-1][:25]) and skip not in kept


def test_calibration(spark):
    """The line is fitted on votes by the other examples: order stays, and scores are as high as labels are frequent."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefghij") + r.choice("klmnop") for _ in range(30)) + (f" bad{r.choice('xyz')}" if i % 8 == 0 and r.random() < 0.9 else ""), int(i % 8 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(df, df.drop("text"))
    before = [x.score for x in toxicity.score_toxicity(df, index).orderBy("doc_id").collect()]
    toxicity.calibrate(spark, index)
    after = [x.score for x in toxicity.score_toxicity(df, index).orderBy("doc_id").collect()]
    assert (index.slope, index.shift) != (1.0, 0.0)
    assert np.array_equal(np.argsort(before, kind="stable")[-50:], np.argsort(after, kind="stable")[-50:])
    held = [(a, b, y) for (i, _, y), a, b in zip(rows, before, after) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert abs(np.mean([b - y for _, b, y in held])) < 0.02 and np.mean([(b - y) ** 2 for _, b, y in held]) < 0.02


def test_repeated_rows_and_ties(spark):
    """Repeated rows score alike; of equally near examples those of smaller doc_id vote; clashing columns don't matter."""
    rows = [(i, f"same words here {'nasty' if i % 2 else ''}", i % 2, "x", 0.1, True) for i in range(1, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, term string, score double, held_out boolean")
    twice = df.unionByName(df)
    index = toxicity.fit(twice, twice.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(twice, index).collect()
    assert len(got) == 158 and len({(x.doc_id, x.score) for x in got}) == 79 and {x.predicted == x.doc_id % 2 for x in got} == {True}
    want = sorted(i for i in range(1, 80, 2) if zlib.crc32(str(i).encode()) % 5)[:3]
    assert next(x.neighbours for x in got if x.doc_id == 1) == want
