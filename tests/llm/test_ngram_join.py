import random
import re

import numpy as np
import pytest
from common import SF, awkward, empty, smallest
from docops.llm.ngram_join import _links, linked
from docops.llm.queries import op1_ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, k=4, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                inter = len(x & y)
                if 100 * inter >= percent * (len(x) + len(y) - inter):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_awkward(spark):
    df, texts = awkward(spark)
    assert got(linked(df, 4, 85)) == brute(texts)
    assert got(linked(df)) == brute(texts, 5, 80)


@pytest.mark.parametrize("tile,pivots", [(4, 1), (8, 2)])
def test_large_groups_in_small_tiles(spark, tile, pivots):
    """Chains of near copies, whose links are lost if tiles aren't compared with each other."""
    r = random.Random(3)
    texts, n = {}, 0
    for length in (30, 60, 200):
        w = [f"v{r.randrange(10**6)}" for _ in range(length)]
        for _ in range(40):
            texts[n] = " ".join(w)
            n += r.randrange(1, 5)
            for _ in range(max(1, length // 60)):
                w[r.randrange(length)] = f"v{r.randrange(10**6)}"
            if r.random() < 0.3:
                w.append(f"v{r.randrange(10**6)}")
                length += 1
    rows = list(texts.items())
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(linked(df, 4, 85, tile, pivots)) == brute(texts)


def test_empty(spark):
    assert linked(empty(spark)).collect() == []


def test_query(spark):
    assert got(op1_ngram_join(spark, SF)) == brute(smallest())


def test_links_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(200) < 0.05, rng.integers(0, 2**63, 200).astype(np.uint64), base)) for _ in range(60)]
    ids = np.arange(60)
    root = {i: i for i in range(60)}
    for a, b in _links(ids, sets, np.ones(60, bool), ids, 85):
        x, y = root[a], root[b]
        root = {i: x if v == y else v for i, v in root.items()}
    want = {i: i for i in range(60)}
    for a in range(60):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 85 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = want[a], want[b]
                want = {i: x if v == y else v for i, v in want.items()}
    assert all((root[a] == root[b]) == (want[a] == want[b]) for a in range(60) for b in range(60))


def passages(n_docs, seed=4):
    """Documents of ten shared passages each, no two of them alike enough to link, all joined by shared shingles."""
    r = random.Random(seed)
    pool = [" ".join(f"p{p}x{i}" for i in range(12)) for p in range(n_docs)]
    return [(i, " ".join(r.sample(pool, 10))) for i in range(n_docs)]


def test_shared_passages_make_small_tiles(spark, monkeypatch):
    """Thousands of sets in one component of shared prefixes that don't link: rows are linear and tiles bounded."""
    from docops.llm import ngram_join

    rows, tiled = {}, ngram_join._tiled

    def watched(tiles, percent):
        got = tiles.groupBy("tile").count().toPandas()["count"]
        rows[n] = (rows.get(n, (0, 0))[0] + int(got.sum()), max(rows.get(n, (0, 0))[1], int(got.max()) if len(got) else 0))
        return tiled(tiles, percent)

    monkeypatch.setattr(ngram_join, "_tiled", watched)
    for n in (1000, 2000, 4000):
        df = spark.createDataFrame(passages(n), "doc_id long, text string")
        assert all(c == i for i, (_, c) in got(linked(df, 4, 85, tile=64)).items())
    assert all(total <= 2 * n and most <= 192 for n, (total, most) in rows.items())


def test_pair_tiles_are_bounded(spark):
    """Sets that one component's signatures hold together, yet do not link: pieces and tiles stay bounded, no link is lost."""
    r = random.Random(9)
    w = [f"v{i}" for i in range(120)]
    texts = {}
    for i in range(300):  # random subsets of edits: some pairs link, some don't
        x = list(w)
        for j in r.sample(range(120), 4):
            x[j] = f"e{r.randrange(40)}"
        texts[i] = " ".join(x)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(linked(df, 4, 85, tile=16, pivots=2)) == brute(texts)
