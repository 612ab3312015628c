import hashlib
import random
import re

import pytest
from common import SF, awkward, empty
from docops.llm import fim
from docops.llm.fim import Fenwick, digests, fill_in_middle
from docops.llm.queries import op12_fim
from oracle import connect, differences

ODD = ["<P>", "a <S> b", "<M", "x<", ">P<", "S>M>P>", "é", "été à l'ÉTÉ", "😀👍 ok!", "\n\n", "abc", "a1b2", "日本語 text", "́x ﬁ"]


def brute(i, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    form = "plain" if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if form == "plain":
        return n, form, None, None, t
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def table(spark):
    df, texts = awkward(spark)
    r = random.Random(3)
    more = ODD + ["".join(r.choice("ab Z1.<é日😀\n") for _ in range(n)) for n in (2047, 2048, 2049, 4096, 9000, 30_000)] + ["a" * 5000, "é" * 5000]
    more = {1000 + i: t for i, t in enumerate(more * 4)}
    return df.unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"), allowMissingColumns=True), texts | more


@pytest.mark.parametrize("block", [7, 2048])
def test_samples(spark, monkeypatch, block):
    df, texts = table(spark)
    if block != fim.BLOCK:  # in this process only, so without Spark
        monkeypatch.setattr(fim, "BLOCK", block)
        import numpy as np
        for i, t in texts.items():
            raw = (t or "").encode()
            layout = fim.Layout(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
            tree, units = layout.tree(0), re.findall(r"[A-Za-z]+|[^A-Za-z]", t or "")
            for u in {0, 1, len(units) // 2, len(units) - 1, len(units)} - {-1}:
                if u <= len(units):
                    head = "".join(units[:u])
                    assert layout.cut(0, tree, u) == (len(head.encode()), len(head)), (i, u)
        return
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle(df).collect()}
    assert got == {i: brute(i, t) for i, t in texts.items()}
    assert {g[1] for g in got.values()} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hashes = {r.doc_id: (r.output_sha256, r.restored_sha256) for r in digests(fill_in_middle(df)).collect()}
    assert hashes == {i: (sha(brute(i, t)[4]), sha(t or "")) for i, t in texts.items()}


def test_tree():
    r = random.Random(5)
    for size in (0, 1, 2, 3, 8, 13, 100):
        units = [r.choice([0, 0, 1, 5]) for _ in range(size)]
        points = [u + r.randrange(4) for u in units]
        tree = Fenwick(units, points)
        for u in range(sum(units) + 2):
            want = next((b for b in range(size) if sum(units[: b + 1]) > u), size)
            assert tree.descend(u) == (want, sum(units[:want]), sum(points[:want]))


def test_query(spark):
    assert differences(op12_fim(spark, SF), connect(SF), fim.ORACLE) == ""


def test_empty_and_odd_rows(spark):
    assert fill_in_middle(empty(spark)).collect() == []
    rows = spark.createDataFrame([(None, "x", 1), (5, "a b", 2), (5, "a b", 3)], "doc_id long, text string, h1 int")
    a, b = fill_in_middle(rows).collect()
    assert a == b and a.doc_id == 5
