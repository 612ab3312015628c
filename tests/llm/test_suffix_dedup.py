import hashlib

import numpy as np
import pytest
from common import SF, awkward, empty, smallest
from docops.llm.queries import op2_suffix_dedup
from docops.llm.suffix_dedup import Suffixes, dedup_suffixes, stripped


def brute(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            else:
                seen.add(w)
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot", [4096, 2, 0])
def test_awkward(spark, hot):
    df, texts = awkward(spark)
    assert got(dedup_suffixes(df, hot=hot)) == brute(texts)


def test_empty(spark):
    assert dedup_suffixes(empty(spark)).collect() == []


def test_query(spark):
    assert got(op2_suffix_dedup(spark, SF)) == brute(smallest())


def test_suffix_sort():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = int(rng.integers(1, 60)), 12
        text = rng.integers(0, 2, (n, m)).astype(np.uint8) + 65
        size = rng.integers(0, m + 1, n)
        group = np.sort(rng.integers(0, 4, n))
        begin = np.searchsorted(group, group)
        end = np.searchsorted(group, group, "right")
        perm, lcp = Suffixes(text, size).sorted(begin, end)
        want = sorted(range(n), key=lambda i: (group[i], text[i, : size[i]].tobytes()))
        rows = [text[i, : size[i]].tobytes() for i in perm]
        assert rows == [text[i, : size[i]].tobytes() for i in want]
        for i in range(1, n):
            if begin[i] < i:
                same = 0
                while same < min(len(rows[i]), len(rows[i - 1])) and rows[i][same] == rows[i - 1][same]:
                    same += 1
                assert lcp[i] == same


def test_stripped_keeps_columns_and_whole_characters(spark):
    df, texts = awkward(spark)
    out = stripped(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    sums = got(dedup_suffixes(df))
    before = {r.doc_id: r for r in df.collect()}
    for i, t in texts.items():
        assert rows[i].n_chars == len(rows[i].text) and rows[i].source == before[i].source and rows[i].score == 0.5
        size = len(rows[i].text.encode())
        assert sums[i][0] - sums[i][1] <= size <= sums[i][0] - sums[i][1] + 6 * sums[i][2]
