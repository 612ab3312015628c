import hashlib
import re

from common import SF, awkward, empty, smallest
from docops.llm.block_dedup import dedup_blocks
from docops.llm.queries import op5_block_dedup


def brute(texts, k=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    low, out = {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            low.setdefault(tuple(words[i][p : p + k]), i)
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if low[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_awkward(spark):
    df, texts = awkward(spark)
    assert got(dedup_blocks(df)) == brute(texts)
    assert got(dedup_blocks(df, window=5, block=3)) == brute(texts, 5)


def test_empty(spark):
    assert dedup_blocks(empty(spark)).collect() == []


def test_query(spark):
    assert got(op5_block_dedup(spark, SF)) == brute(smallest())
