import re
from collections import Counter

from common import awkward, empty
from docops.llm.host_rules import base_rules, host_rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    at = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at)


def test_base(spark):
    df, texts = awkward(spark)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in base_rules(df).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_hosts(spark):
    good, bad = "some words of a plain text that is long enough for the rules", "too short"
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, bad if i < 38 else good, "bad") for i in range(40)] + [(200, bad, None), (201, good, None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (False, True) and got[139] == (False, False) and got[100] == (True, False)
    assert got[200] == (True, False) and got[201] == (False, True)


def test_empty(spark):
    assert host_rules(empty(spark)).collect() == []
