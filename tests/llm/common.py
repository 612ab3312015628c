"""Small tables that hold the awkward cases, and the documents of the smallest test table."""

import random

import pandas as pd

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def awkward(spark, seed=7):
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows, an extra clashing column."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["été", "größe", "Ünï"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, shared, line = text(120), text(40), "the same line of some words stands here again and again, to fill more than a hundred bytes of text"
    texts = [base, base, base.upper(), base + " tail", None, "", "   \n\t ", "one", "one two three", "one  two\nthree four five"]
    texts += [text(30) + " " + shared + " " + text(20) for _ in range(4)]
    texts += [" ".join(w if r.random() > 0.02 else "x" for w in base.split()) for _ in range(6)]
    texts += ["\n".join([line, text(5), line, text(3), line]), line, "ab" * 200, "ab" * 150, text(3000), "x" * 99, "x" * 100, "x" * 101]
    texts += [text(r.randrange(1, 200)) for _ in range(20)]
    rows = [(i * 3 + 1, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), None, 0.5) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), {i: t for i, t, *_ in rows}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def smallest():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(d.doc_id.tolist(), d.text.tolist()))
