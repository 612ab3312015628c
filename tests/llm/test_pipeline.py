"""The stages on the smallest test table, each against a plain version on its own input."""

import re

import corpus_pipeline
from common import SF
from docops.llm.quality_lm import quality
from test_best_fit import valid
from test_ngram_join import brute as groups


def strip(texts, length=100):
    """Texts without what an earlier place holds; a character goes if all its bytes do."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(b[p : p + length])
        at, kept = 0, []
        for c in texts[i]:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def template(text):
    text = re.sub(r"(?<=[^\W_],) ([A-ZÀ-ÖØ-Þ][^\W\d_A-ZÀ-ÖØ-Þ]+)(?![^\W_])|(?<=[^\W_]) ([A-ZÀ-ÖØ-Þ][^\W\d_A-ZÀ-ÖØ-Þ]+)(?![^\W_])", " NAME ", text)
    return re.findall(r"[^\W_]+", text.replace("NAME", "\u0001").lower().replace("\u0001", "name"))


def leaks(texts, items, run=13):
    """Documents that have a run of template words of an item; the test table's passages hold no numbers."""
    grams = {}
    for i, t in items.items():
        w = template(t)
        k = min(run, len(w))
        for p in range(len(w) - k + 1):
            grams.setdefault(k, set()).add(tuple(w[p : p + k]))
    found = set()
    for i, t in texts.items():
        w = template(t)
        if any(tuple(w[p : p + k]) in g for k, g in grams.items() for p in range(len(w) - k + 1)):
            found.add(i)
    return found


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    out = stages["quality classifier"](spark, docs, SF).cache()
    assert out.columns == docs.columns
    verdicts = {r.doc_id: r for r in quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    want = {i: t for i, t in text(docs).items() if verdicts[i].perplexity is not None and verdicts[i].perplexity <= verdicts[i].threshold}
    assert text(out) == want and len(want) > 0.8 * docs.count()

    docs, out = out, stages["n-gram Jaccard join"](spark, out, SF).cache()
    assert out.columns == docs.columns
    want = {i: want[i] for i, g in groups(want, 5, 80).items() if g[1] == i}
    assert text(out) == want

    docs, out = out, stages["suffix-array dedup"](spark, out, SF).cache()
    assert out.columns == docs.columns
    want = {i: t for i, t in strip(want).items() if t.split()}
    assert text(out) == want and all(r.n_chars == len(r.text) for r in out.collect())

    docs, out = out, stages["benchmark decontamination"](spark, out, SF).cache()
    assert out.columns == docs.columns
    gone = set(want) - set(text(out))
    assert gone and gone == leaks(want, items)
    want = text(out)

    rows = stages["best-fit packing"](spark, out, SF).collect()
    valid(rows, {i: len(t.split()) for i, t in want.items()}, 2048)
    assert {r.doc_id for r in rows} == set(want)

    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(want)
