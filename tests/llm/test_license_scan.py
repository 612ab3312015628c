import pytest
from common import awkward, empty
from docops.llm import license_scan
from docops.llm.queries import op10_license_scan


@pytest.fixture(scope="module")
def model(spark):
    return license_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_templates(spark, model):
    said = [(i, f"Some text stands here first.\n{t}\nAnd after it.", f) for i, (f, t) in enumerate((f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts)]
    rows = license_scan.scan(spark.createDataFrame(said, "doc_id long, text string, family string"), model).collect()
    assert [(r.family, r.paragraph, r.n_paragraphs) for r in sorted(rows)] == [(f, 1, 3) for *_, f in said]


def test_others_are_unknown(spark, model):
    texts = ["The driver lost his license in 2019.", "A version of the general public was free to use the work.", "", None, "\n\n", "license", "All of it is by the author."]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(rows) == len(texts) and {r.family for r in rows} == {"none"}


def test_awkward(spark, model):
    df, texts = awkward(spark)
    assert len(license_scan.scan(df, model).collect()) == len(texts)
    assert license_scan.scan(empty(spark), license_scan.fit(empty(spark))).collect() == []


def test_query(spark):
    """The notices that stand in the documents, against a plain search for them."""
    sf = "/root/testdata/sf0.01"
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "Proprietary"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: f for i, t in docs.items() for n, f in notices.items() if n in t}
    got = {r.doc_id: r.family for r in op10_license_scan(spark, sf).collect() if r.family != "none"}
    assert want and got == want


def test_wrapped_and_long_and_double_notices(spark, model):
    """A notice wrapped over lines, one inside a long line, and two on one line."""
    filler = " ".join(f"word{i} goes on" for i in range(120))
    apache = "Licensed under the Apache License, Version 2.0 (the License); you may not\nuse this file except in compliance with the\nLicense."
    texts = [f"some code\n\n{apache}\n\nmore", f"{filler} Licensed under the Mozilla Public License, version 2.0. {filler}", "Licensed under the Apache License, Version 2.0. Released under the MIT License.", filler]
    rows = sorted(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect())
    assert rows[0].family == "Apache-2.0" and rows[0].paragraph in (2, 3) and rows[1].family == "MPL-2.0"
    assert rows[2].families == ["Apache-2.0", "MIT"] and rows[3].family == "none"


def test_unseen_wording(model):
    """Sentences of a licence that a first model has not seen at all: a third are told, and nothing else is taken for one."""
    assert len(model.recall) == len(license_scan.FAMILIES) and model.recall["unknown"] > 0.95
    assert sum(v for f, v in model.recall.items() if f != "unknown") / (len(model.recall) - 1) > 0.25


def test_against_plain_version(spark, model):
    """Every unit of the smallest table's documents, one at a time."""
    import numpy as np
    from common import smallest
    from docops.llm.chunks import LOWER, mix, prefix_hash, span_hash

    def hashed(words):
        data = LOWER[np.frombuffer(" ".join([*words, ""]).encode("latin-1"), np.uint8)]
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        one = span_hash(prefix_hash(data), np.append(0, ends[:-1] + 1), ends)
        two = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        return [int(x >> np.uint64(48)) for x in [*one, *two]]

    def windows(words):
        return [words[i : i + 80] for i in range(0, max(1, len(words) - 40), 40)]

    def plain(text):
        lines, units = text.split("\n"), []
        for n, x in enumerate(lines):
            units += [(False, n, w) for w in windows(license_scan.words(x)) if w]
        block = []
        for n, x in enumerate([*lines, ""]):
            own = license_scan.words(x)
            block += [(n, w) for w in own]
            if not own and block:
                if block[0][0] < block[-1][0]:
                    for i in range(0, max(1, len(block) - 40), 40):
                        part = block[i : i + 80]
                        if part[0][0] < part[-1][0]:
                            units.append((True, part[0][0], [w for _, w in part]))
                block = []
        best = {}
        for is_block, n, w in units:
            f = hashed(w)
            z = (model.weights[f].sum(axis=0) / np.sqrt(len(f)) + model.bias) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if p.argmax() > 0:
                for k in np.flatnonzero(p >= 0.1):
                    if k and license_scan.similarity(license_scan.FAMILIES[k], " ".join(w).encode("latin-1").decode(errors="replace")) >= 0.6:
                        rank = (is_block, -round(float(p[k]), 4), n, license_scan.FAMILIES[k])
                        best[license_scan.FAMILIES[k]] = min(best.get(license_scan.FAMILIES[k], rank), rank)
        return (min(best.values())[3] if best else "none", sorted(best))

    docs = smallest()
    extra = {10**6 + i: f"a b\n{x}\n\nc {x} d\ne" for i, x in enumerate(t for ts in license_scan.TEMPLATES.values() for t in ts)}
    both = {i: t or "" for i, t in {**docs, **extra}.items()}
    got = {r.doc_id: (r.family, r.families) for r in license_scan.scan(spark.createDataFrame(list(both.items()), "doc_id long, text string"), model).collect()}
    want = {i: plain(t) for i, t in both.items()}
    assert got == want
