import pytest
from pyspark.sql import functions as F

from docops.functions import governance as g
from docops.operators import governance as op


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_names_and_extensions(spark):
    assert values(spark, g.safe_name(F.col("s")), [("a/b c.pdf",), ("",), (None,), ("..",), ("x" * 200,)], "s string") == ["b_c.pdf", "file", "file", "file", "x" * 128]
    rows = [("a.pdf", ""), ("a.docx.exe", ""), ("a.exe", "application/pdf"), ("a", "image/png"), ("a.bin", ""), ("x.PDF", "")]
    assert values(spark, g.resolve_ext(F.col("n"), F.col("m")), rows, "n string, m string") == ["pdf", "docx", "pdf", "png", None, "pdf"]
    rows = [("upload", m) for m in ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.oasis.opendocument.text", "application/xhtml+xml", "image/x-ms-bmp")]
    assert values(spark, g.resolve_ext(F.col("n"), F.col("m")), rows, "n string, m string") == ["docx", "odt", "html", "bmp"]
    rows = [("a.docx", "application/zip"), ("a.zip", "application/zip"), ("a.pdf", "application/x-dosexec"), ("a.exe", "application/octet-stream")]
    assert values(spark, g.admit(F.col("n"), F.col("m")), rows, "n string, m string") == [None, "zip_not_office", "type_not_allowed", "extension_not_supported"]


def test_routes_of_targets(spark):
    rows = [("pdf", " Word"), ("xlsx", "EXCEL"), ("png", "pdf"), ("pdf", "docs"), ("png", "docx"), ("pdf", "gif"), (None, "pdf"), ("pdf", None)]
    got = [tuple(r) for r in values(spark, g.route_conversion(F.col("e"), F.col("t")), rows, "e string, t string")]
    assert got == [
        ("docx", "pdf_to_docx", None), ("xlsx", "office", None), ("pdf", "image", None), ("docx", "pdf_to_docx", None), ("docx", None, "unsupported_source"),
        (None, None, "unknown_target"), ("pdf", None, "unsupported_source"), (None, None, "unsupported_source"),
    ]
    # a target is read a few times, not once more for each alias and the one before
    assert spark.range(1).select(g.route_conversion(F.lit("pdf"), F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString().count("lower(") < 150


def test_owned_paths(spark):
    o, j = "a" * 32, "b" * 32
    rows = [(f"generated/{o}/{j}/x.pdf",), (f"generated%2F{o}%2F{j}%2Fx.pdf",), (f"generated/{j}/{o}/x.pdf",), (f"generated/{o}/../x.pdf",), (f"/generated/{o}/{j}/x",), ("%zz",), (None,)]
    want = f"generated/{o}/{j}/x.pdf"
    assert values(spark, g.owned_path(F.col("p"), F.lit(o)), rows, "p string") == [want, want, None, None, None, None, None]


def test_chain_cuts_cycles(spark):
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, None), (1, 5, 5)] + [(2, i, i - 1 if i else None) for i in range(30)]
    objects = spark.createDataFrame([(*r, 1, "field", "/FT", "/Tx") for r in rows], "doc_id int, object_id int, parent_id int, page_number int, scope string, key string, value string")
    got = {(r.doc_id, r.object_id, r.ancestor) for r in op.field_chain(objects).collect()}
    assert {x for x in got if x[0] == 1} == {(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 3, 1)}
    assert {x[2] for x in got if x[:2] == (2, 29)} == set(range(9, 29))


def test_reuse_computes_each_key_once(spark):
    seen = []
    requests = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 1, "x"), (3, "b", 1, "y"), (4, "c", 1, "z")], "request_id int, content_id string, setting int, payload string")
    cache = spark.createDataFrame([("c", 1, "old")], "content_id string, setting int, result string")

    def compute(df):
        seen.append(df.count())
        return df.withColumn("result", F.upper("payload"))

    got = {r.request_id: (r.result, r.hit) for r in op.reuse_by_content(requests, cache, compute).collect()}
    assert got == {1: ("X", False), 2: ("X", False), 3: ("Y", False), 4: ("old", True)} and seen == [2]


def objects(spark, rows):
    return spark.createDataFrame([(*r, 1, "field", "/FT", "/Tx") for r in rows], "doc_id int, object_id int, parent_id int, page_number int, scope string, key string, value string")


def walked(rows, max_depth):
    """Ancestors with their depth, step by step, until the chain ends or comes back."""
    parent = {(d, o): p for d, o, p in rows}
    out = set()
    for d, o, _ in rows:
        seen, at = [o], o
        while (at := parent.get((d, at))) is not None and at not in seen and len(seen) <= max_depth:
            seen.append(at)
            out.add((d, o, at, len(seen) - 1))
    return out


@pytest.mark.parametrize("max_depth", [1, 2, 3, 5, 16, 20, 40])
def test_chains_against_a_walk(spark, max_depth):
    """Straight chains, trees, cycles with tails of every length, parents that are not there."""
    rows = [(1, i, i - 1 if i else None) for i in range(45)] + [(2, i, (i - 1) // 2 if i else None) for i in range(60)]
    rows += [(3 + c, i, i + 1 if i < 30 else 30 - c) for c in range(9) for i in range(31)] + [(20, 1, 99), (20, 2, 1), (20, 3, 3), (20, 4, 3)]
    got = {tuple(r) for r in op.field_chain(objects(spark, rows), max_depth).collect()}
    assert got == walked(rows, max_depth)


def test_chains_take_few_joins(spark, monkeypatch):
    tables = []
    real = op.stored
    monkeypatch.setattr(op, "stored", lambda df, name: tables.append(df) or real(df, name))
    op.field_chain(objects(spark, [(1, i, i - 1 if i else None) for i in range(100)])).collect()
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") for df in tables]
    assert joins == [0, 1, 1, 1, 1, 1]  # the edges, and five doublings
