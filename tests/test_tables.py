import itertools
import random
import re
from decimal import Decimal

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from docops.functions import tables as t
from docops.operators import tables as op
from docops.plans.queries import ORACLES, QUERIES


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, s string").orderBy("i").select(column).collect()]


def test_numbers(spark):
    got = values(spark, t.parse_number(F.col("s")), ["R$ 1.350,00", "135,00", "135.00", "20%", "-7,5", "abc", "", None, "(5)", "1.2.3"])
    assert got == [Decimal("1350"), Decimal("135"), Decimal("135"), Decimal("0.2"), Decimal("-7.5"), None, None, None, None, None]


def test_money(spark):
    got = values(spark, t.format_brl(F.col("s")), ["R$ 135,00", "135,00", "135.00", "1.350,00", "1350.00", "abc", ""])
    assert got == ["R$ 135,00", "R$ 135,00", "R$ 135,00", "R$ 1.350,00", "R$ 1.350,00", "abc", ""]
    got = values(spark, t.format_brl(F.col("s")), ["-1.234,56", "0.999", "-0,05", "R$ -7", "12d", "NaN", "1e3"])
    assert got == ["R$ -1.234,-56", "R$ 0,100", "R$ 0,-5", "R$ -7,00", "12d", "NaN", "R$ 1.000,00"]
    got = values(spark, t.extract_money(F.col("s")), ["x R$ 1,00 2,00", "x 1,50 e 2.75", "none"])
    assert got == [["R$ 1,00"], ["R$ 1,50", "R$ 2,75"], []]


def test_oracles_leave_nothing_to_chance(spark, tmp_path):
    """Letters that grow in upper case push a marker behind the 200th; equal positions end up in one cluster."""
    texts = ["ß" * 99 + "ererx", "ß" * 98 + "ererx", "ŉ" * 100 + "the ", None, " the x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = connect(str(tmp_path))
    assert differences(QUERIES["p42_skip_page"](spark, str(tmp_path)), con, ORACLES["p42_skip_page"]) == ""
    assert [r.skip for r in docs.orderBy("doc_id").select(t.skip_page(F.col("text"), ["the ", "ERER"]).alias("skip")).collect()] == [False, True, False, False, True]
    rows = [(d, n, x) for d in range(300) for n, x in enumerate([0.0, 100.0, 100.0, 100.0, 300.0, 300.0, None])]
    words = spark.createDataFrame(rows, "doc_id long, n long, x0 double")
    words.write.parquet(f"{tmp_path}/words.parquet")
    sql = ORACLES["w7_cluster_1d"].split("FROM {lineitem}")[-1]
    sql = "WITH " + sql[sql.index("k AS (SELECT doc_id, n, x0") :]
    got = op.cluster_1d(words, "x0", ["doc_id"], 60.0).withColumn("mean", F.round("mean", 6))
    assert differences(got, connect(str(tmp_path)), sql) == ""
    assert {(r.cluster, r.mean, r.n) for r in got.collect()} == {(1, None, 1), (2, 0.0, 1), (3, 100.0, 3), (4, 300.0, 2)}
    # no order of the rows may leave equal values open
    assert "ORDER BY x0 NULLS FIRST, n" in sql and "ORDER BY x0)" not in sql and "ORDER BY x0 ROWS" not in sql


def test_safe_cells_and_keys(spark):
    assert values(spark, t.excel_safe(F.col("s")), ["=1+1", " -a\nb ", None, "ok"]) == ["'=1+1", "'-a b", "", "ok"]
    assert values(spark, t.norm_key(F.col("s")), [" Código  Nº 5% "]) == ["codigo n 5 pct "]


LINES = [
    (1, "OUTROS EXEMPLOS"), (2, "Código Procedimento Valor Unimed Co-part 20%"), (3, "1.02.00003 Consulta R$ 10,00"), (4, "Código Procedimento Valor Unimed"), (5, "com retorno"),
    (6, "R$ 2,00 R$ 3,00"), (7, "* Obs: nada"), (8, "R$ 4,00 R$ 5,00 R$ 6,00"), (9, "TOTAL DE COPARTICIPAÇÃO R$ 1,00 R$ 2,00"), (10, "solta"), (11, "9.99.99999 Sem valor"), (12, "1,00 2,00"),
]


def test_stitching(spark):
    df = spark.createDataFrame([(7, n, x) for n, x in LINES], "doc_id int, line_pos int, line string")
    got = [tuple(r)[1:] for r in op.stitch_fee_lines(df).orderBy("line_pos").collect()]
    s = "OUTROS EXEMPLOS"
    assert got == [
        (3, s, "1.02.00003", "Consulta com retorno", "R$ 10,00", "R$ 2,00", "R$ 3,00", "R$ 4,00", "R$ 5,00", "procedimento"),
        (9, s, "", "Total de Coparticipação", "", "R$ 1,00", "R$ 2,00", "", "", "total"),
        (11, s, "9.99.99999", "Sem valor", "R$ 1,00", "R$ 2,00", "", "", "", "procedimento"),
    ]


def table(spark, rows):
    return spark.createDataFrame([(1, i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "table_id long, row_pos int, col_pos int, value string")


def test_table_cleaning(spark):
    cells = op.drop_empty(table(spark, [["Title", None, None, ""], ["Nome", "Valor", "Valor", ""], ["ana", "R$ 1,00", "10%", ""], ["", "", "", ""], ["Nome", "Valor", "Valor", ""], ["=x", "R$ 2,50", "20%", ""]]))
    assert op.detect_header(cells).collect()[0].header_row == 1
    assert [r.label for r in op.headers(cells).orderBy("col_pos").collect()] == ["Nome", "Valor", "Valor (2)"]
    body = op.body(cells)
    assert sorted({r.row_pos for r in body.collect()}) == [2, 4, 5]  # the repeated row isn't equal: its label has a number
    assert {r.col_pos: r.type for r in op.infer_types(body).collect()} == {0: "text", 1: "money", 2: "percent"}
    assert {r.text for r in op.typed(body).where("col_pos = 0").collect()} == {"ana", "Nome", "'=x"}


def test_unique_names_avoid_taken_ones(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(["x", "x", "x (2)", "a.pdf", "a.pdf"])], "k int, i int, name string")
    got = [r.unique_name for r in op.unique_names(df, ["k"], [F.col("i")]).orderBy("i").collect()]
    assert len(set(got)) == 5 and got[0] == "x" and got[2] == "x (2)"
    files = [r.unique_name for r in op.unique_names(df, ["k"], [F.col("i")], style="file").orderBy("i").collect()]
    assert files[3:] == ["a.pdf", "a (1).pdf"]


def one_by_one(names, style):
    """A name keeps its first place; repeats take the next number that no name has."""
    first = 1 if style == "file" else 2
    seen, out = {}, []
    for name in names:
        if name not in seen:
            seen[name] = first
            out.append(name)
            continue
        base, dot, ext = name.rpartition(".") if style == "file" and "." in name else (name, "", "")
        while True:
            made = {"column": f"{name} ({seen[name]})", "field": f"{name}__copy_{seen[name]}", "file": f"{base} ({seen[name]}){dot}{ext}"}[style]
            seen[name] += 1
            if made not in names:
                break
        out.append(made)
    return out


@pytest.mark.parametrize("style", ["column", "field", "file"])
def test_unique_names_against_a_loop(spark, style):
    r = random.Random(style)
    parts = {"column": ["x", "x (2)", "x (3)", "x (2) (2)", "x (02)", "x (1)", " (2)", "y", "x\n (2)"], "field": ["f", "f__copy_2", "f__copy_3", "f__copy_2__copy_2", "f__copy_1", "g", "__copy_2"], "file": ["a.pdf", "a (1).pdf", "a (2).pdf", "a (1) (1).pdf", "a", "a (1)", ".pdf", " (1).pdf", "a.b.pdf", "a (1).b.pdf", "a (0).pdf"]}[style]
    lists = [[r.choice(parts) for _ in range(r.randrange(1, 25))] for _ in range(60)] + [[parts[0]] * 40 + parts[1:3]]
    df = spark.createDataFrame([(k, i, n) for k, names in enumerate(lists) for i, n in enumerate(names)], "k int, i int, name string")
    got = [[x.unique_name for x in sorted(rows, key=lambda x: x.i)] for _, rows in itertools.groupby(sorted(op.unique_names(df, ["k"], [F.col("i")], style=style).collect(), key=lambda x: x.k), key=lambda x: x.k)]
    want = [one_by_one(names, style) for names in lists]
    assert got == want and all(len(set(x)) == len(x) for x in got)
    arrays = df.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("names"))
    assert [r[0] for r in arrays.orderBy("k").select(t.unique_in_order(F.col("names"), style)).collect()] == want


def test_unique_names_of_nulls(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "x"), (1, 2, None), (None, 3, "x"), (None, 4, "x")], "k int, i int, name string")
    assert [r.unique_name for r in op.unique_names(df, ["k"], [F.col("i")]).orderBy("i").collect()] == [None, "x", None, "x", "x (2)"]


def test_csv_keeps_all_columns(spark, tmp_path):
    cells = table(spark, [["a", "b"], ["c", "d", "e"]])
    with pytest.raises(ValueError, match="3 columns"):
        op.write_tables_csv(cells, str(tmp_path / "no"), 2)
    op.write_tables_csv(cells, str(tmp_path / "csv"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "csv").glob("part-*")))
    assert text.splitlines() == ["a;b;", "c;d;e"]
    op.write_tables_csv(cells.limit(0), str(tmp_path / "none"))


def rectangles(r, n, docs, size):
    return [(r.randrange(docs), i, x := r.uniform(-50, 600), y := r.uniform(-50, 800), x + size(), y + size()) for i in range(n)]


def test_lines_in_rects_against_all_pairs(spark):
    r = random.Random(2)
    rects = rectangles(r, 150, 3, lambda: r.choice([0.0, 1.0, 12.0, 16.0, 28.0, r.uniform(0, 500), 2.0 ** r.randrange(10) * 16 - 4])) + [(0, 900, None, 1.0, 2.0, 3.0), (0, 901, 5.0, 5.0, -5.0, 9.0)]
    lines = rectangles(r, 600, 4, lambda: r.choice([0.0, 0.0, r.uniform(0, 60), r.uniform(-40, 500)])) + [(d, 1000 + i, x0 + a, y0 + a, x1 + b, y1 + b) for d, i, x0, y0, x1, y1 in rects[:150] for a, b in [(-2.0, 2.0)]] + [(0, 2000, None, None, 1.0, 1.0)]
    v = spark.createDataFrame(lines, "doc_id int, n int, x0 double, y0 double, x1 double, y1 double")
    q = spark.createDataFrame(rects, "doc_id int, rect_id int, rx0 double, ry0 double, rx1 double, ry1 double")
    want = {(i, k) for d, i, x0, y0, x1, y1 in lines if x0 is not None for e, k, a, b, c, f in rects if a is not None and d == e and min(x0, x1) >= a - 2 and max(x0, x1) <= c + 2 and min(y0, y1) >= b - 2 and max(y0, y1) <= f + 2}
    got = [(x.n, x.rect_id) for x in op.lines_in_rects(v, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_pairs_of_a_large_document(spark):
    """100,000 lines and 10,000 rectangles of one document: far fewer pairs are tested than the 10^9 there are."""
    place = lambda n, seed, size: spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("n"), (F.rand(seed) * 10_000).alias("x0"), (F.rand(seed + 1) * 10_000).alias("y0"), (F.rand(seed + 2) ** 4 * size).alias("w"), (F.rand(seed + 3) ** 4 * size).alias("h"))
    v = place(100_000, 1, 300).select("doc_id", "n", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    q = place(10_000, 7, 1000).select("doc_id", F.col("n").alias("rect_id"), F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), (F.col("x0") + F.col("w")).alias("rx1"), (F.col("y0") + F.col("h")).alias("ry1"))
    assert op.rect_candidates(v, q).count() < 5_000_000


def test_matching(spark):
    labels = spark.createDataFrame([(1, 0, "Código"), (1, 1, "Vlr"), (1, 2, "Procedimento médico"), (1, 3, "Valor total")], "table_id long, col_pos int, label string")
    got = {r.target: r.col_pos for r in op.match_columns(labels, ["codigo", "procedimento", "valor", "zzz"]).collect()}
    assert got == {"codigo": 0, "procedimento": 2, "valor": 3}


def test_matching_folds_both_names(spark):
    """Against a plain loop: accents on both sides, the ratio of column to target, and names that hold each other."""
    from difflib import SequenceMatcher

    fold = str.maketrans("çáàãâéêíóôõú", "caaaaeeiooou")
    norm = lambda s: re.sub(r"\s+", " ", s.strip().lower()).translate(fold).replace("%", " pct ").replace("º", "")
    names = {1: ["Observacao", "Funcao", "Co-part 20%", "Código"], 2: ["x", "Valor Unimed (R$)", "", "Descrição do item", "valor"], 3: ["zz", "qq"]}
    targets = ["Observação", "Função", "Co-part 20 %", "valor unimed", "descricao", "cod"]
    labels = spark.createDataFrame([(k, i, x) for k, xs in names.items() for i, x in enumerate(xs)], "table_id long, col_pos int, label string")
    want = set()
    for k, xs in names.items():
        free = list(enumerate(xs))
        for target in targets:
            best = None
            for i, x in free:
                a, b = norm(x), norm(target)
                score = SequenceMatcher(None, a, b).ratio() + (0.15 if a in b or b in a else 0)
                if best is None or score > best[0]:
                    best = (score, i, x)
            if best and best[0] >= 0.55:
                free.remove(best[1:])
                want.add((k, target, best[1], round(best[0], 9)))
    got = op.match_columns(labels, targets)
    assert {(r.table_id, r.target, r.col_pos, round(r.score, 9)) for r in got.collect()} == want and (1, "Observação", 0, 1.15) in want
    counts = {k: sum(x[0] == k for x in want) for k in names}  # a table without a match has a row too
    assert {(r.table_id, r.matched, r.accepted) for r in op.accept_schema(labels, got, len(targets)).collect()} == {(k, n, n >= 4) for k, n in counts.items()} and counts[3] == 0


def test_files(spark, tmp_path):
    op.write_tables_csv(table(spark, [["=a", "b;c"], ["1", None]]), str(tmp_path / "csv"), 2)
    text = "".join(f.read_text() for f in sorted((tmp_path / "csv").glob("part-*")))
    assert text.splitlines() == ["'=a;\"b;c\"", '1;""']


def test_updates_and_targets(spark, tmp_path):
    from docops.sources import readers

    (tmp_path / "u.json").write_text('{"recent": [{"date": "2026-01-01", "tag": "new", "title": "a", "desc": "b"}, {"date": "2026-01-02", "tag": "fix", "title": "c", "desc": "d"}]}')
    assert [r.title for r in readers.read_updates(spark, str(tmp_path / "u.json")).orderBy("date").collect()] == ["a", "c"]
    cells = table(spark, [["", "one"], ["A ", "B"], ["C", "D"]])
    assert readers.target_columns(cells) == ["A", "B"]
    assert readers.target_columns(cells.limit(0), "x, ,y") == ["x", "y"] and readers.target_columns(cells.limit(0)) == []


def test_keys_of_all_documents(spark):
    from docops.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fold = str.maketrans("çáàãâéêíóôõú", "caaaaeeiooou")
    plain = lambda x: re.sub(r"[ \t\n\v\f\r]+", " ", (x or "").strip(" ").lower()).translate(fold).replace("%", " pct ").replace("º", "")
    got = {r.doc_id: r.key for r in QUERIES["p37_norm_key_all"](spark, sf).collect()}
    assert any(len(x or "") >= 2000 for x in docs.values()) and got == {i: plain(x) for i, x in docs.items()}


def test_cells_are_made_once(spark):
    """Types and widths come by windows over one pass of the cells: no join of the cells with what is made of them."""
    rows = [["Title", None, None, ""], ["Nome", "Valor", "Valor", ""], ["ana", "R$ 1,00", "10%", ""], ["Nome", "Valor", "Valor (2)", ""], ["=x" * 20, "R$ 2,50", "x", ""]]
    cells = op.drop_empty(table(spark, rows))
    typed = op.typed(op.body(cells))
    assert sorted((r.row_pos, r.col_pos, r.type) for r in typed.collect()) == [(i, j, k) for i in (2, 4) for j, k in enumerate(("text", "money", "text"))]
    widths = op.table_widths(cells)
    assert sorted(widths.collect()) == sorted(op.display_width(op.body(cells), op.headers(cells)).collect()) == [(1, 0, 46), (1, 1, 10), (1, 2, 13)]
    for df in (typed, widths):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_amounts_are_read_once(spark):
    """Each step of format_brl stands in its expression once: used twice it is worked out twice, and the code grows past what Java compiles."""
    plan = spark.createDataFrame([("R$ 1,5",)], "s string").select(t.format_brl(F.col("s")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(step) for step in ("regexp_replace(", "bround(", "format_number(")] == [1, 1, 1]


def test_sheets_of_repeated_tables(spark, tmp_path):
    """Lines go on over a sheet's tables; cells are shuffled once for it.  A table listed twice has its lines once, cells of no row none."""
    cells = spark.createDataFrame([(1, 5, 0, "a"), (1, 5, 1, "b"), (1, 9, 0, "c"), (2, 0, 0, "d"), (2, None, 0, "x"), (3, 1, 0, "e"), (4, 0, 0, "y")], "table_id long, row_pos int, col_pos int, value string")
    tables = spark.createDataFrame([(7, 1, False), (7, 1, False), (7, 2, True), (8, 3, False), (9, 1, False), (None, 4, False)], "doc_id long, table_id long, is_fee boolean")
    op.write_tables(cells, str(tmp_path / "one"), tables, True)
    got = sorted((r.doc_id, r.line, r.value) for r in spark.read.parquet(str(tmp_path / "one")).collect())
    assert got == sorted([(7, 0, "a"), (7, 0, "b"), (7, 1, "c")] * 2 + [(7, 2, "d"), (8, 0, "e"), (9, 0, "a"), (9, 0, "b"), (9, 1, "c")])
    op.write_tables(cells, str(tmp_path / "many"), tables)
    got = sorted((r.doc_id, r.sheet, r.line, r.value) for r in spark.read.parquet(str(tmp_path / "many")).collect())
    want = [(d, s, k, v) for d, s in ((7, "Tabela 1"), (7, "Tabela 2"), (9, "Tabela 1")) for k, v in ((0, "a"), (0, "b"), (1, "c"))]
    assert got == sorted([*want, (7, "Coparticipacao", 0, "d"), (8, "Tabela 1", 0, "e")])


def test_labels_take_one_shuffle(spark):
    from docops.sources import readers

    cells = table(spark, [["x", None, " "], ["", None, "C ", "D"], ["", "E", "F", "G"]])
    got = readers.target_labels(cells)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1  # before it runs: then it shows two plans
    assert [r.labels for r in got.collect()] == [["C", "D"]]


def test_page_fixtures_are_dealt_by_the_inputs_size(spark, monkeypatch, tmp_path):
    from docops.plans import fixtures
    from docops.sources.parts import dealt

    spark.range(40_000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert dealt(t, "id", 1000).rdd.getNumPartitions() > 32 and dealt(t, "id", 1000).count() == 40_000
    assert dealt(t, "id") is t
    rows = spark.createDataFrame([(1,)], "id long")
    assert dealt(rows, "id", 1) is rows
    # Spark would join the partitions of the small tables to one; given ones stay, and the window needs no other shuffle
    monkeypatch.setattr(fixtures, "dealt", lambda df, key: dealt(df, key, 1000))
    for name in ("p20_valid_pages", "w8_fill_section", "w9_stitch_fee_lines"):
        assert fixtures.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 32, name


def test_fee_lines_take_one_window(spark):
    """Section and record come by one pass of a document's lines; headers and notes don't enter it.  A line's class does not depend on how it is found."""
    rows = [
        "* Obs: nada", "1.01.00001 antes R$ 1,00", "OUTROS  EXEMPLOS", "codigo procedimento 20%", "2.02.00002  Proc  R$ 1.234,50  e 3,10 fim", "co-participação 40%", "com  contraste", None,
        "* Obs: valores", "5,00 0012.50", "", " 3.03.00003", "R$ 9", "7.777,10", "3.03.0000345x", "a 1.01.00001 codigo 20% 30%", "\ufb06otal de copartici R$ 1,00 R$ 2,00", "3,00",
        "TOTAL DE COPART\u0131CIPACAO 5,00", "OUTROS EXEMPLOS", "solto 1,00", "4.04.00004 TOTAL DE COPARTICIPAÇÃO 1,00", "5.05.00005 codigo procedimento valor unimed 20%", "6.06.00006 1.01.00001 R$ x, y.",
    ]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)] + [(2, None, "1.01.00001 x")], "doc_id long, line_pos int, line string")
    df = op.stitch_fee_lines(lines)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], -1 if r[1] is None else r[1]))
    s, s2, total = "OUTROS  EXEMPLOS", "OUTROS EXEMPLOS", "Total de Coparticipação"
    want = [  # doc, line, section, code, description, amounts
        (1, 1, "", "1.01.00001", "antes", "R$ 1,00"),
        (1, 4, s, "2.02.00002", "Proc e fim com  contraste", "R$ 1.234,50", "R$ 5,00"),  # the null line ends nothing, takes nothing
        (1, 11, s, "3.03.00003", "R$ 9", "R$ 7.777,10"),
        (1, 14, s, "3.03.00003", "45x", "R$ 1,01"),
        (1, 16, s, "", total, "", "R$ 1,00", "R$ 2,00"),
        (1, 18, s, "", total, "", "R$ 5,00"),
        (1, 21, s2, "", total, "", "R$ 4,04", "R$ 1,00"),
        (1, 22, s2, "5.05.00005", "codigo procedimento valor unimed 20%"),
        (1, 23, s2, "6.06.00006", ".00001 R$ x, y.", "R$ 1,01"),
        (2, None, "", "1.01.00001", "x"),
    ]
    assert got == [(*r, *[""] * (10 - len(r)), "total" if r[4] == total else "procedimento") for r in want]


def test_csv_values_are_made_once(spark, tmp_path):
    """A value is made safe once, whatever the number of columns; wide tables and cells of no column are found as before."""
    values = ["\r=x", " +1\n", "a\r\nb", None, "-", "", "@", "'", "\n", "x=\n", "\u00e9=", "\t=1"]
    cells = spark.createDataFrame([(1, 0, i, v) for i, v in enumerate(values)] + [(2, 0, 1, "b"), (2, 1, None, "lost"), (2, 2, 0, "1"), (2, 2, 0, "2")], "table_id long, row_pos int, col_pos int, value string")
    wide = op.wide_rows(cells, 12)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (wide, op.wide_rows(cells, 1))]
    assert plans[0].count("regexp_replace(") == plans[1].count("regexp_replace(") > 0
    rows = {(r[0], r[1]): list(r)[2:] for r in wide.collect()}
    assert rows[1, 0] == ["'=x", "'+1", "a  b", "", "'-", "", "'@", "'", "", "x=", "\u00e9=", "\t=1"]
    assert [rows[2, i][:2] for i in range(3)] == [[None, "b"], [None, None], ["2", None]]
    with pytest.raises(ValueError, match="12 columns, more than 11"):
        op.write_tables_csv(cells, str(tmp_path / "no"), 11)
    op.write_tables_csv(cells.where("table_id = 2"), str(tmp_path / "csv"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "csv").glob("part-*"))).splitlines() == [";b", ";", "2;"]
