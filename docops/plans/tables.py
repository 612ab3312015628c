"""Table-recovery queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import pages as pf
from ..functions import tables as t
from ..operators import tables as op
from ..sources import readers
from ..sources.checkpoints import shared_folder
from .fixtures import query

C = "cells"
# the cleaning of cells, step by step
CL = """c0 AS (SELECT table_id, row_pos, col_pos, trim(regexp_replace(coalesce(value, ''), '[\r\n]', ' ', 'g')) AS value FROM cells),
    c1 AS (SELECT * EXCLUDE (k) FROM (SELECT *, bool_or(value <> '') OVER (PARTITION BY table_id, col_pos) AS k FROM c0) x WHERE k),
    ce AS (SELECT * EXCLUDE (k) FROM (SELECT *, bool_or(value <> '') OVER (PARTITION BY table_id, row_pos) AS k FROM c1) x WHERE k)"""
HD = f"""{CL}, r0 AS (SELECT table_id, row_pos, count(*) FILTER (value <> '') AS n, count(*) AS w FROM ce GROUP BY ALL), r1 AS (SELECT *, n / w::DOUBLE AS fill FROM r0),
    hd AS (SELECT table_id, coalesce(min(row_pos) FILTER (fill >= 0.7), arg_max(row_pos, fill * 1000 - row_pos / 1000.0) FILTER (n >= 2), min(row_pos)) AS header_row FROM r1 GROUP BY table_id)"""
LB = f"""{HD}, l0 AS (SELECT table_id, col_pos, CASE WHEN value = '' THEN concat('Coluna ', CAST(row_number() OVER (PARTITION BY table_id ORDER BY col_pos) AS STRING)) ELSE value END AS name FROM ce JOIN hd USING (table_id) WHERE row_pos = header_row),
    l1 AS (SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY col_pos) AS n FROM l0), lb AS (SELECT table_id, col_pos, CASE WHEN n = 1 THEN name ELSE concat(name, ' (', CAST(n AS STRING), ')') END AS label FROM l1)"""
BD = f"""{LB}, b0 AS (SELECT ce.*, label FROM ce JOIN hd USING (table_id) LEFT JOIN lb USING (table_id, col_pos) WHERE row_pos > header_row),
    bd AS (SELECT * EXCLUDE (same, label) FROM (SELECT *, bool_and(coalesce(value = label, false)) OVER (PARTITION BY table_id, row_pos) AS same FROM b0) x WHERE NOT same)"""
NUMBER = r"""CASE WHEN {v} <> '' AND regexp_matches(trim(replace({v}, 'R$', ' ')), '^[\sR$+()-]?[\d.,\s]+%?$') THEN TRY_CAST(CASE WHEN contains({v}, ',') THEN replace(replace(rtrim(replace(replace({v}, 'R$', ''), ' ', ''), '%'), '.', ''), ',', '.') ELSE rtrim(replace(replace({v}, 'R$', ''), ' ', ''), '%') END AS DECIMAL(28,10)) / CASE WHEN ends_with({v}, '%') THEN 100 ELSE 1 END END"""
TY = f"""{BD}, ty0 AS (SELECT table_id, col_pos, avg(CASE WHEN {NUMBER.format(v='value')} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS ratio, bool_or(ends_with(value, '%')) AS p, bool_or(contains(value, 'R$')) AS m FROM bd GROUP BY ALL),
    ty AS (SELECT table_id, col_pos, CASE WHEN ratio < 0.6 THEN 'text' WHEN p THEN 'percent' WHEN m THEN 'money' ELSE 'number' END AS type FROM ty0)"""


def whole(load):
    return op.drop_empty(load(C))


@query("SELECT table_id, row_pos, col_pos, CASE WHEN regexp_matches(coalesce(value, ''), '^[=+@-]') THEN concat('''', value) ELSE coalesce(value, '') END AS value FROM cells", C)
def p33_excel_safe(load):
    return load(C).select("table_id", "row_pos", "col_pos", t.excel_safe(F.col("value")).alias("value"))


@query("SELECT doc_id, pos, style, CASE WHEN style IN (1, 2, 3) THEN CAST(cents AS DOUBLE) WHEN style = 7 THEN CAST(-cents AS DOUBLE) WHEN style = 4 THEN CAST(cents % 100 AS DOUBLE) END AS cents FROM money_strings", "money_strings")
def p34_parse_number(load):
    n = t.parse_number(F.col("raw"))
    return load("money_strings").select("doc_id", "pos", "style", F.round(n.cast("double") * F.when(F.col("style") == 4, 10000).otherwise(100), 0).alias("x")).select("doc_id", "pos", "style", F.when(F.col("style") == 4, F.round(F.col("x") / 100, 0)).otherwise(F.col("x")).alias("cents"))


WHOLE = """CASE WHEN cents >= 100000 THEN concat(CAST(CAST(floor(cents / 100000) AS BIGINT) AS STRING), '.', lpad(CAST(CAST(floor(cents / 100) AS BIGINT) % 1000 AS STRING), 3, '0')) ELSE CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) END"""


# style 7 is below zero: its cents keep the sign
@query(f"""SELECT doc_id, pos, CASE WHEN style IN (1, 2, 3) THEN concat('R$ ', {WHOLE}, ',', lpad(CAST(cents % 100 AS STRING), 2, '0'))
    WHEN style = 7 THEN concat('R$ -', {WHOLE}, ',', CASE WHEN cents % 100 = 0 THEN '00' ELSE concat('-', CAST(cents % 100 AS STRING)) END) ELSE raw END AS money FROM money_strings""", "money_strings")
def p35_format_brl(load):
    return load("money_strings").select("doc_id", "pos", t.format_brl(F.col("raw")).alias("money"))


MONEY = r"""CASE WHEN regexp_matches(line, 'R\$\s*\d{1,3}(?:\.\d{3})*,\d{2}') THEN regexp_extract_all(line, 'R\$\s*\d{1,3}(?:\.\d{3})*,\d{2}') ELSE [concat('R$ ', replace(x, '.', ',')) for x in regexp_extract_all(line, '\b\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\b')] END"""


@query(f"SELECT doc_id, line_pos, array_to_string({MONEY}, ';') AS money FROM fee_lines", "fee_lines")
def p36_extract_money(load):
    return load("fee_lines").select("doc_id", "line_pos", F.array_join(t.extract_money(F.col("line")), ";").alias("money"))


KEY = "SELECT doc_id, replace(replace(translate(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), 'çáàãâéêíóôõú', 'caaaaeeiooou'), '%', ' pct '), 'º', '') AS key FROM documents"


@query(KEY)
def p37_norm_key(load):
    return load("documents").select("doc_id", t.norm_key(F.col("text")).alias("key"))


# all documents, long ones too; a test holds it against plain Python besides
@query(KEY)
def p37_norm_key_all(load):
    return load("documents").select("doc_id", t.norm_key(F.col("text")).alias("key"))


# written out, so that a word lost from the library's lists shows
HEADER_WORDS = ["codigo", "código", "procedimento", "valor unimed", "co-part", "flex", "pleno", "cop.", "co-participação", "coparticipação", "20%", "30%", "40%", "50%"]
HITS = " + ".join(f"CASE WHEN contains(lower(line), '{x}') THEN 1 ELSE 0 END" for x in HEADER_WORDS)
NOTES = r"(?i)\*\s*Obs[:\s]|Com\s+exce[çc][aã]o\s+dos\s+valores|referem-se\s+ao\s+custo|pode\s+haver\s+varia[çc][aã]o|ANEXO\s+[IVX]+"
SECTIONS = r"(?i)EXEMPLOS\s+DE\s+(?:EXAMES|COPARTICIPAÇÃO|COPARTICIPA[CÇ][AÃ]O)|OUTROS\s+EXEMPLOS"
KIND = rf"""CASE WHEN regexp_matches(line, '{NOTES}') THEN 'note' WHEN ({HITS}) >= 3 AND NOT regexp_matches(line, '\d\.\d\d\.\d{{5}}') THEN 'header' WHEN regexp_matches(line, '{SECTIONS}') THEN 'section'
    WHEN contains(upper(line), 'TOTAL DE COPARTICI') THEN 'total' WHEN regexp_matches(line, '^\d\.\d\d\.\d{{5}}') THEN 'item' ELSE 'other' END"""


@query(f"SELECT doc_id, line_pos, {KIND} AS kind FROM fee_lines", "fee_lines")
def p38_line_class(load):
    return load("fee_lines").select("doc_id", "line_pos", t.line_class(F.col("line")).alias("kind"))


@query("SELECT table_id, row_pos, CAST(0 AS INT) AS part, string_agg(value, ' ' ORDER BY col_pos) AS line FROM cells WHERE coalesce(value, '') <> '' GROUP BY table_id, row_pos", C)
def p39_rows_to_lines(load):
    return op.rows_to_lines(load(C))


ITEM = rf"""regexp_extract(line, '^\d\.\d\d\.\d{{5}}') AS code, trim(regexp_replace(regexp_replace(regexp_replace(substr(line, 11), 'R\$\s*\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}', '', 'g'), '\b\d{{1,3}}(?:[.,]\d{{3}})*[.,]\d{{2}}\b', '', 'g'), '\s{{2,}}', ' ', 'g')) AS description"""
REST = MONEY.replace("line", "substr(line, 11)")


@query(f"SELECT doc_id, line_pos, {ITEM}, array_to_string(({REST})[1:5], ';') AS amounts FROM fee_lines WHERE regexp_matches(line, '^\\d\\.')", "fee_lines")
def p40_parse_item_line(load):
    out = load("fee_lines").where(F.col("line").rlike(r"^\d\.")).select("doc_id", "line_pos", t.parse_item_line(F.col("line")).alias("i"))
    return out.select("doc_id", "line_pos", "i.code", "i.description", F.array_join("i.amounts", ";").alias("amounts"))


@query("SELECT conv_id, turn, CASE WHEN turn = 0 THEN concat('Coluna ', CAST(conv_id + 1 AS STRING)) WHEN length(trim(text)) > 80 THEN concat(substr(trim(text), 1, 79), '…') ELSE trim(text) END AS label FROM conversations")
def p41_header_label(load):
    return load("conversations").select("conv_id", "turn", t.header_label(F.when(F.col("turn") == 0, " ").otherwise(F.col("text")), F.col("conv_id")).alias("label"))


# the first 200 characters of the upper-cased text, where a letter may become two or three (as in Python and Spark; DuckDB
# has one for one); a text that is null is empty
GROWING = [(c, c.upper()) for c in map(chr, range(0x110000)) if len(c.upper()) > 1]
HEAD = "substr(trim(coalesce(text, '')), 1, 200)"
for _letter, _letters in GROWING:
    HEAD = f"replace({HEAD}, '{_letter}', '{_letters}')"


@query(f"WITH x AS (SELECT doc_id, substr(upper({HEAD}), 1, 200) AS head FROM documents) SELECT doc_id, contains(head, 'THE ') OR contains(head, 'ERER') AS skip FROM x")
def p42_skip_page(load):
    return load("documents").select("doc_id", t.skip_page(F.col("text"), ["the ", "ERER"]).alias("skip"))


@query("x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) SELECT doc_id, CAST(pos AS INT) AS pos, trim(line) AS line FROM x WHERE trim(line) <> ''".replace("x AS", "WITH x AS", 1))
def p43_text_lines(load):
    return op.text_lines(load("documents"), "doc_id")


@query("SELECT doc_id, page_number, x0, CAST(height AS DOUBLE) - y1 AS y0, x1, CAST(height AS DOUBLE) - y0 AS y1 FROM (SELECT doc_id, page_number, height, 1.0::DOUBLE AS x0, CAST(page_number AS DOUBLE) AS y0, 5.0::DOUBLE AS x1, CAST(page_number + 9 AS DOUBLE) AS y1 FROM page_geometry) x", "page_geometry")
def p55_flip_y(load):
    box = F.struct(F.lit(1.0).alias("x0"), F.col("page_number").cast("double").alias("y0"), F.lit(5.0).alias("x1"), (F.col("page_number") + 9).cast("double").alias("y1"))
    return load("page_geometry").select("doc_id", "page_number", pf.flip_y(box, F.col("height").cast("double")).alias("b")).select("doc_id", "page_number", "b.*")


@query(f"{CL} SELECT table_id, row_pos, col_pos, value FROM ce", C)
def a22_drop_empty(load):
    return whole(load)


@query(f"{HD} SELECT table_id, header_row FROM hd", C)
def a23_detect_header(load):
    return op.detect_header(whole(load))


@query(f"{LB} SELECT table_id, col_pos, label FROM lb", C)
def w3_unique_names(load):
    return op.headers(whole(load))


def numbered_names(style, names):
    """Oracle: names of a customer's orders, the r-th repeat numbered by the r-th number that no name of the customer has."""
    first, made = {"field": (2, "concat(name, '__copy_', CAST({} AS STRING))"), "file": (1, "concat(regexp_extract(name, '^([^.]*)', 1), ' (', CAST({} AS STRING), ')', regexp_extract(name, '([.].*)$', 1))")}[style]
    case = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names))
    return f"""WITH x AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % {len(names)} {case} END AS name FROM orders),
        y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, name ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c, list(name) OVER (PARTITION BY o_custkey) AS names FROM x),
        z AS (SELECT *, unnest(range({first}, c + {first} + 1)) AS k FROM y WHERE n > 1),
        f AS (SELECT *, {made.format("k")} AS made FROM z), g AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS r FROM f WHERE NOT list_contains(names, made))
        SELECT o_orderkey, name AS unique_name FROM y WHERE n = 1 UNION ALL SELECT o_orderkey, made FROM g WHERE r = n - 1"""


def renamed(load, style, names):
    name = F.get(F.array(*map(F.lit, names)), F.col("o_orderkey") % len(names))
    return op.unique_names(load("orders").select("o_custkey", "o_orderkey", name.alias("name")), ["o_custkey"], [F.col("o_orderkey")], style=style).select("o_orderkey", "unique_name")


FIELDS, FILES = ["campo", "campo__copy_2", "campo", "campo", "campo__copy_2__copy_2"], ["a.pdf", "a (1).pdf", "a.pdf", "a", "a (2).pdf", "a.pdf", "a (1) (1).pdf"]


@query(numbered_names("field", FIELDS))
def w3_unique_fields(load):
    return renamed(load, "field", FIELDS)


@query(numbered_names("file", FILES))
def w3_unique_files(load):
    return renamed(load, "file", FILES)


@query(f"{BD} SELECT table_id, row_pos, col_pos, value FROM bd", C)
def a25_drop_repeated_header(load):
    return op.body(whole(load))


@query(f"{TY} SELECT table_id, col_pos, type FROM ty", C)
def a24_infer_types(load):
    return op.infer_types(op.body(whole(load)))


@query(f"{TY} SELECT table_id, row_pos, col_pos, type, CASE WHEN type <> 'text' THEN round(CAST({NUMBER.format(v='value')} AS DOUBLE), 6) END AS number, CASE WHEN type = 'text' THEN CASE WHEN regexp_matches(value, '^[=+@-]') THEN concat('''', value) ELSE value END END AS text FROM bd JOIN ty USING (table_id, col_pos)", C)
def a24b_typed_cells(load):
    return op.typed(op.body(whole(load))).select("table_id", "row_pos", "col_pos", "type", F.round(F.col("number").cast("double"), 6).alias("number"), "text")


@query(r"s AS (SELECT doc_id AS table_id, 2 * (CAST(bool_or(contains(upper(line), 'CO-PART')) AS INT) + CAST(bool_or(contains(upper(line), 'VALOR UNIMED')) AS INT) + CAST(bool_or(contains(upper(line), 'TOTAL DE COPARTICI')) AS INT) + CAST(bool_or(regexp_matches(upper(line), '(?i)EXEMPLOS\s+DE\s+(?:EXAMES|COPARTICIPA[CÇ][AÃ]O)|OUTROS\s+EXEMPLOS')) AS INT) + CAST(bool_or(regexp_matches(line, '\d\.\d\d\.\d{5}')) AS INT)) AS score FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(replace(line, 'CO', 'C0'), '.', ',') ELSE line END AS line FROM fee_lines) x GROUP BY doc_id) SELECT table_id, CAST(score AS INT) AS score, score >= 4 AS is_fee FROM s", "fee_lines")
def a26_is_fee_table(load):
    # every fifth document's lines are garbled, so that it has fewer signs
    value = F.when(F.col("doc_id") % 5 == 0, F.replace(F.replace("line", F.lit("CO"), F.lit("C0")), F.lit("."), F.lit(","))).otherwise(F.col("line"))
    return op.is_fee_table(load("fee_lines").select(F.col("doc_id").alias("table_id"), value.alias("value")))


@query(f"{BD}, n AS (SELECT table_id, col_pos, max(length(value)) AS n FROM bd GROUP BY ALL) SELECT table_id, col_pos, least(greatest(CAST(floor(greatest(length(label) + 3, coalesce(n, 0)) * 1.15::DOUBLE) AS INT), 10), 60) AS width FROM lb LEFT JOIN n USING (table_id, col_pos)", C)
def a28_display_width(load):
    return op.table_widths(whole(load))


@query("x AS (SELECT doc_id, CAST(page_number % 3 AS INT) AS priority, concat('s', CAST(page_number % 3 AS STRING)) AS strategy, sum(CASE WHEN bytes % 3 = 0 THEN 1 ELSE 0 END) AS n_rows FROM page_geometry GROUP BY ALL) SELECT doc_id, arg_min(strategy, priority) AS strategy FROM x WHERE n_rows > 0 GROUP BY doc_id", "page_geometry")
def a29_first_strategy(load):
    k = F.col("page_number") % 3
    got = load("page_geometry").groupBy("doc_id", k.alias("priority"), F.concat(F.lit("s"), k).alias("strategy")).agg(F.count_if(F.col("bytes") % 3 == 0).alias("n_rows"))
    return op.first_strategy(got)


SECT = f"""k AS (SELECT doc_id, line_pos, line, {KIND} AS kind FROM fee_lines), fs AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'section' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_pos ROWS UNBOUNDED PRECEDING), '') AS section FROM k)"""


@query(f"{SECT} SELECT doc_id, line_pos, section FROM fs", "fee_lines")
def w8_fill_section(load):
    return op.fill_section(load("fee_lines")).select("doc_id", "line_pos", "section")


@query(f"""{SECT}, i0 AS (SELECT *, sum(CASE WHEN kind IN ('item', 'total', 'section') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_pos) AS island FROM fs WHERE kind NOT IN ('note', 'header')),
    i1 AS (SELECT doc_id, island, line_pos, kind, section, CASE WHEN kind = 'item' THEN ({REST})[1:5] ELSE {MONEY} END AS money, CASE WHEN kind = 'item' THEN description ELSE trim(line) END AS text, code FROM (SELECT *, {ITEM} FROM i0) x WHERE island > 0),
    i2 AS (SELECT doc_id, island, min(line_pos) AS line_pos, arg_min(kind, line_pos) AS kind, arg_min(section, line_pos) AS section, arg_min(code, line_pos) AS code, flatten(list(money ORDER BY line_pos)) AS m,
        coalesce(string_agg(text, ' ' ORDER BY line_pos) FILTER (text <> '' AND (kind = 'item' OR len(money) = 0)), '') AS text FROM i1 GROUP BY ALL),
    i3 AS (SELECT *, CASE WHEN kind = 'total' THEN list_concat([''], m[1:4]) ELSE m[1:5] END AS a FROM i2 WHERE kind IN ('item', 'total'))
    SELECT doc_id, line_pos, section, CASE WHEN kind = 'item' THEN code ELSE '' END AS code, CASE WHEN kind = 'total' THEN 'Total de Coparticipação' ELSE text END AS description, coalesce(a[1], '') AS value, coalesce(a[2], '') AS share_20, coalesce(a[3], '') AS share_30, coalesce(a[4], '') AS share_40, coalesce(a[5], '') AS share_50, CASE WHEN kind = 'total' THEN 'total' ELSE 'procedimento' END AS kind FROM i3""", "fee_lines")
def w9_stitch_fee_lines(load):
    return op.stitch_fee_lines(load("fee_lines"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(height) AS BIGINT) AS heights FROM (SELECT doc_id, page_number, height FROM page_geometry UNION ALL SELECT doc_id, page_number, NULL FROM page_geometry WHERE page_number = 1) x GROUP BY doc_id", "page_geometry")
def u1_concat_tables(load):
    g = load("page_geometry")
    both = op.concat_tables([g.select("doc_id", "page_number", "height"), g.where("page_number = 1").select("page_number", "doc_id")])
    return both.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("height").alias("heights"))


@query("x AS (SELECT job_id AS doc_id, file_id AS table_id, file_id % 3 = 0 AS is_fee FROM job_files), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_fee ORDER BY table_id) AS n FROM x) SELECT doc_id, table_id, is_fee, CASE WHEN NOT is_fee THEN concat('Tabela ', CAST(n AS STRING)) WHEN n = 1 THEN 'Coparticipacao' ELSE concat('Coparticipacao ', CAST(n AS STRING)) END AS sheet FROM y", "job_files")
def s9_name_tables(load):
    return op.name_tables(load("job_files").select(F.col("job_id").alias("doc_id"), F.col("file_id").alias("table_id"), (F.col("file_id") % 3 == 0).alias("is_fee")))


RECTS = "rects AS (SELECT doc_id, n AS rect_id, x0 AS rx0, y0 AS ry0, x0 + 400 AS rx1, y0 + 200 AS ry1 FROM vectors WHERE n % 2 = 1)"
INSIDE = "v.x0 >= rx0 - 2 AND v.x1 <= rx1 + 2 AND v.y0 >= ry0 - 2 AND v.y1 <= ry1 + 2"


def rects(load):
    return load("vectors").where("n % 2 = 1").select("doc_id", F.col("n").alias("rect_id"), F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), (F.col("x0") + 400).alias("rx1"), (F.col("y0") + 200).alias("ry1"))


@query(f"{RECTS} SELECT v.doc_id, v.n, rect_id FROM vectors v JOIN rects r ON v.doc_id = r.doc_id WHERE {INSIDE}", "vectors")
def j9_lines_in_rects(load):
    return op.lines_in_rects(load("vectors"), rects(load)).select("doc_id", "n", "rect_id")


@query(f"{RECTS}, k AS (SELECT v.doc_id, rect_id, count(*) AS lines FROM vectors v JOIN rects r ON v.doc_id = r.doc_id WHERE {INSIDE} GROUP BY ALL), s AS (SELECT r.doc_id, r.rect_id, coalesce(lines, 0) / 1.0::DOUBLE AS score FROM rects r LEFT JOIN k ON r.doc_id = k.doc_id AND r.rect_id = k.rect_id) SELECT doc_id, rect_id, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rect_id) <= 2", "vectors")
def l5_dense_rects(load):
    return op.dense_rects(rects(load), load("vectors"), 600.0, 800.0).select("doc_id", "rect_id", "score")


@query("SELECT doc_id, n, text FROM words WHERE contains(lower(text), 'procedimento') OR contains(lower(text), 'valor')", "words")
def j10_hint_words(load):
    return op.hint_words(load("words"), ["Procedimento", "valor"]).select("doc_id", "n", "text")


@query("""h AS (SELECT doc_id, min(top) AS top, min(x0) AS l, max(x1) AS r FROM words WHERE contains(lower(text), 'procedimento') OR contains(lower(text), 'valor') GROUP BY doc_id), p AS (SELECT DISTINCT doc_id FROM words),
    f AS (SELECT p.doc_id, coalesce(top, 160) AS top, l, r FROM p LEFT JOIN h USING (doc_id)), v AS (SELECT * FROM vectors WHERE abs(y1 - y0) <= 1 AND x1 - x0 >= 180),
    b AS (SELECT f.doc_id, f.top, f.l, f.r, max(v.y1) FILTER (v.y1 > f.top) AS b, min(v.x0) AS lx0, max(v.x1) AS lx1 FROM f LEFT JOIN v ON f.doc_id = v.doc_id GROUP BY ALL)
    SELECT doc_id, greatest(0, least(42.0::DOUBLE, l, lx0) - 6) AS x0, greatest(0, top - 6) AS top, least(600, greatest(588.0::DOUBLE, r, lx1) + 6) AS x1, least(800, coalesce(b, 720) + 6) AS bottom FROM b""", "words vectors")
def a27_table_frame(load):
    out = op.table_frame(load("words"), load("vectors"), ["procedimento", "valor"], 600.0, 800.0)
    return out.select("doc_id", F.round("x0", 6).alias("x0"), F.round("top", 6).alias("top"), F.round("x1", 6).alias("x1"), F.round("bottom", 6).alias("bottom"))


@query("k AS (SELECT doc_id, n, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0 NULLS FIRST, n) <= 60 THEN 0 ELSE 1 END AS new FROM words), c AS (SELECT doc_id, x0, sum(new) OVER (PARTITION BY doc_id ORDER BY x0 NULLS FIRST, n ROWS UNBOUNDED PRECEDING) AS cluster FROM k) SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, round(avg(x0), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL", "words")
def w7_cluster_1d(load):
    return op.cluster_1d(load("words"), "x0", ["doc_id"], 60.0).withColumn("mean", F.round("mean", 6))


@query("f AS (SELECT table_id, row_pos, count(*) AS n, string_agg(trim(value), '|' ORDER BY col_pos) AS labels FROM cells WHERE trim(coalesce(value, '')) <> '' GROUP BY ALL) SELECT table_id, labels FROM f WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY row_pos) = 1", C)
def s7_target_labels(load):
    return readers.target_labels(load(C)).select("table_id", F.array_join("labels", "|").alias("labels"))


SAFE = "CASE WHEN regexp_matches(coalesce(value, ''), '^[=+@-]') THEN concat(chr(39), value) ELSE coalesce(value, '') END"


@query(f"SELECT string_agg({SAFE}, ';' ORDER BY col_pos) AS line FROM (SELECT t.table_id, t.row_pos, g.col_pos, value FROM (SELECT DISTINCT table_id, row_pos FROM cells) t CROSS JOIN (SELECT unnest(range(5)) AS col_pos) g LEFT JOIN cells c USING (table_id, row_pos, col_pos)) x GROUP BY table_id, row_pos", C)
def s8_write_tables_csv(load):
    cells = load(C)
    path = f"{shared_folder(cells.sparkSession)}/csv-{uuid.uuid4().hex}"
    op.write_tables_csv(cells, path, 5)
    return cells.sparkSession.read.text(path).select(F.regexp_replace("value", '""', "").alias("line"))


TARGETS = ["quantidade", "Valor", "Taxa anual", "Qtd", "Observação"]


# The test tables' labels are Qtd, Valor, Taxa and Valor (2).  Scores are 2 * matched / both lengths, and 0.15 if one name
# holds the other: valor 1 + 0.15, taxa in taxa anual 8/14 + 0.15, qtd 1 + 0.15; the other targets have none above 0.55.
LABELS = "x AS (SELECT table_id, col_pos, CASE col_pos WHEN 3 THEN 'Valor (2)' WHEN 4 THEN 'Coluna 5' ELSE value END AS label FROM cells WHERE row_pos = 1)"


def labels(load):
    """The rows of labels, blank and repeated ones named."""
    name = F.struct("col_pos", t.header_label(F.col("value"), F.col("col_pos")).alias("name"))
    rows = load(C).where("row_pos = 1").groupBy("table_id").agg(F.sort_array(F.collect_list(name)).alias("row"))
    unique = F.arrays_zip(F.col("row.col_pos").alias("col_pos"), t.unique_in_order(F.col("row.name")).alias("label"))
    return rows.select("table_id", F.explode(unique).alias("c")).select("table_id", "c.col_pos", "c.label")


@query(f"{LABELS}, k(target, label, score) AS (VALUES ('Valor', 'Valor', 1.15::DOUBLE), ('Taxa anual', 'Taxa', 8 / 14.0::DOUBLE + 0.15::DOUBLE), ('Qtd', 'Qtd', 1.15::DOUBLE)) SELECT table_id, target, col_pos, round(score, 9) AS score FROM x JOIN k USING (label)", C)
def j12_match_columns(load):
    return op.match_columns(labels(load), TARGETS).withColumn("score", F.round("score", 9))


# accents on either side: equal keys score 1 + 0.15, observacoes has 9 letters of observacao's 10 and its own 11 in common order
ACCENTS = ["Observacao", " OBSERVAÇÃO", "Observações", "Funcao", "Função do item", "outra coisa"]


@query("""x AS (SELECT DISTINCT table_id, CAST(table_id % 6 AS INT) AS k FROM cells), s(k, target, score) AS (VALUES (0, 'Observação', 1.15::DOUBLE), (1, 'Observação', 1.15::DOUBLE), (2, 'Observação', 18 / 21.0::DOUBLE), (3, 'Função', 1.15::DOUBLE), (4, 'Função', 12 / 20.0::DOUBLE + 0.15::DOUBLE))
    SELECT table_id, target, CAST(0 AS INT) AS col_pos, round(score, 9) AS score FROM x JOIN s USING (k)""", C)
def j12_match_accents(load):
    label = F.get(F.array(*map(F.lit, ACCENTS)), (F.col("table_id") % 6).cast("int"))
    own = load(C).select("table_id").distinct().select("table_id", F.lit(0).alias("col_pos"), label.alias("label"))
    return op.match_columns(own, ["Observação", "Função"]).withColumn("score", F.round("score", 9))


WIDER = [*TARGETS, "VALOR (2)"]  # a fourth match, which tables need to be accepted
MATCHED = f"{LABELS}, n AS (SELECT table_id, count(*) FILTER (label IN ('Qtd', 'Valor', 'Taxa', 'Valor (2)') AND table_id % 4 > 0) AS n FROM x GROUP BY table_id)"


@query(f"{MATCHED} SELECT table_id, n AS matched, n >= 4 AS accepted FROM n", C)
def a30_accept_schema(load):
    # every fourth table has labels that match nothing, and a row all the same
    own = labels(load).withColumn("label", F.when(F.col("table_id") % 4 == 0, F.concat(F.lit("#"), F.col("col_pos").cast("string"))).otherwise(F.col("label")))
    return op.accept_schema(own, op.match_columns(own, WIDER), len(WIDER))


SHEETS = "n AS (SELECT table_id, table_id // 8 AS doc_id, table_id % 3 = 0 AS is_fee FROM (SELECT DISTINCT table_id FROM cells) d), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_fee ORDER BY table_id) AS k FROM n)"
NAMES = "CASE WHEN NOT is_fee THEN concat('Tabela ', CAST(k AS STRING)) WHEN k = 1 THEN 'Coparticipacao' ELSE concat('Coparticipacao ', CAST(k AS STRING)) END"


def written(load, single):
    cells = load(C)
    tables = cells.select("table_id").distinct().select(F.expr("table_id div 8").alias("doc_id"), "table_id", (F.col("table_id") % 3 == 0).alias("is_fee"))
    path = f"{shared_folder(cells.sparkSession)}/sheets-{uuid.uuid4().hex}"
    op.write_tables(cells, path, tables, single)
    return cells.sparkSession.read.schema("doc_id long, line int, col_pos int, value string, sheet string").parquet(path)


def sheet_rows(name):
    return f"{SHEETS}, p AS (SELECT doc_id, {name} AS sheet, c.table_id, row_pos, col_pos, value FROM cells c JOIN m USING (table_id)) SELECT doc_id, sheet, CAST(dense_rank() OVER (PARTITION BY doc_id, sheet ORDER BY table_id, row_pos) - 1 AS INT) AS line, col_pos, value FROM p"


@query(sheet_rows(NAMES), C)
def s9_write_tables(load):
    return written(load, False)


@query(sheet_rows("'Tabela 1'"), C)
def s9_write_single_table(load):
    return written(load, True)


@query("SELECT doc_id, page_number, width * 2 AS width FROM page_geometry WHERE page_number <= 3", "page_geometry")
def f1_with_page_transform(load):
    return op.with_page_transform(load("page_geometry"), lambda df: df.where("page_number <= 3").select("doc_id", "page_number", (F.col("width") * 2).alias("width")))
