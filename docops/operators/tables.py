"""Table recovery: cells (table_id, row_pos, col_pos, value), words, vectors and fee lines."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import tables as t


def cleaned(cells: DataFrame) -> DataFrame:
    """Values on one line, trimmed; null is empty."""
    return cells.withColumn("value", F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"[\r\n]", " ")))


def drop_empty(cells: DataFrame) -> DataFrame:
    """Without the rows and columns of a table that have no value.  The cells of a table come together, once for all steps."""
    cols = Window.partitionBy("table_id", "col_pos")
    rows = _whole_row()  # in the order that with_labels needs: its windows by row and table sort no more
    filled = F.col("value") != ""
    kept = cleaned(cells).repartition("table_id").withColumn("_c", F.bool_or(filled).over(cols)).where("_c")
    return kept.withColumn("_r", F.bool_or(filled).over(rows)).where("_r").drop("_c", "_r")


def _whole_row() -> WindowSpec:
    return Window.partitionBy("table_id", "row_pos").orderBy("col_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def detect_header(cells: DataFrame, min_fill: float = 0.7) -> DataFrame:
    """(table_id, header_row): the first row filled by min_fill, else the fullest with two values, else the first."""
    rows = cells.groupBy("table_id", "row_pos").agg(F.count_if(F.col("value") != "").alias("n"), F.count("*").alias("w"))
    rows = rows.withColumn("fill", F.col("n") / F.greatest(F.col("w"), F.lit(1)))
    first = F.min(F.when(F.col("fill") >= min_fill, F.col("row_pos")))
    best = F.max(F.when(F.col("n") >= 2, F.struct("fill", -F.col("row_pos"))))
    return rows.groupBy("table_id").agg(F.coalesce(first, -best["col2"], F.min("row_pos")).alias("header_row"))


def unique_names(df: DataFrame, keys: list[str], order: list[Column], name: str = "name", style: str = "column") -> DataFrame:
    """Adds unique_name, of which no two are equal within the keys: ``x (2)``, ``x__copy_2`` or ``base (1).ext`` by style.

    A name as it stands keeps its first place.  Its repeats are numbered in order, from 2 (files from 1) on, and pass
    over the numbers that a name of the same keys already has: ``x, x, x (2)`` gives ``x, x (3), x (2)``.  Numbered
    names of two bases never meet, as a name's base and number can be read off it.  A null name stays null.

    Every name is a member of its own group, and one that looks like a numbered ``x`` counts in the group of ``x`` too.
    There the r-th repeat and the taken numbers are put in one order, and what a repeat passes over is a running count.
    """
    first = t.NUMBERED[style][0]
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    base, number = t.numbered_parts(F.col(name), style)
    rows = df.withColumn("_n", n)
    own = F.struct(F.lit(True).alias("own"), F.col(name).alias("group"), F.lit(None).cast("long").alias("taken"))
    other = F.when((F.col("_n") == 1) & base.isNotNull(), F.struct(F.lit(False).alias("own"), base.alias("group"), number.alias("taken")))
    roles = rows.withColumn("_role", F.explode(F.array_compact(F.array(own, other))))
    group = Window.partitionBy(*keys, "_role.group")
    rank = F.row_number().over(group.orderBy("_role.own", "_role.taken"))  # taken numbers come first, by size
    # a taken number stands after as many repeats as there are free numbers below it
    place = F.when(F.col("_role.own"), 2 * (F.col("_n") - 1)).otherwise(2 * (F.col("_role.taken") - first - rank + 1) + 1)
    passed = F.count_if(~F.col("_role.own")).over(group.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    placed = roles.withColumn("_place", place).withColumn("_passed", passed).where("_role.own")
    made = t.numbered(F.col(name), first + F.col("_n") - 2 + F.col("_passed"), style)
    return placed.withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(made)).drop("_n", "_role", "_place", "_passed")


def with_labels(cells: DataFrame, min_fill: float = 0.7) -> DataFrame:
    """Cells with their table's header_row (as detect_header) and their column's label, made unique, in one pass by table."""
    return _labelled(_with_names(cells, min_fill))


def _with_names(cells: DataFrame, min_fill: float = 0.7) -> DataFrame:
    """Cells with their table's header_row, in that row with all its names and the cell's place among them."""
    table, row = Window.partitionBy("table_id"), Window.partitionBy("table_id", "row_pos")
    filled = cells.withColumn("_n", F.count_if(F.col("value") != "").over(row)).withColumn("_fill", F.col("_n") / F.count("*").over(row))
    first = F.min(F.when(F.col("_fill") >= min_fill, F.col("row_pos"))).over(table)
    best = F.max(F.when(F.col("_n") >= 2, F.struct("_fill", (-F.col("row_pos")).alias("back")))).over(table)
    placed = filled.withColumn("header_row", F.coalesce(first, -best["back"], F.min("row_pos").over(table))).drop("_n", "_fill")
    header = F.col("row_pos") == F.col("header_row")
    place = F.row_number().over(Window.partitionBy("table_id", "row_pos").orderBy("col_pos")) - 1
    named = placed.withColumn("_place", place).withColumn("_name", F.when(header, t.header_label(F.col("value"), F.col("_place"))))
    return named.withColumn("_names", F.collect_list("_name").over(_whole_row()))  # empty but in the header row


def _labelled(named: DataFrame) -> DataFrame:
    header = F.col("row_pos") == F.col("header_row")
    label = F.max(F.when(header, F.get(t.unique_in_order(F.col("_names")), F.col("_place")))).over(Window.partitionBy("table_id", "col_pos"))
    return named.withColumn("label", label).drop("_place", "_name", "_names")


def headers(cells: DataFrame) -> DataFrame:
    """(table_id, col_pos, label) of the detected header rows, labels made unique."""
    return _labelled(_with_names(cells).where("row_pos = header_row")).select("table_id", "col_pos", "label")


def body(cells: DataFrame) -> DataFrame:
    """Cells below the header row, without rows that repeat the labels."""
    below = with_labels(cells).where("row_pos > header_row").drop("header_row")
    return _without_repeats(below)


def _same_as_labels() -> Column:
    return F.bool_and(F.coalesce(F.col("value") == F.col("label"), F.lit(False))).over(Window.partitionBy("table_id", "row_pos"))


def _without_repeats(marked: DataFrame) -> DataFrame:
    return marked.withColumn("_same", _same_as_labels()).where("NOT _same").drop("_same", "label")


def drop_repeated_header(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Without the rows whose every value is its column's label."""
    return _without_repeats(cells.join(labels, ["table_id", "col_pos"], "left"))


def infer_types(cells: DataFrame, min_ratio: float = 0.6) -> DataFrame:
    """(table_id, col_pos, type): percent, money or number if enough values parse, else text."""
    ratio, percent, money = _type_signs(t.parse_number(F.col("value")))
    by = cells.groupBy("table_id", "col_pos").agg(ratio.alias("ratio"), percent.alias("p"), money.alias("m"))
    return by.select("table_id", "col_pos", _type(min_ratio).alias("type"))


def _type_signs(number: Column) -> tuple[Column, Column, Column]:
    return F.count_if(number.isNotNull()) / F.count("*"), F.bool_or(F.trim("value").endswith("%")), F.bool_or(F.contains("value", F.lit("R$")))


def _type(min_ratio: float) -> Column:
    return F.when(F.col("ratio") < min_ratio, "text").when(F.col("p"), "percent").when(F.col("m"), "money").otherwise("number")


def typed(cells: DataFrame, min_ratio: float = 0.6) -> DataFrame:
    """Body cells with their column's type (as infer_types), a number where it is numeric, and a safe text where it isn't.

    The type comes by windows, so that the cells are made once; cells of no table or column are left out.
    """
    col = Window.partitionBy("table_id", "col_pos")
    read = cells.where("table_id IS NOT NULL AND col_pos IS NOT NULL").withColumn("number", t.parse_number(F.col("value")))
    some = F.count_if(F.col("number").isNotNull()).over(col) / F.count("*").over(col)
    _, percent, money = _type_signs(F.col("number"))
    both = read.withColumns({"ratio": some, "p": percent.over(col), "m": money.over(col)}).withColumn("type", _type(min_ratio)).drop("ratio", "p", "m")
    text = F.col("type") == "text"
    return both.withColumn("number", F.when(~text, F.col("number"))).withColumn("text", F.when(text, t.excel_safe(F.col("value"))))


def is_fee_table(cells: DataFrame, min_score: int = 4) -> DataFrame:
    """(table_id, score, is_fee): two points for each of five signs."""
    up = F.upper(F.coalesce("value", F.lit("")))
    signs = [F.contains(up, F.lit("CO-PART")), F.contains(up, F.lit("VALOR UNIMED")), F.contains(up, F.lit("TOTAL DE COPARTICI")), up.rlike(t.SECTION), up.rlike(t.CODE)]
    score = sum((F.when(F.bool_or(s), 2).otherwise(0) for s in signs), F.lit(0))
    return cells.groupBy("table_id").agg(score.alias("score")).withColumn("is_fee", F.col("score") >= min_score)


def table_widths(cells: DataFrame) -> DataFrame:
    """display_width of whole tables' body and headers, in one pass."""
    marked = with_labels(cells)
    below = (F.col("row_pos") > F.col("header_row")) & ~F.col("_same")
    longest = F.max(F.when(below, F.length("value"))).over(Window.partitionBy("table_id", "col_pos"))
    return _width(marked.withColumn("_same", _same_as_labels()).withColumn("n", longest).where("row_pos = header_row"))


def display_width(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(table_id, col_pos, width): 1.15 times the longest text (labels with 3 more), from 10 to 60."""
    longest = cells.groupBy("table_id", "col_pos").agg(F.max(F.length("value")).alias("n"))
    return _width(labels.join(longest, ["table_id", "col_pos"], "left"))


def _width(both: DataFrame) -> DataFrame:
    width = F.floor(F.greatest(F.length("label") + 3, F.coalesce("n", F.lit(0))) * 1.15).cast("int")
    return both.select("table_id", "col_pos", F.least(F.greatest(width, F.lit(10)), F.lit(60)).alias("width"))


def first_strategy(candidates: DataFrame) -> DataFrame:
    """(doc_id, strategy): the one of least priority that yielded rows."""
    return candidates.where("n_rows > 0").groupBy("doc_id").agg(F.min_by("strategy", "priority").alias("strategy"))


def rows_to_lines(cells: DataFrame) -> DataFrame:
    """(table_id, row_pos, part, line): values joined by a space, notes dropped, lines parted before codes."""
    values = F.transform(F.sort_array(F.collect_list(F.when(F.trim("value") != "", F.struct("col_pos", F.trim("value").alias("v"))))), lambda x: x["v"])
    rows = cells.groupBy("table_id", "row_pos").agg(F.array_join(values, " ").alias("raw")).where(F.col("raw") != "").where(~F.col("raw").rlike(t.NOTE))
    return rows.select("table_id", "row_pos", F.posexplode(t.split_codes(F.col("raw"))).alias("part", "line"))


def text_lines(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line): trimmed lines of a text that have something on them; pos counts all lines."""
    return pages.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\R")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def fill_section(lines: DataFrame) -> DataFrame:
    """Each line with the last section title before it, '' if none; a column ``kind`` is taken for its class."""
    w = Window.partitionBy("doc_id").orderBy("line_pos").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind") if "kind" in lines.columns else t.line_class(F.col("line"))
    return lines.withColumn("section", F.coalesce(F.last(F.when(kind == "section", F.trim("line")), ignorenulls=True).over(w), F.lit("")))


def stitch_fee_lines(lines: DataFrame) -> DataFrame:
    """Fee records of (doc_id, line_pos, line): items with their continuations, and totals.

    After an item, lines without an amount go on with its description and amounts fill its five places from the left,
    until the next item, total or section; headers and notes neither end nor join it.  Lines are shuffled once, with
    their class; amounts are read of those lines only that belong to an item or a total.
    """
    low = lines.select("doc_id", "line_pos", "line", F.lower("line").alias("low"))
    classed = low.select("doc_id", "line_pos", "line", t.line_class(F.col("line"), F.col("low")).alias("class"))
    # headers and notes go before the sort; a filter would be moved below the class and work it out again
    met = F.when(F.col("class").isin("note", "header"), F.array().cast("array<string>")).otherwise(F.array("class"))
    kinds = classed.select("doc_id", "line_pos", "line", F.explode(met).alias("kind"))
    w = Window.partitionBy("doc_id").orderBy("line_pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col("kind").isin("item", "total", "section"), F.struct("line_pos", "kind"))
    title = F.when(F.col("kind") == "section", F.trim("line"))
    filled = kinds.select("*", F.last(title, ignorenulls=True).over(w).alias("section"), F.last(starts, ignorenulls=True).over(w).alias("start"))
    island = filled.where(F.col("kind") != "section").where(F.col("start.kind").isin("item", "total")).withColumn("island", F.col("start.line_pos"))
    own = F.col("kind") == "item"
    code, after = t.item_parts(F.col("line"))
    read = island.withColumn("rest", F.when(own, after).otherwise(F.trim("line"))).withColumn("marked", t.marked_money(F.col("rest")))
    money = F.when(F.size("marked") > 0, F.col("marked")).otherwise(F.coalesce(t.bare_money(F.col("rest")), F.col("marked")))  # a null line has none
    # without its R$ amounts a line has mostly no figures left to search for bare ones
    bare = F.when(F.size("marked") > 0, F.regexp_replace("rest", t.MONEY_BR, "")).otherwise(F.col("rest"))
    read = read.withColumn("money", money).withColumn("bare", F.when(own, bare))
    figures = F.contains("bare", F.lit(",")) | F.contains("bare", F.lit("."))
    said = t.one_spaced(F.when(figures, F.regexp_replace("bare", t.MONEY_NUM, "")).otherwise(F.col("bare")))
    text = F.when(own, said).when(F.size("money") == 0, F.col("rest"))
    head = F.when(F.col("line_pos").eqNullSafe(F.col("island")), F.coalesce("section", F.lit("")))
    part = F.struct("line_pos", "kind", F.when(own, code).alias("code"), F.when(own, F.slice("money", 1, 5)).otherwise(F.col("money")).alias("money"), F.nullif(text, F.lit("")).alias("text"), head.alias("section"))
    parts = read.select("doc_id", "island", part.alias("part"))
    got = parts.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list("part")).alias("p")).withColumn("head", F.col("p")[0]).where("head.kind IN ('item', 'total')")
    total = F.col("head.kind") == "total"
    amounts = F.when(total, F.slice(F.col("head.money"), 1, 4)).otherwise(F.slice(F.flatten("p.money"), 1, 5))
    words = F.array_join("p.text", " ")
    at = lambda i: F.coalesce(F.get("amounts", F.lit(i)), F.lit(""))
    rated = [F.when(total, at(i - 1)).otherwise(at(i)) for i in range(1, 5)]
    return got.withColumn("amounts", amounts).select(
        "doc_id", F.col("head.line_pos").alias("line_pos"), F.col("head.section").alias("section"), F.coalesce("head.code", F.lit("")).alias("code"),
        F.when(total, "Total de Coparticipação").otherwise(words).alias("description"), F.when(total, "").otherwise(at(0)).alias("value"),
        *[c.alias(n) for c, n in zip(rated, ("share_20", "share_30", "share_40", "share_50"))], F.when(total, "total").otherwise("procedimento").alias("kind"),
    )


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; a column that one lacks is null there."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def name_tables(tables: DataFrame, single: bool = False) -> DataFrame:
    """(table_id, sheet): ``Tabela n`` or ``Coparticipacao[ n]``, counted by kind; one sheet for all if single."""
    n = F.row_number().over(Window.partitionBy("doc_id", "is_fee").orderBy("table_id"))
    fee = F.when(n == 1, "Coparticipacao").otherwise(F.concat(F.lit("Coparticipacao "), n))
    plain = F.concat(F.lit("Tabela "), n)
    return tables.withColumn("sheet", F.lit("Tabela 1") if single else F.when(F.col("is_fee"), fee).otherwise(plain))


def wide_rows(cells: DataFrame, columns: int) -> DataFrame:
    """(table_id, row_pos, 0, 1, ...): a row's values, safe for spreadsheets; of two cells at one place the greater stands."""
    # values are made safe before they are dealt to columns, whose aggregates use what they are given several times
    safe = cells.select("table_id", "row_pos", "col_pos", t.excel_safe(F.col("value")).alias("value"))
    return safe.groupBy("table_id", "row_pos").agg(*[F.max(F.when(F.col("col_pos") == i, F.col("value"))).alias(str(i)) for i in range(columns)])


def write_tables_csv(cells: DataFrame, path: str, columns: int | None = None) -> None:
    """All rows as text without a header, fields parted by ``;``, every value safe for spreadsheets.

    Lines have as many fields as the widest table has columns; with ``columns`` as many as that, and a table that has
    more is an error, as its values would be lost.
    """
    beyond = cells if columns is None else cells.where(F.col("col_pos") >= columns)
    last = beyond.agg(F.max("col_pos")).first()[0]
    widest = 0 if last is None else last + 1
    if columns is not None and columns < widest:
        raise ValueError(f"a table has {widest} columns, more than {columns}")
    # the sort reads its input twice, once for the bounds of its ranges: from a shuffle, so that rows are made once
    wide = wide_rows(cells, columns or max(widest, 1)).repartition("row_pos", "table_id")
    wide.orderBy("table_id", "row_pos").drop("table_id", "row_pos").write.mode("overwrite").csv(path, sep=";", header=False)


def write_tables(cells: DataFrame, path: str, tables: DataFrame, single: bool = False) -> None:
    """Cells (table_id, row_pos, col_pos, value) in one folder a sheet, or all in one sheet, rows counted on over its tables.

    ``tables`` (doc_id, table_id, is_fee) names the sheets; a name is shared by documents, which stay apart by doc_id.
    Cells of no row, and tables of no document, are left out.  Cells are shuffled once, to where their table's first line
    is known, and written from there.
    """
    names = name_tables(tables, single).select("doc_id", "table_id", "sheet").where("doc_id IS NOT NULL")
    sizes = cells.where("row_pos IS NOT NULL").select("table_id", "row_pos").distinct().groupBy("table_id").agg(F.count("*").alias("n"))
    # rows of the sheet's earlier tables; a table that is listed twice counts once
    once = F.row_number().over(Window.partitionBy("sheet", "doc_id", "table_id").orderBy("table_id")) == 1
    before = F.sum(F.when(F.col("once"), F.col("n")).otherwise(0)).over(Window.partitionBy("sheet", "doc_id").orderBy("table_id")) - F.col("n")
    starts = names.join(sizes, "table_id").withColumn("once", once).withColumn("before", before).drop("once", "n")
    # a row a table is hashed, so that cells are sorted once: by sheet first, as the writer wants its rows
    place = F.dense_rank().over(Window.partitionBy("sheet", "table_id").orderBy("row_pos")) - 1
    placed = cells.where("row_pos IS NOT NULL").join(starts.hint("shuffle_hash"), "table_id").withColumn("line", (F.col("before") + place).cast("int"))
    placed.select("doc_id", "sheet", "line", "col_pos", "value").write.mode("overwrite").partitionBy("sheet").parquet(path)


# positions


def lines_in_rects(vectors: DataFrame, rects: DataFrame, tol: float = 2.0, cell: float = 16.0) -> DataFrame:
    """Vectors inside rectangles of the same document (rect_id, rx0, ry0, rx1, ry1), with a tolerance.

    Either end of a vector may come first.  See ``rect_candidates`` for how pairs are found; the test itself is exact.
    """
    low, high = (lambda a: F.least(f"{a}0", f"{a}1")), (lambda a: F.greatest(f"{a}0", f"{a}1"))
    inside = (low("x") >= F.col("rx0") - tol) & (high("x") <= F.col("rx1") + tol) & (low("y") >= F.col("ry0") - tol) & (high("y") <= F.col("ry1") + tol)
    return rect_candidates(vectors, rects, tol, cell).where(inside)


def rect_candidates(vectors: DataFrame, rects: DataFrame, tol: float = 2.0, cell: float = 16.0) -> DataFrame:
    """Pairs of a vector and a rectangle that can hold it, each pair once, by grids of cells.

    A rectangle lies in the grid whose cells are the least doublings of ``cell`` as wide and as high as it is, where it
    meets four cells at most; a vector stands in the one cell of its lower corner, in every grid that its document's
    rectangles use and whose cells are large enough to hold it.  So a rectangle meets vectors near its own size only,
    whatever else the document holds.  Rectangles and vectors without all four coordinates meet nothing.
    """
    level = lambda a, b: F.greatest(F.lit(0.0), F.ceil(F.log2((F.col(b) - F.col(a) + 2 * tol) / cell))).cast("int")
    size = lambda c: F.lit(cell) * F.pow(F.lit(2.0), c)
    at = lambda x, c: F.floor(x / size(c)).cast("long")
    whole = (F.col("rx1") - F.col("rx0") + 2 * tol >= 0) & (F.col("ry1") - F.col("ry0") + 2 * tol >= 0)
    placed = rects.where(whole).withColumn("_lx", level("rx0", "rx1")).withColumn("_ly", level("ry0", "ry1"))
    span = lambda low, high, c: F.sequence(at(F.col(low) - tol, c), at(F.col(high) + tol, c))
    cells = placed.withColumn("_gx", F.explode(span("rx0", "rx1", F.col("_lx")))).withColumn("_gy", F.explode(span("ry0", "ry1", F.col("_ly"))))
    grids = placed.groupBy("doc_id").agg(F.collect_set(F.struct("_lx", "_ly")).alias("_grids"))
    room = 1.001  # a level comes from a logarithm: what fits by a hair is let in
    fits = lambda g: (F.abs(F.col("x1") - F.col("x0")) <= room * size(g["_lx"])) & (F.abs(F.col("y1") - F.col("y0")) <= room * size(g["_ly"]))
    corners = vectors.join(grids, "doc_id").withColumn("_g", F.explode(F.filter("_grids", fits))).select(*vectors.columns, "_g.*")
    corners = corners.withColumn("_gx", at(F.least("x0", "x1"), F.col("_lx"))).withColumn("_gy", at(F.least("y0", "y1"), F.col("_ly")))
    return corners.join(cells, ["doc_id", "_lx", "_ly", "_gx", "_gy"]).drop("_lx", "_ly", "_gx", "_gy")


def dense_rects(rects: DataFrame, vectors: DataFrame, width: float, height: float, k: int = 2) -> DataFrame:
    """The k rectangles of each document of 5 % of the page at least with the most lines for their share of it."""
    share = (F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0")) / F.lit(width * height)
    large = rects.withColumn("share", share).where("share >= 0.05")
    counts = lines_in_rects(vectors, large).groupBy("doc_id", "rect_id").agg(F.count("*").alias("lines"))
    scored = large.join(counts, ["doc_id", "rect_id"], "left").withColumn("score", F.coalesce("lines", F.lit(0)) / F.greatest(F.lit(1.0), F.col("share")))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "rect_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hint_words(words: DataFrame, hints: list[str]) -> DataFrame:
    """Words that contain one of the hints, in any case."""
    low = F.lower("text")
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(low, F.lit(h.lower()))
    return words.where(out)


def table_frame(words: DataFrame, vectors: DataFrame, hints: list[str], width: float, height: float, margin: float = 6.0) -> DataFrame:
    """(doc_id, x0, top, x1, bottom) of a page's table, from its hint words and long level lines."""
    found = hint_words(words, hints).groupBy("doc_id").agg(F.min("top").alias("top"), F.min("x0").alias("l"), F.max("x1").alias("r"))
    pages = words.select("doc_id").union(vectors.select("doc_id")).distinct()
    framed = pages.join(found, "doc_id", "left").withColumn("top", F.coalesce("top", F.lit(0.20 * height)))
    level = vectors.where((F.abs(F.col("y1") - F.col("y0")) <= 1) & (F.col("x1") - F.col("x0") >= 0.30 * width)).select("doc_id", "y1", F.col("x0").alias("lx0"), F.col("x1").alias("lx1"))
    below = framed.join(level, "doc_id", "left").groupBy("doc_id", "top", "l", "r").agg(F.max(F.when(F.col("y1") > F.col("top"), F.col("y1"))).alias("b"), F.min("lx0").alias("lx0"), F.max("lx1").alias("lx1"))
    return below.select(
        "doc_id", F.greatest(F.lit(0.0), F.least(F.lit(0.07 * width), "l", "lx0") - margin).alias("x0"), F.greatest(F.lit(0.0), F.col("top") - margin).alias("top"),
        F.least(F.lit(width), F.greatest(F.lit(0.98 * width), "r", "lx1") + margin).alias("x1"), F.least(F.lit(height), F.coalesce("b", F.lit(0.90 * height)) + margin).alias("bottom"),
    )


def cluster_1d(df: DataFrame, value: str, keys: list[str], tol: float) -> DataFrame:
    """(keys, cluster, mean, n): sorted values, a new cluster where the step is larger than tol."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= tol, 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "cluster").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


# schema matching: the one matcher that built-in expressions can't state


@lru_cache(1 << 16)
def _likeness(column: str, target: str) -> float:
    return SequenceMatcher(None, column, target).ratio() + (0.15 if column in target or target in column else 0.0)


def match_columns(labels: DataFrame, targets: list[str], min_score: float = 0.55) -> DataFrame:
    """(table_id, target, col_pos, score): each target, in order, takes the free column whose name is most alike.

    Both names are folded to keys.  The score is the matcher's ratio of column to target, and 0.15 more if one key holds
    the other (an empty one is held by all); of equal scores the first column wins.  A table's labels come as one row,
    many tables to a batch; a worker remembers the scores of names that it has met.
    """
    wanted = F.array(*[t.norm_key(F.lit(x)) for x in targets])
    keyed = labels.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col_pos", t.norm_key(F.col("label")).alias("key")))).alias("own"))
    kind = pa.schema([("table_id", pa.int64()), ("target", pa.string()), ("col_pos", pa.int32()), ("score", pa.float64())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for table, own, keys in zip(*(b[c].to_pylist() for c in ("table_id", "own", "wanted"))):
                free = {c["col_pos"]: c["key"] for c in own}
                for name, target in zip(targets, keys):
                    best = max(((_likeness(k, target), -c) for c, k in free.items()), default=(0.0, 0))
                    if best[0] >= min_score:
                        out.append((table, name, -best[1], best[0]))
                        del free[-best[1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    rows = keyed.select(F.col("table_id").cast("long").alias("table_id"), "own", wanted.alias("wanted"))
    return rows.mapInArrow(pick, "table_id long, target string, col_pos int, score double")


def accept_schema(labels: DataFrame, matches: DataFrame, n_targets: int) -> DataFrame:
    """(table_id, matched, accepted) of every table: four matches at least, and four in ten of the targets."""
    need = max(4, int(0.4 * max(1, n_targets)))
    counts = matches.groupBy("table_id").agg(F.count("*").alias("n"))
    every = labels.select("table_id").distinct().join(counts, "table_id", "left")
    return every.select("table_id", F.coalesce("n", F.lit(0)).alias("matched")).withColumn("accepted", F.col("matched") >= need)


def with_page_transform(pages: DataFrame, fn, schema: str | None = None) -> DataFrame:
    """Pages through a caller's function: of DataFrames, or with a schema of pandas batches (the slow way)."""
    if schema is None:
        return pages.transform(fn)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return pages.mapInPandas(each, schema)
