"""Cells, money and fee-schedule lines as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and words of the fee schedules.
CODE, CODE_LENGTH = r"\d\.\d{2}\.\d{5}", 10
MONEY_BR = r"R\$\s*\d{1,3}(?:\.\d{3})*,\d{2}"
MONEY_NUM = r"\b\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\b"
SECTION = r"(?i)EXEMPLOS\s+DE\s+(?:EXAMES|CO(?:PARTICIPAÇÃO|PARTICIPA[CÇ][AÃ]O))|OUTROS\s+EXEMPLOS"
NOTE = r"(?i)\*\s*Obs[:\s]|Com\s+exce[çc][aã]o\s+dos\s+valores|referem-se\s+ao\s+custo|pode\s+haver\s+varia[çc][aã]o|ANEXO\s+[IVX]+"
HEADER_TOKENS = ["codigo", "código", "procedimento", "valor unimed", "co-part", "flex", "pleno", "cop.", "co-participação", "coparticipação", "20%", "30%", "40%", "50%"]
NUMBER = r"^[\sR$\-+()]?[\d.,\s]+%?$"
FOLDED = ("çáàãâéêíóôõú", "caaaaeeiooou")


def excel_safe(value: Column) -> Column:
    """One line, trimmed; a leading = + - or @ gets an apostrophe so that no program takes it for a formula."""
    raw = F.coalesce(value.cast("string"), F.lit(""))
    broken = F.contains(raw, F.lit("\n")) | F.contains(raw, F.lit("\r"))
    text = F.trim(F.when(broken, F.regexp_replace(raw, r"[\r\n]", " ")).otherwise(raw))
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), text)).otherwise(text)


def parse_number(value: Column) -> Column:
    """A decimal from a local number: R$ and spaces go, % divides by 100, with a comma dots part thousands; else null."""
    text = F.trim(value.cast("string"))
    bare = F.trim(F.replace(text, F.lit("R$"), F.lit(" ")))
    percent = bare.endswith("%")
    t = F.translate(F.when(percent, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare), " ", "")
    t = F.when(F.instr(t, ",") > 0, F.translate(t, ",.", ".")).otherwise(t)
    number = t.try_cast("decimal(28,10)")
    return F.when((text != "") & bare.rlike(NUMBER), F.when(percent, number / 100).otherwise(number)).cast("decimal(38,10)")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once; a column used twice in an expression is worked out twice."""
    return F.get(F.transform(F.array(value), then), 0)


def format_brl(raw: Column) -> Column:
    """``R$ n.nnn,cc``; what has that form already, or can't be read, stays as it is.

    The cents are what is left after the whole part, rounded: below zero they keep their sign, and they may be 100.
    """
    s = F.trim(raw)

    def shown(value: Column, whole: Column) -> Column:
        padded = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)  # noqa: E731 (lpad would cut longer ones)
        cents = _let(F.bround((value - whole) * 100).cast("int").cast("string"), padded)
        return F.concat(F.lit("R$ "), F.translate(F.format_number(whole, 0), ",", "."), F.lit(","), cents)

    both = lambda t: (F.instr(t, ",") > 0) & (F.instr(t, ".") > 0)
    dotted = lambda t: F.when(both(t), F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", "."))
    number = lambda t: F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double"))
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")
    value = _let(_let(F.trim(F.regexp_replace(s, r"^R\$\s*", "")), dotted), number)
    written = _let(value, lambda v: F.when(v.isNotNull(), _let(whole(v), lambda w: shown(v, w))).otherwise(raw))
    return F.when(s.rlike(f"^{MONEY_BR}"), s).otherwise(written)


def marked_money(text: Column) -> Column:
    """All R$ amounts of a text; empty without one."""
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit("R$")), F.regexp_extract_all(text, F.lit(f"({MONEY_BR})"), F.lit(1))).otherwise(none)


def bare_money(text: Column) -> Column:
    """All bare amounts of a text in the form of R$ ones; most have it already but for R$ and a comma."""
    plain = lambda x: F.when(x.rlike(r"^(?:0|[1-9]\d{0,2})[.,]\d\d$"), F.concat(F.lit("R$ "), F.translate(x, ".", ","))).otherwise(format_brl(x))
    return F.transform(F.regexp_extract_all(text, F.lit(f"({MONEY_NUM})"), F.lit(1)), plain)


def extract_money(text: Column) -> Column:
    """All R$ amounts of a text, else all bare ones, in one form.  Each text is searched once for either."""
    once = F.transform(F.array(marked_money(text)), lambda m: F.when(F.size(m) > 0, m).otherwise(bare_money(text)))
    return F.when(text.isNotNull(), F.get(once, 0))


def norm_key(text: Column) -> Column:
    """Lower case, one space between words, accents folded; % is a word."""
    s = F.translate(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " "), *FOLDED)
    return F.regexp_replace(F.regexp_replace(s, "%", " pct "), "º", "")


#: Of each alternative of NOTE and SECTION a part that a line has to hold, in lower case: most lines hold none.
NOTE_PARTS, SECTION_PART = ["obs", "exce", "referem-se", "haver", "anexo"], "exemplos"
#: Header tokens by a part that they have in common.
HEADER_PARTS = {p: [x for x in HEADER_TOKENS if next((q for q in ("co", "0%") if q in x), "") == p] for p in ("co", "0%", "")}
#: The same of a total, without letters that others than a to z can become in upper case (dotless i, the ligature of s and t).
TOTAL_PART = "otal de copar"


def line_class(line: Column, low: Column | None = None) -> Column:
    """note, header (3 of the tokens and no code), section, total, item (starts with a code) or other.

    ``low`` is the line in lower case, where the caller has it as a column.
    """
    low = F.lower(line) if low is None else low
    has = lambda part: F.contains(low, F.lit(part))
    hits = F.lit(0)
    for part, tokens in HEADER_PARTS.items():
        found = sum((F.when(has(t), 1).otherwise(0) for t in tokens), F.lit(0))
        hits = hits + (F.when(has(part), found).otherwise(0) if part else found)
    noted = has(NOTE_PARTS[0])
    for part in NOTE_PARTS[1:]:
        noted = noted | has(part)
    section = has(SECTION_PART) & line.rlike(SECTION)
    total = has(TOTAL_PART) & F.contains(F.upper(line), F.lit("TOTAL DE COPARTICI"))
    coded = F.when(section, "section").when(total, "total").otherwise("item")  # a line with a code is no header
    return (
        F.when(noted & line.rlike(NOTE), "note").when(F.trim(line).rlike(f"^{CODE}"), coded).when((hits >= 3) & ~line.rlike(CODE), "header")
        .when(section, "section").when(total, "total").otherwise("other")
    )


def split_codes(text: Column) -> Column:
    """A text parted before each code; blank parts go."""
    return F.filter(F.transform(F.split(text, f"(?={CODE})"), lambda x: F.trim(x)), lambda x: x != "")


def item_code(line: Column) -> Column:
    return F.regexp_extract(F.trim(line), f"^({CODE})", 1)


def after_code(line: Column) -> Column:
    """What follows the code at the beginning of a line."""
    return F.trim(F.regexp_replace(F.trim(line), f"^{CODE}", ""))


def item_parts(line: Column) -> tuple[Column, Column]:
    """item_code and after_code of a line that is known to begin with a code: codes are of one length."""
    text = F.trim(line)
    return F.substring(text, 1, CODE_LENGTH), F.trim(F.substring(text, F.lit(CODE_LENGTH + 1), F.length(text)))


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"\s{2,}", " "))


def without_money(text: Column) -> Column:
    """A text without its amounts, spaces squeezed."""
    return one_spaced(F.regexp_replace(F.regexp_replace(text, MONEY_BR, ""), MONEY_NUM, ""))


def parse_item_line(line: Column) -> Column:
    """struct(code, description, amounts): money is taken out of the description, five amounts at most."""
    rest = after_code(line)
    return F.struct(item_code(line).alias("code"), without_money(rest).alias("description"), F.slice(extract_money(rest), 1, 5).alias("amounts"))


def header_label(value: Column, position: Column, size: int = 80) -> Column:
    """A column's label; blank is ``Coluna n`` (from 1), longer ones are cut with an ellipsis."""
    text = F.trim(F.coalesce(value, F.lit("")))
    named = F.when(text == "", F.concat(F.lit("Coluna "), (position + 1).cast("string"))).otherwise(text)
    return F.when(F.length(named) > size, F.concat(F.substring(named, 1, size - 1), F.lit("…"))).otherwise(named)


#: By style, how a repeated name is numbered, from which number on, and what such a name looks like.
NUMBERED = {
    "column": (2, r"^(.*) \((\d+)\)()$"),
    "field": (2, r"^(.*)__copy_(\d+)()$"),
    "file": (1, r"^(.*?) \((\d+)\)(\.[^.]*)?$"),
}


def numbered(name: Column, n: Column, style: str) -> Column:
    """``x (2)`` for columns, ``x__copy_2`` for fields, ``base (1).ext`` for files."""
    n = n.cast("string")
    if style == "column":
        return F.concat(name, F.lit(" ("), n, F.lit(")"))
    if style == "field":
        return F.concat(name, F.lit("__copy_"), n)
    ext = F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(base, F.lit(" ("), n, F.lit(")"), ext)


def numbered_parts(name: Column, style: str) -> tuple[Column, Column]:
    """The name that a numbered one repeats and its number; null where it is none that ``numbered`` would give."""
    first, pattern = NUMBERED[style]
    pattern = f"(?s){pattern}"
    base, digits = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    base = F.concat(base, F.regexp_extract(name, pattern, 3))
    number = digits.try_cast("long")
    known = (number >= first) & (numbered(base, number, style) == name)
    return F.when(known, base), F.when(known, number)


def unique_in_order(names: Column, style: str = "column") -> Column:
    """An array's names, each once: a name keeps its first place, repeats take the next numbers that no name has.

    For short arrays, as the columns of a table; ``operators.tables.unique_names`` does the same for any number.
    """
    first = NUMBERED[style][0]

    def own(name: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, 1, i), lambda y: y == name))
        free = F.filter(F.sequence(F.lit(first), F.size(names) + first), lambda k: ~F.array_contains(names, numbered(name, k, style)))
        return F.when(before == 0, name).otherwise(numbered(name, F.get(free, before - 1), style))

    return F.transform(names, own)


def skip_page(text: Column, markers: list[str]) -> Column:
    head = F.substring(F.upper(F.trim(F.coalesce(text, F.lit("")))), 1, 200)
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(head, F.lit(m.upper()))
    return out
