"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders that remember their value, so that a question with other figures
has the same template.  Any capitalised word may be a name; two words are equal as placeholders of one type or as words
in lower case.  Every rolling window of ``block`` template words of the benchmark is joined by hash with the documents'
non-overlapping blocks: a common run of 2 * block - 1 words holds a whole block.  A key has a literal word, at least;
windows of placeholders only are joined with their neighbours, so that tables of figures share no key.

Around each hit the two templates are laid side by side.  A document is contaminated by an item if a stretch of ``run``
words or more (the whole item, if it is shorter) has equal templates and slots that agree (one value of the item always
stands for one of the document) and holds ``run`` words in a row of which ``block`` or more are the same words: a
stretch of nothing but other figures or names tells nothing.  A stretch ends where two of its slots would disagree, so
what stands beside it never clears a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit words that become a placeholder after a number.
UNITS = "kg|km|cm|mm|mg|ml|lb|lbs|ft|kwh|mph|grams|kilograms|meters|metres|kilometers|miles|feet|inches|liters|litres|seconds|minutes|hours|days|weeks|months|years|percent|dollars|euros|pounds|cents|usd|eur|stunden|tage|jahre|meter|heures|jours|ans|mètres|horas|días|años|metros"
#: Rows of benchmark windows up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
OPEN, MID, CLOSE, POINT = "\ue000", "\ue001", "\ue002", "\ue003"


def annotate(text: Column) -> Column:
    """The text in lower case, words parted by single spaces, values of numbers, names and units in marks."""
    text = F.coalesce(text, F.lit(""))
    number = F.regexp_replace(text, rf"(?i)(?<=\d)({UNITS})(?![\p{{L}}\p{{N}}])", " $1")
    number = F.regexp_replace(number, r"(?<=\d)[.,:/](?=\d)", POINT)
    number = F.regexp_replace(number, rf"(?<![\p{{L}}\p{{N}}{POINT}])(\d[\d{POINT}]*)(?![\p{{L}}\p{{N}}{POINT}])", f"{OPEN}d{MID}$1{CLOSE}")
    number = F.regexp_replace(number, rf"(?i)({CLOSE} )({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{OPEN}u{MID}$2{CLOSE}")
    out = F.when(text.rlike(r"\d"), number).otherwise(text)
    # a capitalised word may be a name wherever it stands
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}{MID}])(\p{{Lu}}\p{{Ll}}+)(?![\p{{L}}\p{{N}}])", f"{OPEN}n{MID}$1{CLOSE}")
    return F.trim(F.regexp_replace(F.lower(out), rf"[^\p{{L}}\p{{N}}{OPEN}-{POINT}]+", " "))


def template(annotated: Column) -> Column:
    return F.split(F.regexp_replace(annotated, f"{MID}[^{CLOSE}]*{CLOSE}", CLOSE), " ")


def worded(annotated: Column) -> Column:
    """The template with the placeholders as the words that they are."""
    return F.split(F.regexp_replace(annotated, f"{OPEN}[dnu]{MID}([^{CLOSE}]*){CLOSE}", "$1"), " ")


def _choices(i: Column, n: int, fixed: tuple[int, int] = (0, 0), more: Column | None = None) -> Column:
    """Of the n words from place i of t and l: a hash for every choice of reading placeholders as such or as words.

    At least one word of a choice is literal; those of ``fixed`` are placeholders read as such.  Two windows share a
    hash if each word of one equals the other's as a placeholder or as a word, and some word is the same.  ``more``
    hashes are added where all words are placeholders.
    """
    open_ = [k for k in range(n) if not fixed[0] <= k < fixed[1]]
    all_ = (1 << len(open_)) - 1
    held = sum(F.when(F.get("t", i + k) != F.get("l", i + k), 1 << b).otherwise(0) for b, k in enumerate(open_))
    hashed = lambda words: F.xxhash64(F.lit(n), F.lit(fixed[0]), *words)
    plain = F.array(hashed([F.get("t", i + k) for k in range(n)]))
    bit = {k: 1 << b for b, k in enumerate(open_)}
    choice = lambda v: hashed([F.when(v.bitwiseAND(bit[k]) > 0, F.get("l", i + k)).otherwise(F.get("t", i + k)) if k in bit else F.get("t", i + k) for k in range(n)])
    some = lambda m: F.transform(F.filter(F.sequence(F.lit(0), F.lit(all_)), lambda v: (v.bitwiseAND(m) == v) & ((v != 0) | (m != all_))), choice)
    each = lambda m: F.when(m == 0, plain).when(m != all_, some(m)).otherwise(F.concat(some(m), more) if more is not None else some(m))
    return F.flatten(F.transform(F.array(held), each))  # the array holds the mask, so that it is worked out once


def _keys(i: Column, block: int) -> Column:
    """Keys of the block at place i: its own, and if it is of placeholders only those of 2 * block - 1 words around it."""
    more = []
    for back in (block - 1, (block - 1) // 2, 0):  # the block stands at the end, in the middle, at the beginning
        fits = (i >= back) & (i - back + 2 * block - 1 <= F.size("t"))
        more.append(F.when(fits, _choices(i - back, 2 * block - 1, (back, back + block))).otherwise(F.array().cast("array<bigint>")))
    return _choices(i, block, more=F.concat(*more))


def contaminated(docs: DataFrame, benchmark: DataFrame, run: int = 13, block: int = 5) -> DataFrame:
    """(doc_id, item_id, doc_start, run, n_slots, exact) for each document and item that it gives away.

    doc_start and run: the longest stretch (of equal ones the first); n_slots: its slots; exact: each slot
    has the same value on both sides.  Null and empty texts match nothing; texts of any length are looked at whole; an
    item of fewer than ``block`` words has to stand word for word; repeated rows give one result a doc_id, rows of one
    doc_id or item_id with different texts count as texts of that id; rows without an id are left out; empty tables
    give an empty result; other columns are ignored.
    """
    if run < 2 * block + 2:
        raise ValueError("a run must hold a whole block and its neighbours: run >= 2 * block + 2")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), annotate(F.col("text")).alias("a")).where("item_id IS NOT NULL AND a <> ''").distinct()
    items = items.select(F.xxhash64("item_id", "a").alias("k"), "item_id", F.split("a", " ").alias("item"), template(F.col("a")).alias("t"), worded(F.col("a")).alias("l")).withColumn("size", F.size("t"))
    places = F.sequence(F.lit(0), F.col("size") - block)
    windows = items.where(F.col("size") >= block).select("k", F.explode(places).alias("i"), "size", "t", "l").select("k", "i", "size", F.explode(_keys(F.col("i"), block)).alias("h"))
    few = lambda df: df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = few(windows.select("h")) and few(items.select("k"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    marked = own.select("doc_id", annotate(F.col("text")).alias("a"))
    split = marked.select("doc_id", template(F.col("a")).alias("t"), worded(F.col("a")).alias("l"))

    def hits(step: int, part: DataFrame, n: int, keys: Callable[[Column], Column]) -> DataFrame:
        places = F.sequence(F.lit(0), F.floor((F.size("t") - n) / step).cast("int"))
        hashes = F.when(F.size("t") >= n, F.transform(places, lambda j: keys(j * step)))
        blocks = split.select("doc_id", F.posexplode(hashes).alias("j", "h")).select("doc_id", "j", F.explode("h").alias("h"))
        return blocks.join(F.broadcast(part) if small else part, "h").select("doc_id", "k", (F.col("j") * step - F.col("i")).alias("shift")).distinct()

    found = hits(block, windows.where(F.col("size") >= 2 * block - 1), block, lambda i: _keys(i, block))
    short = windows.where(F.col("size") < 2 * block - 1)
    if short.limit(1).count():  # a short item need not hold a whole block of the document: every place is tried
        found = found.unionByName(hits(1, short, block, lambda i: _choices(i, block)))
    whole = lambda n: lambda i: F.array(F.xxhash64(F.lit(-n), *[F.get("l", i + k) for k in range(n)]))
    for n in sorted(r["size"] for r in items.where(F.col("size") < block).select("size").distinct().collect()):  # fewer than ``block`` numbers
        tiny = items.where(F.col("size") == n).select("k", F.lit(0).alias("i"), F.explode(whole(n)(F.lit(0))).alias("h"))
        found = found.unionByName(hits(1, tiny, n, whole(n)))
    pairs = found.groupBy("doc_id", "k").agg(F.collect_set("shift").alias("shifts"))
    texts = items.select("k", "item_id", "item")
    laid = pairs.join(F.broadcast(texts) if small else texts, "k").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "shifts")).alias("p"))
    both = own.join(laid, "doc_id").select("doc_id", F.split(annotate(F.col("text")), " ").alias("doc"), F.explode("p").alias("p")).select("doc_id", "doc", "p.item_id", "p.item", F.explode("p.shifts").alias("shift"))
    return _stretches(both, run, block)


def _stretches(both: DataFrame, run: int, block: int) -> DataFrame:
    """The longest stretch of each document and item of rows (doc_id, item_id, doc, item, shift)."""
    bare = lambda x: F.regexp_replace(x, f"{MID}[^{CLOSE}]*{CLOSE}", CLOSE)
    word = lambda x: F.regexp_replace(x, f"{OPEN}[dnu]{MID}|{CLOSE}", "")
    need = F.least(F.lit(run), F.size("item"))
    facing = F.transform("item", lambda x, j: F.struct(x.alias("x"), F.when(F.col("shift") + j >= 0, F.get("doc", F.greatest(F.col("shift") + j, F.lit(0)))).alias("y")))
    # per place of the item: whether the templates are equal, whether the words are; a slot's values where they may differ
    cell = lambda c: F.struct((F.coalesce((bare(c["x"]) == bare(c["y"])) | (word(c["x"]) == word(c["y"])), F.lit(False))).alias("eq"), F.coalesce(word(c["x"]) == word(c["y"]), F.lit(False)).alias("same"), F.when(F.contains(c["x"], F.lit(MID)) | F.contains(c["y"], F.lit(MID)), F.struct(word(c["x"]).alias("i"), word(c["y"]).alias("d"))).alias("slot"))
    both = both.select("doc_id", "item_id", "shift", need.alias("need"), F.transform(facing, cell).alias("c"))
    at = lambda j: F.coalesce(F.when(j >= 0, F.get("c", j)["eq"]), F.lit(False))
    places = F.sequence(F.lit(0), F.size("c") - 1)
    first, last = F.filter(places, lambda j: at(j) & ~at(j - 1)), F.filter(places, lambda j: at(j) & ~at(j + 1))
    runs = F.filter(F.zip_with(first, last, lambda i, j: F.struct(i.alias("from"), j.alias("to"))), lambda r: r["to"] - r["from"] + 1 >= F.col("need"))
    both = both.withColumn("r", F.explode(runs)).select("doc_id", "item_id", "shift", "need", "c", "r.from", "r.to")
    # slots of the run, and of each the nearest earlier one that it disagrees with
    held = F.filter(F.transform(F.slice("c", F.col("from") + 1, F.col("to") - F.col("from") + 1), lambda c, j: F.struct((F.col("from") + j).alias("p"), c["slot"].alias("s"))), lambda x: x["s"].isNotNull())
    both = both.withColumn("s", held)
    against = lambda x: F.array_max(F.transform(F.filter("s", lambda y: (y["p"] < x["p"]) & ((y["s"]["i"] == x["s"]["i"]) != (y["s"]["d"] == x["s"]["d"]))), lambda y: y["p"]))
    both = both.withColumn("ends", F.filter(F.transform("s", lambda x: F.struct(x["p"].alias("p"), against(x).alias("q"))), lambda x: x["q"].isNotNull()))
    # a stretch ends before a slot that disagrees with one of it, and the next begins behind that one
    kind = "struct<low:int,out:array<struct<from:int,n:int>>>"
    start = F.struct(F.col("from").alias("low"), F.array().cast("array<struct<from:int,n:int>>").alias("out")).cast(kind)
    piece = lambda low, end: F.array(F.struct(low.alias("from"), (end - low).alias("n")))
    step = lambda acc, x: F.when(x["q"] < acc["low"], acc).otherwise(F.struct((x["q"] + 1).alias("low"), F.concat(acc["out"], piece(acc["low"], x["p"])).alias("out")).cast(kind))
    cut = F.aggregate("ends", start, step, lambda acc: F.concat(acc["out"], piece(acc["low"], F.col("to") + 1)))
    enough = lambda a: F.size(F.filter(F.slice("c", a + 1, F.col("need")), lambda c: c["same"])) >= F.least(F.lit(block), F.col("need"))
    good = F.filter(cut, lambda r: (r["n"] >= F.col("need")) & F.exists(F.sequence(r["from"], F.greatest(r["from"], r["from"] + r["n"] - F.col("need"))), enough))
    best = F.array_max(F.transform(good, lambda r: F.struct(r["n"].alias("n"), (-r["from"]).alias("back"))))
    both = both.withColumn("best", best).where("best IS NOT NULL")
    slots = F.transform(F.filter("s", lambda x: (x["p"] >= -F.col("best.back")) & (x["p"] < F.col("best.n") - F.col("best.back"))), lambda x: x["s"])
    both = both.withColumn("slots", slots)
    row = F.struct(F.col("best.n").alias("run"), (F.col("best.back") - F.col("shift")).alias("place"), F.size("slots").alias("n_slots"), F.forall("slots", lambda s: s["i"] == s["d"]).alias("exact"))
    top = both.groupBy("doc_id", "item_id").agg(F.max(row).alias("r"))
    return top.select("doc_id", "item_id", (-F.col("r.place")).cast("long").alias("doc_start"), F.col("r.run").cast("long").alias("run"), F.col("r.n_slots").cast("long").alias("n_slots"), F.col("r.exact").alias("exact"))
