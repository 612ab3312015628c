import random
import re

from common import SF, empty
from docops.llm.decontaminate import contaminated
from docops.llm.queries import op7_decontaminate

QUESTION = "A train leaves the old town at 14:30 with 120 passengers and travels 75 km before the first stop, where Anna leaves it with 120 others."
OTHER = "A train leaves the old town at 9:15 with 48 passengers and travels 300 km before the first stop, where Peter leaves it with 48 others."
BROKEN = "A train leaves the old town at 9:15 with 48 passengers and travels 300 km before the first stop, where Peter leaves it with 51 others."


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long, h string")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    return {(r.doc_id, r.item_id): r for r in contaminated(d, b).collect()}


def test_slots(spark):
    pad = "Some words stand before it. "
    docs = [(1, pad + QUESTION, 0, ""), (2, pad * 3 + OTHER + " And after.", 0, ""), (3, BROKEN, 0, ""), (4, None, 0, ""), (5, "", 0, ""), (6, pad * 40, 0, ""), (1, pad + QUESTION, 0, ""), (7, "Who was the first king of it?", 0, "")]
    got = run(spark, docs, [(10, QUESTION, 1), (11, None, 1), (12, "", 1), (13, "two words", 1), (14, "who was the first king of it", 1), (10, QUESTION, 1)])
    # the 24 words before the slot that disagrees are a leak by themselves: what follows does not clear it
    assert set(got) == {(1, 10), (2, 10), (3, 10), (7, 14)} and got[3, 10].run == 24
    assert got[1, 10].exact and not got[2, 10].exact and got[2, 10].n_slots == 6
    assert got[1, 10].doc_start == 5 and got[2, 10].doc_start == 15


def test_empty(spark):
    b = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert contaminated(empty(spark), b).collect() == []
    assert contaminated(b.withColumnRenamed("item_id", "doc_id"), b.limit(0)).collect() == []


def test_query_finds_every_passage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, q in zip(items.item_id, items.text) if q in t}
    got = {(r.doc_id, r.item_id) for r in op7_decontaminate(spark, SF).collect()}
    assert want and want <= got
    norm = lambda t: re.findall(r"\w+", t.lower())
    grams = {i: {tuple(w[p : p + 13]) for p in range(len(w) - 12)} for i, w in ((i, norm(q)) for i, q in zip(items.item_id, items.text))}
    for d, t in zip(docs.doc_id, docs.text):
        w = norm(t)
        own = {tuple(w[p : p + 13]) for p in range(len(w) - 12)}
        for i in items.item_id:
            assert not (own & grams[i]) or (d, i) in got


def test_every_run_of_a_shift(spark):
    """A verbatim run beside a slot that disagrees, and a stretch with agreeing slots beside one that disagrees."""
    road = "the long road from the hill to the sea was built by men who came here on foot"
    item = f"it took 120 days until {road} and then 120 more"
    two = f"there were 5 of them in the house when we came and saw it alpha {item}"
    docs = [(1, item.replace("120 more", "121 more"), 0, ""), (2, "it took 120 days until the long road and then 121 more", 0, ""), (3, item.replace("120", "77"), 0, "")]
    docs += [(5, item.replace("120 days", "3 days").replace("120 more", "4 more"), 0, "")]
    docs += [(6, two.replace("alpha", "beta").replace("5", "6").replace("120 days", "3 days").replace("120 more", "4 more").replace("sea", "lake").replace("men who", "those that"), 0, "")]
    got = run(spark, docs, [(10, item, 1), (11, two, 1)])
    assert (got[1, 10].doc_start, got[1, 10].run, got[1, 10].n_slots, got[1, 10].exact) == (0, 25, 2, True)
    assert (2, 10) not in got and got[3, 10].run == 27
    assert got[6, 11].run == 14 and not got[6, 11].exact
    assert not got[5, 10].exact and got[5, 10].run == 25  # all before the second 120, which disagrees with the first


def test_names_anywhere_and_in_any_case(spark):
    item = "Anna has 12 apples and gives 3 away. Then Berlin sells all of the rest."
    short = "Which river runs through the old town of Prague today"
    docs = [(1, item.replace("Anna", "Peter"), 0, ""), (2, f"He said:\n\"{item.replace('Anna', 'Peter').replace('Berlin', 'Paris')}\"", 0, ""), (3, item.lower(), 0, ""), (4, item.upper(), 0, "")]
    docs += [(5, f"and so, {short}", 0, ""), (6, short.upper(), 0, ""), (7, short.replace("river", "lake"), 0, ""), (8, item.lower().replace("anna", "peter"), 0, "")]
    got = run(spark, docs, [(10, item, 1), (11, short, 1)])
    assert set(got) == {(1, 10), (2, 10), (3, 10), (4, 10), (5, 11), (6, 11), (8, 10)}
    assert got[3, 10].exact and got[4, 10].exact and not got[1, 10].exact and got[5, 11].exact


def tokens(spark, texts):
    from docops.llm.decontaminate import annotate
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "n int, x string").select("n", annotate(F.col("x")).alias("a")).collect()
    return [r.a.split(" ") if r.a else [] for r in sorted(rows)]


def brute(doc, item, need_run=13, block=5):
    """(longest stretch, its first place in the document), by trying every stretch of every shift; None without one."""
    bare = lambda x: re.sub("\ue001[^\ue002]*\ue002", "\ue002", x)
    word = lambda x: re.sub("\ue000[dnu]\ue001|\ue002", "", x)
    need, best = min(need_run, len(item)), None
    for shift in range(-len(item) + 1, len(doc)):
        for a in range(len(item)):
            one, other, same = {}, {}, []
            for j in range(a, len(item)):
                if not 0 <= shift + j < len(doc):
                    break
                x, y = item[j], doc[shift + j]
                if bare(x) != bare(y) and word(x) != word(y):
                    break
                if "\ue001" in x + y and (one.setdefault(word(x), word(y)) != word(y) or other.setdefault(word(y), word(x)) != word(x)):
                    break
                same.append(word(x) == word(y))
                n = len(same)
                if n >= need and any(sum(same[i : i + need]) >= min(block, need) for i in range(n - need + 1)):
                    best = max(best or (0, 0), (n, -(shift + a)))
    return best and (best[0], -best[1])


def test_against_brute_force(spark):
    """Generated documents around generated items: numbers, names, edits, tables of figures, short items, awkward rows."""
    r = random.Random(12)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)]
    names, units = ["Anna", "Peter", "Berlin", "Paris", "Lund"], ["km", "kg", "hours"]

    def some(n):
        return [r.choice([*[r.choice(words)] * 5, r.choice(names), str(r.randrange(9)), f"{r.randrange(9)} {r.choice(units)}"]) for _ in range(n)]

    items = [some(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 24, 30)]
    items += [[str(r.randrange(50)) for _ in range(20)], [*some(4), *[str(r.randrange(50)) for _ in range(9)], *some(4)], ["Anna", *some(3), "Anna", *some(12), "7", "7", *some(3)]]

    def changed(w):
        w, swap = list(w), {x: y for x, y in zip(names, r.sample(names, len(names)))}
        for i in range(len(w)):
            p = r.random()
            if w[i] in swap and p < 0.7:
                w[i] = swap[w[i]]
            elif w[i].isdigit() and p < 0.5:
                w[i] = str(r.randrange(60))
            elif p < 0.02:
                w[i] = r.choice(words)
        return w

    docs = []
    for w in items:
        for _ in range(6):
            a = r.randrange(len(w)) if r.random() < 0.3 else 0
            docs.append([*some(r.randrange(12)), *changed(w[a:]), *some(r.randrange(12))])
    docs += [[str(r.randrange(50)) for _ in range(60)], some(200), []]
    d = [(n, " ".join(w), "x", n) for n, w in enumerate(docs)] + [(len(docs), None, "x", 0), (None, " ".join(items[-1]), "x", 0)]
    d += d[:20]
    b = [(n, " ".join(w), -n, 1) for n, w in enumerate(items)] + [(90, None, 0, 0), (None, " ".join(items[-1]), 0, 0), (91, "  \n ", 0, 0)]
    got = contaminated(spark.createDataFrame(d, "doc_id long, text string, h string, shift long"), spark.createDataFrame([*b, *b], "item_id long, text string, k long, size int"))
    got = {(x.doc_id, x.item_id): (x.run, x.doc_start) for x in got.collect()}
    own, other = tokens(spark, [x[1] for x in d]), tokens(spark, [x[1] for x in b])
    want = {(x[0], y[0]): m for x, t in zip(d, own) for y, i in zip(b, other) if x[0] is not None and y[0] is not None and t and i and (m := brute(t, i))}
    assert len({i for _, i in want}) > 15 and got == want


def test_what_follows_does_not_clear(spark):
    item = "the first bus of the day leaves the small market town with 12 people and comes back with 12 more at 9 in the evening, when all 9 shops are shut"
    half = item.split(" at 9")[0]
    clash = item.replace("all 9 shops", "all 8 shops")
    got = run(spark, [(1, half, 0, ""), (2, clash, 0, ""), (3, " ".join(str(i) for i in range(40)), 0, "")], [(10, item, 1), (11, " ".join(str(i) for i in range(70, 90)), 1)])
    assert set(got) == {(1, 10), (2, 10)} and got[2, 10].run >= got[1, 10].run


def test_tables_of_figures_share_no_key(spark):
    """Windows of placeholders only are joined by their neighbours: rows of figures meet in no key of their own."""
    from docops.llm.decontaminate import _keys, annotate, template, worded
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" ".join(str(i * 7) for i in range(100)),), ("one two three 4 5 6 7 8 nine ten",)], "x string").select(annotate(F.col("x")).alias("a"))
    df = df.select(template(F.col("a")).alias("t"), worded(F.col("a")).alias("l")).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - 5), lambda i: _keys(i, 5))).alias("h"), F.size("t").alias("n"))
    sizes = {}
    for x in df.collect():
        sizes.setdefault(x.n, []).append(len(x.h))
    assert max(sizes[100]) <= 31 + 3 * 15 and max(sizes[10]) <= 31 + 3 * 15 and min(sizes[10]) >= 1
