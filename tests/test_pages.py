import random
import re

from pyspark.sql import functions as F

from docops.functions import pages as p
from docops.operators import pages as op


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_snap_is_half_even(spark):
    assert values(spark, p.snap(F.col("a")), [(x,) for x in (45, 135, 225, 315, -90, 450, 89, 0)], "a int") == [0, 180, 180, 0, 270, 90, 90, 0]


def test_rotation_dialects(spark):
    rows = [(90,), (-90,), (45,), (0,), (None,)]
    assert values(spark, p.norm_rotation(F.col("a"), "split"), rows, "a int") == [90, 270, None, None, None]
    assert values(spark, p.norm_rotation(F.col("a"), "merge"), rows, "a int") == [90, -1, -1, 0, None]
    assert values(spark, p.norm_rotation(F.col("a"), "edit"), rows, "a int") == [90, 270, None, 0, None]


def test_page_specs(spark):
    specs = ["1-3, 5", "[2,0,2]", "[]", "", None, "3,1,3", "0", "4-2", "a", "1,,2", "[1,\"x\"]", " 2 - 4 "]
    got = values(spark, p.parse_pages(F.col("s")), [(s,) for s in specs], "s string")
    assert [g["pages"] for g in got] == [[1, 2, 3, 5], [2], None, None, None, [3, 1], None, None, None, [1, 2], None, [2, 3, 4]]
    assert [g["error"] for g in got] == [False, False, False, False, False, False, True, True, True, False, True, False]
    assert values(spark, p.parse_pages(F.col("s"), strict=False)["pages"], [("1,x,3-2,4",)], "s string") == [[1, 4]]


def test_image_params(spark):
    got = values(spark, p.image_params(F.col("q"), F.col("d")), [(80, 100), (50, 100), (20, 100), (100, 300), (5, 10)], "q int, d int")
    assert [(g.qfactor, g.color_res, g.downsample) for g in got] == [(0.3, 100, "Bicubic"), (0.8, 85, "Average"), (1.5, 72, "Subsample"), (0.05, 300, "Bicubic"), (1.5, 72, "Subsample")]


def test_estimate_of_the_known_observation(spark):
    kb = p.estimate_kb(F.lit(5.81 * 1024), F.lit(77), F.lit(100), F.lit(1.0), F.lit(True), F.lit(False), F.lit(False), F.lit(1.0))
    assert round(values(spark, kb, [(1,)], "a int")[0] / 1024, 2) == 4.94


def test_estimate_sweep_of_the_known_observation(spark):
    obs = spark.createDataFrame([(1, 5.81 * 1024, 4.01 * 1024, 77, 100, 1.0), (2, 5.81 * 1024, 4.01 * 1024, 77, 100, 1.2)], "obs_id int, orig_kb double, result_kb double, quality int, dpi int, size_factor double")
    grid = [("anchor120", 120.0, 0.68, 0.27, 1.0, 0.0), ("shipped", 150.0, 0.55, 0.40, 0.8, 0.85)]
    got = {(r.name, r.obs_id): round(r.estimate_mb, 2) for r in op.estimate_sweep(grid, obs).collect()}
    assert got["shipped", 1] == got["shipped", 2] == 4.94


def test_outcomes(spark):
    got = values(spark, p.fallback_reason(F.col("a"), F.col("b"), F.lit(2), F.col("n")), [(100000, 50000, 2), (100000, 50000, 1), (100000, 100000, 2), (100000, 9000, 2), (1000000, 20000, 2)], "a long, b long, n int")
    assert got == [None, "page_mismatch", "gs_larger", "suspiciously_small", "ratio_too_low"]
    got = values(spark, p.job_outcome(F.col("a"), F.col("b"), F.col("k")), [(100, 80, False), (100, 100, False), (100, 120, True), (100, 60, True)], "a long, b long, k boolean")
    assert [tuple(g) for g in got] == [("none", 80, 20.0), ("final_original", 100, 0.0), ("preserved_interactive", 120, 0.0), ("preserved_interactive", 60, 40.0)]


def test_merge_keeps_order_and_repeats(spark):
    pages = spark.createDataFrame([(1, s, n, 200 + 20 * n + s, 300, 0) for s in (0, 1) for n in (0, 1)], "job_id int, src int, page0 int, width int, height int, rotate int")
    plan = spark.createDataFrame([(1, 0, 1, 2, 90), (1, 1, 0, 1, None), (1, 2, 1, 2, None), (1, 3, 0, 0, 0), (1, 4, 0, 9, 0)], "job_id int, pos int, src int, page int, rotation int")
    got = op.page_occurrence(op.rotated_plan(op.plan_pages(plan, pages))).orderBy("pos").collect()
    assert [(r.pos, r.src, r.page0, r.final_rotation, r.occurrence) for r in got] == [(0, 1, 1, 90, 1), (1, 0, 0, 0, 1), (2, 1, 1, 0, 2), (3, 0, 0, 0, 2)]


def test_page_lists(spark):
    got = values(spark, p.page_selection(F.col("p"), F.col("n")), [([1, 2], 2), ([0, 1], 2), ([0, 2], 2), ([], 2), (None, 1)], "p array<int>, n int")
    assert got == [[0, 1], [0, 1], None, [0, 1], [0]]


def test_reference_like_parser(spark):
    """Random specs against a plain reading of the rules."""
    r = random.Random(1)
    specs = [",".join(r.choice(["1", "2", "3-5", "9-9", "0", "x", "", "5-3", " 7 "]) for _ in range(r.randrange(1, 5))) for _ in range(60)]

    def plain(s):
        out = []
        for x in s.replace(" ", "").split(","):
            m = re.fullmatch(r"(\d+)(?:-(\d+))?", x)
            if not x:
                continue
            if not m or int(m[1]) <= 0 or (m[2] and int(m[2]) < int(m[1])):
                return None
            out += range(int(m[1]), int(m[2] or m[1]) + 1)
        return list(dict.fromkeys(out)) or None

    assert values(spark, p.parse_pages(F.col("s"))["pages"], [(s,) for s in specs], "s string") == [plain(s) for s in specs]
