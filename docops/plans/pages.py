"""Page analysis, compression and page-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as p
from ..operators import pages as op
from .fixtures import query

G = "page_geometry"
META = """m0 AS (SELECT doc_id, page_number, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, CAST(width * height AS DOUBLE) AS area, bytes, rotate FROM page_geometry),
    meta AS (SELECT doc_id, page_number, width, height, area, CAST(sum(bytes) OVER w AS DOUBLE) / 1024.0::DOUBLE * (area / sum(area) OVER w) AS estimated_size_kb, area > 1.3::DOUBLE * avg(area) OVER w AS is_large,
        CAST(count(*) OVER w AS BIGINT) AS total_pages, sum(area) OVER w AS total_area, avg(area) OVER w AS avg_area FROM m0 WINDOW w AS (PARTITION BY doc_id)),
    rich0 AS (SELECT *, area / avg(area) OVER (PARTITION BY doc_id) AS f FROM meta),
    rich AS (SELECT * EXCLUDE (is_large), f > 1.3::DOUBLE AS is_large, CASE WHEN f > 1.3::DOUBLE THEN greatest(20, CAST(round_even(80 / f, 0) AS INT)) ELSE 80 END AS quality, CASE WHEN f > 1.3::DOUBLE THEN greatest(72, CAST(round_even(100 / f, 0) AS INT)) ELSE 100 END AS dpi, f > 1.3::DOUBLE AS resize_to_a4 FROM rich0)"""
SET = """cs AS (SELECT doc_id, page_number, include, least(greatest(quality, 20), 100) AS q, least(greatest(dpi, 50), 300) AS d, resize_to_a4 AS rz, keep_original FROM page_settings)"""
EST = f"""{META}, {SET}, e0 AS (SELECT r.*, q, d, rz, include, keep_original, estimated_size_kb AS o,
        estimated_size_kb * (0.55::DOUBLE + q / 100.0::DOUBLE * 0.40::DOUBLE) * pow(d / 150.0::DOUBLE, 0.8::DOUBLE) / pow(round(f, 9), 0.20::DOUBLE) * CASE WHEN rz THEN least(1.0::DOUBLE, 500990.0::DOUBLE / (width * height)) ELSE 1.0::DOUBLE END AS s FROM rich r JOIN cs USING (doc_id, page_number)),
    est AS (SELECT *, CASE WHEN NOT include THEN 0 WHEN keep_original THEN o ELSE least(o, greatest(10, CASE WHEN q >= 75 AND d >= 90 AND NOT rz THEN greatest(s, o * 0.85::DOUBLE) ELSE s END)) END AS estimate_kb FROM e0)"""


def rich(load):
    out = op.enrich_pages(op.page_metadata(load(G)))
    return out.withColumn("size_factor", F.round("f", 9))  # unrounded, so that both engines agree


def settings(load):
    return op.clean_settings(load("page_settings").withColumn("pos", F.lit(0)))


def est(load):
    return op.estimated(rich(load), settings(load))


@query(f"{META} SELECT doc_id, page_number, width, height, area, round(estimated_size_kb, 6) AS estimated_size_kb, is_large, total_pages, total_area, round(avg_area, 6) AS avg_area FROM meta", G)
def a10_page_metadata(load):
    return op.page_metadata(load(G)).withColumns({"estimated_size_kb": F.round("estimated_size_kb", 6), "avg_area": F.round("avg_area", 6)})


@query(f"{META} SELECT doc_id, page_number, round(f, 6) AS f, is_large, quality, dpi, resize_to_a4 FROM rich", G)
def w1_enrich_pages(load):
    return op.enrich_pages(op.page_metadata(load(G))).select("doc_id", "page_number", F.round("f", 6).alias("f"), "is_large", "quality", "dpi", "resize_to_a4")


@query(f"{SET} SELECT doc_id, page_number, include, q AS quality, d AS dpi, rz AS resize_to_a4, keep_original FROM cs", "page_settings")
def p21_clean_settings(load):
    return settings(load)


Q = "least(greatest(quality, 20), 100)"


@query(f"""x AS (SELECT doc_id, page_number, {Q} AS q, dpi, CASE WHEN {Q} >= 75 THEN 1.0::DOUBLE WHEN {Q} >= 50 THEN 0.85::DOUBLE WHEN {Q} >= 35 THEN 0.70::DOUBLE ELSE 0.55::DOUBLE END AS r FROM page_settings)
    SELECT doc_id, page_number, q AS jpeg_q, round(CASE WHEN q >= 80 THEN 0.05::DOUBLE + (100 - q) / 20.0::DOUBLE * 0.25::DOUBLE WHEN q >= 60 THEN 0.30::DOUBLE + (80 - q) / 20.0::DOUBLE * 0.30::DOUBLE WHEN q >= 40 THEN 0.60::DOUBLE + (60 - q) / 20.0::DOUBLE * 0.40::DOUBLE ELSE 1.0::DOUBLE + (40 - q) / 20.0::DOUBLE * 0.50::DOUBLE END, 4) AS qfactor,
    greatest(72, CAST(floor(dpi * r) AS INT)) AS color_res, greatest(72, CAST(floor(dpi * least(1.0::DOUBLE, r * 1.2::DOUBLE)) AS INT)) AS mono_res, CASE WHEN q >= 75 THEN 'Bicubic' WHEN q >= 45 THEN 'Average' ELSE 'Subsample' END AS downsample,
    CASE WHEN q >= 75 THEN '[1 1 1 1]' WHEN q >= 45 THEN '[2 1 1 1]' ELSE '[2 1 1 2]' END AS hsamples, CASE WHEN q >= 45 THEN '[1 1 1 1]' ELSE '[2 1 1 2]' END AS vsamples FROM x""", "page_settings")
def p22_image_params(load):
    out = load("page_settings").select("doc_id", "page_number", p.image_params(F.col("quality"), F.col("dpi")).alias("i"))
    return out.select("doc_id", "page_number", *[f"i.{c}" for c in ("jpeg_q", "qfactor", "color_res", "mono_res", "downsample", "hsamples", "vsamples")])


@query(f"{EST} SELECT doc_id, page_number, round(estimate_kb, 6) AS estimate_kb FROM est", "page_geometry page_settings")
def p23_estimate_kb(load):
    return est(load).select("doc_id", "page_number", F.round("estimate_kb", 6).alias("estimate_kb"))


@query(f"{EST}, s AS (SELECT doc_id, coalesce(sum(o) FILTER (include), 0) AS a, sum(estimate_kb) AS b, CAST(count(*) FILTER (include) AS BIGINT) AS selected, CAST(count(*) FILTER (is_large) AS BIGINT) AS large, CAST(count(*) AS BIGINT) AS pages FROM est GROUP BY doc_id) SELECT doc_id, round(a, 5) AS original_kb, round(b, 5) AS adjusted_kb, selected, large, pages, round(CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0 END, 4) AS saved_pct FROM s", "page_geometry page_settings")
def a11_selection_summary(load):
    return op.selection_summary(est(load)).withColumns({"original_kb": F.round("original_kb", 5), "adjusted_kb": F.round("adjusted_kb", 5), "saved_pct": F.round("saved_pct", 4)})


GROUPS = f"{SET}, sg AS (SELECT doc_id, keep_original AS kept, CASE WHEN NOT keep_original THEN q END AS quality, CASE WHEN NOT keep_original THEN d END AS dpi, CASE WHEN NOT keep_original THEN rz END AS resize_to_a4, list_sort(list(page_number)) AS pages FROM cs WHERE include GROUP BY ALL)"
PARTS = f"""{GROUPS}, ps AS (SELECT doc_id, kept, dense_rank() OVER (PARTITION BY doc_id ORDER BY kept, pages[1]) AS part, pages FROM sg), px AS (SELECT doc_id, kept, part, unnest(pages) AS page_number, unnest(range(len(pages))) AS "at" FROM ps)"""


@query(f"{GROUPS} SELECT doc_id, kept, quality, dpi, resize_to_a4, array_to_string(pages, ',') AS pages FROM sg", "page_settings")
def a12_settings_groups(load):
    return op.settings_groups(settings(load)).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(f'{PARTS} SELECT doc_id, kept, CAST(part AS INT) AS part, CAST("at" AS INT) AS "at", page_number FROM px', "page_settings")
def j6_page_sources(load):
    return op.page_sources(op.settings_groups(settings(load)))


@query(f"{PARTS} SELECT doc_id, CAST(part AS INT) AS part, page_number, CAST(row_number() OVER (PARTITION BY doc_id, part ORDER BY page_number) AS INT) AS new_page FROM px", "page_settings")
def w4_renumber_in_group(load):
    return op.renumber_in_group(op.page_sources(op.settings_groups(settings(load)))).select("doc_id", "part", "page_number", "new_page")


@query("SELECT doc_id, CAST(count(DISTINCT (width, height)) AS BIGINT) AS sizes FROM page_geometry GROUP BY doc_id", G)
def a13_distinct_page_sizes(load):
    return op.distinct_page_sizes(load(G))


@query("SELECT doc_id, bool_or(rotate IN (90, 270)) AS rotated FROM page_geometry GROUP BY doc_id", G)
def a14_has_rotated_pages(load):
    return op.has_rotated_pages(load(G))


OFF = "(rotate % 360 <> 0 OR NOT ((abs(width - 595) <= 2 AND abs(height - 842) <= 2) OR (abs(width - 842) <= 2 AND abs(height - 595) <= 2)))"


@query(f"SELECT doc_id, count(DISTINCT (width, height)) > 1 AND NOT bool_or(rotate IN (90, 270)) AS normalize, bool_or({OFF}) OR (bool_or(width > height) AND bool_or(width <= height)) AS needs FROM page_geometry GROUP BY doc_id", G)
def a15_normalize_decision(load):
    return op.normalize_decision(load(G))


@query(f"SELECT doc_id, page_number, {OFF} AS off FROM page_geometry", G)
def p28_off_target(load):
    return load(G).select("doc_id", "page_number", p.off_target(F.col("width"), F.col("height"), F.col("rotate")).alias("off"))


@query("""n AS (SELECT doc_id, count(*) AS n_pages FROM page_geometry GROUP BY doc_id), j AS (SELECT job_id, file_id, 150 * n_pages AS n_pages, CASE WHEN file_id % 3 = 0 THEN 5 END AS picks FROM job_files JOIN n ON file_id = doc_id),
    s AS (SELECT job_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(coalesce(picks, n_pages)) AS BIGINT) AS pages, max(n_pages) AS largest FROM j GROUP BY job_id),
    r AS (SELECT *, CASE WHEN files > 25 THEN 'too_many_files' WHEN largest > 800 THEN 'file_too_long' WHEN pages > 2000 THEN 'job_too_long' END AS reason FROM s) SELECT job_id, files, pages, largest, reason, reason IS NULL AS ok FROM r""", "page_geometry job_files")
def a16_check_limits(load):
    n = load(G).groupBy(F.col("doc_id").alias("file_id")).agg((150 * F.count("*")).alias("n_pages"))
    return op.check_limits(load("job_files").join(n, "file_id").select("job_id", "file_id", "n_pages", F.when(F.col("file_id") % 3 == 0, 5).alias("picks")))


@query("SELECT doc_id, doc_id % 3 = 0 OR (doc_id % 3 = 1 AND count(*) = 1) AS valid FROM page_geometry GROUP BY doc_id", G)
def a17_reorder_valid(load):
    # the reversed order; the same with its last place doubled off by one; every page 0
    n = F.col("n_pages").cast("int")
    every = F.sequence(F.lit(0), n - 1)
    order = F.when(F.col("doc_id") % 3 == 0, F.reverse(every)).when(F.col("doc_id") % 3 == 1, F.transform(every, lambda x: F.lit(0) * x)).otherwise(F.concat(every, F.array(n)))
    return op.reorder_valid(load(G).groupBy("doc_id").agg(F.count("*").alias("n_pages")).withColumn("reorder", order))


SIZES = "(bytes % 100000) AS size_in, CASE page_number % 5 WHEN 0 THEN bytes % 100000 + 7 WHEN 1 THEN 9000 WHEN 2 THEN bytes % 20000 + 10240 ELSE CAST(floor(bytes % 100000 / 2) AS BIGINT) END AS size_out, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS pages_out"


def sizes(load):
    k, b = F.col("page_number") % 5, F.col("bytes") % 100000
    out = F.when(k == 0, b + 7).when(k == 1, 9000).when(k == 2, F.col("bytes") % 20000 + 10240).otherwise(F.floor(b / 2))
    return load(G).select("doc_id", "page_number", b.alias("size_in"), out.alias("size_out"), F.when(F.col("doc_id") % 11 == 0, 2).otherwise(1).alias("pages_out"))


@query(f"x AS (SELECT doc_id, page_number, {SIZES} FROM page_geometry) SELECT doc_id, page_number, CASE WHEN pages_out <> 1 THEN 'page_mismatch' WHEN size_out >= size_in THEN 'gs_larger' WHEN size_out < 10240 THEN 'suspiciously_small' WHEN size_in > 0 AND CAST(size_out AS DOUBLE) / size_in < 0.05 THEN 'ratio_too_low' END AS reason FROM x", G)
def p25_fallback_reason(load):
    return sizes(load).select("doc_id", "page_number", p.fallback_reason(F.col("size_in"), F.col("size_out"), F.lit(1), F.col("pages_out")).alias("reason"))


@query(f"""x AS (SELECT doc_id, page_number, {SIZES} FROM page_geometry), y AS (SELECT *, pages_out = 2 AS preserved FROM x)
    SELECT doc_id, page_number, CASE WHEN preserved THEN 'preserved_interactive' WHEN size_out >= size_in THEN 'final_original' ELSE 'none' END AS outcome, CASE WHEN NOT preserved AND size_out >= size_in THEN size_in ELSE size_out END AS final_size,
    CASE WHEN size_in > 0 AND size_out < size_in THEN CAST(CASE WHEN s - floor(s) < 0.5 OR s - floor(s) = 0.5 AND floor(s) % 2 = 0 THEN floor(s) ELSE floor(s) + 1 END AS DOUBLE) / 10 ELSE 0 END AS reduction_pct
    FROM (SELECT *, CAST(CAST(abs((1 - CAST(size_out AS DOUBLE) / nullif(size_in, 0)) * 100) AS VARCHAR) AS DECIMAL(38,18)) * 10 AS s FROM y) z""", G)
def p26_job_outcome(load):
    # the share as a decimal, ties to the even digit, in both engines
    df = sizes(load)
    return df.select("doc_id", "page_number", p.job_outcome(F.col("size_in"), F.col("size_out"), F.col("pages_out") == 2).alias("o")).select("doc_id", "page_number", "o.*")


@query("""x AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Strong' WHEN 1 THEN ' leve ' WHEN 2 THEN 'max' WHEN 3 THEN 'lossless' WHEN 4 THEN 'light' ELSE role END AS n FROM conversations),
    y AS (SELECT *, CASE lower(trim(n)) WHEN 'strong' THEN 'forte' WHEN 'max' THEN 'forte' WHEN 'light' THEN 'leve' WHEN 'leve' THEN 'leve' WHEN 'lossless' THEN 'lossless' ELSE 'equilibrio' END AS profile FROM x)
    SELECT conv_id, turn, profile, CASE profile WHEN 'leve' THEN 85 WHEN 'forte' THEN 45 WHEN 'lossless' THEN 95 ELSE 72 END AS quality, CASE profile WHEN 'leve' THEN 150 WHEN 'forte' THEN 96 WHEN 'lossless' THEN 300 ELSE 120 END AS dpi FROM y""".replace("x AS", "WITH x AS", 1))
def p27_profile_params(load):
    k = F.col("turn") % 6
    name = F.when(k == 0, "Strong").when(k == 1, " leve ").when(k == 2, "max").when(k == 3, "lossless").when(k == 4, "light").otherwise(F.col("role"))
    return load("conversations").select("conv_id", "turn", p.profile_params(name).alias("p")).select("conv_id", "turn", "p.*")


@query("""x AS (SELECT doc_id, CAST(sum(bytes) AS DOUBLE) / 1024.0::DOUBLE AS kb FROM page_geometry GROUP BY doc_id) SELECT doc_id, CASE WHEN kb >= 1024 THEN concat(CAST(CAST(round(CAST(CAST(kb / 1024.0::DOUBLE AS VARCHAR) AS DECIMAL(38,18)), 2) AS DECIMAL(18,2)) AS VARCHAR), ' MB')
    ELSE concat(CAST(CAST(round(CAST(CAST(kb AS VARCHAR) AS DECIMAL(38,18)), 1) AS DECIMAL(18,1)) AS VARCHAR), ' KB') END AS label FROM x""", G)
def p56_size_label(load):
    # the number as a decimal, ties up, in both engines
    df = load(G).groupBy("doc_id").agg((F.sum("bytes").cast("double") / 1024.0).alias("kb"))
    return df.select("doc_id", p.size_label(F.col("kb")).alias("label"))


@query("""SELECT doc_id, page_number, CASE WHEN width > 1.05::DOUBLE * height THEN 842.0::DOUBLE ELSE 595.0::DOUBLE END AS page_w,
    round(CASE WHEN width > 1.05::DOUBLE * height THEN least(806.0::DOUBLE / width, 559.0::DOUBLE / height) ELSE least(559.0::DOUBLE / width, 806.0::DOUBLE / height) END, 9) AS scale,
    round(CASE WHEN width > 1.05::DOUBLE * height THEN (842.0::DOUBLE - width * least(806.0::DOUBLE / width, 559.0::DOUBLE / height)) / 2 ELSE (595.0::DOUBLE - width * least(559.0::DOUBLE / width, 806.0::DOUBLE / height)) / 2 END, 6) AS x FROM page_geometry""", G)
def p30_fit_placement(load):
    out = load(G).select("doc_id", "page_number", p.fit_placement(F.col("width"), F.col("height")).alias("f"))
    return out.select("doc_id", "page_number", "f.page_w", F.round("f.scale", 9).alias("scale"), F.round("f.x", 6).alias("x"))


# plans

SPECS = "CASE doc_id % 7 WHEN 0 THEN '1-3, 5' WHEN 1 THEN '[2, 0, 2, 7]' WHEN 2 THEN '4-2' WHEN 3 THEN 'x' WHEN 4 THEN '' WHEN 5 THEN '3,3,1-2' ELSE concat(CAST(doc_id AS STRING), ',1') END"
STRICT = "CASE doc_id % 7 WHEN 0 THEN '1,2,3,5' WHEN 1 THEN '2,7' WHEN 5 THEN '3,1,2' WHEN 6 THEN CASE WHEN doc_id = 1 THEN '1' ELSE concat(CAST(doc_id AS STRING), ',1') END END"


@query(f"SELECT DISTINCT l_orderkey AS doc_id, {STRICT.replace('doc_id', 'l_orderkey')} AS pages, l_orderkey % 7 IN (2, 3) AS error, {STRICT.replace('doc_id', 'l_orderkey')} AS lenient FROM lineitem")
def p13_parse_pages(load):
    k, n = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    spec = F.when(k == 0, "1-3, 5").when(k == 1, "[2, 0, 2, 7]").when(k == 2, "4-2").when(k == 3, "x").when(k == 4, "").when(k == 5, "3,3,1-2").otherwise(F.concat(n, F.lit(",1")))
    df = load("lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("spec", spec)
    df = df.select("doc_id", p.parse_pages(F.col("spec")).alias("s"), p.parse_pages(F.col("spec"), strict=False).alias("l"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return df.select("doc_id", text("s.pages").alias("pages"), "s.error", text("l.pages").alias("lenient"))


@query("""x AS (SELECT doc_id, page_number, 15 * ((bytes % 61) - 20) AS a FROM page_geometry), y AS (SELECT *, (a % 360 + 360) % 360 AS t FROM x)
    SELECT doc_id, page_number, nullif(CAST(round_even(t / 90.0::DOUBLE, 0) AS BIGINT) * 90 % 360, 0) AS split_angle, CASE WHEN a IN (0, 90, 180, 270) THEN a ELSE -1 END AS merge_angle, CASE WHEN t % 90 = 0 THEN t END AS edit_angle FROM y""", G)
def p14_norm_rotation(load):
    a = 15 * (F.col("bytes") % 61 - 20)
    return load(G).select("doc_id", "page_number", p.norm_rotation(a, "split").cast("long").alias("split_angle"), p.norm_rotation(a, "merge").alias("merge_angle"), p.norm_rotation(a, "edit").alias("edit_angle"))


@query("SELECT g.doc_id, g.page_number, (rotate + coalesce(rotation, 0) + 720) % 360 AS relative, CASE WHEN coalesce(rotation, 0) = 0 THEN rotate % 360 ELSE (rotation + 360) % 360 END AS absolute FROM page_geometry g JOIN merge_plan m ON g.doc_id = m.job_id AND g.page_number = m.pos + 1", "page_geometry merge_plan")
def p15_effective_rotation(load):
    m = load("merge_plan").select(F.col("job_id").alias("doc_id"), (F.col("pos") + 1).alias("page_number"), "rotation")
    df = load(G).join(m, ["doc_id", "page_number"])
    return df.select("doc_id", "page_number", p.effective_rotation(F.col("rotate"), F.col("rotation"), False).alias("relative"), p.effective_rotation(F.col("rotate"), F.col("rotation"), True).alias("absolute"))


@query("SELECT g.doc_id, g.page_number, CASE WHEN rotation IS NULL AND width > height AND rotate IN (0, 180) THEN (rotate + 90) % 360 ELSE rotate END AS rotation FROM page_geometry g JOIN merge_plan m ON g.doc_id = m.job_id AND g.page_number = m.pos + 1", "page_geometry merge_plan")
def p16_auto_orient(load):
    m = load("merge_plan").select(F.col("job_id").alias("doc_id"), (F.col("pos") + 1).alias("page_number"), F.col("rotation").alias("angle"))
    return load(G).join(m, ["doc_id", "page_number"]).select("doc_id", "page_number", p.auto_orient(F.col("width"), F.col("height"), F.col("rotate"), F.col("angle")).alias("rotation"))


CROP = "(bytes % 8) / 8.0::DOUBLE AS x, (page_number % 4) / 4.0::DOUBLE AS y, (bytes % 5) / 4.0::DOUBLE AS w, (bytes % 3) / 2.0::DOUBLE AS h"


def crops(load):
    return load(G).select("doc_id", "page_number", "width", "height", (F.col("bytes") % 8 / 8.0).alias("x"), (F.col("page_number") % 4 / 4.0).alias("y"), (F.col("bytes") % 5 / 4.0).alias("w"), (F.col("bytes") % 3 / 2.0).alias("h"))


@query(f"""c AS (SELECT doc_id, page_number, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, {CROP} FROM page_geometry), d AS (SELECT *, least(w, 1 - x) AS ww, least(h, 1 - y) AS hh FROM c)
    SELECT doc_id, page_number, CASE WHEN ww > 0 AND hh > 0 THEN x * width END AS x0, CASE WHEN ww > 0 AND hh > 0 THEN (1 - y - hh) * height END AS y0, CASE WHEN ww > 0 AND hh > 0 THEN (x + ww) * width END AS x1, CASE WHEN ww > 0 AND hh > 0 THEN (1 - y) * height END AS y1,
    least(least(x, 1), least(w, 1)) * width AS cx0, greatest(least(x, 1), least(w, 1)) * width AS cx1 FROM d""", G)
def p17_crop_box(load):
    top = p.crop_box(F.struct("x", "y", "w", "h"), F.col("width"), F.col("height"), "topleft")
    corners = p.crop_box(F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("w").alias("x1"), F.col("h").alias("y1")), F.col("width"), F.col("height"), "corners")
    return crops(load).select("doc_id", "page_number", top.alias("t"), corners.alias("c")).select("doc_id", "page_number", "t.*", F.col("c.x0").alias("cx0"), F.col("c.x1").alias("cx1"))


SPECS = """s AS (SELECT doc_id, page_number, CAST(width AS DOUBLE) AS pw, CAST(height AS DOUBLE) AS ph, bytes % 6 AS k, CAST(CASE WHEN bytes % 6 < 3 THEN bytes % 5 / 8.0 ELSE bytes % 300 END AS DOUBLE) AS x, CAST(CASE WHEN bytes % 6 < 3 THEN bytes % 7 / 8.0 ELSE bytes % 400 END AS DOUBLE) AS y,
    CAST(CASE WHEN bytes % 6 < 3 THEN bytes % 3 / 2.0 ELSE bytes % 200 END AS DOUBLE) AS w, CAST(CASE WHEN bytes % 6 < 3 THEN bytes % 4 / 4.0 ELSE bytes % 250 END AS DOUBLE) AS h, page_number % 2 = 0 AS top FROM page_geometry)"""


@query(f"""{SPECS}, t AS (SELECT *, k IN (0, 3) OR k <> 4 AND greatest(x, y, w, h) <= 1 AND w > 0 AND h > 0 AS share FROM s),
    u AS (SELECT *, x * CASE WHEN share THEN pw ELSE 1 END AS a, CASE WHEN top THEN ph - (y + h) * CASE WHEN share THEN ph ELSE 1 END ELSE y * CASE WHEN share THEN ph ELSE 1 END END AS b, w * CASE WHEN share THEN pw ELSE 1 END AS dx, h * CASE WHEN share THEN ph ELSE 1 END AS dy FROM t),
    v AS (SELECT *, greatest(a, 0) AS l, least(a + dx, pw) AS r, greatest(b, 0) AS lo, least(b + dy, ph) AS hi FROM u),
    f AS (SELECT *, greatest(x, y, w, h) <= 1 AS fraction FROM s), p AS (SELECT *, greatest(least(x, w) * CASE WHEN fraction THEN pw ELSE 1 END, 0) AS pl, least(greatest(x, w) * CASE WHEN fraction THEN pw ELSE 1 END, pw) AS pr, greatest(least(y, h) * CASE WHEN fraction THEN ph ELSE 1 END, 0) AS plo, least(greatest(y, h) * CASE WHEN fraction THEN ph ELSE 1 END, ph) AS phi FROM f)
    SELECT doc_id, page_number, CASE WHEN r - l > 1 AND hi - lo > 1 THEN round(l, 6) END AS x0, CASE WHEN r - l > 1 AND hi - lo > 1 THEN round(lo, 6) END AS y0, CASE WHEN r - l > 1 AND hi - lo > 1 THEN round(r, 6) END AS x1, CASE WHEN r - l > 1 AND hi - lo > 1 THEN round(hi, 6) END AS y1,
    CASE WHEN pr - pl > 1 AND phi - plo > 1 THEN round(pl, 6) END AS px0, CASE WHEN pr - pl > 1 AND phi - plo > 1 THEN round(phi, 6) END AS py1 FROM v JOIN p USING (doc_id, page_number)""", G)
def p17_crop_spec(load):
    """The dialects with units and origins (spec), and of corners in points or fractions (points)."""
    b = F.col("bytes")
    small = b % 6 < 3
    pick = lambda a, c: F.when(small, a).otherwise(c).cast("double")
    df = load(G).select("doc_id", "page_number", "width", "height", (b % 6).alias("k"), pick(b % 5 / 8.0, b % 300).alias("x"), pick(b % 7 / 8.0, b % 400).alias("y"), pick(b % 3 / 2.0, b % 200).alias("w"), pick(b % 4 / 4.0, b % 250).alias("h"))
    unit = F.when(F.col("k").isin(0, 3), "percent").when(F.col("k") == 4, " pt ").when(F.col("k") == 5, "")
    spec = F.struct("x", "y", "w", "h", unit.alias("unit"), F.when(F.col("page_number") % 2 == 0, "TopLeft").otherwise(F.lit(None).cast("string")).alias("origin"))
    corners = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("w").alias("x1"), F.col("h").alias("y1"))
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    out = df.select("doc_id", "page_number", p.crop_box(spec, width, height, "spec").alias("s"), p.crop_box(corners, width, height, "points").alias("c"))
    return out.select("doc_id", "page_number", *[F.round(f"s.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round("c.x0", 6).alias("px0"), F.round("c.y1", 6).alias("py1"))


@query("SELECT doc_id, page_number, 0::DOUBLE AS x0, CAST(least(0, 20 - bytes % 40) AS DOUBLE) AS y0, CAST(greatest(width, bytes % 900) AS DOUBLE) AS x1, CAST(height AS DOUBLE) AS y1 FROM page_geometry", G)
def p18_union_box(load):
    box = lambda *v: F.struct(*[F.lit(x).cast("double").alias(n) if not hasattr(x, "cast") else x.cast("double").alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v)])
    media = box(0, 0, F.col("width"), F.col("height"))
    crop = F.when(F.col("page_number") > 0, box(F.col("bytes") % 900, 20 - F.col("bytes") % 40, 0, 30))  # corners the wrong way round
    return load(G).select("doc_id", "page_number", p.union_box([media, crop, F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")], media).alias("b")).select("doc_id", "page_number", "b.*")


@query("n AS (SELECT doc_id, count(*) AS n FROM page_geometry GROUP BY 1) SELECT job_id, CAST(pos AS BIGINT) AS pos, CASE WHEN page BETWEEN 1 AND n THEN page - 1 WHEN page = 0 THEN 0 END AS page0 FROM merge_plan JOIN n ON job_id = doc_id", "merge_plan page_geometry")
def p19_page_index(load):
    n = load(G).groupBy(F.col("doc_id").alias("job_id")).agg(F.count("*").alias("n"))
    return load("merge_plan").join(n, "job_id").select("job_id", F.col("pos").cast("long").alias("pos"), p.page_index(F.col("page"), F.col("n")).alias("page0"))


PLANNED = """fl AS (SELECT job_id, src, pg.page_number - 1 AS page0, width, height, rotate FROM (SELECT DISTINCT job_id, src FROM merge_plan) s JOIN page_geometry pg ON pg.doc_id = s.job_id),
    np AS (SELECT job_id, src, count(*) AS n FROM fl GROUP BY ALL), pk AS (SELECT m.*, CASE WHEN page BETWEEN 1 AND n THEN page - 1 WHEN page = 0 THEN 0 END AS page0 FROM merge_plan m JOIN np USING (job_id, src)),
    pp AS (SELECT pk.job_id, pk.pos, pk.src, pk.page, pk.rotation, pk.page0, width, height, rotate FROM pk JOIN fl USING (job_id, src, page0))"""


def planned(load):
    files = load("merge_plan").select("job_id", "src").distinct()
    pages = files.join(load(G).withColumnRenamed("doc_id", "job_id"), "job_id").select("job_id", "src", (F.col("page_number") - 1).alias("page0"), "width", "height", "rotate")
    return op.plan_pages(load("merge_plan"), pages)


@query(f"{PLANNED} SELECT job_id, CAST(pos AS INT) AS pos, src, page0, width, height FROM pp", "merge_plan page_geometry")
def j3_plan_pages(load):
    return planned(load).select("job_id", "pos", "src", "page0", "width", "height")


@query(f"{PLANNED}, b AS (SELECT *, CASE WHEN coalesce((rotation + 360) % 360, 0) = 0 THEN rotate ELSE (rotation + 360) % 360 END AS r FROM pp) SELECT job_id, CAST(pos AS INT) AS pos, CASE WHEN coalesce((rotation + 360) % 360, 0) = 0 AND width > height AND r IN (0, 180) THEN (r + 90) % 360 ELSE r END AS final_rotation FROM b", "merge_plan page_geometry")
def p15b_rotated_plan(load):
    return op.rotated_plan(planned(load)).select("job_id", "pos", "final_rotation")


@query(f"{PLANNED} SELECT job_id, CAST(pos AS INT) AS pos, CAST(row_number() OVER (PARTITION BY job_id, src, page0 ORDER BY pos) AS INT) AS occurrence FROM pp", "merge_plan page_geometry")
def w2_page_occurrence(load):
    return op.page_occurrence(planned(load)).select("job_id", "pos", "occurrence")


@query(f"{PLANNED} SELECT job_id, CAST(pos AS INT) AS pos, CAST(count(*) OVER (PARTITION BY job_id ORDER BY pos) AS BIGINT) AS running, count(*) OVER (PARTITION BY job_id ORDER BY pos) > 3 AS over_limit FROM pp", "merge_plan page_geometry")
def w6_running_page_total(load):
    return op.running_page_total(planned(load), 3).select("job_id", "pos", "running", "over_limit")


@query(f"{PLANNED} SELECT job_id, CAST(count(*) AS BIGINT) AS pages_out, CAST(count(DISTINCT (src, page0)) AS BIGINT) AS pages_in, CAST(count(*) FILTER (coalesce((rotation + 360) % 360, 0) <> 0) AS BIGINT) AS rotated, CAST(count(*) FILTER (pos % 2 = 0 AND width <> 400) AS BIGINT) AS cropped FROM pp GROUP BY job_id", "merge_plan page_geometry")
def a33_plan_summary(load):
    df = planned(load).withColumn("new_width", F.when(F.col("pos") % 2 == 0, 400).otherwise(F.col("width"))).withColumn("new_height", F.col("height"))
    return op.plan_summary(df)


@query("""n AS (SELECT doc_id, count(*) AS n FROM page_geometry GROUP BY 1), k AS (SELECT doc_id, n, unnest([0, 1, 2, 3]) AS pos FROM n), p AS (SELECT doc_id, n, pos, CASE WHEN doc_id % 4 = 0 THEN 500 + pos ELSE CASE pos WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END END AS page_number FROM k)
    SELECT doc_id, pos, page_number, NULL::STRING AS error FROM p WHERE page_number BETWEEN 1 AND n UNION ALL SELECT doc_id, NULL, NULL, 'no_valid_page' FROM n WHERE doc_id % 4 = 0""", G)
def p20_valid_pages(load):
    # picks 2, 0, 1, 2 of every document, which drop out where they are no page; every fourth one has none but such
    pages = load(G)
    pick = F.posexplode(F.when(F.col("doc_id") % 4 == 0, F.array(*map(F.lit, (500, 501, 502, 503)))).otherwise(F.array(*map(F.lit, (2, 0, 1, 2))))).alias("pos", "page_number")
    return op.valid_pages(pages.select("doc_id").distinct().select("doc_id", pick), pages)


@query("SELECT g.doc_id, g.page_number, CASE WHEN bytes % 3 = 0 THEN 90 END AS angle, CASE WHEN bytes % 4 = 0 THEN 10 END AS x0 FROM page_geometry g", G)
def j4_page_edits(load):
    pages = load(G)
    rotations = pages.where("bytes % 3 = 0").select("doc_id", "page_number", F.lit(90).alias("angle"))
    crops_ = pages.where("bytes % 4 = 0").select("doc_id", "page_number", F.lit(10).alias("x0"))
    return op.page_edits(pages.select("doc_id", "page_number"), rotations, crops_)


@query("""n AS (SELECT doc_id, count(*) AS n FROM page_geometry GROUP BY 1), s AS (SELECT doc_id, n, unnest(range(CASE WHEN doc_id % 3 = 0 THEN n WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END)) AS "at" FROM n WHERE doc_id % 3 <> 2 OR n > 0),
    t AS (SELECT doc_id, "at", CASE WHEN doc_id % 3 = 0 THEN "at" WHEN doc_id % 3 = 1 THEN 0 ELSE n - 1 END AS page0 FROM s) SELECT doc_id AS job_id, CAST("at" AS INT) AS "at", CAST(page0 AS INT) AS page0, CASE "at" WHEN 0 THEN 90 WHEN 1 THEN 180 END AS rotation, CASE WHEN page0 = 0 THEN 7 END AS crop FROM t""", G)
def j5_nested_plan_pages(load):
    n = load(G).groupBy(F.col("doc_id").alias("job_id")).agg(F.count("*").cast("int").alias("n_pages"))
    k = F.col("job_id") % 3
    # none: all pages; page 1 twice; the last page
    pages = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(1), F.lit(1))).otherwise(F.array("n_pages"))
    crop = F.array(*[F.struct(F.lit(1).alias("page"), F.lit(b).alias("box")) for b in (7, 8)])
    files = n.select("job_id", F.lit(0).alias("src"), "n_pages", pages.alias("pages"), F.array(F.lit(90), F.lit(180)).alias("rotations"), crop.alias("crops"))
    return op.nested_plan_pages(files).select("job_id", "at", "page0", "rotation", "crop")


@query("SELECT doc_id, page_number FROM page_geometry WHERE bytes % 5 <> 0", G)
def j8_drop_pages(load):
    pages = load(G)
    return op.drop_pages(pages.select("doc_id", "page_number"), pages.where("bytes % 5 = 0").select("doc_id", "page_number"))


@query("o AS (SELECT doc_id, page_number, CASE WHEN page_number % 2 = 0 THEN 100 - page_number END AS pos FROM page_geometry) SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos NULLS LAST, page_number) AS INT) AS place FROM o", G)
def l6_order_pages(load):
    pages = load(G).select("doc_id", "page_number")
    return op.order_pages(pages, pages.where("page_number % 2 = 0").withColumn("pos", 100 - F.col("page_number")))


@query("f AS (SELECT doc_id, width, min(page_number) AS first FROM page_geometry GROUP BY ALL) SELECT doc_id, string_agg(CAST(width AS STRING), ',' ORDER BY first) AS widths FROM f GROUP BY doc_id", G)
def u3_ordered_distinct(load):
    return op.ordered_distinct(load(G), ["doc_id"], "width", "page_number").select("doc_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("widths"))


@query("f AS (SELECT job_id, file_id, row_number() OVER (PARTITION BY job_id ORDER BY file_id DESC) AS file_pos FROM (SELECT * FROM job_files UNION ALL SELECT * FROM job_files WHERE file_id % 4 = 0) x) SELECT job_id, CAST(file_id AS BIGINT) AS doc_id, page_number, CAST(row_number() OVER (PARTITION BY job_id ORDER BY file_pos, page_number) AS INT) AS out_page FROM f JOIN page_geometry ON file_id = doc_id", "job_files page_geometry")
def u2_concat_documents(load):
    from pyspark.sql import Window

    files = load("job_files")
    files = files.unionAll(files.where("file_id % 4 = 0")).withColumn("file_pos", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("file_id")))).withColumnRenamed("file_id", "doc_id")
    return op.concat_documents(files, load(G)).select("job_id", "doc_id", "page_number", "out_page")


@query("SELECT doc_id, page_number, concat('page_', lpad(CAST(page_number AS STRING), 3, '0'), '.pdf') AS name, bytes, CAST(count(*) OVER w AS BIGINT) AS bundle_pages, CAST(sum(bytes) OVER w AS BIGINT) AS bundle_bytes FROM page_geometry WINDOW w AS (PARTITION BY doc_id)", G)
def u7_split_all(load):
    return op.split_all(load(G))


@query("SELECT doc_id, page_number, bytes FROM page_geometry QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bytes DESC, page_number DESC) = 1", G)
def w5_pick_one(load):
    return op.pick_one(load(G).select("doc_id", "page_number", "bytes"), ["doc_id"], [F.col("bytes"), F.col("page_number")], last=True)


#: Candidate estimators (anchor, base, slope, exponent, floor) and the observation they are held against.
CANDIDATES = [("anchor110_60_35", 110.0, 0.60, 0.35, 1.3, 0.0), ("anchor110_65_30", 110.0, 0.65, 0.30, 1.3, 0.0), ("anchor120_68_27", 120.0, 0.68, 0.27, 1.3, 0.0), ("shipped", 150.0, 0.55, 0.40, 0.8, 0.85)]
GRID = "(VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {s}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for n, a, b, s, e, f in CANDIDATES) + ") g(name, anchor, base, slope, exponent, floor)"
SWEEP = f"""ob AS (SELECT event_id AS obs_id, 5949.44::DOUBLE + event_id % 100 AS orig_kb, 4106.24::DOUBLE AS result_kb, 60 + event_id % 40 AS quality, 72 + event_id % 80 AS dpi, 1.0::DOUBLE + (event_id % 3) / 10.0::DOUBLE AS size_factor FROM events),
    sw AS (SELECT obs_id, name, greatest(orig_kb / 1024.0::DOUBLE * (base + slope * quality / 100.0::DOUBLE) * pow(dpi / anchor, exponent) / pow(size_factor, 0.20::DOUBLE), floor * (orig_kb / 1024.0::DOUBLE)) AS e, result_kb / 1024.0::DOUBLE AS r FROM ob, {GRID})"""


def sweep(load):
    n = F.col("event_id")
    obs = load("events").select(n.alias("obs_id"), (5949.44 + n % 100).alias("orig_kb"), F.lit(4106.24).alias("result_kb"), (60 + n % 40).alias("quality"), (72 + n % 80).alias("dpi"), (1.0 + n % 3 / 10.0).alias("size_factor"))
    return op.estimate_sweep(CANDIDATES, obs)


@query(f"WITH {SWEEP} SELECT obs_id, name, round(e, 6) AS estimate_mb, round((e - r) / r * 100, 6) AS error_pct, e BETWEEN 3.9 AND 4.2 AS hit FROM sw")
def p24_estimate_sweep(load):
    return sweep(load).select("obs_id", "name", F.round("estimate_mb", 6).alias("estimate_mb"), F.round("error_pct", 6).alias("error_pct"), "hit")


@query(f"WITH {SWEEP}, b AS (SELECT name, avg(abs(e - r)) AS m, avg(abs((e - r) / r * 100)) AS p, CAST(count(*) FILTER (e BETWEEN 3.9 AND 4.2) AS BIGINT) AS hits FROM sw GROUP BY name) SELECT name, round(m, 6) AS mean_abs_mb, round(p, 6) AS mean_abs_pct, hits, p = (SELECT min(p) FROM b) AS best FROM b")
def a32_estimator_error(load):
    return op.estimator_error(sweep(load)).withColumns({"mean_abs_mb": F.round("mean_abs_mb", 6), "mean_abs_pct": F.round("mean_abs_pct", 6)})
