"""Page analysis, compression plans and page plans.  Page tables are keyed by document, so their windows share one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pages as p


def page_metadata(pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Per page: rounded sides, area, share of the document's bytes in KB, whether larger than 1.3 times the mean area."""
    w = Window.partitionBy("doc_id")
    total = F.sum("bytes").over(w)
    if sizes is not None:  # the file's own size
        pages, total = pages.join(sizes.select("doc_id", F.col("bytes").alias("file_bytes")), "doc_id"), F.col("file_bytes")
    pages = pages.withColumn("area", F.col("width") * F.col("height").cast("double"))
    area_sum, mean = F.sum("area").over(w), F.avg("area").over(w)
    share = F.when(area_sum > 0, F.col("area") / area_sum).otherwise(1.0 / F.count("*").over(w))
    return pages.select(
        "doc_id", "page_number", F.bround(F.col("width").cast("double"), 1).alias("width"), F.bround(F.col("height").cast("double"), 1).alias("height"), "area",
        (total / 1024.0 * share).alias("estimated_size_kb"), (F.col("area") > 1.3 * mean).alias("is_large"), F.count("*").over(w).alias("total_pages"), area_sum.alias("total_area"), mean.alias("avg_area"),
    )


def enrich_pages(pages: DataFrame) -> DataFrame:
    """Size factor against the document's mean, from the rounded sides, and the settings it suggests."""
    area = F.col("width") * F.col("height")
    out = pages.withColumn("f", F.coalesce(area / F.nullif(F.avg(area).over(Window.partitionBy("doc_id")), F.lit(0.0)), F.lit(1.0)))
    large = F.col("f") > 1.3
    return out.withColumns({
        "size_factor": F.bround("f", 2), "is_large": large,
        "quality": F.when(large, F.greatest(F.lit(20), F.bround(80 / F.col("f")).cast("int"))).otherwise(80),
        "dpi": F.when(large, F.greatest(F.lit(p.MIN_DPI), F.bround(100 / F.col("f")).cast("int"))).otherwise(100),
        "resize_to_a4": large,
    })


def pick_one(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a total order."""
    order = [c.desc() if last else c.asc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def clean_settings(settings: DataFrame, order: str = "pos") -> DataFrame:
    """Usable settings: bad and non-positive pages dropped, the last of a page wins, numbers defaulted and clamped."""
    ok = settings.withColumn("page_number", F.col("page_number").try_cast("int")).where("page_number >= 1")
    one = pick_one(ok, ["doc_id", "page_number"], [F.col(order)], last=True)
    number = lambda c, d, a, b: p.clamp(F.coalesce(F.col(c).try_cast("int"), F.lit(d)), a, b).alias(c)
    return one.select("doc_id", "page_number", F.coalesce("include", F.lit(True)).alias("include"), number("quality", 80, 20, 100), number("dpi", 100, 50, 300), F.coalesce("resize_to_a4", F.lit(False)).alias("resize_to_a4"), F.coalesce("keep_original", F.lit(False)).alias("keep_original"))


def estimated(pages: DataFrame, settings: DataFrame) -> DataFrame:
    """Pages (enriched) with settings and the estimate of their compressed size."""
    s = settings.select("doc_id", "page_number", "include", F.col("quality").alias("q"), F.col("dpi").alias("d"), F.col("resize_to_a4").alias("rz"), "keep_original")
    both = pages.join(s, ["doc_id", "page_number"])
    est = p.estimate_kb(F.col("estimated_size_kb"), F.col("q"), F.col("d"), F.col("size_factor"), F.col("include"), F.col("keep_original"), F.col("rz"), F.col("width") * F.col("height"))
    return both.withColumn("estimate_kb", est)


def selection_summary(estimates: DataFrame, large_only: bool = False) -> DataFrame:
    """Per document: KB of the included pages, estimated KB, pages selected, large and in all, percent saved."""
    df = estimates.where("is_large") if large_only else estimates
    sums = df.groupBy("doc_id").agg(F.sum(F.when(F.col("include"), F.col("estimated_size_kb")).otherwise(0.0)).alias("original_kb"), F.sum("estimate_kb").alias("adjusted_kb"), F.count_if("include").alias("selected"), F.count_if("is_large").alias("large"), F.count("*").alias("pages"))
    return sums.withColumn("saved_pct", F.when(F.col("original_kb") > 0, (F.col("original_kb") - F.col("adjusted_kb")) / F.col("original_kb") * 100).otherwise(0.0))


def settings_groups(settings: DataFrame) -> DataFrame:
    """Included pages by equal settings, ascending; kept pages stand apart (kept = true, null settings)."""
    inc = settings.where("include")
    key = lambda c: F.when(~F.col("keep_original"), F.col(c)).alias(c)
    return inc.select("doc_id", F.col("keep_original").alias("kept"), key("quality"), key("dpi"), key("resize_to_a4"), "page_number").groupBy("doc_id", "kept", "quality", "dpi", "resize_to_a4").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))


def page_sources(groups: DataFrame) -> DataFrame:
    """(doc_id, page_number) to its group and place there, from settings_groups; groups count by their first page."""
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("kept", F.col("pages")[0]))
    return groups.select("doc_id", "kept", number.alias("part"), F.posexplode("pages").alias("at", "page_number"))


def renumber_in_group(grouped: DataFrame) -> DataFrame:
    """Pages of each group counted from 1, as they stand in the group's own file; other columns stay with their page."""
    return grouped.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("page_number")))


def distinct_page_sizes(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count_distinct(F.bround(F.col("width").cast("double")), F.bround(F.col("height").cast("double"))).alias("sizes"))


def has_rotated_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.bool_or(F.pmod("rotate", F.lit(360)).isin(90, 270)).alias("rotated"))


def normalize_decision(pages: DataFrame, mode: str = "auto", target: tuple[float, float] = p.A4) -> DataFrame:
    """Per document whether pages are brought to one size; auto: several sizes and none turned.  needs: the other rule, any page off target or both orientations."""
    rotated = F.bool_or(F.pmod("rotate", F.lit(360)).isin(90, 270))
    sizes = F.count_distinct(F.bround(F.col("width").cast("double")), F.bround(F.col("height").cast("double")))
    auto = {"on": F.lit(True), "off": F.lit(False), "auto": (sizes > 1) & ~rotated}[mode]
    off = F.bool_or(p.off_target(F.col("width"), F.col("height"), F.col("rotate"), target))
    both = F.bool_or(F.col("width") > F.col("height")) & F.bool_or(F.col("width") <= F.col("height"))
    return pages.groupBy("doc_id").agg(auto.alias("normalize"), (off | both).alias("needs"))


def check_limits(job_files: DataFrame, max_files: int = 25, max_file_pages: int = 800, max_job_pages: int = 2000) -> DataFrame:
    """Per job of (job_id, file_id, n_pages, picks): files, pages and the first limit broken, null if none; picks null counts every page."""
    n = F.coalesce(F.col("picks"), F.col("n_pages"))
    sums = job_files.groupBy("job_id").agg(F.count("*").alias("files"), F.sum(n).alias("pages"), F.max("n_pages").alias("largest"))
    return sums.withColumn("reason", F.when(F.col("files") > max_files, "too_many_files").when(F.col("largest") > max_file_pages, "file_too_long").when(F.col("pages") > max_job_pages, "job_too_long")).withColumn("ok", F.col("reason").isNull())


def reorder_valid(ops: DataFrame) -> DataFrame:
    """Whether each document's order lists every page 0..n-1 once (doc_id, reorder, n_pages)."""
    every = F.when(F.col("n_pages") > 0, F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return ops.select("doc_id", (F.array_sort(F.col("reorder").cast("array<int>")) == every).alias("valid"))


def valid_pages(picks: DataFrame, pages: DataFrame) -> DataFrame:
    """Picks (doc_id, pos, page_number) that are pages of their document, in order; repeated picks stay.

    A document of which no pick is a page has one row of error ``no_valid_page``; the error is null elsewhere.
    """
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    judged = picks.join(counts, "doc_id", "left").withColumn("ok", (F.col("page_number") >= 1) & (F.col("page_number") <= F.coalesce("n", F.lit(0))))
    good = judged.where("ok").select("doc_id", "pos", "page_number", F.lit(None).cast("string").alias("error"))
    none = judged.groupBy("doc_id").agg(F.bool_or("ok").alias("any")).where("NOT any")
    return good.unionByName(none.select("doc_id", F.lit("no_valid_page").alias("error")), allowMissingColumns=True)


def plan_pages(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """A plan's picks (job_id, pos, src, page, rotation; pages 0-based after page_index) joined to pages (job_id, src, page0, width, height, rotate).

    Order and repeated picks stay; a pick that is no page of its file drops out.
    """
    counts = pages.groupBy("job_id", "src").agg(F.count("*").alias("n_pages"))
    placed = plan.join(counts, ["job_id", "src"]).withColumn("page0", p.page_index(F.col("page"), F.col("n_pages"))).where("page0 IS NOT NULL")
    return placed.join(pages, ["job_id", "src", "page0"])


def rotated_plan(planned: DataFrame) -> DataFrame:
    """Planned pages with their final rotation: an absolute angle, else the page's own, turned if landscape."""
    angle = F.nullif(F.pmod("rotation", F.lit(360)), F.lit(0))
    base = p.effective_rotation(F.col("rotate"), angle, absolute=True)
    return planned.withColumn("final_rotation", p.auto_orient(F.col("width"), F.col("height"), base, angle))


def page_occurrence(planned: DataFrame) -> DataFrame:
    """How often a page has been picked before and with this pick, in output order."""
    return planned.withColumn("occurrence", F.row_number().over(Window.partitionBy("job_id", "src", "page0").orderBy("pos")))


def running_page_total(planned: DataFrame, limit: int) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("job_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return planned.withColumn("running", n).withColumn("over_limit", F.col("running") > limit)


def plan_summary(planned: DataFrame) -> DataFrame:
    """Per job: pages picked, of how many different ones, turned and cropped (size changed)."""
    cropped = (F.col("new_width") != F.col("width")) | (F.col("new_height") != F.col("height"))
    return planned.groupBy("job_id").agg(F.count("*").alias("pages_out"), F.count_distinct("src", "page0").alias("pages_in"), F.count_if(F.coalesce(F.pmod("rotation", F.lit(360)), F.lit(0)) != 0).alias("rotated"), F.count_if(cropped).alias("cropped"))


def page_edits(pages: DataFrame, rotations: DataFrame, crops: DataFrame) -> DataFrame:
    """Pages with the extra angle and crop that stand for their number."""
    return pages.join(rotations, ["doc_id", "page_number"], "left").join(crops, ["doc_id", "page_number"], "left")


def nested_plan_pages(files: DataFrame) -> DataFrame:
    """Picks of (job_id, src, n_pages, pages, rotations, crops): the j-th pick takes the j-th angle and the first crop of its page."""
    sel = files.withColumn("sel", p.page_selection(F.col("pages"), F.col("n_pages"))).where("sel IS NOT NULL")
    crop = F.filter("crops", lambda c: c["page"] == F.col("page0") + 1)
    return sel.select("job_id", "src", "rotations", "crops", F.posexplode("sel").alias("at", "page0")).select("job_id", "src", "at", "page0", F.get("rotations", F.col("at")).alias("rotation"), F.get(crop, F.lit(0))["box"].alias("crop"))


def drop_pages(ordered: DataFrame, deletes: DataFrame) -> DataFrame:
    return ordered.join(deletes, ["doc_id", "page_number"], "left_anti")


def order_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages in a given order (doc_id, page_number, pos); those not listed follow in their own; place counts from 1."""
    both = pages.join(order, ["doc_id", "page_number"], "left")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("pos").asc_nulls_last(), "page_number"))).drop("pos")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each key's different values as an array in order of their first place."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_at"))
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", value))).alias("_l")).select(*keys, F.transform("_l", lambda x: x[value]).alias("values"))


def concat_documents(files: DataFrame, pages: DataFrame) -> DataFrame:
    """All pages of a job's files in the caller's order (job_id, file_pos, doc_id); the same file twice stands twice."""
    w = Window.partitionBy("job_id").orderBy("file_pos", "page_number")
    return files.join(pages, "doc_id").withColumn("out_page", F.row_number().over(w))


def split_all(pages: DataFrame) -> DataFrame:
    """Every page as a document of its own, with its name, and the number and bytes of its bundle."""
    w = Window.partitionBy("doc_id")
    return pages.select("doc_id", "page_number", F.format_string("page_%03d.pdf", "page_number").alias("name"), "bytes", F.count("*").over(w).alias("bundle_pages"), F.sum("bytes").over(w).alias("bundle_bytes"))


def estimate_sweep(grid: list[tuple], observations: DataFrame) -> DataFrame:
    """Estimates (MB) of each candidate (name, anchor, base, slope, exponent, floor) for each observation."""
    names = ("name", "anchor", "base", "slope", "exponent", "floor")
    both = observations.select("*", F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in grid])))
    mb = F.col("orig_kb") / 1024.0
    scaled = mb * (F.col("base") + F.col("slope") * F.col("quality") / 100.0) * F.pow(F.col("dpi") / F.col("anchor"), F.col("exponent")) / F.pow("size_factor", F.lit(0.20))
    est = F.greatest(scaled, F.col("floor") * mb)
    real = F.col("result_kb") / 1024.0
    return both.select("obs_id", "name", est.alias("estimate_mb"), (est - real).alias("error_mb"), ((est - real) / real * 100).alias("error_pct"), est.between(3.9, 4.2).alias("hit"))


def estimator_error(sweep: DataFrame) -> DataFrame:
    """Mean absolute errors by candidate, and which is best (of equals the first by name)."""
    by = sweep.groupBy("name").agg(F.avg(F.abs("error_mb")).alias("mean_abs_mb"), F.avg(F.abs("error_pct")).alias("mean_abs_pct"), F.count_if("hit").alias("hits"))
    best = by.agg(F.min(F.struct("mean_abs_pct", "name")).alias("b")).select("b.name").scalar()
    return by.withColumn("best", F.col("name") == best)
