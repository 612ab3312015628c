"""Page geometry, plans and compression settings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A4 = (595.0, 842.0)
#: Quality and dpi of the profiles, and their aliases.
PROFILES = {"leve": (85, 150), "equilibrio": (72, 120), "forte": (45, 96), "lossless": (95, 300)}
PROFILE_ALIASES = {"light": "leve", "balanced": "equilibrio", "strong": "forte", "max": "forte"}
MIN_DPI = 72


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def parse_pages(spec: Column, strict: bool = True) -> Column:
    """struct(pages, error) of a page list: a JSON list (values under 1 dropped) or ranges as ``1-3, 5``.

    Duplicates keep their first place; null or empty gives null pages.  Strict, a bad token or range is an error; lenient, it is skipped.
    """
    listed = F.from_json(spec, "array<int>")
    is_list = F.trim(spec).startswith("[") & listed.isNotNull() & ~F.exists(F.coalesce(listed, F.array().cast("array<int>")), lambda x: x.isNull())
    tokens = F.filter(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","), lambda x: x != "")
    bound = lambda x, i: F.split(x, "-", 2)[i].try_cast("int")
    good = lambda x: F.when(F.instr(x, "-") > 0, F.coalesce((bound(x, 0) > 0) & (F.get(F.split(x, "-", 2), F.lit(1)).try_cast("int") >= bound(x, 0)), F.lit(False))).otherwise(F.coalesce(x.try_cast("int") > 0, F.lit(False)))
    run = lambda x: F.when(F.instr(x, "-") > 0, F.sequence(bound(x, 0), F.get(F.split(x, "-", 2), F.lit(1)).try_cast("int"))).otherwise(F.array(x.try_cast("int")))
    text = F.array_distinct(F.flatten(F.transform(F.filter(tokens, good), run)))
    pages = F.when(is_list, F.array_distinct(F.filter(listed, lambda p: p >= 1))).otherwise(text)
    error = F.lit(False) if not strict else ~is_list & (spec != "") & F.exists(tokens, lambda x: ~good(x))
    return F.struct(F.when((spec != "") & ~error & (F.size(pages) > 0), pages).alias("pages"), F.coalesce(error, F.lit(False)).alias("error"))


def snap(angle: Column) -> Column:
    """The nearest quarter turn, 0..270; halves go to the even quarter."""
    return F.pmod(F.bround(F.pmod(angle, F.lit(360)) / 90.0).cast("int") * 90, F.lit(360))


def norm_rotation(angle: Column, dialect: str) -> Column:
    """Extra or absolute angle by dialect; null drops it.

    split: nearest quarter turn, 0 dropped.  merge: quarter turns only, else an error (-1 here).  edit, pipeline: other
    angles are ignored.
    """
    turn = F.pmod(angle, F.lit(360))
    if dialect == "split":
        return F.nullif(snap(angle), F.lit(0))
    if dialect == "merge":
        return F.when(angle.isNotNull(), F.when(angle.isin(0, 90, 180, 270), angle).otherwise(-1))
    if dialect in ("edit", "pipeline"):
        return F.when(turn % 90 == 0, turn)
    raise ValueError("dialect must be split, merge, edit or pipeline")


def effective_rotation(base: Column, angle: Column, absolute: bool) -> Column:
    """Relative angles add to the base; an absolute one replaces it, unless it is null or 0."""
    if absolute:
        return F.when(F.coalesce(angle, F.lit(0)) == 0, F.pmod(base, F.lit(360))).otherwise(F.pmod(angle, F.lit(360)))
    return F.pmod(base + F.coalesce(angle, F.lit(0)), F.lit(360))


def auto_orient(width: Column, height: Column, rotation: Column, angle: Column) -> Column:
    """A landscape page without an angle of its own and not on its side is turned a quarter."""
    return F.when(angle.isNull() & (width > height) & rotation.isin(0, 180), F.pmod(rotation + 90, F.lit(360))).otherwise(rotation)


def _inside(box: Column, width: Column, height: Column) -> Column:
    """The box cut at the page, corners in order; null if a side is a point or less."""
    left, right = F.greatest(F.least(box["x0"], box["x1"]), F.lit(0.0)), F.least(F.greatest(box["x0"], box["x1"]), width)
    low, high = F.greatest(F.least(box["y0"], box["y1"]), F.lit(0.0)), F.least(F.greatest(box["y0"], box["y1"]), height)
    return F.when((right - left > 1) & (high - low > 1), F.struct(left.alias("x0"), low.alias("y0"), right.alias("x1"), high.alias("y1")))


def crop_box(crop: Column, width: Column, height: Column, dialect: str) -> Column:
    """struct(x0, y0, x1, y1) in points from the bottom left; null if the crop is none.

    topleft: {x, y, w, h} as fractions from the top left, cut at the page's end.  points: {x0, y0, x1, y1}, fractions if
    all are 0..1, else points; a side of a point or less is no crop.  spec: {x, y, w, h, unit, origin}, from the bottom left
    or the origin topleft, as fractions if the unit is percent or none is given and all are, else points.  corners: {x0, y0, x1, y1} as fractions, clamped and sorted.
    """
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    if dialect == "topleft":
        w, h = F.least(crop["w"], 1.0 - crop["x"]), F.least(crop["h"], 1.0 - crop["y"])
        ok = (crop["x"] >= 0) & (crop["x"] < 1) & (crop["y"] >= 0) & (crop["y"] < 1) & (w > 0) & (h > 0)
        return F.when(ok, box(crop["x"] * width, (1.0 - crop["y"] - h) * height, (crop["x"] + w) * width, (1.0 - crop["y"]) * height))
    if dialect == "points":
        values = [crop[c] for c in ("x0", "y0", "x1", "y1")]
        fraction = (F.least(*values) >= 0) & (F.greatest(*values) <= 1)
        x0, y0, x1, y1 = (F.when(fraction, v * s).otherwise(v) for v, s in zip(values, (width, height, width, height)))
        return _inside(box(x0, y0, x1, y1), width, height)
    if dialect == "spec":
        x, y, w, h = (F.coalesce(crop[c].cast("double"), F.lit(0.0)) for c in ("x", "y", "w", "h"))
        unit, origin = (F.lower(F.trim(F.coalesce(crop[c], F.lit("")))) for c in ("unit", "origin"))
        small = (F.least(x, y) >= 0) & (F.greatest(x, y, w, h) <= 1) & (w > 0) & (h > 0)
        share = (unit == "percent") | ((unit == "") & small)
        sx, sy = F.when(share, width).otherwise(1.0), F.when(share, height).otherwise(1.0)
        low = F.when(origin == "topleft", height - (y + h) * sy).otherwise(y * sy)
        corners = F.struct((x * sx).alias("x0"), low.alias("y0"), (x * sx + w * sx).alias("x1"), (low + h * sy).alias("y1"))
        return _inside(corners, width, height)
    if dialect == "corners":
        x0, y0, x1, y1 = (clamp(crop[c], 0.0, 1.0) for c in ("x0", "y0", "x1", "y1"))
        return box(F.least(x0, x1) * width, F.least(y0, y1) * height, F.greatest(x0, x1) * width, F.greatest(y0, y1) * height)
    raise ValueError("dialect must be topleft, points, spec or corners")


def union_box(boxes: list[Column], media: Column) -> Column:
    """The smallest box around all given ones; a missing one is the media box; corners are put in order."""
    each = [F.coalesce(b, media) for b in boxes]
    low = lambda a, b: F.least(*[F.least(x[a], x[b]) for x in each]) if len(each) > 1 else F.least(each[0][a], each[0][b])
    high = lambda a, b: F.greatest(*[F.greatest(x[a], x[b]) for x in each]) if len(each) > 1 else F.greatest(each[0][a], each[0][b])
    return F.struct(low("x0", "x1").alias("x0"), low("y0", "y1").alias("y0"), high("x0", "x1").alias("x1"), high("y0", "y1").alias("y1"))


def page_index(page: Column, n_pages: Column) -> Column:
    """0-based page of a pick: 1..n is 1-based, 0 the first; anything else is null."""
    return F.when((page >= 1) & (page <= n_pages), page - 1).when(page == 0, F.lit(0))


def page_selection(pages: Column, n_pages: Column) -> Column:
    """0-based pages of a list: all 1-based, else all 0-based, else null; none or empty is every page."""
    every = F.when(n_pages > 0, F.sequence(F.lit(0), n_pages.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    one = F.forall(pages, lambda p: (p >= 1) & (p <= n_pages))
    zero = F.forall(pages, lambda p: (p >= 0) & (p < n_pages))
    return F.when(F.coalesce(F.size(pages), F.lit(0)) <= 0, every).when(one, F.transform(pages, lambda p: p - 1)).when(zero, pages)


def image_params(quality: Column, dpi: Column) -> Column:
    """struct of the image settings that a quality and a resolution stand for."""
    q = clamp(quality, 20, 100)
    factor = F.when(q >= 80, 0.05 + (100 - q) / 20.0 * 0.25).when(q >= 60, 0.30 + (80 - q) / 20.0 * 0.30).when(q >= 40, 0.60 + (60 - q) / 20.0 * 0.40).otherwise(1.00 + (40 - q) / 20.0 * 0.50)
    res = F.when(q >= 75, 1.00).when(q >= 50, 0.85).when(q >= 35, 0.70).otherwise(0.55)
    color = F.greatest(F.lit(MIN_DPI), F.floor(dpi * res).cast("int"))
    mono = F.greatest(F.lit(MIN_DPI), F.floor(dpi * F.least(F.lit(1.0), res * 1.2)).cast("int"))
    step = lambda a, b, c: F.when(q >= 75, a).when(q >= 45, b).otherwise(c)
    return F.struct(
        q.alias("jpeg_q"), F.bround(factor, 4).alias("qfactor"), color.alias("color_res"), color.alias("gray_res"), mono.alias("mono_res"),
        step("Bicubic", "Average", "Subsample").alias("downsample"), step("[1 1 1 1]", "[2 1 1 1]", "[2 1 1 2]").alias("hsamples"), step("[1 1 1 1]", "[1 1 1 1]", "[2 1 1 2]").alias("vsamples"),
    )


def estimate_kb(orig: Column, quality: Column, dpi: Column, size_factor: Column, include: Column, keep: Column, resize: Column, area: Column) -> Column:
    """Estimated size of a page after compression: none if left out, as it is if kept, otherwise scaled and bounded."""
    a4 = F.when(resize & (area > 0), F.least(F.lit(1.0), F.lit(A4[0] * A4[1]) / area)).otherwise(1.0)
    scaled = orig * (0.55 + quality / 100.0 * 0.40) * F.pow(dpi / 150.0, F.lit(0.8)) / F.pow(size_factor, F.lit(0.20)) * a4
    floor = F.when((quality >= 75) & (dpi >= 90) & ~resize, F.greatest(scaled, orig * 0.85)).otherwise(scaled)
    return F.when(~include, 0.0).when(keep, orig).otherwise(F.least(orig, F.greatest(F.lit(10.0), floor)))


def fallback_reason(size_in: Column, size_out: Column, pages_in: Column, pages_out: Column) -> Column:
    """Why a group's compressed form isn't taken, null if it is."""
    return (
        F.when(pages_in != pages_out, "page_mismatch")
        .when(size_out >= size_in, "gs_larger")
        .when(size_out < 10 * 1024, "suspiciously_small")
        .when((size_in > 0) & (size_out / size_in < 0.05), "ratio_too_low")
    )


def job_outcome(original: Column, final: Column, preserved: Column) -> Column:
    """struct(outcome, final_size, reduction_pct): the original stands unless the result is smaller."""
    gain = F.when((original > 0) & (final < original), F.bround((1 - final / original) * 100, 1)).otherwise(0.0)
    larger = ~preserved & (final >= original)
    return F.struct(
        F.when(preserved, "preserved_interactive").when(larger, "final_original").otherwise("none").alias("outcome"),
        F.when(larger, original).otherwise(final).alias("final_size"),
        F.when(larger, 0.0).otherwise(gain).alias("reduction_pct"),
    )


def profile_params(name: Column) -> Column:
    """struct(profile, quality, dpi); aliases are resolved, an unknown name is ``equilibrio``."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for alias, profile in PROFILE_ALIASES.items():
        key = F.when(key == alias, profile).otherwise(key)
    key = F.when(key.isin(list(PROFILES)), key).otherwise("equilibrio")
    pick = lambda i: F.coalesce(*[F.when(key == p, v[i]) for p, v in PROFILES.items()])
    return F.struct(key.alias("profile"), pick(0).alias("quality"), pick(1).alias("dpi"))


def off_target(width: Column, height: Column, rotate: Column, size: tuple[float, float] = A4, tolerance: float = 2.0) -> Column:
    """Whether a page is turned, or within tolerance of the target size in neither orientation."""
    near = lambda a, b: (F.abs(width - a) <= tolerance) & (F.abs(height - b) <= tolerance)
    return (F.pmod(rotate, F.lit(360)) != 0) | ~(near(*size) | near(size[1], size[0]))


def fit_placement(w: Column, h: Column, mode: str = "fit", margin: float = 18.0, size: tuple[float, float] = A4) -> Column:
    """struct(page_w, page_h, scale, x, y): an image centred on a page, landscape when w > 1.05 h."""
    wide = w > 1.05 * h
    pw, ph = F.when(wide, size[1]).otherwise(size[0]), F.when(wide, size[0]).otherwise(size[1])
    sx, sy = (pw - 2 * margin) / w, (ph - 2 * margin) / h
    scale = F.least(sx, sy) if mode == "fit" else F.greatest(sx, sy)
    return F.struct(pw.alias("page_w"), ph.alias("page_h"), scale.alias("scale"), ((pw - w * scale) / 2).alias("x"), ((ph - h * scale) / 2).alias("y"))


def flip_y(box: Column, height: Column) -> Column:
    """A box with its origin moved between the top and the bottom of the page."""
    return F.struct(box["x0"].alias("x0"), (height - box["y1"]).alias("y0"), box["x1"].alias("x1"), (height - box["y0"]).alias("y1"))


def size_label(kb: Column) -> Column:
    return F.when(kb >= 1024, F.concat(F.format_string("%.2f", kb / 1024.0), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", kb), F.lit(" KB")))
