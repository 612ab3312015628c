"""Admission, ownership, content and routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types that may be stored, archive types of office files, extensions by kind and by type.
ALLOWED_MIMES = [
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/rtf", "text/plain", "text/html",
    "application/vnd.oasis.opendocument.text", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel.sheet.macroenabled.12", "application/vnd.oasis.opendocument.spreadsheet", "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.oasis.opendocument.presentation", "image/jpeg", "image/png", "image/bmp", "image/tiff", "application/zip",
]
OOXML = ["docx", "xlsx", "xlsm", "pptx", "dotx", "xltx", "ppsx", "potx"]
EXTENSIONS = ["pdf", "doc", "docx", "odt", "rtf", "txt", "html", "xls", "xlsx", "xlsm", "ods", "ppt", "pptx", "odp", "jpg", "jpeg", "png", "bmp", "tiff", "csv"]
IMAGES, DOCUMENTS, SHEETS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp"], ["doc", "docx", "odt", "rtf", "txt", "html", "htm", "ppt", "pptx", "odp"], ["csv", "xls", "xlsx", "ods"]
BY_MIME = {
    "application/pdf": "pdf", "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/bmp": "bmp", "image/x-ms-bmp": "bmp", "image/tiff": "tiff", "image/x-tiff": "tiff",
    "text/plain": "txt", "text/html": "html", "application/xhtml+xml": "html", "text/csv": "csv", "application/csv": "csv", "application/msword": "doc", "application/vnd.ms-excel": "xls",
    "application/vnd.ms-powerpoint": "ppt", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-excel.sheet.macroenabled.12": "xlsm",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp",
}
TARGETS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "docs": "docx", "word": "docx", "xlsx": "xlsx", "excel": "xlsx", "xlsm": "xlsm", "csv": "csv"}


def safe_name(name: Column) -> Column:
    """The last part of a path with odd characters replaced, 128 long at most; ``file`` if nothing is left."""
    base = F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1), r"[^A-Za-z0-9_.-]", "_")
    return F.substring(F.when(base.isin("", ".", ".."), "file").otherwise(base), 1, 128)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; '' if none."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def sniff_type(content: Column, tolerant: bool = False) -> Column:
    """A type from the leading bytes: PDF (tolerant: anywhere in the first 1024), PNG, JPEG, else octet-stream."""
    starts = lambda h: F.hex(F.substring(content, 1, len(h) // 2)) == h
    pdf = F.hex(F.substring(content, 1, 1024)).rlike("^(?:..)*?255044462D") if tolerant else starts("255044462D")
    return F.when(pdf, "application/pdf").when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg").otherwise("application/octet-stream")


def resolve_ext(name: Column, mime: Column, allowed: list[str] = EXTENSIONS) -> Column:
    """The extension to store a file under, null if none is allowed: .pdf at the end; the right-most allowed suffix of
    the safe name, of the raw name; the type's; the raw one; pdf by type."""
    suffixes = lambda n: F.filter(F.reverse(F.slice(F.split(F.lower(n), r"\."), 2, 1000)), lambda s: s.isin(allowed))
    by_type = F.when(F.lower(mime).startswith("application/pdf"), "pdf")
    for m, e in BY_MIME.items():
        by_type = F.when(F.lower(mime) == m, e).otherwise(by_type)
    safe, raw = safe_name(name), F.coalesce(name, F.lit(""))
    return F.coalesce(
        F.when((F.lower(raw).endswith(".pdf") | F.lower(safe).endswith(".pdf")) & F.lit("pdf" in allowed), F.lit("pdf")),
        F.get(suffixes(safe), F.lit(0)), F.get(suffixes(raw), F.lit(0)), F.when(by_type.isin(allowed), by_type), F.when(extension(raw).isin(allowed), extension(raw)),
    )


def admit(name: Column, mime: Column) -> Column:
    """Why a file isn't taken, null if it is: a type off the list, an archive that is no office file, an unknown extension."""
    m, ext = F.lower(mime), extension(F.coalesce(name, F.lit("")))
    known = (m != "") & (m != "application/octet-stream")
    return F.when(known & ~m.isin(ALLOWED_MIMES), "type_not_allowed").when((m == "application/zip") & ~ext.isin(OOXML), "zip_not_office").when(resolve_ext(name, mime).isNull(), "extension_not_supported")


def route_conversion(ext: Column, target: Column) -> Column:
    """struct(target, engine, reason) for a source extension and a wanted format."""
    # looked up in a map: alias by alias, each step would hold the step before twice
    known = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])
    t = F.coalesce(F.try_element_at(known, F.lower(F.trim(target))), F.lower(F.trim(target)))
    e = F.lower(F.coalesce(ext, F.lit("")))
    office, sheet, image, pdf = e.isin(DOCUMENTS + SHEETS), e.isin(SHEETS), e.isin(IMAGES), e == "pdf"
    engine = (
        F.when((t == "pdf") & pdf, "copy").when((t == "pdf") & image, "image").when((t == "pdf") & office, "office")
        .when((t == "docx") & pdf, "pdf_to_docx").when((t == "docx") & ~image, "office")
        .when((t == "csv") & pdf, "pdf_to_csv").when(t.isin("xlsx", "xlsm") & pdf, "pdf_to_xlsx").when(t.isin("csv", "xlsx", "xlsm") & sheet, "office")
    )
    wanted = t.isin(sorted(set(TARGETS.values())))
    reason = F.when(~wanted, "unknown_target").when(engine.isNull(), "unsupported_source")
    return F.struct(F.when(wanted, t).alias("target"), engine.alias("engine"), reason.alias("reason"))


def owned_path(path: Column, owner: Column, namespace: str = "generated") -> Column:
    """The normalised path if it is ``namespace/owner/job/file`` of this owner, else null."""
    p = F.regexp_replace(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), r"\\", "/")
    parts = F.split(p, "/")
    at = lambda i: F.get(parts, F.lit(i))
    hex32 = lambda c: c.rlike(r"^[0-9a-f]{32}$")
    ok = (F.size(parts) == 4) & (at(0) == namespace) & hex32(at(1)) & hex32(at(2)) & ~at(3).isin("", ".", "..") & (p == F.trim(p)) & (at(1) == owner)
    return F.when(ok, p)


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 40)


def resolve_langs(requested: Column, available: list[str]) -> Column:
    """struct(langs, missing, error): the wanted languages (``a+b``) that are there, in order."""
    want = F.filter(F.transform(F.split(F.coalesce(requested, F.lit("")), r"\+"), lambda x: F.trim(x)), lambda x: x != "")
    have = F.filter(want, lambda x: x.isin(available))
    missing = F.filter(want, lambda x: ~x.isin(available))
    return F.struct(F.array_join(have, "+").alias("langs"), F.array_join(missing, ",").alias("missing"), ((F.size(want) > 0) & (F.size(have) == 0)).alias("error"))


def ocr_queue(pages: Column, signed: Column, has_text: Column, policy: str = "block", max_pages: int = 800) -> Column:
    """What to do with a document: too_long, blocked or ask (signed), skip (has text), run."""
    held = {"block": "blocked", "ask": "ask", "invalidate": None}[policy]
    first = F.when(pages > max_pages, "too_long")
    return (first.when(signed, held) if held else first).when(has_text, "skip").otherwise("run")


def hex_color(color: Column) -> Column:
    """struct(r, g, b) of 0..1 from 3 or 6 hex digits; anything else is black."""
    h = F.regexp_replace(F.coalesce(color, F.lit("")), "^#+", "")
    h = F.when(F.length(h) == 3, F.concat(*[F.repeat(F.substring(h, i, 1), F.lit(2)) for i in (1, 2, 3)])).otherwise(h)
    ok = h.rlike("^[0-9A-Fa-f]{6}")
    part = lambda i: F.when(ok, F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255.0).otherwise(0.0)
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
