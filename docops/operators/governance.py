"""Document governance: active content, preservation, fields, reuse, retention, overlays.

Object tables are long: doc_id, object_id, parent_id, page_number, scope (catalog, annotation, field), key, value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import governance as g
from ..sources.checkpoints import stored

#: What each profile removes, as (profile, scope, key, pattern of the value).
DANGER = [
    *[(p, "catalog", k, ".*") for p in ("strict", "preserving", "edit") for k in ("/OpenAction", "/AA", "/JavaScript", "/JS", "/EmbeddedFiles", "/XFA")],
    ("strict", "field", "%", ".*"), ("strict", "annotation", "%", ".*"), ("strict", "catalog", "/SigFlags", ".*"), ("strict", "catalog", "/NeedAppearances", ".*"), ("edit", "catalog", "/NeedAppearances", ".*"),
    *[(p, "annotation", k, "JavaScript|Launch|URI") for p in ("preserving", "edit") for k in ("/A", "/AA")],
]


def allow_list_split(df: DataFrame, allowed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by a list of values."""
    return df.join(allowed, key, "left_semi"), df.join(allowed, key, "left_anti")


def sanitize_objects(objects: DataFrame, profile: str) -> DataFrame:
    """Objects without what the profile's rules name."""
    rules = [r for r in DANGER if r[0] == profile]
    if not rules:
        raise ValueError("profile must be strict, preserving or edit")
    value, out = F.coalesce("value", F.lit("")), F.lit(False)
    for _, scope, key, pattern in rules:
        hit = F.col("scope") == scope
        if key != "%":
            hit = hit & (F.col("key") == key)
        if pattern != ".*":
            hit = hit & value.rlike(pattern)
        out = out | hit
    return objects.where(~out)


def ancestor_lists(objects: DataFrame, max_depth: int = 20) -> DataFrame:
    """(doc_id, object_id, ancestors): each object's ancestors, nearest first; a cycle is cut where it comes back.

    Lists double: one that is as long as it can be takes on the list of its last member, so a chain of 20 is there
    after five joins.  Objects whose list ended are joined no more, and rounds end when all have.
    """
    edges = objects.where("parent_id IS NOT NULL AND parent_id <> object_id").select("doc_id", "object_id", F.array("parent_id").alias("ancestors")).distinct()
    (lists, longest), length = _with_longest(edges), 1
    while length < max_depth and longest == length:
        last = F.when(F.size("ancestors") == length, F.element_at("ancestors", -1))
        more = lists.select("doc_id", F.col("object_id").alias("last"), F.col("ancestors").alias("more"))
        both = F.array_remove(F.array_distinct(F.concat("ancestors", F.coalesce("more", F.slice("ancestors", 1, 0)))), F.col("object_id"))
        grown = lists.withColumn("last", last).join(more, ["doc_id", "last"], "left")
        lists, longest = _with_longest(grown.select("doc_id", "object_id", F.slice(both, 1, max_depth).alias("ancestors")))
        length *= 2
    return lists


def _with_longest(lists: DataFrame) -> tuple[DataFrame, int | None]:
    """The lists stored, and the length of the longest, which is observed as they are written."""
    seen = Observation()
    return stored(lists.observe(seen, F.max(F.size("ancestors")).alias("longest")), "chains"), seen.get["longest"]


def field_chain(objects: DataFrame, max_depth: int = 20) -> DataFrame:
    """(doc_id, object_id, ancestor, depth): each object with its ancestors; a cycle is cut where it comes back."""
    lists = ancestor_lists(objects, max_depth)
    return lists.select("doc_id", "object_id", F.posexplode("ancestors").alias("place", "ancestor")).select("doc_id", "object_id", "ancestor", (F.col("place") + 1).alias("depth"))


def preservation_flags(objects: DataFrame) -> DataFrame:
    """Per document: what has to be preserved; filled fields alone do not ask for it."""
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    key, scope, value = F.col("key"), F.col("scope"), F.col("value")
    flags = objects.groupBy("doc_id").agg(
        has(scope == "field").alias("has_acroform"), has((key == "/V") & (value != "")).alias("has_filled_fields"), has(key == "/Widget").alias("has_widgets"),
        has((key == "/FT") & (value == "/Sig")).alias("has_signature_fields"), has(scope == "annotation").alias("has_annotations"), has(key == "/AP").alias("has_annotation_appearances"),
        has((key == "/NeedAppearances") & (value == "true")).alias("has_need_appearances"), has(key == "/SigFlags").alias("has_sigflags"),
    )
    needs = [c for c in flags.columns if c not in ("doc_id", "has_filled_fields")]
    out = F.lit(False)
    for c in needs:
        out = out | F.col(c)
    return flags.withColumn("requires_preservation", out)


def has_signature(objects: DataFrame) -> DataFrame:
    """Per document: a signature flag with its first bit set, or a signature field, its own or its parent's."""
    parents = objects.select("doc_id", F.col("object_id").alias("parent_id"), F.col("key").alias("pk"), F.col("value").alias("pv"))
    both = objects.join(parents, ["doc_id", "parent_id"], "left")
    flag = (F.col("key") == "/SigFlags") & (F.coalesce(F.col("value").try_cast("int"), F.lit(0)).bitwiseAND(1) == 1)
    sig = lambda k, v: F.coalesce((F.col(k) == "/FT") & (F.col(v) == "/Sig"), F.lit(False))
    return both.groupBy("doc_id").agg(F.bool_or(flag | sig("key", "value") | ((F.col("key") == "/Widget") & sig("pk", "pv"))).alias("signed"))


def signature_markers(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The other rule: signature marks in a file's first 256 KB."""
    head = F.hex(F.substring("content", 1, 262144))
    marks = F.lit(False)
    for m in ("/ByteRange", "/Sig ", "/Type/Sig", "adbe.pkcs7"):
        marks = marks | (F.instr(head, m.encode().hex().upper()) > 0)
    return documents.select(key, marks.alias("signed"))


def job_warnings(jobs: DataFrame) -> DataFrame:
    """(job_id, warnings, flatten) of inputs (job_id, pos, signed, preserved, resize, flatten): each once, in order."""
    listed = F.array_compact(F.array(F.when(F.col("preserved"), "preserved"), F.when(F.col("preserved") & F.col("resize"), "resize_ignored"), F.when(F.col("signed"), "signature"), F.when(F.col("signed") & F.col("flatten"), "flatten_disabled")))
    rows = jobs.groupBy("job_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", listed.alias("l")))), lambda x: x["l"])).alias("l"), (F.bool_or("flatten") & ~F.bool_or("signed")).alias("flatten"))
    return rows.select("job_id", F.array_join(F.array_distinct("l"), "; ").alias("warnings"), "flatten")


def has_text(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.bool_or((F.coalesce("n_chars", F.lit(0)) > 0) | (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("has_text"))


def scope_form(objects: DataFrame, exported: DataFrame) -> DataFrame:
    """Fields and annotations of exported pages with the fields above them; safe catalog keys stay."""
    own = objects.join(exported, ["doc_id", "page_number"], "left_semi").where("scope <> 'catalog'").select("doc_id", "object_id")
    above = field_chain(objects).join(own, ["doc_id", "object_id"], "left_semi").select("doc_id", F.col("ancestor").alias("object_id"))
    kept = objects.where("scope <> 'catalog'").join(own.union(above).distinct(), ["doc_id", "object_id"], "left_semi")
    return kept.unionByName(objects.where(F.col("key").isin("/DR", "/DA", "/Q", "/NeedAppearances", "/SigFlags")))


def reuse_by_content(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests (request_id, content_id, setting, payload) with a result; each missing key is computed once.

    cache and compute's result have content_id, setting, result.  hit: the key was in the cache.
    """
    keys = ["content_id", "setting"]
    missing = requests.join(cache, keys, "left_anti").dropDuplicates(keys)
    known = cache.select(*keys, "result", F.lit(True).alias("hit")).unionByName(compute(missing).select(*keys, "result", F.lit(False).alias("hit")))
    return requests.join(known, keys).select("request_id", *keys, "result", "hit")


def live_sessions(sessions: DataFrame, inventory: DataFrame) -> DataFrame:
    return sessions.join(inventory.select("file_id").distinct(), "file_id", "left_semi")


def expire_sessions(sessions: DataFrame, now: str, ttl: int = 3600) -> DataFrame:
    """Sessions with their age in seconds and whether it is over ttl."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return sessions.withColumn("age", age).withColumn("expired", F.col("age") > ttl)


def stale_files(inventory: DataFrame, now: str, max_age_hours: int = 24) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {max_age_hours} HOURS")
    return inventory.where(F.col("modification_time").cast("timestamp") < cutoff)


def overlay_rows(ops: DataFrame, pages: DataFrame, max_ops: int = 200, max_text: int = 5000) -> DataFrame:
    """One row a box or text line, in page units.

    ops: doc_id, pos, type, page_index, x, y, w, h, size, color, text, view_w, view_h; those of unknown pages, with empty
    text or beyond max_ops drop out.  Lines of a text stand 1.25 sizes apart.
    """
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    used = ops.withColumn("_n", n).where(F.col("_n") <= max_ops).withColumn("type", F.lower(F.trim("type"))).withColumn("page_number", F.col("page_index") + 1)
    sx, sy = F.col("width") / F.col("view_w"), F.col("height") / F.col("view_h")
    both = used.join(pages.select("doc_id", "page_number", "width", "height"), ["doc_id", "page_number"]).where((F.col("view_w") > 1) & (F.col("view_h") > 1))
    text = F.substring(F.coalesce("text", F.lit("")), 1, max_text)
    is_text = F.col("type") == "text"
    size = F.least(F.greatest(F.coalesce("size", F.lit(14.0)), F.lit(6.0)), F.lit(96.0))
    lines = F.when(is_text, F.split(F.regexp_replace(text, r"\R$", ""), r"\R")).otherwise(F.array(F.lit("")))
    rows = both.where(~is_text | (F.trim(text) != "")).select("doc_id", "page_number", "pos", "type", sx.alias("sx"), sy.alias("sy"), "x", "y", "w", "h", size.alias("size"), g.hex_color(F.col("color")).alias("rgb"), F.posexplode(lines).alias("line_no", "line"))
    return rows.select("doc_id", "page_number", "pos", "type", "line_no", "line", "rgb", "size", (F.col("x") * F.col("sx")).alias("x0"), (F.col("y") * F.col("sy") + F.when(F.col("type") == "text", F.col("line_no") * F.col("size") * 1.25).otherwise(0.0)).alias("y0"), ((F.col("x") + F.col("w")) * F.col("sx")).alias("x1"), ((F.col("y") + F.col("h")) * F.col("sy")).alias("y1"))
