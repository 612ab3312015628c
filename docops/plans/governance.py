"""Governance queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import governance as g
from ..operators import governance as op
from ..operators.reuse import ReuseStore
from ..sources import readers
from ..sources.checkpoints import shared_folder
from .fixtures import NOW, query

I, O = "file_inventory", "doc_objects"
LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
EXT = "CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '\\.([^.]*)$', 1)) ELSE '' END"
MIME_EXT = "CASE mime WHEN 'application/pdf' THEN 'pdf' WHEN 'text/plain' THEN 'txt' END"
# every type that names an extension, and one that names none
TYPES = [
    ("application/pdf; charset=binary", "pdf"), ("image/jpeg", "jpg"), ("image/jpg", "jpg"), ("IMAGE/PNG", "png"), ("image/bmp", "bmp"), ("image/x-ms-bmp", "bmp"), ("image/tiff", "tiff"), ("image/x-tiff", "tiff"),
    ("text/plain", "txt"), ("text/html", "html"), ("application/xhtml+xml", "html"), ("text/csv", "csv"), ("application/csv", "csv"), ("application/msword", "doc"), ("application/vnd.ms-excel", "xls"),
    ("application/vnd.ms-powerpoint", "ppt"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"),
    ("application/vnd.ms-excel.sheet.macroenabled.12", "xlsm"), ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx"), ("application/vnd.oasis.opendocument.text", "odt"),
    ("application/vnd.oasis.opendocument.spreadsheet", "ods"), ("application/vnd.oasis.opendocument.presentation", "odp"), ("application/x-unknown", None),
]
ALLOWED = [
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/rtf", "text/plain", "text/html",
    "application/vnd.oasis.opendocument.text", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel.sheet.macroenabled.12", "application/vnd.oasis.opendocument.spreadsheet", "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.oasis.opendocument.presentation", "image/jpeg", "image/png", "image/bmp", "image/tiff", "application/zip",
]
TYPED = f"m(k, mime, ext) AS (VALUES {', '.join(f'({k}, {chr(39)}{m}{chr(39)}, ' + (f'{chr(39)}{e}{chr(39)}' if e else 'NULL') + ')' for k, (m, e) in enumerate(TYPES))}), f AS (SELECT file_id, m.mime, ext FROM file_inventory JOIN m ON file_id % {len(TYPES)} = k)"
RESOLVED = f"CASE WHEN {EXT} IN ('pdf', 'docx', 'xlsx') THEN {EXT} ELSE {MIME_EXT} END"


@query("SELECT conv_id, turn, substr(CASE WHEN regexp_replace(regexp_extract(text, '[^/]*$'), '[^A-Za-z0-9_.-]', '_', 'g') IN ('', '.', '..') THEN 'file' ELSE regexp_replace(regexp_extract(text, '[^/]*$'), '[^A-Za-z0-9_.-]', '_', 'g') END, 1, 128) AS name FROM conversations")
def p44_safe_name(load):
    return load("conversations").select("conv_id", "turn", g.safe_name(F.col("text")).alias("name"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS strict_type, CASE WHEN doc_id % 5 IN (0, 1) THEN 'application/pdf' WHEN doc_id % 5 = 2 THEN 'image/png' WHEN doc_id % 5 = 3 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS tolerant_type FROM documents")
def p45_sniff_type(load):
    k, b = F.col("doc_id") % 5, F.encode(F.col("text"), "utf-8")
    raw = F.when(k == 0, F.concat(F.to_binary(F.lit("255044462D"), F.lit("hex")), b)).when(k == 1, F.concat(F.to_binary(F.lit("0A0A255044462D"), F.lit("hex")), b)).when(k == 2, F.concat(F.to_binary(F.lit("89504E470D0A1A0A"), F.lit("hex")), b)).when(k == 3, F.concat(F.to_binary(F.lit("FFD8FFE0"), F.lit("hex")), b)).otherwise(b)
    return load("documents").select("doc_id", g.sniff_type(raw).alias("strict_type"), g.sniff_type(raw, tolerant=True).alias("tolerant_type"))


@query(f"SELECT file_id, {RESOLVED} AS ext FROM file_inventory", I)
def p46_resolve_ext(load):
    return load(I).select("file_id", g.resolve_ext(F.col("path"), F.col("mime")).alias("ext"))


def unnamed(load):
    """The files without a name that has a suffix, each of one type."""
    mime = F.element_at(F.array(*[F.lit(m) for m, _ in TYPES]), (F.col("file_id") % len(TYPES) + 1).cast("int"))
    return load(I).select("file_id", F.lit("upload").alias("path"), mime.alias("mime"))


@query(f"{TYPED} SELECT file_id, ext FROM f", I)
def p46_resolve_ext_by_type(load):
    return unnamed(load).select("file_id", g.resolve_ext(F.col("path"), F.col("mime")).alias("ext"))


@query(f"{TYPED} SELECT file_id, CASE WHEN lower(mime) NOT IN {LIST(ALLOWED)} THEN 'type_not_allowed' WHEN ext IS NULL THEN 'extension_not_supported' END AS reason FROM f", I)
def p47_admit_by_type(load):
    return unnamed(load).select("file_id", g.admit(F.col("path"), F.col("mime")).alias("reason"))


OFFICE = ["docx", "xlsx", "xlsm", "pptx", "dotx", "xltx", "ppsx", "potx"]
REASON = f"CASE WHEN mime = 'application/x-dosexec' THEN 'type_not_allowed' WHEN mime = 'application/zip' AND {EXT} NOT IN {LIST(OFFICE)} THEN 'zip_not_office' WHEN {RESOLVED} IS NULL THEN 'extension_not_supported' END"


@query(f"SELECT file_id, {REASON} AS reason FROM file_inventory", I)
def p47_admit(load):
    return load(I).select("file_id", g.admit(F.col("path"), F.col("mime")).alias("reason"))


TARGET = "CASE file_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN ' Word' WHEN 2 THEN 'EXCEL' WHEN 3 THEN 'csv' WHEN 4 THEN 'xlsm' WHEN 5 THEN 'docx' ELSE 'gif' END"
WANT = "CASE file_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'csv' WHEN 4 THEN 'xlsm' WHEN 5 THEN 'docx' END"
ENGINE = "CASE WHEN t = 'pdf' AND e = 'pdf' THEN 'copy' WHEN t = 'pdf' AND e IN ('docx', 'xlsx') THEN 'office' WHEN t = 'docx' AND e = 'pdf' THEN 'pdf_to_docx' WHEN t = 'docx' THEN 'office' WHEN t = 'csv' AND e = 'pdf' THEN 'pdf_to_csv' WHEN t IN ('xlsx', 'xlsm') AND e = 'pdf' THEN 'pdf_to_xlsx' WHEN t IN ('csv', 'xlsx', 'xlsm') AND e = 'xlsx' THEN 'office' END"


@query(f"x AS (SELECT file_id, {WANT} AS t, {EXT} AS e FROM file_inventory) SELECT file_id, t AS target, {ENGINE} AS engine, CASE WHEN t IS NULL THEN 'unknown_target' WHEN {ENGINE} IS NULL THEN 'unsupported_source' END AS reason FROM x", I)
def p48_route_conversion(load):
    k = F.col("file_id") % 7
    target = F.when(k == 0, "pdf").when(k == 1, " Word").when(k == 2, "EXCEL").when(k == 3, "csv").when(k == 4, "xlsm").when(k == 5, "docx").otherwise("gif")
    return load(I).select("file_id", g.route_conversion(g.extension(F.col("path")), target).alias("r")).select("file_id", "r.*")


@query("x AS (SELECT event_id, md5(CAST(user_id AS STRING)) AS u, md5(CAST(event_id AS STRING)) AS j FROM events) SELECT event_id, CASE WHEN event_id % 6 <= 1 THEN concat('generated/', u, '/', j, '/out 1.pdf') END AS path FROM x".replace("x AS", "WITH x AS", 1))
def p49_owned_path(load):
    h = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    k, u, j = F.col("event_id") % 6, h("user_id"), h("event_id")
    path = F.when(k == 0, F.concat(F.lit("generated/"), u, F.lit("/"), j, F.lit("/out 1.pdf"))).when(k == 1, F.concat(F.lit("generated%2F"), u, F.lit("/"), j, F.lit("/out%201.pdf"))).when(k == 2, F.concat(F.lit("generated/"), j, F.lit("/"), j, F.lit("/a.pdf"))).when(k == 3, F.concat(F.lit("generated/"), u, F.lit("/../a.pdf"))).when(k == 4, F.concat(F.lit("/generated/"), u, F.lit("/"), j, F.lit("/a.pdf"))).otherwise("")
    return load("events").select("event_id", g.owned_path(path, u).alias("path"))


@query("SELECT doc_id, substr(sha256(text), 1, 40) AS content_id FROM documents")
def p50_content_id(load):
    return load("documents").select("doc_id", g.content_id(F.encode(F.col("text"), "utf-8")).alias("content_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' WHEN lang IN ('en', 'de') THEN concat(lang, '+en') ELSE 'en' END AS langs, CASE WHEN doc_id % 4 = 3 THEN CASE WHEN lang IN ('xx') THEN '' ELSE 'xx' END WHEN lang IN ('en', 'de') THEN '' ELSE lang END AS missing, doc_id % 4 = 3 AS error FROM documents")
def p53_resolve_langs(load):
    want = F.when(F.col("doc_id") % 4 == 3, " xx ").otherwise(F.concat("lang", F.lit("+ en")))
    return load("documents").select("doc_id", g.resolve_langs(want, ["en", "de"]).alias("r")).select("doc_id", "r.*")


@query("x AS (SELECT doc_id, count(*) AS n, bool_or(bytes % 50 = 0) AS signed, doc_id % 3 = 0 AS text FROM page_geometry GROUP BY doc_id) SELECT doc_id, CASE WHEN n > 6 THEN 'too_long' WHEN signed THEN 'ask' WHEN text THEN 'skip' ELSE 'run' END AS action FROM x", "page_geometry")
def p54_ocr_queue(load):
    x = load("page_geometry").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("bytes") % 50 == 0).alias("signed"))
    return x.select("doc_id", g.ocr_queue(F.col("n"), F.col("signed"), F.col("doc_id") % 3 == 0, "ask", 6).alias("action"))


@query("SELECT file_id, mime, mime IN ('application/pdf', 'text/plain') AS kept FROM file_inventory", I)
def j7_allow_list_split(load):
    files = load(I).select("file_id", "mime")
    kept, rejected = op.allow_list_split(files, files.sparkSession.createDataFrame([("application/pdf",), ("text/plain",)], "mime string"), "mime")
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))


GONE = "(scope = 'catalog' AND key IN ('/OpenAction', '/AA', '/JavaScript', '/EmbeddedFiles'))"


@query(f"SELECT 'strict' AS profile, doc_id, object_id, key, value FROM doc_objects WHERE false UNION ALL SELECT 'preserving', doc_id, object_id, key, value FROM doc_objects WHERE NOT ({GONE} OR (scope = 'annotation' AND key = '/A' AND value IN ('/JavaScript', '/Launch', '/URI')))", O)
def u4_sanitize_objects(load):
    # strict leaves nothing of what these stand-ins hold: every form, annotation and active catalog key goes
    out = [op.sanitize_objects(load(O), p).select(F.lit(p).alias("profile"), "doc_id", "object_id", "key", "value") for p in ("strict", "preserving")]
    return out[0].unionByName(out[1])


RUNS = "w AS (SELECT *, sum(CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY object_id) AS run FROM doc_objects)"
CHAIN = f"{RUNS}, ch AS (SELECT a.doc_id, a.object_id, b.object_id AS ancestor, a.object_id - b.object_id AS depth FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.run = b.run AND b.object_id < a.object_id AND a.object_id - b.object_id <= 20)"


@query(f"{CHAIN} SELECT doc_id, object_id, ancestor, CAST(depth AS INT) AS depth FROM ch", O)
def j11_field_chain(load):
    return op.field_chain(load(O))


@query(f"{CHAIN}, own AS (SELECT doc_id, object_id FROM doc_objects WHERE page_number = 1 AND scope <> 'catalog'), k AS (SELECT * FROM own UNION SELECT ch.doc_id, ancestor FROM ch JOIN own USING (doc_id, object_id)) SELECT d.doc_id, d.object_id, d.key FROM doc_objects d JOIN k USING (doc_id, object_id) WHERE scope <> 'catalog' UNION ALL SELECT doc_id, object_id, key FROM doc_objects WHERE key = '/SigFlags'", O)
def u5_scope_form(load):
    exported = load(O).select("doc_id", F.lit(1).alias("page_number")).distinct()
    return op.scope_form(load(O), exported).select("doc_id", "object_id", "key")


@query("""x AS (SELECT doc_id, bool_or(scope = 'field') AS has_acroform, bool_or(key = '/V' AND value <> '') AS has_filled_fields, bool_or(key = '/Widget') AS has_widgets, bool_or(key = '/FT' AND value = '/Sig') AS has_signature_fields, bool_or(scope = 'annotation') AS has_annotations, bool_or(key = '/SigFlags') AS has_sigflags,
        bool_or(key = '/AP') AS has_annotation_appearances, bool_or(key = '/NeedAppearances' AND value = 'true') AS has_need_appearances FROM (SELECT * FROM doc_objects
        UNION ALL SELECT doc_id, object_id, parent_id, page_number, 'object', CASE WHEN doc_id % 3 = 0 THEN '/AP' ELSE '/NeedAppearances' END, CASE WHEN doc_id % 4 = 1 THEN 'true' ELSE 'false' END FROM doc_objects WHERE object_id = 1) o GROUP BY doc_id)
    SELECT *, has_acroform OR has_widgets OR has_signature_fields OR has_annotations OR has_sigflags OR has_annotation_appearances OR has_need_appearances AS requires_preservation FROM x""", O)
def a18_preservation_flags(load):
    objects, doc = load(O), F.col("doc_id")
    # the test tables have no appearances: one more object a document
    more = objects.where("object_id = 1").withColumn("scope", F.lit("object")).withColumn("key", F.when(doc % 3 == 0, "/AP").otherwise("/NeedAppearances"))
    return op.preservation_flags(objects.unionByName(more.withColumn("value", F.when(doc % 4 == 1, "true").otherwise("false"))))


@query("SELECT d.doc_id, bool_or((d.key = '/SigFlags' AND TRY_CAST(d.value AS INT) % 2 = 1) OR (d.key = '/FT' AND d.value = '/Sig') OR coalesce(d.key = '/Widget' AND p.key = '/FT' AND p.value = '/Sig', false)) AS signed FROM (SELECT doc_id, parent_id, key, CASE WHEN key = '/SigFlags' THEN value ELSE CASE WHEN key = '/FT' THEN value ELSE '' END END AS value FROM doc_objects) d LEFT JOIN doc_objects p ON d.doc_id = p.doc_id AND d.parent_id = p.object_id GROUP BY d.doc_id", O)
def a19_has_signature(load):
    return op.has_signature(load(O))


@query("SELECT doc_id, doc_id % 3 = 0 AS signed FROM documents")
def a19b_signature_markers(load):
    text = F.coalesce("text", F.lit(""))
    body = F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit(" /ByteRange [0 1]"))).otherwise(text), "utf-8")
    return op.signature_markers(load("documents").select("doc_id", body.alias("content")))


@query("""x AS (SELECT job_id, file_id AS pos, file_id % 4 = 0 AS signed, file_id % 3 = 0 AS preserved, file_id % 2 = 0 AS resize, job_id % 2 = 0 AS flatten FROM job_files),
    w AS (SELECT job_id, pos, 1 AS k, 'preserved' AS m FROM x WHERE preserved UNION ALL SELECT job_id, pos, 2, 'resize_ignored' FROM x WHERE preserved AND resize UNION ALL SELECT job_id, pos, 3, 'signature' FROM x WHERE signed UNION ALL SELECT job_id, pos, 4, 'flatten_disabled' FROM x WHERE signed AND flatten),
    f AS (SELECT job_id, m, min(pos * 10 + k) AS first FROM w GROUP BY ALL), s AS (SELECT job_id, string_agg(m, '; ' ORDER BY first) AS warnings FROM f GROUP BY job_id), j AS (SELECT job_id, bool_or(flatten) AND NOT bool_or(signed) AS flatten FROM x GROUP BY job_id)
    SELECT job_id, coalesce(warnings, '') AS warnings, flatten FROM j LEFT JOIN s USING (job_id)""", "job_files")
def a20_job_warnings(load):
    n = F.col("file_id")
    return op.job_warnings(load("job_files").select("job_id", n.alias("pos"), (n % 4 == 0).alias("signed"), (n % 3 == 0).alias("preserved"), (n % 2 == 0).alias("resize"), (F.col("job_id") % 2 == 0).alias("flatten")))


@query("SELECT conv_id AS doc_id, bool_or(turn % 3 = 1) AS has_text FROM conversations GROUP BY conv_id")
def a21_has_text(load):
    k = F.col("turn") % 3
    pages = load("conversations").select(F.col("conv_id").alias("doc_id"), F.when(k == 2, None).otherwise(0).alias("n_chars"), F.when(k == 1, F.col("text")).when(k == 0, " ").alias("text"))
    return op.has_text(pages)


@query("""WITH r AS (SELECT doc_id AS request_id, substr(sha256(text), 1, 40) AS content_id, CAST(doc_id % 2 AS INT) AS setting, length(text) AS n FROM documents), c AS (SELECT DISTINCT content_id, setting FROM r WHERE request_id % 10 = 0)
    SELECT request_id, r.content_id, r.setting, CASE WHEN c.content_id IS NULL THEN n ELSE -1 END AS result, c.content_id IS NOT NULL AS hit FROM r LEFT JOIN c USING (content_id, setting)""")
def c1_reuse_by_content(load):
    requests = load("documents").select(F.col("doc_id").alias("request_id"), g.content_id(F.encode(F.col("text"), "utf-8")).alias("content_id"), (F.col("doc_id") % 2).cast("int").alias("setting"), F.col("text").alias("payload"))
    cache = requests.where("request_id % 10 = 0").select("content_id", "setting").distinct().withColumn("result", F.lit(-1).cast("long"))
    return op.reuse_by_content(requests, cache, lambda df: df.withColumn("result", F.length("payload").cast("long")))


@query("""WITH r AS (SELECT doc_id AS request_id, substr(sha256(text), 1, 40) AS content_id, length(text) AS n, doc_id % 2 = 0 AS even FROM documents), c AS (SELECT DISTINCT content_id FROM r WHERE even)
    SELECT request_id, r.content_id, CAST(0 AS INT) AS setting, n AS result, c.content_id IS NOT NULL AS hit FROM r LEFT JOIN c USING (content_id)""")
def c1_reuse_store(load):
    """Every document asked for in one of two settings, then every one in the first."""
    docs = load("documents").select(F.col("doc_id").alias("request_id"), g.content_id(F.encode(F.col("text"), "utf-8")).alias("content_id"), F.col("text").alias("payload"))
    store = ReuseStore(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/reuse-{uuid.uuid4().hex}", 16)
    compute = lambda df: df.withColumn("result", F.length("payload").cast("long"))
    store.reuse(docs.withColumn("setting", (F.col("request_id") % 2).cast("int")), compute)
    return store.reuse(docs.withColumn("setting", F.lit(0)), compute)


@query("SELECT session_id FROM sessions WHERE file_id IN (SELECT file_id FROM file_inventory)", "sessions file_inventory")
def j13_live_sessions(load):
    return op.live_sessions(load("sessions"), load(I)).select("session_id")


@query(f"SELECT session_id, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) AS BIGINT) AS age, epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) > 3600 AS expired FROM sessions", "sessions")
def st6_expire_sessions(load):
    return op.expire_sessions(load("sessions"), NOW).select("session_id", "age", "expired")


@query("SELECT file_id, path FROM file_inventory WHERE modification_time < TIMESTAMP '1997-01-02 00:00:00' - INTERVAL 24 HOUR", I)
def st7_stale_files(load):
    return op.stale_files(load(I), "1997-01-02 00:00:00").select("file_id", "path")


@query("SELECT file_id, path, length, strftime(modification_time, '%Y-%m-%d') AS day FROM file_inventory", I)
def s5_inventory(load):
    return load(I).select("file_id", "path", "length", F.date_format(F.col("modification_time").cast("timestamp"), "yyyy-MM-dd").alias("day"))


@query("SELECT concat('client-', CAST(o_custkey % 16 AS STRING)) AS name, CAST(sum(length(CAST(o_orderkey AS STRING)) + 1) AS BIGINT) AS length FROM orders GROUP BY o_custkey % 16")
def s5_read_inventory(load):
    """The orders' keys as one text file a client, and a folder below that is not listed."""
    orders = load("orders")
    folder = f"{shared_folder(orders.sparkSession)}/inventory-{uuid.uuid4().hex}"
    named = orders.select(F.col("o_orderkey").cast("string").alias("value"), F.concat(F.lit("client-"), F.col("o_custkey") % 16).alias("name"))
    named.repartition("name").write.partitionBy("name").text(f"{folder}/parts")
    parts = sorted(r.name for r in named.select("name").distinct().collect())  # a name a file, not a row
    listed = [readers.read_inventory(orders.sparkSession, f"{folder}/parts/name={part}").withColumn("name", F.lit(part)) for part in parts]
    none = orders.sparkSession.createDataFrame([], "path string, length long, modificationTime timestamp, name string")
    return reduce(lambda a, b: a.unionByName(b), listed, none).groupBy("name").agg(F.sum("length").alias("length"))


@query("SELECT concat('client-', CAST(o_custkey % 16 AS STRING)) AS name, CAST(sum(length(CAST(o_orderkey AS STRING)) + 1) AS BIGINT) AS length, sha256(string_agg(concat(CAST(o_orderkey AS STRING), chr(10)), '' ORDER BY o_orderkey)) AS content_sha256, sha256(substr(string_agg(concat(CAST(o_orderkey AS STRING), chr(10)), '' ORDER BY o_orderkey), 1, 8192)) AS header_sha256 FROM orders GROUP BY o_custkey % 16")
def s6_read_written_documents(load):
    """The orders' keys as one file a client, read back whole."""
    orders = load("orders")
    folder = f"{shared_folder(orders.sparkSession)}/documents-{uuid.uuid4().hex}"
    named = orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("value"), F.concat(F.lit("client-"), F.col("o_custkey") % 16).alias("name"))
    named.repartition("name").sortWithinPartitions("name", "o_orderkey").select("value", "name").write.partitionBy("name").text(folder)
    sha = lambda c: F.sha2(c, 256)
    return readers.read_documents(orders.sparkSession, f"{folder}/*").select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "length", sha(F.col("content")).alias("content_sha256"), sha(F.col("header")).alias("header_sha256"))


@query("""o AS (SELECT doc_id, page_number AS pos, CASE page_number % 3 WHEN 0 THEN 'text' ELSE 'redact' END AS type, (page_number - 1) % 4 AS page_index, bytes % 50 AS x, bytes % 40 AS y FROM page_geometry),
    p AS (SELECT o.doc_id, g.page_number, pos, type, o.x, o.y, g.width / 100.0::DOUBLE AS sx, g.height / 100.0::DOUBLE AS sy FROM o JOIN page_geometry g ON o.doc_id = g.doc_id AND o.page_index + 1 = g.page_number),
    q AS (SELECT *, unnest(CASE WHEN type = 'text' THEN [0, 1] ELSE [0] END) AS line_no FROM p)
    SELECT doc_id, page_number, pos, type, CAST(line_no AS INT) AS line_no, CASE WHEN type = 'text' THEN CASE line_no WHEN 0 THEN 'a' ELSE 'b' END ELSE '' END AS line, round(x * sx, 6) AS x0, round(y * sy + CASE WHEN type = 'text' THEN line_no * 96 * 1.25::DOUBLE ELSE 0 END, 6) AS y0, round((x + 10) * sx, 6) AS x1 FROM q""", "page_geometry")
def p29_overlay_rows(load):
    b = load("page_geometry")
    ops = b.select("doc_id", F.col("page_number").alias("pos"), F.when(F.col("page_number") % 3 == 0, " TEXT").otherwise("redact").alias("type"), ((F.col("page_number") - 1) % 4).alias("page_index"), (F.col("bytes") % 50).cast("double").alias("x"), (F.col("bytes") % 40).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(5.0).alias("h"), F.lit(500.0).alias("size"), F.lit("#fff").alias("color"), F.lit("a\nb").alias("text"), F.lit(100.0).alias("view_w"), F.lit(100.0).alias("view_h"))
    out = op.overlay_rows(ops, b)
    return out.select("doc_id", "page_number", "pos", "type", "line_no", "line", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1")])


@query("SELECT doc_id, lang IN ('en', 'fr') AS both, CASE WHEN lang IN ('en', 'fr') THEN '' ELSE lang END AS lacking FROM documents")
def u6_lang_sets(load):
    r = g.resolve_langs(F.col("lang"), ["en", "fr"])
    return load("documents").select("doc_id", r.alias("r")).select("doc_id", (F.col("r.langs") != "").alias("both"), F.col("r.missing").alias("lacking"))
