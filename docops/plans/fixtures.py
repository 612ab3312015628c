"""Stand-in relations, derived from the test tables by SQL that Spark and DuckDB both run.

Table names stand in braces: Spark gets DataFrames for them, DuckDB the names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.parts import dealt

NOW = "2024-01-30 12:34:56"
_PAGE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)"

FIXTURES = {
    "request_events": """SELECT event_id, user_id, ts,
        CASE WHEN event_id % 5 = 4 THEN 'job' ELSE 'request' END AS kind,
        CASE event_id % 8 WHEN 0 THEN '/api/merge' WHEN 1 THEN '/api/split' WHEN 2 THEN '/api/compress/analyze' WHEN 3 THEN '/api/convert/to-pdf'
            WHEN 4 THEN '/api/edit/upload' WHEN 5 THEN '/api/organize' WHEN 6 THEN '/viewer/raw' ELSE ' /API/Merge' END AS path,
        CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN '500' ELSE '404' END
            WHEN event_type = 'signup' THEN '302' WHEN event_id % 97 = 0 THEN 'n/a' ELSE '200' END AS status,
        CASE WHEN event_type = 'error' THEN concat('failure for user ', CAST(user_id AS STRING)) END AS message,
        CASE WHEN event_id % 5 = 4 THEN CASE user_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN ' Split' ELSE '' END END AS tool,
        CASE WHEN event_id % 5 = 4 THEN event_type <> 'error' END AS ok FROM {events}""",
    "page_geometry": f"""SELECT l_orderkey AS doc_id, {_PAGE} AS page_number, 300 + 10 * (l_partkey % 60) AS width, 400 + 10 * (l_suppkey % 50) AS height,
        (l_linenumber % 4) * 90 AS rotate, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes FROM {{lineitem}}""",
    "page_settings": f"""SELECT l_orderkey AS doc_id, {_PAGE} AS page_number, l_linenumber <> 7 AS include, CAST(floor(l_quantity * 3) AS INT) AS quality,
        CAST(floor(l_extendedprice / 300) AS INT) AS dpi, l_linestatus = 'F' AS resize_to_a4, l_returnflag = 'R' AS keep_original FROM {{lineitem}}""",
    "merge_plan": f"""SELECT l_orderkey AS job_id, {_PAGE} - 1 AS pos, l_suppkey % 3 AS src, l_linenumber - 1 + (l_partkey % 2) AS page,
        CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 90 WHEN 3 THEN -90 ELSE 450 END AS rotation FROM {{lineitem}}""",
    "feedback": """SELECT conv_id * 100 + turn AS arrival, role AS page,
        CASE turn % 4 WHEN 0 THEN 'problema' WHEN 1 THEN ' Sugestao ' WHEN 2 THEN 'duvida' ELSE 'outro' END AS type,
        CASE conv_id % 9 WHEN 0 THEN 'oi' WHEN 1 THEN concat(text, text, text) WHEN 2 THEN '  ' ELSE text END AS message,
        concat('req-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS request_id FROM {conversations}""",
    "file_inventory": """SELECT o_orderkey AS file_id, concat('in/', CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX'
            WHEN 2 THEN '.xlsx' WHEN 3 THEN '.zip' WHEN 4 THEN '.exe' ELSE '' END) AS path,
        CASE o_custkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/octet-stream' ELSE 'application/x-dosexec' END AS mime,
        CAST(floor(o_totalprice) AS BIGINT) AS length, o_orderdate AS modification_time FROM {orders}""",
    "money_strings": f"""WITH c AS (SELECT l_orderkey AS doc_id, {_PAGE} AS pos, l_linenumber AS style, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM {{lineitem}}),
        s AS (SELECT c.*, CAST(floor(cents / 100) AS BIGINT) AS w, lpad(CAST(cents % 100 AS STRING), 2, '0') AS f FROM c),
        g AS (SELECT s.*, CASE WHEN w >= 1000 THEN concat(CAST(CAST(floor(w / 1000) AS BIGINT) AS STRING), '.', lpad(CAST(w % 1000 AS STRING), 3, '0')) ELSE CAST(w AS STRING) END AS dotted FROM s)
        SELECT doc_id, pos, style, cents, CASE style WHEN 1 THEN concat('R$ ', dotted, ',', f) WHEN 2 THEN concat(dotted, ',', f) WHEN 3 THEN concat(CAST(w AS STRING), '.', f)
            WHEN 4 THEN concat(f, '%') WHEN 5 THEN 'abc' WHEN 6 THEN '' ELSE concat('-', dotted, ',', f) END AS raw FROM g""",
    "fee_lines": f"""WITH c AS (SELECT l_orderkey AS doc_id, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, {_PAGE} AS pos FROM {{lineitem}}),
        m AS (SELECT c.*, concat('R$ ', CAST(pk % 900 AS STRING), ',', lpad(CAST(sk % 100 AS STRING), 2, '0')) AS a, concat(CAST(sk % 900 AS STRING), ',', lpad(CAST(pk % 100 AS STRING), 2, '0')) AS b FROM c),
        k AS (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8)
        SELECT doc_id, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 10 * pos WHEN 3 THEN 10 * pos + 1 WHEN 4 THEN 10 * pos + 2 WHEN 5 THEN 10 * pos + 3 WHEN 6 THEN 1000000 WHEN 7 THEN 1000001 ELSE 1000002 END AS INT) AS line_pos,
            CASE k WHEN 0 THEN 'OUTROS EXEMPLOS' WHEN 1 THEN 'Código Procedimento Valor Unimed Co-part 20% 30%'
            WHEN 2 THEN concat(CAST(ln AS STRING), '.', lpad(CAST(sk % 100 AS STRING), 2, '0'), '.', lpad(CAST(pk % 100000 AS STRING), 5, '0'), ' Proc ', CAST(pk AS STRING),
                CASE pk % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' ', a) WHEN 2 THEN concat(' ', b, ' ', b) ELSE concat(' ', a, ' ', a, ' ', a, ' ', a, ' ', a, ' ', a) END)
            WHEN 3 THEN CASE WHEN pk % 4 = 0 THEN concat(a, ' ', a) ELSE 'com contraste' END WHEN 4 THEN 'Código Procedimento Valor Unimed' WHEN 5 THEN concat(b, ' ', b) WHEN 6 THEN '* Obs: valores podem variar'
            WHEN 7 THEN concat('TOTAL DE COPARTICIPAÇÃO ', a, ' ', a)
            ELSE CASE doc_id % 9 WHEN 0 THEN 'Com exceção dos valores' WHEN 1 THEN 'com excecao  dos valores' WHEN 2 THEN 'Referem-se ao custo' WHEN 3 THEN 'pode haver variação' WHEN 4 THEN 'ANEXO IV'
                WHEN 5 THEN 'EXEMPLOS DE EXAMES' WHEN 6 THEN 'EXEMPLOS DE COPARTICIPAÇÃO' WHEN 7 THEN 'exemplos  de COPARTICIPACAO' ELSE 'Flex Pleno Cop. 40%' END END AS line
        FROM m CROSS JOIN k WHERE k = 2 OR (k = 3 AND pk % 4 < 2) OR (k IN (4, 5) AND pk % 8 = 0) OR (pos = 1 AND (k IN (1, 6, 7, 8) OR (k = 0 AND doc_id % 3 = 0)))""",
    # a title row, a header row with a repeated label, data rows with an always-empty column; every third table repeats its header
    "cells": f"""WITH p AS (SELECT l_orderkey AS table_id, {_PAGE} AS n, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_returnflag AS f FROM {{lineitem}}),
        h AS (SELECT table_id, CAST(n AS INT) + 1 AS row_pos, q, e, d, f FROM p),
        k AS (SELECT DISTINCT table_id FROM p),
        x AS (SELECT table_id, max(n) AS m FROM p GROUP BY table_id)
        SELECT table_id, CAST(0 AS INT) AS row_pos, CAST(0 AS INT) AS col_pos, 'Tabela de valores' AS value FROM k
        UNION ALL SELECT table_id, CAST(1 AS INT), CAST(c AS INT), CASE c WHEN 0 THEN 'Qtd' WHEN 1 THEN 'Valor' WHEN 2 THEN 'Taxa' WHEN 3 THEN 'Valor' ELSE '' END FROM k CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) cs
        UNION ALL SELECT table_id, row_pos, CAST(c AS INT), CASE c WHEN 0 THEN CAST(CAST(q AS BIGINT) AS STRING) WHEN 1 THEN concat('R$ ', CAST(CAST(floor(e) AS BIGINT) AS STRING), ',50')
            WHEN 2 THEN concat(CAST(CAST(round(d * 100) AS BIGINT) AS STRING), '%') WHEN 3 THEN CASE WHEN f = 'R' THEN concat('=', f) ELSE f END END
            FROM h CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) cs
        UNION ALL SELECT table_id, CAST(m + 2 AS INT), CAST(c AS INT), CASE c WHEN 0 THEN 'Qtd' WHEN 1 THEN 'Valor' WHEN 2 THEN 'Taxa' WHEN 3 THEN 'Valor' ELSE '' END FROM x CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) cs WHERE table_id % 3 = 0""",
    "doc_objects": f"""WITH o AS (SELECT l_orderkey AS doc_id, CAST({_PAGE} AS INT) AS object_id, l_partkey AS pk, l_suppkey AS sk FROM {{lineitem}})
        SELECT doc_id, object_id, CASE WHEN pk % 3 = 0 AND object_id > 1 THEN object_id - 1 END AS parent_id, CAST(1 + sk % 3 AS INT) AS page_number,
            CASE WHEN pk % 12 < 5 THEN 'catalog' WHEN pk % 12 < 9 THEN 'annotation' ELSE 'field' END AS scope,
            CASE pk % 12 WHEN 0 THEN '/OpenAction' WHEN 1 THEN '/AA' WHEN 2 THEN '/JavaScript' WHEN 3 THEN '/EmbeddedFiles' WHEN 4 THEN '/SigFlags'
                WHEN 5 THEN '/Widget' WHEN 6 THEN '/Highlight' WHEN 7 THEN '/A' WHEN 8 THEN '/A' WHEN 9 THEN '/FT' WHEN 10 THEN '/FT' ELSE '/V' END AS key,
            CASE pk % 12 WHEN 4 THEN CAST(sk % 4 AS STRING) WHEN 7 THEN CASE sk % 4 WHEN 0 THEN '/JavaScript' WHEN 1 THEN '/Launch' WHEN 2 THEN '/URI' ELSE '/GoTo' END
                WHEN 8 THEN '/GoTo' WHEN 9 THEN '/Sig' WHEN 10 THEN '/Tx' WHEN 11 THEN CASE sk % 2 WHEN 0 THEN 'filled' ELSE '' END ELSE '' END AS value FROM o""",
    "words": f"""SELECT l_orderkey AS doc_id, {_PAGE} AS n, CASE l_partkey % 7 WHEN 0 THEN 'Procedimento' WHEN 1 THEN 'VALOR total' ELSE 'outro' END AS text,
        CAST(l_partkey % 600 AS DOUBLE) AS x0, CAST(l_partkey % 600 + CAST(l_quantity AS BIGINT) AS DOUBLE) AS x1, CAST(l_suppkey % 800 AS DOUBLE) AS top FROM {{lineitem}}""",
    "vectors": f"""SELECT l_orderkey AS doc_id, {_PAGE} AS n, CAST(l_partkey % 600 AS DOUBLE) AS x0, CAST(l_partkey % 600 + 10 * CAST(l_quantity AS BIGINT) AS DOUBLE) AS x1,
        CAST(l_suppkey % 800 AS DOUBLE) AS y0, CAST(l_suppkey % 800 + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS DOUBLE) AS y1 FROM {{lineitem}}""",
    "job_files": """SELECT o_custkey AS job_id, o_orderkey AS file_id FROM {orders}""",
    "sessions": """SELECT event_id AS session_id, CAST(1 + event_id % 20000 AS BIGINT) AS file_id, ts FROM {events}""",
}
_TABLE = re.compile(r"\{(\w+)\}")


def duck(names: str | list[str], body: str) -> str:
    """Oracle SQL: the fixtures as common tables, then the body.  A body that begins with a name and AS goes on with common tables."""
    names = names.split() if isinstance(names, str) else names
    ctes = [f"{n} AS ({_TABLE.sub(lambda m: m[1], FIXTURES[n])})" for n in names]
    body = body.strip()
    return "WITH " + ",\n".join(ctes) + (",\n" if not body.upper().startswith("SELECT") else "\n") + body


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(sql))}
    if _PAGE in sql:  # its rows are shuffled by order for the window anyway
        tables["lineitem"] = dealt(tables["lineitem"], "l_orderkey")
    return spark.sql(sql, **tables)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, names: str = "") -> Callable:
    """Register a function of (load, spark, sf_dir) as a query; load(name) gives a fixture, or a test table."""

    def register(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            load = lambda n: fixture(spark, sf_dir, n) if n in FIXTURES else spark.read.parquet(f"{sf_dir}/{n}.parquet")
            return fn(load)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = duck(names, sql) if names else sql
        return fn

    return register
