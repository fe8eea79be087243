"""Queries of file structure, over sources written from the tables: each order is a job step, a paragraph and a statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import structure
from korpusgraf.sources.adapter import table


def _files(s, d, head: str, line: str):
    """A file for each customer with a head and its orders' lines by key."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("os"))
    return o.selectExpr("concat('src/', o_custkey) as path", f"concat({head}, array_join(transform(os, x -> {line}), '\\n')) as content")


def jcl(s, d):
    return _files(s, d, "'//J', o_custkey, ' JOB (1)\\n//* note\\n'", "concat('//S', x.o_orderkey, ' EXEC PGM=P', x.o_orderkey % 50, '\\n//D', x.o_orderkey % 7, ' DD DSN=DATA.', x.o_orderstatus, x.o_orderkey % 9, ',DISP=SHR')")


def cobol(s, d):
    return _files(s, d, "'       IDENTIFICATION DIVISION.\\n       PROCEDURE DIVISION.\\n'", "concat('       P-', x.o_orderkey, '.\\n      * CALL NOTHING\\n           PERFORM P-', x.o_orderkey + 1, '.\\n           CALL ', case when x.o_orderstatus = 'F' then concat('\\'SUB', x.o_orderkey % 10, '\\'') else 'WS-NAME' end, '.')")


def scripts(s, d):
    return _files(s, d, "'-- note; still note\\ncreate table T', o_custkey, ' (a int);\\n'", "concat('insert into T', o_custkey, ' select * from S', x.o_orderkey % 5, ' join S', x.o_orderkey % 3, ' using (a);')")


QUERIES = {
    "jcl_entities": lambda s, d: structure.jcl_entities(jcl(s, d)),
    "cobol_units": lambda s, d: structure.cobol_units(cobol(s, d)),
    "cobol_edges": lambda s, d: structure.local_targets(structure.cobol_edges(cobol(s, d)), structure.cobol_units(cobol(s, d))),
    "sql_statements": lambda s, d: structure.sql_statements(scripts(s, d)),
}
O = "o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)"
SQL = {
    "jcl_entities": f"""WITH {O} SELECT 'src/' || o_custkey AS path, CAST(1 AS INT) AS line, 'job' AS type, 'J' || o_custkey AS name, NULL AS owner, NULL AS target FROM o WHERE n = 1
UNION ALL SELECT 'src/' || o_custkey, CAST(1 + 2 * n AS INT), 'step', 'S' || o_orderkey, 'J' || o_custkey, 'P' || o_orderkey % 50 FROM o
UNION ALL SELECT 'src/' || o_custkey, CAST(2 + 2 * n AS INT), 'dataset', 'D' || o_orderkey % 7, 'S' || o_orderkey, 'DATA.' || o_orderstatus || o_orderkey % 9 FROM o""",
    "cobol_units": f"""WITH {O} SELECT 'src/' || o_custkey AS path, 1 AS line, 'division' AS type, 'IDENTIFICATION' AS name, 1 AS end_line FROM o WHERE n = 1 UNION ALL SELECT 'src/' || o_custkey, 2, 'division', 'PROCEDURE', 2 FROM o WHERE n = 1
UNION ALL SELECT 'src/' || o_custkey, CAST(4 * n - 1 AS INT), 'paragraph', 'P-' || o_orderkey, CAST(4 * n + 2 AS INT) FROM o""",
    "cobol_edges": f"""WITH {O} SELECT 'src/' || a.o_custkey AS path, CAST(4 * a.n + 1 AS INT) AS line, 'P-' || a.o_orderkey AS src, 'PERFORM' AS type, 'P-' || (a.o_orderkey + 1) AS dst_name, CASE WHEN b.n IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution, CAST(4 * b.n - 1 AS INT) AS dst_line
FROM o a LEFT JOIN o b ON b.o_custkey = a.o_custkey AND b.o_orderkey = a.o_orderkey + 1
UNION ALL SELECT 'src/' || o_custkey, CAST(4 * n + 2 AS INT), 'P-' || o_orderkey, 'CALL', CASE WHEN o_orderstatus = 'F' THEN 'SUB' || o_orderkey % 10 ELSE 'WS-NAME' END, CASE WHEN o_orderstatus = 'F' THEN 'unresolved' ELSE 'dynamic' END, NULL FROM o""",
    "sql_statements": f"""WITH {O} SELECT 'src/' || o_custkey AS path, 0 AS nr, 'CREATE' AS verb, 'T' || o_custkey AS object, 'T' || o_custkey AS tables FROM o WHERE n = 1
UNION ALL SELECT 'src/' || o_custkey, CAST(n AS INT), 'INSERT', NULL, 'T' || o_custkey || ',S' || o_orderkey % 5 || CASE WHEN o_orderkey % 5 <> o_orderkey % 3 THEN ',S' || o_orderkey % 3 ELSE '' END FROM o""",
}
