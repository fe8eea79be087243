"""Queries of changes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import change, reports
from korpusgraf.sources.adapter import ORDER, PART, edges, entities, table, with_relations

CLASSES = [("timeout|slow", "timeout"), ("size", "too_large"), ("code [0-9]+", "decode")]


def ids(s, *xs):
    return s.createDataFrame([(x,) for x in xs], "id long")


def statements(s, d, flags):
    """Fields read or written by line items: a unit is an order, a field a part, a line its place in the order."""
    return table(s, d, "lineitem").where(f"l_returnflag in ({flags})").selectExpr("l_orderkey as unit", "l_linenumber as line", "l_partkey as field").distinct()


def jumps(s, d):
    return table(s, d, "lineitem").selectExpr("l_suppkey as unit", "l_partkey % 9 as src", "cast(l_quantity as int) % 3 as line", "l_orderkey % 9 as dst").distinct()


def problems(s, d):
    """A message for each event of three types."""
    return table(s, d, "events").selectExpr("concat('f', user_id) as path", "case event_id % 4 when 0 then concat('timeout after ', event_id % 5, ' s') when 1 then concat('bad code ', event_id % 3) when 2 then 'size limit' else 'unknown' end as message", "case when event_id % 3 = 0 then 'partial' when event_id % 3 = 1 then 'fallback' else 'complete' end as status", "event_id")


def documents(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", F.concat_ws("/", "source", F.col("doc_id") % 40).alias("file_path"), (F.col("doc_id") % 3 == 0).alias("is_code"), (F.col("doc_id") % 7).alias("project_id"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("embedding_model"))


def items(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey as id", "cast(o_orderdate as date) as due", "cast(substring(o_orderpriority, 1, 1) as int) as priority", "case o_orderstatus when 'O' then 'open' when 'F' then 'review' else 'done' end as status")


def tree(s, d):
    e = entities(s, d).where("type in ('region', 'nation', 'supplier')")
    return e.select("id", "parent_id", "name")


def pages(s, d):
    e = entities(s, d).where("type in ('region', 'nation', 'customer')")
    up = e.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("top"))
    return e.join(up, "parent_id", "left").select("id", F.filter(F.array("parent_id", "top"), lambda x: x.isNotNull()).alias("ancestors"), (F.col("id") % 11 == 3).alias("restricted"))


def uploads(s, d, kind):
    return table(s, d, "events").where(f"event_id % 3 {kind} 0").selectExpr("user_id as run", "event_type as job", "cast(user_id % 4 + event_id % 3 div 2 as string) as payload")


def nodes(s, d):
    e = entities(s, d)
    return e.select("id", F.col("type").alias("kind"), F.col("source_id").alias("source"), (F.col("id") % 97).alias("degree"), (F.col("file_path").startswith("EUROPE")).alias("in_focus"))


QUERIES = {
    "used_by": lambda s, d: change.used_by(edges(s, d), entities(s, d), ids(s, PART + 17, PART + 5)),
    "test_evidence": lambda s, d: change.test_evidence(edges(s, d), entities(s, d), entities(s, d).where("type = 'part'").select("id"), F.col("id") % 10 == 0),
    "includes": lambda s, d: change.includes(edges(s, d), F.startswith("dst_name", F.lit("a"))),
    "data_origin": lambda s, d: change.data_origin(statements(s, d, "'R'"), statements(s, d, "'A'"), table(s, d, "part").where("p_partkey in (1, 2)").select(F.col("p_partkey").alias("field")), 2),
    "group_paths": lambda s, d: change.group_paths(tree(s, d)),
    "visible_groups": lambda s, d: change.visible_groups(change.group_paths(tree(s, d)), ["EUROPE", "ASIA"]),
    "scan_reasons": lambda s, d: reports.scan_reasons(problems(s, d), CLASSES),
    "parser_gaps": lambda s, d: reports.parser_gaps(problems(s, d).groupBy("path", "message").count()),
    "source_status": lambda s, d: reports.source_status(problems(s, d).groupBy("path").agg(F.max("status").alias("status")), 5),
    "facets": lambda s, d: reports.facets(documents(s, d), ["lang", "source"]),
    "set_size": lambda s, d: reports.set_size(documents(s, d), reports.set_condition({"lang": ["de", "fr"], "source": ["src1", "src2"]}, [("src3", "src3/3")])),
    "visibility_gate": lambda s, d: reports.gated(documents(s, d), table(s, d, "nation").where("n_nationkey in (2, 4)").select(F.col("n_nationkey").alias("project_id")), 1).select("doc_id"),
    "worklist": lambda s, d: reports.worklist(items(s, d), "1995-06-01").limit(50).select("id", "priority", "status"),
    "embedding_coverage": lambda s, d: reports.coverage(documents(s, d), "en"),
    "restricted_pages": lambda s, d: reports.restricted(pages(s, d)).select("id"),
    "ci_ingest": lambda s, d: reports.new_reports(uploads(s, d, "="), uploads(s, d, "<>"), ["run", "job"]),
    "spread_selection": lambda s, d: reports.spread_selection(nodes(s, d), 60),
}
REF = f"""own AS (SELECT * FROM entities WHERE id IN ({PART + 17}, {PART + 5})), refs AS (SELECT src_id, line FROM edges WHERE dst_id IN (SELECT id FROM own) UNION ALL SELECT src_id, line FROM edges WHERE resolution = 'unresolved' AND lower(dst_name) IN (SELECT lower(name) FROM own)),
u AS (SELECT DISTINCT file_path, line FROM refs JOIN entities ON id = src_id WHERE file_path NOT IN (SELECT file_path FROM own))"""
STAT = "SELECT DISTINCT l_orderkey AS unit, l_linenumber AS line, l_partkey AS field FROM lineitem WHERE l_returnflag = "
PROBLEMS = "p AS (SELECT event_id, 'f' || user_id AS path, CASE event_id % 4 WHEN 0 THEN 'timeout after ' || event_id % 5 || ' s' WHEN 1 THEN 'bad code ' || event_id % 3 WHEN 2 THEN 'size limit' ELSE 'unknown' END AS message, CASE event_id % 3 WHEN 0 THEN 'partial' WHEN 1 THEN 'fallback' ELSE 'complete' END AS status FROM events)"
TREE = "tree AS (SELECT id, parent_id, name FROM entities WHERE type IN ('region', 'nation', 'supplier')), paths AS (SELECT id, name AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT tree.id, path || '/' || name FROM tree JOIN paths ON parent_id = paths.id)"
DOCS = "d AS (SELECT doc_id, lang, source, source || '/' || doc_id % 40 AS file_path, doc_id % 7 AS project_id FROM documents)"
UP = "SELECT DISTINCT user_id, event_type, user_id % 4 + event_id % 3 // 2 AS payload FROM events WHERE event_id % 3"
SQL = {
    "used_by": with_relations("entities edges", f"{REF}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line) AS n FROM u) SELECT file_path, string_agg(line, ',' ORDER BY line) AS lines FROM r WHERE n <= 3 GROUP BY 1"),
    "test_evidence": with_relations("edges", "SELECT dst_id AS id, count(DISTINCT src_id) AS tests FROM edges WHERE resolution = 'resolved' AND src_id % 10 = 0 GROUP BY 1"),
    "includes": with_relations("edges", "i AS (SELECT DISTINCT src_id, dst_name, line, type, resolution FROM edges WHERE type IN ('COPY', 'IMPORTS')) SELECT src_id, count(*) FILTER (resolution = 'resolved') AS resolved, count(*) FILTER (resolution <> 'resolved' AND dst_name LIKE 'a%') AS external, count(*) FILTER (resolution <> 'resolved' AND dst_name NOT LIKE 'a%') AS unresolved FROM i GROUP BY 1"),
    "data_origin": f"""WITH w AS ({STAT}'R'), r AS ({STAT}'A'), step AS (SELECT DISTINCT w.field AS a, r.field AS b FROM w JOIN r ON w.unit = r.unit AND r.line BETWEEN w.line AND w.line + 2 AND w.field <> r.field),
one AS (SELECT a AS field, b AS origin FROM step WHERE a IN (1, 2)), two AS (SELECT DISTINCT field, b AS origin FROM one JOIN step ON a = origin WHERE b <> field AND (field, b) NOT IN (SELECT * FROM one)) SELECT field, origin, 1 AS hop FROM one UNION ALL SELECT field, origin, 2 FROM two""",
    "group_paths": with_relations("entities", f"{TREE} SELECT * FROM paths"),
    "visible_groups": with_relations("entities", f"{TREE}, s AS (SELECT id, path, string_split(path, '/') AS p FROM paths) SELECT id, CASE WHEN p[1] NOT IN ('EUROPE', 'ASIA') THEN p[1] WHEN len(p) > 1 THEN p[1] || '/' || p[2] ELSE path END AS shown FROM s"),
    "scan_reasons": f"WITH {PROBLEMS} SELECT CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'decode' WHEN 2 THEN 'too_large' ELSE 'other' END AS reason, count(*) AS files FROM p GROUP BY 1",
    "parser_gaps": f"WITH {PROBLEMS}, u AS (SELECT DISTINCT path, message FROM p), x AS (SELECT *, regexp_replace(message, '[0-9]+', '#', 'g') AS pattern FROM u) SELECT pattern, count(*) AS occurrences, count(DISTINCT path) AS files, arg_min(message, path || ' ' || message) AS example FROM x GROUP BY 1 ORDER BY occurrences DESC, pattern LIMIT 10",
    "source_status": f"WITH {PROBLEMS}, u AS (SELECT path, max(status) AS status FROM p GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) AS n FROM u WHERE status <> 'complete') SELECT status, count(*) AS files, string_agg(path, ',' ORDER BY path) FILTER (n <= 5) AS listed FROM r GROUP BY 1",
    "facets": "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2",
    "set_size": f"WITH {DOCS} SELECT count(DISTINCT (source, file_path)) AS documents, count(*) AS chunks FROM d WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2') OR file_path = 'src3/3'",
    "visibility_gate": f"WITH {DOCS} SELECT doc_id FROM d WHERE doc_id % 3 <> 0 OR project_id IN (1, 2, 4)",
    "worklist": "WITH i AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS due, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'review' ELSE 'done' END AS status FROM orders) SELECT id, priority, status FROM i ORDER BY coalesce(due < DATE '1995-06-01', false) DESC, priority DESC, CASE status WHEN 'open' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, due NULLS LAST, id LIMIT 50",
    "embedding_coverage": "SELECT CASE WHEN doc_id % 5 <> 0 THEN lang ELSE 'none' END AS model, count(*) AS chunks, count(*) FILTER (doc_id % 5 <> 0 AND lang = 'en') AS done FROM documents GROUP BY 1",
    "restricted_pages": with_relations("entities", "p AS (SELECT e.id, e.parent_id AS a, u.parent_id AS b FROM entities e LEFT JOIN entities u ON u.id = e.parent_id WHERE e.type IN ('region', 'nation', 'customer')) SELECT id FROM p WHERE id % 11 <> 3 AND coalesce(a % 11, 0) <> 3 AND coalesce(b % 11, 0) <> 3"),
    "ci_ingest": f"""WITH a AS ({UP} = 0), b AS ({UP} <> 0) SELECT sha256('["' || user_id || '","' || event_type || '"]') AS identity, CAST(b.payload AS VARCHAR) AS payload, CASE WHEN a.payload IS NULL THEN 'new' WHEN a.payload = b.payload THEN 'known' ELSE 'conflict' END AS state FROM b LEFT JOIN a USING (user_id, event_type)""",
    "spread_selection": with_relations("entities", """n AS (SELECT id, type AS kind, source_id AS source, id % 97 AS degree, starts_with(file_path, 'EUROPE') AS f FROM entities),
t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY source ORDER BY degree DESC, id) = 1 THEN 1 ELSE 2 END AS tier FROM n),
x AS (SELECT id FROM t WHERE tier = 2 AND f ORDER BY degree DESC, id LIMIT 42)
SELECT id FROM (SELECT id, degree, CASE WHEN tier < 2 THEN tier WHEN id IN (SELECT id FROM x) THEN 2 ELSE 3 END AS tier FROM t) ORDER BY tier, degree DESC, id LIMIT 60"""),
}
