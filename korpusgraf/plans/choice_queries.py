"""Queries of choices between candidates and of facts that files pass on."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import choices
from korpusgraf.sources.adapter import CUSTOMER, ORDER, SUPPLIER, edges, entities, table, with_relations


def overloads(s, d):
    """A call for each event, a method for each part; four methods share a name."""
    types = "array('int', 'java.lang.String', 'java.util.List<String>')"
    calls = table(s, d, "events").selectExpr(
        "event_id as call_id", "event_id % 50 as name", "case when event_id % 5 > 0 then event_id % 3 end as n_args",
        "case when event_id % 7 > 0 then slice(array('Integer', 'String', 'List', 'int'), cast(1 + user_id % 2 as int), cast(event_id % 3 as int)) else array(cast(null as string)) end as arg_types",
    )
    methods = table(s, d, "part").selectExpr("p_partkey as method_id", "p_partkey div 4 as name", f"slice({types}, cast(1 + p_size % 2 as int), cast(p_partkey % 3 as int)) as param_types")
    return choices.chosen_overloads(calls, methods)


def libraries(s, d):
    copies = table(s, d, "events").selectExpr("event_id as copy_id", "concat('b', event_id % 70) as name", "case when event_id % 4 = 0 then concat('L', user_id % 3) end as library")
    books = table(s, d, "part").selectExpr("concat('B', p_partkey div 3) as name", "concat('src/d', p_size % 2, '/l', p_size % 3, '/', p_partkey) as path")
    return choices.library_paths(copies, books, ["src/d1", "src/d0"])


def accesses(s, d):
    e = edges(s, d).selectExpr("edge_id", "src_id", "case when type = 'CALL' then 'WRITES' else type end as type", "dst_name", f"cast(line + (src_id - {ORDER}) % 300 as int) as line", "line = 3 as file_io")
    return choices.data_access(e, entities(s, d), entities(s, d).where("type = 'order'").select("id"))


def dependencies(s, d):
    return choices.file_dependencies(edges(s, d).selectExpr("src_id", "dst_id", "case when line = 1 then concat('orders/', length(dst_name)) when line = 2 then '' end as target_path"), entities(s, d))


def broken(s, d):
    sources = table(s, d, "customer").selectExpr("c_custkey as id", "case when c_custkey % 4 = 0 then 'syncing' else 'idle' end as status")
    return choices.interrupted(sources, table(s, d, "orders").where("o_orderstatus = 'O'").selectExpr("o_custkey as id"))


def reports(s, d):
    inner = "case event_type when 'error' then '<error/><failure/>' when 'click' then '<failure/>' when 'view' then '<skipped/>' else '' end"
    with_cases = f"concat('<testsuite tests=\"9\"><testcase name=\"c', event_id, '\">', {inner}, '</testcase><testcase name=\"ok\"/></testsuite>')"
    bare = "concat('<testsuites><testsuite tests=\"', user_id, '\" failures=\"2\"/><testsuite tests=\"1\" errors=\"1\"/></testsuites>')"
    return choices.test_reports(table(s, d, "events").selectExpr("event_id as path", f"case when event_type = 'signup' then {bare} else {with_cases} end as content"))


def settings(s, d):
    e = entities(s, d).where("type in ('region', 'nation', 'supplier', 'customer')")  # SQL text must not hold a whole ${name}: Spark would replace it
    props = "case type when 'region' then map('region', name, 'label', concat('$', '{region}!')) when 'nation' then map('nation', name, 'label', concat('$', '{nation} in $', '{region}')) when 'supplier' then map('own', concat('<$', '{label}>')) else cast(map() as map<string,string>) end"
    return choices.effective_settings(e.selectExpr("id as path", "parent_id as parent", f"{props} as props"))


def items(s, d):
    """Items of each order, a level for each line."""
    return choices.nested_items(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line")).agg(F.max(F.expr("case when l_partkey % 11 = 0 then 88 when l_partkey % 13 = 0 then 77 else cast(l_partkey % 5 + 1 as int) end")).alias("level")))


def nodes(s, d):
    label = lambda t, i, c: table(s, d, t).selectExpr(f"{i} as id", f"{c} as label")
    return choices.search_nodes({"nation": label("nation", "cast(n_nationkey as bigint)", "n_name"), "part": label("part", "p_partkey", "p_name"), "supplier": label("supplier", "s_suppkey", "s_name")}, "AR", 10)


QUERIES = {
    "chosen_overloads": overloads, "library_paths": libraries, "data_access": accesses, "file_dependencies": dependencies, "interrupted_runs": broken,
    "test_reports": reports, "effective_settings": settings, "nested_items": items, "search_nodes": nodes,
}
SIMPLE = "list_transform({}, lambda t: regexp_extract(regexp_replace(t, '<.*', ''), '[^.]*$'))"
SQL = {
    "chosen_overloads": f"""WITH c AS (SELECT event_id AS call_id, event_id % 50 AS name, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS n_args,
  CASE WHEN event_id % 7 > 0 THEN ['Integer', 'String', 'List', 'int'][1 + user_id % 2 : user_id % 2 + event_id % 3] ELSE [NULL] END AS a FROM events),
m AS (SELECT p_partkey AS method_id, p_partkey // 4 AS name, {SIMPLE.format("['int', 'java.lang.String', 'java.util.List<String>'][1 + p_size % 2 : p_size % 2 + p_partkey % 3]")} AS p FROM part),
j AS (SELECT call_id, method_id, method_id IS NOT NULL AND (n_args IS NULL OR len(p) = n_args) AS ar, len(a) > 0 AND len(list_filter(a, lambda t: t IS NULL)) = 0 AND len(a) = len(p) AS ok, a, p FROM c LEFT JOIN m USING (name)),
k AS (SELECT call_id, method_id, ar, ar AND ok AND a = p AS ex, ar AND ok AND a = list_transform(generate_series(1, len(p)), lambda i: CASE WHEN p[i] = 'int' AND a[i] = 'Integer' THEN 'Integer' ELSE p[i] END) AS fi FROM j)
SELECT call_id, CASE WHEN count(*) FILTER (ar) = 1 THEN min(method_id) FILTER (ar) WHEN count(*) FILTER (ex) = 1 THEN min(method_id) FILTER (ex) WHEN count(*) FILTER (fi) = 1 THEN min(method_id) FILTER (fi) END AS method_id FROM k GROUP BY 1""",
    "library_paths": """WITH c AS (SELECT event_id AS copy_id, 'B' || event_id % 70 AS name, CASE WHEN event_id % 4 = 0 THEN 'l' || user_id % 3 END AS lib FROM events),
b AS (SELECT 'B' || p_partkey // 3 AS name, 'l' || p_size % 3 AS dir, p_size % 2 AS d, 'src/d' || p_size % 2 || '/l' || p_size % 3 || '/' || p_partkey AS path FROM part),
g AS (SELECT copy_id, count(path) AS n, min(path) AS p, count(path) FILTER (dir = lib) AS nl, min(path) FILTER (dir = lib) AS pl, count(path) FILTER (d = 1) AS n1, min(path) FILTER (d = 1) AS p1, count(path) FILTER (d = 0) AS n0, min(path) FILTER (d = 0) AS p0 FROM c LEFT JOIN b USING (name) GROUP BY 1)
SELECT copy_id, CASE WHEN n = 1 THEN p WHEN nl = 1 THEN pl WHEN n1 = 1 THEN p1 WHEN n1 > 1 THEN NULL WHEN n0 = 1 THEN p0 END AS path FROM g""",
    "data_access": with_relations("edges entities", f"""a AS (SELECT edge_id, src_id, CASE WHEN type = 'CALL' THEN 'WRITES' ELSE type END AS type, dst_name, line + (src_id - {ORDER}) % 300 AS line, line = 3 AS file_io FROM edges WHERE type IN ('CALL', 'READS')),
m AS (SELECT w.id, a.* FROM a JOIN entities s ON s.id = a.src_id JOIN entities w ON w.type = 'order' AND w.source_id = s.source_id AND w.file_path = s.file_path AND a.line BETWEEN w.start_line AND w.end_line),
g AS (SELECT id, type, dst_name, max(file_io) AS io, min(line) AS first, array_to_string(list(line ORDER BY line, edge_id)[1:4], ',') AS lines FROM m GROUP BY 1, 2, 3)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY io DESC, CASE type WHEN 'WRITES' THEN 0 ELSE 2 END, first, type, dst_name) AS INT) AS pos, type AS access, dst_name AS target, lines FROM g QUALIFY pos <= 15"""),
    "file_dependencies": with_relations("edges entities", """n AS (SELECT s.file_path AS path, CASE WHEN line = 1 THEN 'orders/' || length(dst_name) WHEN t.source_id = s.source_id THEN t.file_path END AS needs FROM edges JOIN entities s ON s.id = src_id LEFT JOIN entities t ON t.id = dst_id)
SELECT DISTINCT path, needs FROM n WHERE needs <> path"""),
    "interrupted_runs": "WITH s AS (SELECT c_custkey AS id, c_custkey % 4 = 0 AS syncing, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS held FROM customer) SELECT id, CASE WHEN syncing AND NOT held THEN 'error' WHEN syncing THEN 'syncing' ELSE 'idle' END AS status, CASE WHEN syncing AND NOT held THEN 'interrupted' END AS error FROM s",
    "test_reports": """WITH r AS (SELECT event_id AS path, event_type = 'signup' AS bare, CASE WHEN event_type = 'signup' THEN user_id + 1 ELSE 2 END AS tests, CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS failures, CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END AS errors,
  CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS skipped, CASE WHEN event_type IN ('error', 'click') THEN 'c' || event_id ELSE '' END AS failed FROM events) SELECT path, tests, failures, errors, skipped, failed, failures + errors + skipped <= tests AS consistent FROM r""",
    "effective_settings": f"""WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), l AS (
  SELECT CAST(100 + n_nationkey AS BIGINT) AS path, n_nationkey, 0 AS up FROM nation UNION ALL SELECT {SUPPLIER} + s_suppkey, s_nationkey, 1 FROM supplier UNION ALL SELECT {CUSTOMER} + c_custkey, c_nationkey, 1 FROM customer), f AS (SELECT * FROM l JOIN n USING (n_nationkey))
SELECT path, 'nation' AS key, n_name AS value, up AS level FROM f UNION ALL SELECT path, 'region', r_name, up + 1 FROM f UNION ALL SELECT path, 'label', n_name || ' in ' || r_name, up FROM f
UNION ALL SELECT {SUPPLIER} + s_suppkey, 'own', '<' || n_name || ' in ' || r_name || '>', 0 FROM supplier JOIN n ON s_nationkey = n_nationkey
UNION ALL SELECT r_regionkey, 'region', r_name, 0 FROM region UNION ALL SELECT r_regionkey, 'label', r_name || '!', 0 FROM region""",
    "nested_items": """WITH i AS (SELECT l_orderkey AS path, l_linenumber AS line, max(CASE WHEN l_partkey % 11 = 0 THEN 88 WHEN l_partkey % 13 = 0 THEN 77 ELSE l_partkey % 5 + 1 END) AS level FROM lineitem GROUP BY 1, 2)
SELECT path, line, level, CASE WHEN level = 88 THEN (SELECT max(line) FROM i b WHERE b.path = a.path AND b.line < a.line AND b.level <> 88) WHEN level < 50 THEN (SELECT max(line) FROM i b WHERE b.path = a.path AND b.line < a.line AND b.level < a.level) END AS parent_line FROM i a""",
    "search_nodes": """WITH h AS (SELECT * FROM (SELECT 'nation' AS node_type, CAST(n_nationkey AS BIGINT) AS node_id, n_name AS label FROM nation UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) WHERE contains(lower(label), 'ar'))
SELECT *, count(*) OVER (PARTITION BY node_type) AS hits FROM h QUALIFY row_number() OVER (PARTITION BY node_type ORDER BY label, node_id) <= 10""",
}
