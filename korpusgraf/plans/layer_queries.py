"""Queries of layers: customers down to what their orders call, with suppliers and parts beyond."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import layers as L
from korpusgraf.sources.adapter import CUSTOMER, ORDER, PART, SUPPLIER, edges, entities, table, with_relations

DEPTH, COLLAPSE, FRONTIER = 4, 30, 20
ROOTS = "c_nationkey = 7"


def linked(s, d):
    """Edges of orders, calls of parts to suppliers and of suppliers to parts; parts of source 4 lie among tests."""
    line = table(s, d, "lineitem").where("l_returnflag = 'R' and l_linenumber <= 2")
    name = "concat(l_linenumber, ':', l_partkey, ':', l_suppkey)"
    pair = [(name, f"{PART} + l_partkey", f"{SUPPLIER} + l_suppkey", 1), (name, f"{SUPPLIER} + l_suppkey", f"{PART} + l_partkey", 2)]
    e = edges(s, d).select("edge_id", "src_id", "dst_id", "dst_name", "type", "resolution")
    for n, a, b, nr in pair:
        e = e.union(line.where(f"l_linenumber = {nr}").selectExpr(n, a, b, "'x'", "'CALL'", "'resolved'").distinct())
    hidden = (F.col("type") == "part") & (F.col("source_id") == 4)
    return e, entities(s, d).withColumn("file_path", F.when(hidden, F.concat(F.lit("src/test/"), "file_path")).otherwise(F.col("file_path")))


def walked(s, d):
    customer = table(s, d, "customer").where(ROOTS)
    expand = customer.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + CUSTOMER).alias("root"), F.explode(F.array(F.lit(1), F.lit(3))).alias("layer"))
    return L.layers(*linked(s, d), customer.select((F.col("c_custkey") + CUSTOMER).alias("id")), "down", DEPTH, ("control",), COLLAPSE, expand, FRONTIER, containers=("customer",))


def shown(s, d):
    w = walked(s, d)
    return w.edges.withColumn("leads", F.lit("on")).union(w.back.withColumn("leads", F.lit("back")))


def other_ways(s, d):
    e, n = linked(s, d)
    return L.alternatives(e, n, L.members(n, table(s, d, "nation").selectExpr("100 + n_nationkey as id"), ["nation"]), "down")


QUERIES = {"layer_edges": shown, "layer_summary": lambda s, d: walked(s, d).summary, "layer_alternatives": other_ways}

GRAPH = f"""e AS MATERIALIZED (SELECT edge_id, src_id, dst_id, dst_name, type, resolution FROM edges UNION ALL SELECT DISTINCT l_linenumber || ':' || l_partkey || ':' || l_suppkey,
  CASE l_linenumber WHEN 1 THEN {PART} + l_partkey ELSE {SUPPLIER} + l_suppkey END, CASE l_linenumber WHEN 1 THEN {SUPPLIER} + l_suppkey ELSE {PART} + l_partkey END, 'x', 'CALL', 'resolved' FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 2)"""


def _layer(h: int) -> str:
    """The tables of layer h: edges met, entities found by first edge, sums, places, what is held and the next frontier."""
    src = "f.root" if h == 1 else "k.src_id"
    before = "f0" if h == 1 else f"g{h - 1}"
    within = "AND NOT (s.member AND (k.src_id <> f.root OR k.dst_id <> f.root))" if h == 1 else ""
    expanded = f"root IN (SELECT {CUSTOMER} + c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')" if h in (1, 3) else "false"
    return f"""m{h} AS MATERIALIZED (SELECT f.root, edge_id, {src} AS src_id, k.dst_id AS target, CASE WHEN s.member THEN f.root ELSE k.dst_id END AS dst_id, k.type, k.external, s.id IS NOT NULL AS held, s.id IS NOT NULL {within} AS back, p.source_id = 4 AS hidden
  FROM f{h - 1} f JOIN k ON k.src_id = f.id LEFT JOIN s{h - 1} s ON s.root = f.root AND s.id = k.dst_id LEFT JOIN entities p ON p.id = k.dst_id AND p.type = 'part'),
n{h} AS MATERIALIZED (SELECT root, target AS id, row_number() OVER (PARTITION BY root ORDER BY min(edge_id), target) AS pos, count(*) OVER (PARTITION BY root) AS n FROM m{h} WHERE NOT held AND target IS NOT NULL AND NOT coalesce(hidden, false) GROUP BY root, target),
c{h} AS MATERIALIZED (SELECT root, {h} AS layer, (SELECT count(*) FROM n{h} n WHERE n.root = a.root) AS nodes, (SELECT count(DISTINCT target) FROM m{h} m WHERE m.root = a.root AND NOT held AND hidden) AS hidden,
  (SELECT count(*) FROM m{h} m WHERE m.root = a.root AND target IS NULL) AS unresolved, (SELECT count(*) FROM m{h} m WHERE m.root = a.root AND external) AS unresolved_external FROM (SELECT DISTINCT root FROM {before}) a),
o{h} AS MATERIALIZED (SELECT *, nodes > {COLLAPSE} AND NOT {expanded} AS collapsed, nodes > {FRONTIER} AND NOT (nodes > {COLLAPSE} AND NOT {expanded}) AS truncated FROM c{h}),
g{h} AS (SELECT root FROM o{h} WHERE nodes > 0 AND NOT collapsed),
l{h} AS (SELECT root, {h} AS layer, row_number() OVER (PARTITION BY root ORDER BY edge_id) AS pos, edge_id, src_id, dst_id, type FROM m{h} WHERE NOT held AND target IS NOT NULL AND NOT coalesce(hidden, false) AND root IN (FROM g{h}) QUALIFY pos <= {4 * COLLAPSE}),
s{h} AS MATERIALIZED (FROM s{h - 1} UNION ALL SELECT root, id, false FROM n{h} WHERE root IN (FROM g{h})), f{h} AS MATERIALIZED (SELECT root, id FROM n{h} WHERE pos <= {FRONTIER} AND root IN (FROM g{h}))"""


LAST = DEPTH + 1
WALK = f"""{GRAPH}, i AS (SELECT DISTINCT file_path, dst_name FROM e JOIN entities ON id = src_id WHERE e.type IN ('IMPORTS', 'IMPORTS_MODULE') AND resolution = 'unresolved'),
k AS MATERIALIZED (SELECT edge_id, src_id, dst_id, type, dst_id IS NULL AND (SELECT file_path FROM entities WHERE id = src_id) || '|' || dst_name IN (SELECT file_path || '|' || dst_name FROM i) AS external FROM e WHERE type = 'CALL'),
f0 AS MATERIALIZED (SELECT {CUSTOMER} + c_custkey AS root, {CUSTOMER} + c_custkey AS id FROM customer WHERE {ROOTS} UNION SELECT {CUSTOMER} + o_custkey, {ORDER} + o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE {ROOTS}),
s0 AS (SELECT root, id, true AS member FROM f0), {', '.join(map(_layer, range(1, DEPTH + 1)))},
m{LAST} AS (SELECT f.root, edge_id, k.src_id, CASE WHEN s.member THEN f.root ELSE s.id END AS dst_id, k.type, true AS back FROM f{DEPTH} f JOIN k ON k.src_id = f.id JOIN s{DEPTH} s ON s.root = f.root AND s.id = k.dst_id),
b AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT root, {h} AS layer, edge_id, src_id, dst_id, type FROM m{h} WHERE back' for h in range(1, LAST + 1))}) QUALIFY row_number() OVER (PARTITION BY root, src_id, dst_id, type ORDER BY layer, edge_id) = 1),
y AS (SELECT root, layer, row_number() OVER (PARTITION BY root ORDER BY layer, edge_id) AS pos, edge_id, src_id, dst_id, type FROM b QUALIFY pos <= {4 * COLLAPSE})"""
SQL = {
    "layer_edges": with_relations("entities edges", f"{WALK} {' UNION ALL '.join(f'''SELECT *, 'on' AS leads FROM l{h}''' for h in range(1, DEPTH + 1))} UNION ALL SELECT *, 'back' FROM y"),
    "layer_summary": with_relations("entities edges", f"""{WALK} SELECT *, CASE WHEN nodes = 0 THEN 'end' WHEN collapsed THEN 'collapsed' END AS stopped FROM ({' UNION ALL '.join(f'FROM o{h}' for h in range(1, DEPTH + 1))})"""),
    "layer_alternatives": with_relations("entities edges", f"""{GRAPH}, r AS (SELECT 100 + n_nationkey AS root, 100 + n_nationkey AS id FROM nation UNION SELECT 100 + c_nationkey, {CUSTOMER} + c_custkey FROM customer UNION SELECT 100 + s_nationkey, {SUPPLIER} + s_suppkey FROM supplier UNION SELECT 100 + c_nationkey, {ORDER} + o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
t AS (SELECT 'down' AS direction, src_id AS a, dst_id AS b, type FROM e WHERE type <> 'CALL' UNION ALL SELECT 'up', dst_id, src_id, type FROM e)
SELECT root, direction, CASE type WHEN 'CALL' THEN 'control' WHEN 'READS' THEN 'data' ELSE 'includes' END AS kind, count(DISTINCT b) AS n FROM t JOIN r ON r.id = a WHERE (root, b) NOT IN (FROM r) AND b NOT IN (SELECT id FROM entities WHERE type = 'part' AND source_id = 4) AND b IS NOT NULL GROUP BY ALL"""),
}
