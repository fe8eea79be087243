"""Queries of control flow: cycles of jumps, long rings, and the walk over a process."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import cycles, process, slices
from korpusgraf.plans.change_queries import jumps
from korpusgraf.sources.adapter import CUSTOMER, ORDER, PART, edges, entities, table, with_relations

BLOCK = 20_000_000
RING, HOPS, EDGE_LIMIT = 23, 3, 60


def rings(s, d):
    """Each part leads to the next of its run of RING parts, in two runs of three back to the first, and to the part RING further on."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("p"))
    after = p.selectExpr("p as src", f"case when p % {RING} < {RING - 1} then p + 1 when p div {RING} % 3 > 0 then p - {RING - 1} end as dst").union(p.selectExpr("p", f"p + {RING}"))
    return after.where("dst is not null").join(p.withColumnRenamed("p", "dst"), "dst", "left_semi").select("src", "dst")


def steps(s, d):
    """Edges and entities with a block in each finished order; a block of an urgent order returns, others call the order's customer."""
    o = table(s, d, "orders").where("o_orderstatus = 'F'")
    urgent = "o_orderpriority like '1%'"
    e = edges(s, d).selectExpr("edge_id", "src_id", "dst_id", "type", "resolution", "line % 2 = 0 as loop", "type = 'READS' and line > 4 as guarded")
    e = e.union(o.selectExpr("concat('c', o_orderkey)", f"{ORDER} + o_orderkey", f"{BLOCK} + o_orderkey", "'CONTAINS'", "'resolved'", "false", "false"))
    e = e.union(o.where(f"not {urgent}").selectExpr("concat('d', o_orderkey)", f"{BLOCK} + o_orderkey", f"{CUSTOMER} + o_custkey", "'CALL'", "'resolved'", "false", "false"))
    nodes = entities(s, d).select("id", "type", F.lit(None).cast("string").alias("operation")).union(o.selectExpr(f"{BLOCK} + o_orderkey", "'exec_block'", f"case when {urgent} then 'RETURN' else 'LINK' end"))
    return e, nodes


def walked(s, d):
    roots = table(s, d, "part").where("p_brand = 'Brand#7'").select((F.col("p_partkey") + PART).alias("id"))
    return process.walk(*steps(s, d), roots, "both", HOPS, 5_000, EDGE_LIMIT)


LINE = "l_orderkey % 200"
OPERATION = "case l_linenumber % 3 when 0 then 'MOVE' when 1 then 'STRING' else 'COMPUTE' end"
DEPTH, MOST = 5, 10


def sliced(s, d):
    """Statements of suppliers' units write and read parts; rows of tables set parts of fifth lines; small parts are parameters that orders give."""
    line = table(s, d, "lineitem").withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long")))
    one = ["cast(l_suppkey as string) as unit", f"{OPERATION} as operation", f"cast({LINE} as int) as line", "concat('F', l_partkey) as field"]
    writes = line.where("l_returnflag = 'R'").selectExpr("id as write_id", *one)
    reads = line.where("l_returnflag = 'A'").selectExpr(*one, "l_linestatus = 'F' as source")
    flows = line.where("l_returnflag = 'N' and l_linenumber = 5").selectExpr("id as row_id", "concat('T', l_suppkey) as unit", f"cast({LINE} as int) as line", "'assign' as operation", "concat('F', l_partkey) as field", "array(concat('F', l_orderkey), concat('F', l_suppkey)) as sources")
    parameters = table(s, d, "part").where("p_size < 5").selectExpr("concat('F', p_partkey) as field", "concat('r', p_size) as routine", "p_size % 2 as position")
    calls = table(s, d, "orders").selectExpr("o_orderkey as call_id", "concat('r', o_custkey % 5) as routine", "concat('c', o_custkey) as caller", "cast(o_orderkey % 90 as int) as line", "o_orderstatus = 'P' as test", "array(concat('x', o_custkey), 'y') as arguments", "array(concat('F', o_custkey), cast(null as string)) as refs")
    steps = slices.statement_steps(writes, reads).unionByName(slices.table_steps(flows)).unionByName(slices.argument_steps(parameters, calls))
    starts = table(s, d, "part").where("p_brand in ('Brand#3', 'Brand#4')").selectExpr("concat('F', p_partkey) as field")
    return slices.backward_slice(starts, steps, depth=DEPTH, most=MOST)


QUERIES = {
    "backward_slice": sliced,
    "branches_and_cycles": lambda s, d: cycles.branches_and_cycles(jumps(s, d)),
    "strong_components": lambda s, d: cycles.strong_components(rings(s, d)),
    "process_walk": lambda s, d: walked(s, d)[0],
    "process_walk_limits": lambda s, d: walked(s, d)[1].select("root", "nodes", "steps", "omitted_steps", "reasons"),
}


def _hop(h: int) -> str:
    """The tables of hop h: touched edges, those within the budget, steps with blocks replaced by their calls, steps so far and the next frontier."""
    before = " UNION ALL ".join(f"SELECT root, edge_id FROM s{i}" for i in range(1, h)) or "SELECT NULL AS root, NULL AS edge_id LIMIT 0"
    return f"""a{h} AS MATERIALIZED ({before}), n{h} AS (SELECT root, count(*) AS used FROM a{h} GROUP BY root),
t{h} AS (SELECT root, k.* FROM f{h - 1} JOIN k ON src_id = node UNION SELECT root, k.* FROM f{h - 1} JOIN k ON dst_id = node),
r{h} AS MATERIALIZED (SELECT t.*, coalesce(used, 0) AS used, row_number() OVER (PARTITION BY t.root ORDER BY edge_id) AS nr, count(*) OVER (PARTITION BY t.root) AS n FROM t{h} t LEFT JOIN n{h} n ON n.root = t.root),
x{h} AS (SELECT r.root, r.src_id, coalesce(i.edge_id, r.edge_id) AS edge_id, CASE WHEN i.edge_id IS NULL THEN r.dst_id ELSE i.dst_id END AS dst_id, CASE WHEN i.edge_id IS NOT NULL THEN i.kind WHEN b.id IS NOT NULL AND f.node IS NOT NULL THEN CASE WHEN b.operation IN ('RETURN', 'ABEND') THEN 'exit' ELSE 'step' END ELSE r.kind END AS kind,
  coalesce(i.certainty, r.certainty) AS certainty, nr, i.edge_id AS inner_id, used FROM r{h} r LEFT JOIN f{h - 1} f ON f.root = r.root AND f.node = r.src_id LEFT JOIN b ON b.id = r.dst_id AND r.type = 'CONTAINS' LEFT JOIN i ON i.block = b.id AND f.node IS NOT NULL WHERE used + nr <= {EDGE_LIMIT}),
s{h} AS MATERIALIZED (SELECT root, {h} AS hop, used + row_number() OVER (PARTITION BY root ORDER BY nr, inner_id) AS pos, edge_id, src_id, dst_id, kind, certainty FROM (SELECT *, row_number() OVER (PARTITION BY root, edge_id ORDER BY nr, inner_id) AS c FROM x{h} WHERE (root, edge_id) NOT IN (FROM a{h})) WHERE c = 1),
f{h} AS MATERIALIZED (SELECT root, src_id AS node FROM s{h} WHERE dst_id IS NOT NULL UNION SELECT root, dst_id FROM s{h} WHERE dst_id IS NOT NULL EXCEPT FROM f{h - 1})"""


WALK = f"""b AS (SELECT {BLOCK} + o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'RETURN' ELSE 'LINK' END AS operation, {CUSTOMER} + o_custkey AS customer, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
y AS (SELECT edge_id, src_id, dst_id, type, resolution, line % 2 = 0 AS loop, type = 'READS' AND line > 4 AS guarded FROM edges UNION ALL SELECT 'c' || o_orderkey, {ORDER} + o_orderkey, id, 'CONTAINS', 'resolved', false, false FROM b UNION ALL SELECT 'd' || o_orderkey, id, customer, 'CALL', 'resolved', false, false FROM b WHERE operation = 'LINK'),
k AS MATERIALIZED (SELECT edge_id, src_id, dst_id, type, CASE WHEN type = 'CALL' AND resolution <> 'resolved' THEN 'external_call' WHEN type = 'READS' THEN 'data_access' WHEN loop THEN 'iteration' ELSE 'call' END AS kind,
  CASE WHEN resolution = 'dynamic' THEN 'possible' WHEN resolution <> 'resolved' THEN 'unresolved' WHEN guarded THEN 'possible' ELSE 'certain' END AS certainty FROM y WHERE type IN ('CALL', 'READS', 'CONTAINS')),
i AS (SELECT src_id AS block, edge_id, dst_id, kind, certainty FROM k WHERE type = 'CALL' AND src_id IN (SELECT id FROM b)),
f0 AS (SELECT {PART} + p_partkey AS root, {PART} + p_partkey AS node FROM part WHERE p_brand = 'Brand#7'), {', '.join(map(_hop, range(1, HOPS + 1)))},
s AS ({' UNION ALL '.join(f'FROM s{h}' for h in range(1, HOPS + 1))})"""


def _level(h: int) -> str:
    seen = " UNION ALL ".join(f"SELECT start, field FROM f{i}" for i in range(h))
    before = " UNION ALL ".join(f"SELECT start FROM m{i}" for i in range(1, h)) or "SELECT CAST(NULL AS VARCHAR) AS start WHERE false"
    return f"""n{h} AS (SELECT start, count(*) AS n FROM ({before}) GROUP BY start),
m{h} AS MATERIALIZED (SELECT * FROM (SELECT f.start, coalesce(n, 0) + row_number() OVER (PARTITION BY f.start ORDER BY place, kind, s.nr) AS nr, {h} AS level, f.field, unit, line, operation, reads, follows FROM f{h - 1} f JOIN s ON s.field = f.field LEFT JOIN n{h} n ON n.start = f.start) WHERE nr <= {MOST}),
g{h} AS (SELECT start, nr, unnest(follows) AS field, generate_subscripts(follows, 1) AS p FROM m{h}),
f{h} AS MATERIALIZED (SELECT start, field, row_number() OVER (PARTITION BY start ORDER BY min((nr, p))) AS place FROM g{h} WHERE (start, field) NOT IN ({seen}) AND start NOT IN (SELECT start FROM ({before} UNION ALL SELECT start FROM m{h}) GROUP BY start HAVING count(*) >= {MOST}) GROUP BY start, field)"""


LINES = "SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, *"
SLICE = f"""WITH l AS ({LINES}, CAST(l_suppkey AS VARCHAR) AS unit, CASE l_linenumber % 3 WHEN 0 THEN 'MOVE' WHEN 1 THEN 'STRING' ELSE 'COMPUTE' END AS operation, CAST({LINE} AS INT) AS line, 'F' || l_partkey AS field FROM lineitem),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY line, id) AS nr FROM l WHERE l_returnflag = 'R') WHERE nr <= 4),
o AS (SELECT w.id, list_sort(list(DISTINCT r.field)) AS reads FROM w JOIN l r ON r.l_returnflag = 'A' AND r.unit = w.unit AND r.operation = w.operation AND r.field <> w.field AND (CASE w.operation WHEN 'MOVE' THEN r.line = w.line WHEN 'STRING' THEN r.l_linestatus = 'F' AND r.line BETWEEN w.line - 25 AND w.line ELSE r.l_linestatus = 'F' AND r.line BETWEEN w.line AND w.line + 2 END) GROUP BY w.id),
t AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY 'T' || l_suppkey, line, id) AS nr FROM l WHERE l_returnflag = 'N' AND l_linenumber = 5),
p AS (SELECT 'F' || p_partkey AS field, 'c' || o_custkey AS unit, CAST(o_orderkey % 90 AS INT) AS line, CASE p_size % 2 WHEN 0 THEN 'x' || o_custkey ELSE 'y' END AS argument, CASE p_size % 2 WHEN 0 THEN ['F' || o_custkey] ELSE [] END AS refs, row_number() OVER (PARTITION BY p_partkey ORDER BY o_orderstatus = 'P', o_orderkey) AS nr FROM part JOIN orders ON o_custkey % 5 = p_size WHERE p_size < 5),
s AS MATERIALIZED (SELECT w.field, 0 AS kind, nr, unit, line, operation, coalesce(reads, []) AS reads, coalesce(reads, []) AS follows FROM w LEFT JOIN o ON o.id = w.id
  UNION ALL SELECT field, 1, nr, 'T' || l_suppkey, line, 'assign', ['F' || l_orderkey, 'F' || l_suppkey], list_filter(CASE WHEN l_orderkey = l_suppkey THEN ['F' || l_suppkey] ELSE ['F' || l_orderkey, 'F' || l_suppkey] END, lambda x: x <> field) FROM t WHERE nr <= 4
  UNION ALL SELECT field, 2, nr, unit, line, 'argument', [argument], refs FROM p WHERE nr <= 4),
f0 AS (SELECT 'F' || p_partkey AS start, 'F' || p_partkey AS field, 1 AS place FROM part WHERE p_brand IN ('Brand#3', 'Brand#4')), {', '.join(map(_level, range(1, DEPTH + 1)))}
SELECT start, nr, level, field, unit, line, operation, array_to_string(reads, ',') AS reads FROM ({' UNION ALL '.join(f'FROM m{h}' for h in range(1, DEPTH + 1))})"""
CUT = " UNION ALL ".join(f"SELECT root, max(n - ({EDGE_LIMIT} - used)) AS omitted FROM r{h} WHERE used < {EDGE_LIMIT} GROUP BY root HAVING max(n - ({EDGE_LIMIT} - used)) > 0 UNION ALL SELECT DISTINCT f.root, 0 FROM f{h - 1} f JOIN n{h} n ON n.root = f.root WHERE used >= {EDGE_LIMIT}" for h in range(1, HOPS + 1))
SQL = {
    "backward_slice": SLICE,
    "branches_and_cycles": """WITH RECURSIVE j AS (SELECT DISTINCT l_suppkey AS unit, l_partkey % 9 AS src, CAST(l_quantity AS INT) % 3 AS line, l_orderkey % 9 AS dst FROM lineitem),
walk AS (SELECT unit, src AS a, dst AS b FROM j UNION SELECT w.unit, a, dst FROM walk w JOIN j ON j.unit = w.unit AND src = b), n AS (SELECT unit, src, line, count(DISTINCT dst) AS n FROM j GROUP BY ALL)
SELECT j.*, n >= 2 AS is_branch, src = dst OR EXISTS (SELECT 1 FROM walk WHERE walk.unit = j.unit AND a = dst AND b = src) AS is_cycle FROM j JOIN n USING (unit, src, line)""",
    "strong_components": f"SELECT p_partkey AS node, p_partkey // {RING} * {RING} AS component FROM part WHERE p_partkey // {RING} % 3 > 0 AND p_partkey // {RING} < (SELECT count(*) FROM part) // {RING}",
    "process_walk": with_relations("edges", f"{WALK} FROM s"),
    "process_walk_limits": with_relations("edges", f"""{WALK}, o AS (SELECT root, CAST(sum(omitted) AS BIGINT) AS omitted_steps FROM ({CUT}) GROUP BY root), e AS (SELECT root, src_id AS node FROM s UNION SELECT root, dst_id FROM s WHERE dst_id IS NOT NULL UNION FROM f0),
m AS (SELECT root, count(*) AS nodes FROM e GROUP BY root), c AS (SELECT root, count(*) AS steps FROM s GROUP BY root)
SELECT m.root, nodes, coalesce(steps, 0) AS steps, coalesce(omitted_steps, 0) AS omitted_steps, CASE WHEN o.root IS NULL THEN '' ELSE 'edge_limit' END AS reasons FROM m LEFT JOIN c ON c.root = m.root LEFT JOIN o ON o.root = m.root"""),
}
