"""Queries of traversals and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import graph, intervals
from korpusgraf.sources.adapter import ORDER, PART, SUPPLIER, chunks, edges, entities, table, with_relations, writes

START = ORDER + 1


def start(s):
    return s.createDataFrame([(START,)], "id long")


def hunks(s, d):
    """One range of changed lines for each event, in the files of parts."""
    p = "concat('Brand#', 1 + event_id % 5, 1 + user_id % 5, '/', element_at(array('STANDARD', 'PROMO', 'SMALL', 'LARGE', 'ECONOMY', 'MEDIUM'), cast(event_id % 6 + 1 as int)))"
    return table(s, d, "events").selectExpr("event_id as hunk_id", f"{p} as file_path", "cast(event_id % 480 as int) as start_line", "cast(event_id % 480 + user_id % 7 as int) as end_line")


def linked(s, d):
    """The edges, and from each part a call to the next one, so that walks go on."""
    return edges(s, d).union(table(s, d, "part").selectExpr("concat('p', p_partkey)", f"{PART} + p_partkey", f"{PART} + p_partkey + 1", "p_name", "case when p_size % 2 = 0 then 'CALL' else 'USES' end", "'resolved'", "p_size"))


def hits(s, d, of=intervals.overlapping):
    return of(hunks(s, d), entities(s, d).where("type = 'part'"))


QUERIES = {
    "reach_both": lambda s, d: graph.reach(edges(s, d), start(s), 3),
    "reach_in_writes": lambda s, d: graph.reach(writes(s, d), s.createDataFrame([(PART + 7,)], "id long"), 1, "in"),
    "focus_subgraph": lambda s, d: graph.focus(edges(s, d), entities(s, d), start(s), ["CALL", "COPY"], 2, None),
    "ancestors": lambda s, d: graph.with_ancestors(entities(s, d).where("type = 'order'"), entities(s, d)),
    "shortest_paths": lambda s, d: graph.shortest_paths(edges(s, d).union(edges(s, d).selectExpr("concat('r', edge_id)", "dst_id", "src_id", "dst_name", "type", "resolution", "line")).where("src_id is not null"), start(s), 2).select("id", "hop", F.array_join("path", ">").alias("path")),
    "call_flow": lambda s, d: graph.call_flow(linked(s, d), entities(s, d).where("type = 'order'").select("id"), 2, 3),
    "impact": lambda s, d: graph.impact(edges(s, d), entities(s, d), s.createDataFrame([(PART + 1,), (PART + 17,)], "id long")),
    "grouped_neighbours": lambda s, d: graph.grouped_neighbours(edges(s, d), entities(s, d), PART + 5),
    "neighbour_page": lambda s, d: graph.page(edges(s, d).where(f"src_id = {START} or dst_id = {PART + 5}").select("edge_id", "type"), "edge_id", "1", 20),
    "shared_targets": lambda s, d: graph.shared_targets(writes(s, d), s.createDataFrame([(SUPPLIER + 3,)], "id long")),
    "graphml_lines": lambda s, d: graph.to_graphml(entities(s, d), writes(s, d)),
    "cypher_lines": lambda s, d: graph.to_cypher(entities(s, d), edges(s, d)),
    "edge_csv_lines": lambda s, d: graph.to_csv_lines(edges(s, d).withColumn("note", F.concat("type", F.lit(', "'), "line")), ["edge_id", "dst_id", "dst_name", "note"]),
    "overlapping_entities": lambda s, d: hits(s, d, lambda h, e: intervals.overlapping(h, e, 16, by_cell=True)).select("hunk_id", "id", "size"),
    "innermost_entities": lambda s, d: hits(s, d, intervals.innermost_of),
    "smallest_unique_entity": lambda s, d: hits(s, d, intervals.smallest_unique_of),
    "line_window": lambda s, d: intervals.line_window(chunks(s, d), 2, 4),
}
UND = "step AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE dst_id IS NOT NULL UNION SELECT dst_id, src_id FROM edges WHERE dst_id IS NOT NULL)"
HITS = """hunks AS (SELECT event_id AS hunk_id, 'Brand#' || (1 + event_id % 5) || (1 + user_id % 5) || '/' || ['STANDARD', 'PROMO', 'SMALL', 'LARGE', 'ECONOMY', 'MEDIUM'][event_id % 6 + 1] AS file_path, event_id % 480 AS a, event_id % 480 + user_id % 7 AS b FROM events),
hits AS (SELECT hunk_id, id, start_line, end_line, end_line - start_line AS size FROM hunks JOIN entities USING (file_path) WHERE type = 'part' AND start_line <= b AND end_line >= a)"""
WALK = f"walk AS (SELECT CAST({START} AS BIGINT) AS id, 0 AS hop UNION SELECT b, hop + 1 FROM walk JOIN step ON a = id WHERE hop < "
SQL = {
    "reach_both": with_relations("edges", f"{UND}, {WALK} 3) SELECT id, min(hop) AS hop FROM walk GROUP BY id"),
    "reach_in_writes": with_relations("writes", f"SELECT CAST({PART + 7} AS BIGINT) AS id, 0 AS hop UNION ALL SELECT DISTINCT src_id, 1 FROM writes WHERE dst_id = {PART + 7}"),
    "focus_subgraph": with_relations("edges entities", f"""typed AS (SELECT * FROM edges WHERE type IN ('CALL', 'COPY') AND dst_id IS NOT NULL), step AS (SELECT src_id AS a, dst_id AS b FROM typed UNION SELECT dst_id, src_id FROM typed), {WALK} 2),
nodes AS (SELECT DISTINCT id FROM walk), up AS (SELECT id FROM nodes UNION SELECT parent_id FROM up JOIN entities USING (id) WHERE parent_id IS NOT NULL)
SELECT DISTINCT src_id, dst_id, type FROM typed WHERE src_id IN (SELECT id FROM nodes) AND dst_id IN (SELECT id FROM nodes) UNION ALL SELECT parent_id, id, 'CONTAINS' FROM entities WHERE parent_id IN (SELECT id FROM up) AND id IN (SELECT id FROM up)"""),
    "ancestors": with_relations("entities", "up AS (SELECT id FROM entities WHERE type = 'order' UNION SELECT parent_id FROM up JOIN entities USING (id) WHERE parent_id IS NOT NULL) SELECT id FROM up"),
    "shortest_paths": with_relations("edges", f"""both_ AS (SELECT edge_id, src_id, dst_id FROM edges WHERE dst_id IS NOT NULL UNION ALL SELECT 'r' || edge_id, dst_id, src_id FROM edges WHERE dst_id IS NOT NULL), step AS (SELECT src_id, dst_id, min(edge_id) AS e FROM both_ GROUP BY ALL),
one AS (SELECT dst_id AS id, e AS path FROM step WHERE src_id = {START}), two AS (SELECT step.dst_id AS id, arg_min(path || '>' || e, e) AS path FROM one JOIN step ON src_id = one.id WHERE step.dst_id <> {START} AND step.dst_id NOT IN (SELECT id FROM one) GROUP BY 1)
SELECT CAST({START} AS BIGINT) AS id, 0 AS hop, '' AS path UNION ALL SELECT id, 1, path FROM one UNION ALL SELECT id, 2, path FROM two"""),
    "call_flow": with_relations("edges", f"""linked AS (SELECT edge_id, src_id, dst_id, type, resolution, line FROM edges UNION ALL SELECT 'p' || p_partkey, {PART} + p_partkey, {PART} + p_partkey + 1, CASE WHEN p_size % 2 = 0 THEN 'CALL' ELSE 'USES' END, 'resolved', p_size FROM part),
best AS (SELECT edge_id, src_id, dst_id FROM linked WHERE dst_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY CASE WHEN type = 'CALL' THEN 0 WHEN type = 'READS' THEN 1 ELSE 2 END, CASE resolution WHEN 'resolved' THEN 0 ELSE 1 END, line, edge_id) <= 3),
one AS (SELECT *, 1 AS hop FROM best WHERE src_id >= {ORDER}) SELECT * FROM one UNION ALL SELECT *, 2 FROM best WHERE src_id IN (SELECT dst_id FROM one)"""),
    "impact": with_relations("edges entities", f"""s AS (SELECT unnest([{PART + 1}, {PART + 17}]) AS id), one AS (SELECT DISTINCT src_id AS id FROM edges WHERE resolution = 'resolved' AND dst_id IN (SELECT id FROM s))
SELECT id, 'edge' AS via, 1 AS hop FROM one UNION ALL SELECT DISTINCT src_id, 'name', 1 FROM edges WHERE resolution = 'unresolved' AND lower(dst_name) IN (SELECT lower(name) FROM entities WHERE id IN (SELECT id FROM s))"""),
    "grouped_neighbours": with_relations("edges", f"SELECT 'in' AS direction, type, count(DISTINCT src_id) AS neighbours, count(*) AS edges FROM edges WHERE dst_id = {PART + 5} GROUP BY type"),
    "neighbour_page": with_relations("edges", f"SELECT edge_id, type, (SELECT count(*) FROM edges WHERE (src_id = {START} OR dst_id = {PART + 5}) AND edge_id > '1') > 20 AS has_more FROM edges WHERE (src_id = {START} OR dst_id = {PART + 5}) AND edge_id > '1' ORDER BY edge_id LIMIT 20"),
    "shared_targets": with_relations("writes", f"SELECT dst_id, count(DISTINCT src_id) AS users, 'WRITES' AS kinds FROM writes WHERE dst_id IN (SELECT dst_id FROM writes WHERE src_id = {SUPPLIER + 3}) GROUP BY 1 HAVING users > 1"),
    "graphml_lines": with_relations("entities writes", """SELECT 1 AS nr, CAST(id AS VARCHAR) AS id, '<node id="n' || id || '"><data key="name">' || name || '</data></node>' AS line FROM entities
UNION ALL SELECT 2, src_id || ':' || dst_id || ':WRITES', '<edge source="n' || src_id || '" target="n' || dst_id || '"><data key="type">WRITES</data></edge>' FROM writes
UNION ALL SELECT * FROM (VALUES (0, '0', '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (0, '1', '<key id="name" for="node" attr.name="name" attr.type="string"/>'),
  (0, '2', '<key id="type" for="edge" attr.name="type" attr.type="string"/>'), (0, '3', '<graph edgedefault="directed">'), (3, '0', '</graph>'), (3, '1', '</graphml>'))"""),
    "cypher_lines": with_relations("entities edges", """SELECT 1 AS nr, 'MERGE (n:Entity {id: ' || id || '}) SET n.name = ''' || name || ''';' AS line FROM entities
UNION ALL SELECT 2, 'MATCH (a:Entity {id: ' || src_id || '}), (b:Entity {id: ' || dst_id || '}) MERGE (a)-[:EDGE {type: ''' || type || '''}]->(b);' FROM edges WHERE dst_id IS NOT NULL"""),
    "edge_csv_lines": with_relations("edges", """SELECT edge_id || ',' || coalesce(CAST(dst_id AS VARCHAR), '') || ',' || dst_name || ',"' || type || ', ""' || line || '"' AS line FROM edges"""),
    "overlapping_entities": with_relations("entities", f"{HITS} SELECT hunk_id, id, size FROM hits"),
    "innermost_entities": with_relations("entities", f"{HITS} SELECT hunk_id, id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.hunk_id = h.hunk_id AND o.start_line >= h.start_line AND o.end_line <= h.end_line AND o.size < h.size)"),
    "smallest_unique_entity": with_relations("entities", f"{HITS}, m AS (SELECT * FROM hits QUALIFY size = min(size) OVER (PARTITION BY hunk_id)) SELECT hunk_id, min(id) AS id FROM m GROUP BY 1 HAVING count(*) = 1"),
    "line_window": with_relations("chunks", "l AS (SELECT chunk_id, string_split(content, chr(10)) AS l FROM chunks) SELECT chunk_id, CAST(i AS INT) AS line, l[i] AS content_line FROM l, (SELECT unnest([2, 3, 4]) AS i) WHERE i <= len(l)"),
}
