"""Queries of results put together from several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import assembly as A
from korpusgraf.operators import graph
from korpusgraf.plans.graph_queries import HITS, hunks, linked
from korpusgraf.plans.rollup_queries import PAIRS, pairs
from korpusgraf.sources.adapter import ORDER, PART, SUPPLIER, chunks, edges, entities, table, with_relations


def of(s, d, kind):
    return entities(s, d).where(f"type = '{kind}'")


def entry(s, d):
    programs = table(s, d, "customer").selectExpr("c_custkey as id", "c_custkey % 2 as source_id", "concat('v', c_custkey % 3) as variant", "concat('f', c_custkey % 50) as file_path", "c_custkey % 200 as start_line", "c_custkey % 200 + 60 as end_line")
    paragraphs = table(s, d, "part").selectExpr("p_partkey as id", "p_partkey % 2 as source_id", "concat('v', p_size % 3) as variant", "concat('f', p_partkey % 50) as file_path", "p_partkey % 230 as start_line", "p_partkey % 230 + 5 as end_line")
    return A.entry_paragraphs(programs, paragraphs)


def places(s, d):
    """A chunk for each event, in the files of parts."""
    return hunks(s, d).withColumnRenamed("hunk_id", "chunk_id")


def parts(s, d):
    return of(s, d, "part").withColumn("end_line", F.when(F.col("id") % 9 > 0, F.col("end_line")))


def doc_links(s, d):
    """A link for each event between a part and a document."""
    return table(s, d, "events").selectExpr(f"{PART} + 1 + event_id % 150 as id", "event_id % 200 as chunk_id", "case when event_id % 3 = 0 then 'approved' else 'pending' end as status")


def package(s, d):
    impact = graph.impact(edges(s, d), entities(s, d), s.createDataFrame([(PART + 1,), (PART + 17,)], "id long"))
    return A.change_package(impact, entities(s, d), edges(s, d).union(back(s, d)), doc_links(s, d).withColumn("id", F.col("id") - PART + ORDER), chunks(s, d), F.col("id") % 5 == 0, [("^orders/1", "one"), ("^orders/[2-9]", "rest")])


def back(s, d):
    """Calls into orders, from the part of the same number."""
    return table(s, d, "orders").selectExpr("concat('b', o_orderkey)", f"{PART} + o_orderkey % 200", f"{ORDER} + o_orderkey", "'x'", "'CALL'", "'resolved'", "1")


def steps(s, d):
    e = edges(s, d).withColumn("loop", F.col("line") % 2 == 0)
    return A.process_steps(e, of(s, d, "order").select("id"), 3)


def falls(s, d):
    return A.fall_through_steps(of(s, d, "part").select("id", "file_path", "start_line"), table(s, d, "lineitem").where("l_suppkey % 4 = 0").selectExpr(f"{PART} + l_partkey as id", "l_linenumber > 1 as conditional"))


def knowledge(s, d):
    return table(s, d, "nation").selectExpr("concat('k', n_regionkey) as a", "concat('k', n_nationkey) as b")


def overview(s, d):
    links = table(s, d, "events").selectExpr("concat('doc', event_id % 30) as document", "concat('3:orders/', user_id) as file_path")
    return A.overview_graph(pairs(s, d), links, knowledge(s, d), 200)


def degrees(s, d):
    shown = table(s, d, "lineitem").selectExpr("case when l_linenumber < 4 then 'file' else 'document' end as kind", "concat('f', l_partkey % 90) as a", "concat('f', l_suppkey % 40) as b")
    return A.overview_degrees(shown, table(s, d, "supplier").selectExpr("concat('f', s_suppkey) as file", "s_suppkey * 3 as degree"))


def cover(s, d):
    return A.greedy_cover(table(s, d, "lineitem").selectExpr("l_suppkey as item", "l_partkey % 40 as word", "1.0 as weight", "0.5 as base").distinct(), 4)


def packs(s, d):
    t = table(s, d, "documents").selectExpr("source as pack", "doc_id as item", "doc_id % 5 as rank", "text")
    return A.fitted(t.where("text is not null"), 6_000, [2_000, 500, 200, 60]).select("pack", "item", F.char_length("text").alias("chars"))


def context(s, d):
    hits = table(s, d, "events").selectExpr("event_type as scope", "event_id as id", "event_id * 37 % 101 as score")
    return A.scoped_hits(hits, {"click": 4, "view": 4, "error": 2}, 6, table(s, d, "events").selectExpr("event_id as a", "event_id * 7 % 1000 as b"))


def answers(s, d):
    claims = table(s, d, "events").selectExpr("user_id % 90 as answer_id", f"case when event_id % 2 = 0 then {SUPPLIER} + event_id % 10 end as src_id", "case when event_id % 2 = 0 then 'WRITES' end as type", f"case when event_id % 2 = 0 then {PART} + event_id % 200 end as dst_id", "case when event_id % 3 = 0 then concat('f', event_id % 7) end as path", "case when event_id % 3 = 0 then event_id % 50 end as line")
    known = table(s, d, "lineitem").selectExpr(f"{SUPPLIER} + l_suppkey as src_id", f"{PART} + l_partkey as dst_id", "'WRITES' as type").distinct()
    evidence = table(s, d, "customer").selectExpr("c_custkey % 90 as answer_id", "concat('f', c_custkey % 7) as path", "c_custkey % 30 as start_line", "c_custkey % 30 + 20 as end_line")
    return A.checked_answers(claims, known, evidence)


def about(s, d):
    gaps = edges(s, d).where("resolution = 'unresolved'").groupBy(F.col("dst_name").alias("path")).agg(F.count("*").alias("open_edges"))
    return A.project_overview(entities(s, d), pairs(s, d), gaps)


def tallies(s, d):
    t = "concat('see Order', event_id % 9, 'Form.java and com.acme.Order', event_id % 9, 'Form or order', event_id % 5, ' OrderList org.x.y.Thing word')"
    return A.name_tallies(table(s, d, "events").selectExpr("event_id as id", f"{t} as text"))


def references(s, d):
    links = table(s, d, "events").selectExpr("event_id as link_id", f"case when event_id % 2 = 0 then {PART} + event_id % 300 end as a_entity", "case when event_id % 2 = 1 then event_id % 250 end as a_chunk", f"case when event_id % 3 = 0 then {SUPPLIER} + event_id % 20 end as b_entity", "case when event_id % 3 > 0 then event_id % 210 end as b_chunk")
    return A.project_references(links, chunks(s, d), entities(s, d))


def bindings(s, d):
    f = table(s, d, "events").selectExpr("event_id as id", "to_json(array(named_struct('source_id', user_id % 15, 'version', event_type), named_struct('source_id', event_id % 12, 'version', 'v1'))) as bindings")
    return A.bound_sources(f, table(s, d, "supplier").selectExpr("s_suppkey as source_id", "concat('v', s_nationkey % 3) as version"))


def current(s, d):
    files = table(s, d, "part").selectExpr("p_partkey as path", "concat('h', p_size % 4) as fingerprint", "case when p_partkey % 9 = 0 then 'bad' end as error", "case when p_partkey % 4 = 0 then 10 else 20 end as size_limit")
    return A.analysis_is_current(files, table(s, d, "events").selectExpr("event_id as path", "concat('h', event_id % 4) as fingerprint", "20 as size_limit"))


def swapped(s, d):
    t = table(s, d, "documents").selectExpr("doc_id", "doc_id as embedding", "'old' as embedding_model", "case when doc_id >= 0 then doc_id + 1 end as embedding_next", "'new' as embedding_next_model")
    return A.swapped_vectors(t, "new")


def operands(s, d):
    at = "l_orderkey as unit, case l_suppkey % 3 when 0 then 'MOVE' when 1 then 'STRING' else 'ADD' end as operation, l_linenumber + l_orderkey % 2 as line, l_partkey as field".split(", ")
    t = table(s, d, "lineitem")
    return A.operand_origins(t.where("l_returnflag = 'R'").selectExpr(*at).distinct(), t.where("l_returnflag <> 'R'").selectExpr(*at).distinct())


def arguments(s, d):
    parameters = table(s, d, "part").selectExpr("p_partkey as parameter", "p_partkey div 3 as routine", "cast(p_partkey % 3 as int) as position")
    calls = table(s, d, "events").selectExpr("event_id as call_id", "user_id % 60 as routine", "concat('p', event_id % 4) as path", "slice(array(concat('a', event_id), 'b', 'c'), 1, cast(event_id % 4 as int)) as arguments")
    return A.argument_origins(parameters, calls, F.col("path") == "p0")


def shared(s, d):
    t = table(s, d, "lineitem")
    sets = t.selectExpr("concat('P', l_suppkey) as program", "concat('dsn:D', l_partkey % 30) as resource", "case when l_returnflag = 'R' then 'read' else 'write' end as access", "concat('j', l_orderkey % 9) as path", "l_linenumber as line")
    rows = t.where("l_linenumber = 1").selectExpr("concat('P', l_suppkey % 7) as program", "concat('sql:T', l_partkey % 50) as resource", "'read' as access", "concat('s', l_orderkey % 9) as path", "l_linenumber as line")
    return A.shared_data([sets, rows], s.createDataFrame([("P3",), ("P5",)], "program string"))


def symbols(s, d):
    asked = [("AFRICA.ALGERIA", ["africa", "algeria"]), ("supp 001", ["supp", "00001"]), ("Cust", ["cust"]), ("xx 7", ["xx", "7"])]
    e = entities(s, d).where("type in ('nation', 'supplier', 'customer')")
    return A.symbol_stages(e, s.createDataFrame(asked, "query string, tokens array<string>"))


def windows(s, d):
    c = table(s, d, "documents").where("text is not null").selectExpr("doc_id as chunk_id", "concat(source, '/', doc_id % 20) as file_path", "1 + doc_id % 5 as start_line", "text as content")
    return A.source_window(c, 3, 9, 5)


def pack(s, d):
    asked = [("AFRICA.ALGERIA", ["africa", "algeria"]), ("ORDER-7", ["order-7"]), ("ORDER-40", ["order-40"])]
    e = entities(s, d).where("type in ('nation', 'order')")
    return A.evidence_pack(e, edges(s, d).union(back(s, d)), s.createDataFrame(asked, "query string, tokens array<string>"), 60, [40, 12, 6], 3)


QUERIES = {
    "call_flow_page": lambda s, d: A.call_flow_page(linked(s, d), of(s, d, "order").where(f"id < {ORDER + 30}").select("id"), 2, 10, 15, 3),
    "evidence_pack": pack,
    "entry_paragraphs": entry,
    "units_of_chunks": lambda s, d: A.units_of(places(s, d), parts(s, d)),
    "covering_entity": lambda s, d: A.covering_entity(hunks(s, d), of(s, d, "part")),
    "outline_facts": lambda s, d: A.outline(entities(s, d), edges(s, d), of(s, d, "customer").select("id"), 2),
    "linked_documents": lambda s, d: A.linked_documents(of(s, d, "part").where("id % 2 = 0").select("id"), doc_links(s, d), chunks(s, d)),
    "diff_impact": lambda s, d: A.diff_impact(hunks(s, d), of(s, d, "part"), edges(s, d), 2),
    "change_package": package,
    "process_steps": steps,
    "fall_through_steps": falls,
    "overview_graph": overview,
    "overview_degrees": degrees,
    "greedy_cover": cover,
    "offset_page": lambda s, d: A.offset_page(of(s, d, "customer").select("id", "name"), ["name", "id"], 40, 25),
    "evidence_fit": packs,
    "chat_context": context,
    "answer_check": answers,
    "project_overview": about,
    "name_tallies": tallies,
    "project_references": references,
    "bound_sources": bindings,
    "analysis_is_current": current,
    "swapped_vectors": swapped,
    "operand_origins": operands,
    "argument_origins": arguments,
    "shared_data": shared,
    "symbol_stages": symbols,
    "neighbour_groups": lambda s, d: A.neighbour_pages(edges(s, d), PART + 5, {("in", "COPY"): "2"}, 3),
    "source_window": windows,
}
PLACES = "c AS (SELECT event_id AS chunk_id, 'Brand#' || (1 + event_id % 5) || (1 + user_id % 5) || '/' || ['STANDARD', 'PROMO', 'SMALL', 'LARGE', 'ECONOMY', 'MEDIUM'][event_id % 6 + 1] AS file_path, event_id % 480 AS line FROM events)"
SQL = {
    "call_flow_page": with_relations("edges", f"""linked AS (SELECT edge_id, src_id, dst_id, type, resolution, line FROM edges UNION ALL SELECT 'p' || p_partkey, {PART} + p_partkey, {PART} + p_partkey + 1, CASE WHEN p_size % 2 = 0 THEN 'CALL' ELSE 'USES' END, 'resolved', p_size FROM part),
best AS (SELECT edge_id, src_id, dst_id FROM linked WHERE dst_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY CASE WHEN type = 'CALL' THEN 0 WHEN type = 'READS' THEN 1 ELSE 2 END, CASE resolution WHEN 'resolved' THEN 0 ELSE 1 END, line, edge_id) <= 3),
one AS (SELECT *, 1 AS hop FROM best WHERE src_id >= {ORDER} AND src_id < {ORDER + 30}), f AS (SELECT * FROM one UNION ALL SELECT *, 2 FROM best WHERE src_id IN (SELECT dst_id FROM one)),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY hop, src_id, edge_id) AS INT) AS pos, count(*) OVER () AS n FROM f)
SELECT pos, hop, src_id, edge_id, dst_id, (SELECT count(*) FROM linked l WHERE l.src_id = p.dst_id) AS out_edges, n > 25 AS has_more, CASE WHEN n > 25 THEN 25 END AS next_cursor FROM p WHERE pos BETWEEN 11 AND 25"""),
    "evidence_pack": with_relations("entities edges", f"""e AS (SELECT edge_id, src_id, dst_id, dst_name, type, line FROM edges UNION ALL SELECT 'b' || o_orderkey, {PART} + o_orderkey % 200, {ORDER} + o_orderkey, 'x', 'CALL', 1 FROM orders),
q AS (SELECT 'AFRICA.ALGERIA' AS query, id, qualified_name FROM entities WHERE qualified_name = 'AFRICA.ALGERIA' UNION ALL SELECT qualified_name, id, qualified_name FROM entities WHERE name IN ('ORDER-7', 'ORDER-40')),
r AS (SELECT query, 0 AS block, CAST(id AS VARCHAR) AS item, qualified_name AS text FROM q
  UNION ALL SELECT * FROM (SELECT query, 1, edge_id, type || ' ' || dst_name FROM q JOIN e ON src_id = id QUALIFY row_number() OVER (PARTITION BY query ORDER BY line, edge_id) <= 3) UNION ALL SELECT * FROM (SELECT query, 2, edge_id, type || ' ' || dst_name FROM q JOIN e ON dst_id = id QUALIFY row_number() OVER (PARTITION BY query ORDER BY line, edge_id) <= 3)),
s AS (SELECT query, CASE WHEN sum(least(length(text), 40)) <= 60 THEN 40 WHEN sum(least(length(text), 12)) <= 60 THEN 12 ELSE 6 END AS step FROM r GROUP BY 1)
SELECT query, block, item, text[1:step] AS text FROM r JOIN s USING (query) QUALIFY sum(least(length(text), step)) OVER (PARTITION BY query ORDER BY block, block || ':' || item ROWS UNBOUNDED PRECEDING) <= 60"""),
    "entry_paragraphs": """SELECT c_custkey AS program, arg_min(p_partkey, (p_partkey % 230, p_partkey)) AS id FROM customer JOIN part ON p_partkey % 2 = c_custkey % 2 AND p_size % 3 = c_custkey % 3 AND p_partkey % 50 = c_custkey % 50
AND p_partkey % 230 >= c_custkey % 200 AND p_partkey % 230 + 5 <= c_custkey % 200 + 60 GROUP BY 1""",
    "units_of_chunks": with_relations("entities", f"{PLACES}, h AS (SELECT chunk_id, id, CASE WHEN id % 9 > 0 THEN end_line ELSE 1000000000 END - start_line AS size FROM c JOIN entities USING (file_path) WHERE type = 'part' AND line >= start_line AND (id % 9 = 0 OR line <= end_line)) SELECT chunk_id, arg_min(id, (size, id)) AS id FROM h GROUP BY 1"),
    "covering_entity": with_relations("entities", f"{HITS} SELECT hunk_id, min(id) AS id FROM hits JOIN hunks USING (hunk_id) WHERE start_line <= a AND end_line >= b GROUP BY 1"),
    "outline_facts": with_relations("entities edges", """one AS (SELECT src_id, type, dst_name, min(line) AS line FROM edges GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY src_id, type ORDER BY line, dst_name) AS nr FROM one),
f AS (SELECT src_id, lower(type) || ' ' || string_agg(dst_name, ', ' ORDER BY nr) FILTER (nr <= 2) || CASE WHEN count(*) > 2 THEN ' +' || (count(*) - 2) ELSE '' END AS fact FROM r GROUP BY src_id, type), g AS (SELECT src_id, string_agg(fact, '; ' ORDER BY fact) AS facts FROM f GROUP BY 1)
SELECT e.parent_id AS id, e.id AS child, e.start_line, coalesce(facts, '') AS facts FROM entities e LEFT JOIN g ON src_id = e.id WHERE e.type = 'order' AND e.parent_id IN (SELECT id FROM entities WHERE type = 'customer')"""),
    "linked_documents": with_relations("chunks entities", f"l AS (SELECT {PART} + 1 + event_id % 150 AS id, event_id % 200 AS chunk_id FROM events WHERE event_id % 3 = 0) SELECT file_path, count(DISTINCT id) AS nodes, count(DISTINCT chunk_id) AS chunks FROM l JOIN chunks USING (chunk_id) WHERE id % 2 = 0 AND id IN (SELECT id FROM entities) GROUP BY 1"),
    "diff_impact": with_relations("entities edges", f"""{HITS}, seed AS (SELECT DISTINCT id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.hunk_id = h.hunk_id AND o.start_line >= h.start_line AND o.end_line <= h.end_line AND o.size < h.size)),
one AS (SELECT DISTINCT src_id AS id FROM edges WHERE resolution = 'resolved' AND dst_id IN (SELECT id FROM seed)), n AS (SELECT DISTINCT src_id AS id FROM edges WHERE resolution = 'unresolved' AND lower(dst_name) IN (SELECT lower(name) FROM entities WHERE id IN (SELECT id FROM seed) AND type = 'part'))
SELECT id, 'change' AS via, 0 AS hop FROM seed UNION ALL SELECT id, min(via), 1 FROM (SELECT id, 'edge' AS via FROM one UNION ALL SELECT id, 'name' FROM n) GROUP BY 1"""),
    "change_package": with_relations("entities edges chunks", f"""s AS (SELECT unnest([{PART + 1}, {PART + 17}]) AS id), e AS (SELECT DISTINCT src_id AS id, 'edge 1' AS way FROM edges WHERE resolution = 'resolved' AND dst_id IN (SELECT id FROM s)),
m AS (SELECT DISTINCT src_id AS id, 'name 1' AS way FROM edges WHERE resolution = 'unresolved' AND lower(dst_name) IN (SELECT lower(name) FROM entities WHERE id IN (SELECT id FROM s))), i AS (SELECT * FROM e UNION ALL SELECT * FROM m), ids AS (SELECT DISTINCT id FROM i),
l AS (SELECT DISTINCT {ORDER} + 1 + event_id % 150 AS id, event_id % 200 AS chunk_id FROM events WHERE event_id % 3 = 0 AND {ORDER} + 1 + event_id % 150 IN (SELECT id FROM ids)),
t AS (SELECT DISTINCT {PART} + o_orderkey % 200 AS src_id, {ORDER} + o_orderkey AS dst_id FROM orders WHERE {ORDER} + o_orderkey IN (SELECT id FROM ids) AND {PART} + o_orderkey % 200 IN (SELECT id FROM entities) AND o_orderkey % 5 = 0),
own AS (SELECT id, file_path FROM entities WHERE id IN (SELECT id FROM ids))
SELECT 'impact' AS section, way AS item, count(*) AS n FROM i GROUP BY way UNION ALL SELECT 'document', file_path, count(DISTINCT id) FROM l JOIN chunks USING (chunk_id) GROUP BY file_path
UNION ALL SELECT 'test', CAST(src_id AS VARCHAR), count(*) FROM t GROUP BY src_id UNION ALL SELECT 'owner', CASE WHEN file_path LIKE 'orders/1%' THEN 'one' WHEN regexp_matches(file_path, '^orders/[2-9]') THEN 'rest' ELSE 'none' END, count(DISTINCT file_path) FROM own GROUP BY 2
UNION ALL SELECT 'gap', CAST(id AS VARCHAR), 1 FROM own WHERE id NOT IN (SELECT id FROM l UNION ALL SELECT dst_id FROM t)"""),
    "process_steps": with_relations("edges", """k AS (SELECT *, CASE WHEN type = 'CALL' THEN CASE WHEN dst_id IS NULL THEN 'external_call' WHEN line % 2 = 0 THEN 'iteration' ELSE 'call' END WHEN type = 'READS' THEN 'data_access' END AS kind FROM edges)
SELECT src_id, CAST(row_number() OVER w AS INT) AS pos, kind, dst_id, dst_name, CASE WHEN count(*) OVER (PARTITION BY src_id) > 3 THEN 'step_limit' END AS cut FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY src_id ORDER BY line, edge_id) QUALIFY pos <= 3"""),
    "fall_through_steps": with_relations("entities", f"""x AS (SELECT {PART} + l_partkey AS id, bool_or(l_linenumber = 1) AS leaves FROM lineitem WHERE l_suppkey % 4 = 0 GROUP BY 1), p AS (SELECT id, lead(id) OVER (PARTITION BY file_path ORDER BY start_line, id) AS next_id FROM entities WHERE type = 'part')
SELECT id, next_id, CASE WHEN leaves IS NULL THEN 'certain' ELSE 'possible' END AS certainty FROM p LEFT JOIN x USING (id) WHERE next_id IS NOT NULL AND NOT coalesce(leaves, false)"""),
    "overview_graph": with_relations("entities edges", f"""{PAIRS},
held AS (SELECT pairs.*, a.degree AS src_degree, b.degree AS dst_degree, count(*) OVER () AS total_pairs FROM pairs JOIN degree a ON a.file = src_file JOIN degree b ON b.file = dst_file),
nodes AS (SELECT *, src_file AS node, dst_degree AS other FROM held UNION ALL SELECT *, dst_file, src_degree FROM held),
strong AS (SELECT src_file, dst_file FROM nodes QUALIFY row_number() OVER (PARTITION BY node ORDER BY priority DESC, is_control DESC, other, edge_count DESC, src_file, dst_file) <= 3),
one AS (SELECT *, unnest(string_split(edge_types, ',')) AS t FROM held), by_type AS (SELECT src_file, dst_file FROM one QUALIFY row_number() OVER (PARTITION BY t ORDER BY priority DESC, edge_count DESC, src_file, dst_file) <= 3),
bb AS (SELECT * FROM held WHERE total_pairs <= 1000 OR (src_file, dst_file) IN (SELECT * FROM strong UNION SELECT * FROM by_type)),
top AS (SELECT f FROM (SELECT src_file AS f FROM bb UNION ALL SELECT dst_file FROM bb) GROUP BY f ORDER BY count(*) DESC, f LIMIT 200)
SELECT 'file' AS kind, src_file AS a, dst_file AS b, edge_count AS weight FROM bb WHERE src_file IN (SELECT f FROM top) AND dst_file IN (SELECT f FROM top)
UNION ALL SELECT 'document', 'doc' || event_id % 30, '3:orders/' || user_id, count(*) FROM events GROUP BY 2, 3 UNION ALL SELECT 'knowledge', 'k' || n_regionkey, 'k' || n_nationkey, 1 FROM nation"""),
    "overview_degrees": """WITH e AS (SELECT l_linenumber < 4 AS f, 'f' || l_partkey % 90 AS node FROM lineitem UNION ALL SELECT l_linenumber < 4, 'f' || l_suppkey % 40 FROM lineitem), b AS (SELECT node, count(*) AS n, count(*) FILTER (f) AS files FROM e GROUP BY 1)
SELECT node, n - files + coalesce(s_suppkey * 3, files) AS degree FROM b LEFT JOIN supplier ON node = 'f' || s_suppkey""",
    "offset_page": with_relations("entities", "SELECT id, name, (SELECT count(*) FROM customer) > 65 AS has_more, CASE WHEN (SELECT count(*) FROM customer) > 65 THEN 65 END AS next_cursor FROM entities WHERE type = 'customer' ORDER BY name, id LIMIT 25 OFFSET 40"),
    "evidence_fit": """WITH t AS (SELECT source AS pack, doc_id AS item, doc_id % 5 AS rank, length(text) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT pack, CASE WHEN sum(least(n, 2000)) <= 6000 THEN 2000 WHEN sum(least(n, 500)) <= 6000 THEN 500 WHEN sum(least(n, 200)) <= 6000 THEN 200 ELSE 60 END AS step FROM t GROUP BY 1)
SELECT pack, item, CAST(least(n, step) AS INT) AS chars FROM t JOIN s USING (pack) QUALIFY sum(least(n, step)) OVER (PARTITION BY pack ORDER BY rank, item ROWS UNBOUNDED PRECEDING) <= 6000""",
    "chat_context": """WITH h AS (SELECT event_type AS scope, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id * 37 % 101 DESC, event_id) AS pos FROM events), o AS (SELECT * FROM h WHERE pos <= CASE scope WHEN 'click' THEN 4 WHEN 'view' THEN 4 WHEN 'error' THEN 2 ELSE 6 END),
n AS (SELECT scope, pos, event_id * 7 % 1000 AS id FROM o JOIN events ON event_id = id WHERE event_id * 7 % 1000 NOT IN (SELECT id FROM o))
SELECT scope, CAST(pos AS INT) AS pos, id, 'hit' AS origin FROM o UNION ALL SELECT * FROM (SELECT scope, CAST(pos AS INT), id, 'graph' FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, scope) = 1)""",
    "answer_check": f"""WITH c AS (SELECT event_id, user_id % 90 AS answer_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 10, event_id % 200) IN (SELECT (l_suppkey, l_partkey) FROM lineitem) ELSE true END AS r,
  CASE WHEN event_id % 3 = 0 THEN EXISTS (SELECT 1 FROM customer WHERE c_custkey % 90 = user_id % 90 AND c_custkey % 7 = event_id % 7 AND event_id % 50 BETWEEN c_custkey % 30 AND c_custkey % 30 + 20) ELSE true END AS p FROM events),
g AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (r AND p) AS supported FROM c GROUP BY 1) SELECT *, CASE WHEN supported = claims THEN 'valid' WHEN supported > 0 THEN 'partial' ELSE 'rejected' END AS state FROM g""",
    "project_overview": with_relations("entities edges", f"""{PAIRS}, u AS (SELECT 'inventory' AS section, type AS name, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'area', string_split(file_path, '/')[1], count(*) FROM entities GROUP BY 2
UNION ALL SELECT 'entry', src_file, count(DISTINCT dst_file) FROM pairs WHERE is_control AND src_file NOT IN (SELECT dst_file FROM pairs WHERE is_control) GROUP BY 2 UNION ALL SELECT 'gap', dst_name, count(*) FROM edges WHERE resolution = 'unresolved' GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'central', dst_file, count(DISTINCT src_file) AS n FROM pairs GROUP BY 2 ORDER BY n DESC, sum(edge_count) DESC, dst_file LIMIT 5))
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY n DESC, name) AS INT) AS pos, name, n FROM u QUALIFY pos <= 5"""),
    "name_tallies": """SELECT event_id AS id, 'Order' || event_id % 9 || 'Form' AS name, 1 AS as_file, 1 AS in_package, 0 AS bare FROM events UNION ALL SELECT event_id, 'order' || event_id % 5, 0, 0, 1 FROM events UNION ALL SELECT event_id, 'OrderList', 0, 0, 1 FROM events UNION ALL SELECT event_id, 'Thing', 0, 1, 0 FROM events""",
    "project_references": with_relations("entities chunks", f"""SELECT event_id AS link_id, coalesce(ae.qualified_name, ac.file_path) AS a, coalesce(be.qualified_name, bc.file_path) AS b FROM events LEFT JOIN entities ae ON event_id % 2 = 0 AND ae.id = {PART} + event_id % 300
LEFT JOIN chunks ac ON event_id % 2 = 1 AND ac.chunk_id = event_id % 250 LEFT JOIN entities be ON event_id % 3 = 0 AND be.id = {SUPPLIER} + event_id % 20 LEFT JOIN chunks bc ON event_id % 3 > 0 AND bc.chunk_id = event_id % 210"""),
    "bound_sources": """WITH b AS (SELECT event_id AS id, user_id % 15 AS source_id, event_type AS bound FROM events UNION ALL SELECT event_id, event_id % 12, 'v1' FROM events) SELECT id, source_id, bound, 'v' || s_nationkey % 3 AS now FROM b LEFT JOIN supplier ON s_suppkey = source_id""",
    "analysis_is_current": "SELECT event_id AS path, coalesce(p_size % 4 = event_id % 4 AND p_partkey % 9 > 0 AND p_partkey % 4 > 0, false) AS current FROM events LEFT JOIN part ON p_partkey = event_id",
    "swapped_vectors": "SELECT doc_id, doc_id + 1 AS embedding, 'new' AS embedding_model, doc_id AS embedding_next, 'old' AS embedding_next_model FROM documents",
    "operand_origins": """WITH x AS (SELECT DISTINCT l_orderkey AS unit, l_suppkey % 3 AS op, l_linenumber + l_orderkey % 2 AS line, l_partkey AS field, l_returnflag = 'R' AS w FROM lineitem)
SELECT w.unit, w.field, r.field AS origin, min(r.line) AS line FROM x w JOIN x r ON w.w AND NOT r.w AND w.unit = r.unit AND w.op = r.op AND w.field <> r.field AND r.line BETWEEN CASE WHEN w.op = 1 THEN w.line - 9 ELSE w.line END AND CASE WHEN w.op < 2 THEN w.line ELSE w.line + 2 END GROUP BY 1, 2, 3""",
    "argument_origins": """SELECT p_partkey AS parameter, event_id AS call_id, ['a' || event_id, 'b', 'c'][p_partkey % 3 + 1] AS expression FROM part JOIN events ON user_id % 60 = p_partkey // 3 AND p_partkey % 3 < event_id % 4
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY event_id % 4 = 0, event_id) <= 4""",
    "shared_data": """WITH u AS (SELECT 'P' || l_suppkey AS program, 'dsn:D' || l_partkey % 30 AS resource, CASE WHEN l_returnflag = 'R' THEN 'read' ELSE 'write' END AS access, 'j' || l_orderkey % 9 AS path, l_linenumber AS line FROM lineitem
UNION ALL SELECT 'P' || l_suppkey % 7, 'sql:T' || l_partkey % 50, 'read', 's' || l_orderkey % 9, l_linenumber FROM lineitem WHERE l_linenumber = 1),
k AS (SELECT resource FROM u GROUP BY 1 HAVING count(DISTINCT program) > 1 AND bool_or(program IN ('P3', 'P5'))) SELECT resource, program, access, path, line FROM u WHERE resource IN (SELECT resource FROM k) QUALIFY row_number() OVER (PARTITION BY resource, program, access ORDER BY path, line) = 1""",
    "symbol_stages": with_relations("entities", """q AS (SELECT * FROM (VALUES ('AFRICA.ALGERIA', ['africa', 'algeria'], 'algeria'), ('supp 001', ['supp', '00001'], '00001'), ('Cust', ['cust'], 'cust'), ('xx 7', ['xx', '7'], 'xx')) t(query, tokens, l)),
s AS (SELECT query, id, name, CASE WHEN lower(name) = lower(query) OR lower(qualified_name) = lower(query) THEN 0 WHEN len(list_filter(tokens, lambda t: NOT contains(lower(qualified_name), t))) = 0 THEN 1 WHEN starts_with(lower(name), tokens[-1]) THEN 2 WHEN contains(lower(name), l) THEN 3 END AS stage
  FROM q, entities WHERE type IN ('nation', 'supplier', 'customer')), b AS (SELECT * FROM s WHERE stage IS NOT NULL QUALIFY stage = min(stage) OVER (PARTITION BY query))
SELECT query, stage, id FROM b QUALIFY stage < 3 OR row_number() OVER (PARTITION BY query ORDER BY length(name), lower(name), id) <= 5"""),
    "neighbour_groups": with_relations("edges", f"""r AS (SELECT 'in' AS direction, type, edge_id, src_id AS other, row_number() OVER (PARTITION BY type ORDER BY edge_id) AS nr, count(*) OVER (PARTITION BY type) > 3 AS has_more FROM edges WHERE dst_id = {PART + 5} AND (type <> 'COPY' OR edge_id > '2'))
SELECT direction, type, edge_id, other, has_more FROM r WHERE nr <= 3"""),
    "source_window": """WITH c AS (SELECT doc_id, source || '/' || doc_id % 20 AS file_path, 1 + doc_id % 5 AS s, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT file_path, doc_id, s, unnest(l) AS text, unnest(range(len(l))) + s AS line FROM c),
o AS (SELECT * FROM x WHERE line BETWEEN 3 AND 9 QUALIFY row_number() OVER (PARTITION BY file_path, line ORDER BY s, doc_id) = 1)
SELECT file_path, CAST(line AS INT) AS line, text, count(*) OVER (PARTITION BY file_path) > 5 AS has_more FROM o QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY line) <= 5""",
}
