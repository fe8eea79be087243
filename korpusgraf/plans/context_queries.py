"""Queries of layers, references, related findings and blended ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import context, search, vectors
from korpusgraf.plans.search_queries import COS, UNIT, one_query, unit
from korpusgraf.sources.adapter import ORDER, chunks, edges, entities, table, with_relations

ROOT = ORDER + 1


def both_ways(s, d):
    e = edges(s, d).select("src_id", "dst_id")
    return e.union(e.where("dst_id is not null").select("dst_id", "src_id"))


def blended(s, d):
    hits = search.term_score(chunks(s, d), ["the", "tion"]).select(F.col("chunk_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(40)
    near = vectors.cosine_distances(unit(s, d), one_query(s, d)).select("id", (1 - F.col("distance")).alias("cosine"))
    return context.blend_rerank(hits.join(near, "id", "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0))))


def findings(s, d):
    """A finding for each vector, its text changed since where the label is 3."""
    return unit(s, d).withColumn("hash", F.col("source").cast("string")).withColumn("current_hash", F.when(F.col("source") == 3, "new").otherwise(F.col("hash")))


def noted(s, d):
    return table(s, d, "events").selectExpr("event_id as id", "ts", "to_json(array(named_struct('entity_id', user_id), named_struct('entity_id', event_id % 50))) as evidence")


QUERIES = {
    "drop_layers": lambda s, d: context.drop_layers(both_ways(s, d), s.createDataFrame([(ROOT,)], "id long"), 2)[1],
    "drop_layer_nodes": lambda s, d: context.drop_layers(both_ways(s, d), s.createDataFrame([(ROOT,)], "id long"), 2, 1 << 40)[0],
    "outside_index": lambda s, d: context.outside_index(edges(s, d), entities(s, d)),
    "file_references": lambda s, d: context.file_references(edges(s, d), entities(s, d), "orders/7"),
    "control_flow": lambda s, d: context.control_flow(edges(s, d), entities(s, d), "orders/7"),
    "blend_rerank": blended,
    "semantic_candidates": lambda s, d: context.semantic_candidates(findings(s, d), one_query(s, d), 0.9),
    "related_findings": lambda s, d: context.related_findings(noted(s, d), 7),
    "assignment_candidates": lambda s, d: context.assignment_candidates(table(s, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey as id"), table(s, d, "orders").selectExpr("o_orderstatus as project_id", "o_custkey as user_id"), table(s, d, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as user_id")),
    "project_pulse": lambda s, d: context.project_pulse(entities(s, d)),
}
SQL = {
    "drop_layers": with_relations("edges", f"""step AS (SELECT src_id AS a, dst_id AS b FROM edges UNION ALL SELECT dst_id, src_id FROM edges WHERE dst_id IS NOT NULL),
one AS (SELECT DISTINCT b AS id FROM step WHERE a = {ROOT} AND b <> {ROOT}), two AS (SELECT DISTINCT b AS id FROM step WHERE a IN (SELECT id FROM one) AND b <> {ROOT} AND b NOT IN (SELECT id FROM one))
SELECT CAST(1 AS INT) AS layer, (SELECT count(*) FROM one) AS nodes, (SELECT count(*) FROM step WHERE a = {ROOT} AND b IS NULL) AS unresolved, false AS collapsed
UNION ALL SELECT 2, (SELECT count(*) FROM two), (SELECT count(*) FROM step WHERE a IN (SELECT id FROM one) AND b IS NULL), (SELECT count(*) FROM two) > 40"""),
    "drop_layer_nodes": with_relations("edges", f"""step AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE dst_id IS NOT NULL UNION SELECT dst_id, src_id FROM edges WHERE dst_id IS NOT NULL),
walk AS (SELECT CAST({ROOT} AS BIGINT) AS id, 0 AS layer UNION SELECT b, layer + 1 FROM walk JOIN step ON a = id WHERE layer < 2) SELECT id, min(layer) AS layer FROM walk GROUP BY id"""),
    "outside_index": with_relations("edges entities", "o AS (SELECT file_path, dst_name, edges.type FROM edges JOIN entities ON id = src_id WHERE dst_id IS NULL) SELECT file_path, count(*) AS open_edges FROM o WHERE (file_path, dst_name) IN (SELECT file_path, dst_name FROM o WHERE type = 'IMPORTS') GROUP BY 1"),
    "file_references": with_relations("edges entities", "SELECT line, edge_id, edges.type AS type, t.qualified_name AS target, t.file_path AS target_path FROM edges JOIN entities s ON s.id = src_id JOIN entities t ON t.id = dst_id WHERE resolution = 'resolved' AND s.file_path = 'orders/7' ORDER BY line, edge_id LIMIT 200"),
    "control_flow": with_relations("edges entities", "SELECT DISTINCT CAST(1 AS INT) AS hop, start_line, line, src_id, dst_id FROM edges JOIN entities ON id = src_id WHERE edges.type = 'CALL' AND dst_id IS NOT NULL AND file_path = 'orders/7'"),
    "blend_rerank": with_relations("chunks", f"""{UNIT}, near AS (SELECT b.id, 1 - round(1 - {COS}, 4) AS cosine FROM n a, n b WHERE a.id = 7),
t AS (SELECT chunk_id AS id, round(((length(l) - length(replace(l, 'the', ''))) / 3 + (length(l) - length(replace(l, 'tion', ''))) / 4) / (1 + ln(length(l) + 1)), 4) AS score
  FROM (SELECT chunk_id, translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM chunks)),
h AS (SELECT id, score, coalesce(cosine, 0) AS cosine, row_number() OVER (ORDER BY score DESC, id) AS nr FROM t LEFT JOIN near USING (id) WHERE score > 0 QUALIFY nr <= 40)
SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN nr <= 12 THEN round(score + 8 * greatest(0, cosine), 4) END DESC NULLS LAST, nr) AS INT) AS pos FROM h"""),
    "semantic_candidates": f"WITH {UNIT} SELECT b.id, round(1 - {COS}, 4) AS distance FROM n a, n b WHERE a.id = 7 AND b.source <> 3 AND round(1 - {COS}, 4) < 0.9",
    "related_findings": "SELECT event_id AS id FROM events WHERE user_id = 7 OR event_id % 50 = 7 ORDER BY ts DESC, event_id LIMIT 40",
    "assignment_candidates": "SELECT DISTINCT o_orderstatus AS project_id, o_custkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'",
    "project_pulse": with_relations("entities", "r AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY md5(CAST(id AS VARCHAR))) AS nr FROM entities) SELECT type, count(*) AS n, string_agg(id, ',' ORDER BY nr) FILTER (nr <= 3) AS sample FROM r GROUP BY 1"),
}
