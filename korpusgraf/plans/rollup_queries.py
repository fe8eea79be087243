"""Queries of the file roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import rollup
from korpusgraf.sources.adapter import entities, targeted_edges, with_relations

PAIRS = """met AS (SELECT e.*, s.source_id || ':' || s.file_path AS src_file, t.source_id || ':' || t.file_path AS dst_file FROM edges e JOIN entities s ON s.id = src_id JOIN entities t ON t.id = dst_id WHERE (s.source_id, s.file_path) <> (t.source_id, t.file_path)),
typed AS (SELECT *, CASE WHEN type = 'IMPORTS' THEN 0 WHEN type IN ('CALL', 'COPY') THEN 3 WHEN type = 'READS' THEN 2 ELSE 1 END AS p FROM met),
pairs AS (SELECT src_file, dst_file, count(*) AS edge_count, string_agg(DISTINCT type, ',' ORDER BY type) AS edge_types, max(p) AS priority, bool_or(type = 'CALL') AS is_control FROM typed GROUP BY ALL),
ends AS (SELECT src_file AS file FROM pairs UNION ALL SELECT dst_file FROM pairs),
degree AS (SELECT file, count(*) AS degree FROM ends GROUP BY file)"""


def pairs(spark, d):
    return rollup.file_pairs(targeted_edges(spark, d), entities(spark, d))


def flat(df):
    return df.withColumn("edge_types", F.array_join("edge_types", ","))


QUERIES = {
    "file_pair_rollup": lambda s, d: flat(rollup.file_pairs(targeted_edges(s, d), entities(s, d), samples=5)).withColumn("sample_ids", F.array_join("sample_ids", ",")),
    "file_pair_evidence": lambda s, d: rollup.sample_edges(targeted_edges(s, d), entities(s, d)),
    "file_degree": lambda s, d: rollup.degrees(pairs(s, d)),
    "graph_backbone": lambda s, d: flat(rollup.backbone(pairs(s, d))),
    "directory_rollup": lambda s, d: flat(rollup.file_pairs(targeted_edges(s, d), entities(s, d), F.substring_index("file_path", "/", 1))),
    "overview_cap": lambda s, d: rollup.capped(pairs(s, d), 200).select("src_file", "dst_file", "edge_count"),
    "inventory": lambda s, d: rollup.inventory(entities(s, d)),
    "areas": lambda s, d: rollup.areas(entities(s, d)),
    "entry_points": lambda s, d: rollup.entry_points(pairs(s, d)),
    "most_used": lambda s, d: rollup.most_used(pairs(s, d)),
}
_q = lambda body: with_relations("entities edges", f"{PAIRS}{body}")
SQL = {
    "file_pair_rollup": _q(", ids AS (SELECT src_file, dst_file, array_to_string(list(edge_id ORDER BY edge_id)[1:5], ',') AS sample_ids FROM met GROUP BY 1, 2) SELECT pairs.*, sample_ids FROM pairs JOIN ids USING (src_file, dst_file)"),
    "file_pair_evidence": _q(", r AS (SELECT src_file, dst_file, edge_id, CAST(row_number() OVER (PARTITION BY src_file, dst_file ORDER BY edge_id) AS INT) AS nr FROM met) SELECT * FROM r WHERE nr <= 5"),
    "file_degree": _q(" SELECT * FROM degree"),
    "graph_backbone": _q(""",
held AS (SELECT pairs.*, a.degree AS src_degree, b.degree AS dst_degree, count(*) OVER () AS total_pairs FROM pairs JOIN degree a ON a.file = src_file JOIN degree b ON b.file = dst_file),
nodes AS (SELECT *, src_file AS node, dst_degree AS other FROM held UNION ALL SELECT *, dst_file, src_degree FROM held),
strong AS (SELECT src_file, dst_file FROM nodes QUALIFY row_number() OVER (PARTITION BY node ORDER BY priority DESC, is_control DESC, other, edge_count DESC, src_file, dst_file) <= 3),
one AS (SELECT *, unnest(string_split(edge_types, ',')) AS t FROM held),
by_type AS (SELECT src_file, dst_file FROM one QUALIFY row_number() OVER (PARTITION BY t ORDER BY priority DESC, edge_count DESC, src_file, dst_file) <= 3)
SELECT held.* FROM held WHERE total_pairs <= 1000 OR (src_file, dst_file) IN (SELECT * FROM strong UNION SELECT * FROM by_type)"""),
    "directory_rollup": with_relations("entities edges", PAIRS.replace("s.file_path", "string_split(s.file_path, '/')[1]").replace("t.file_path", "string_split(t.file_path, '/')[1]") + " SELECT * FROM pairs"),
    "overview_cap": _q(", kept AS (SELECT file FROM degree ORDER BY degree DESC, file LIMIT 200) SELECT src_file, dst_file, edge_count FROM pairs WHERE src_file IN (SELECT file FROM kept) AND dst_file IN (SELECT file FROM kept)"),
    "inventory": with_relations("entities", "SELECT type, count(*) AS entities, count(DISTINCT file_path) AS files FROM entities GROUP BY type"),
    "areas": with_relations("entities", "SELECT string_split(file_path, '/')[1] AS area, count(*) AS units FROM entities GROUP BY 1 ORDER BY units DESC, area LIMIT 10"),
    "entry_points": _q(" SELECT src_file AS file, count(DISTINCT dst_file) AS targets FROM pairs WHERE is_control AND src_file NOT IN (SELECT dst_file FROM pairs WHERE is_control) GROUP BY 1"),
    "most_used": _q(" SELECT dst_file AS file, count(DISTINCT src_file) AS users, CAST(sum(edge_count) AS BIGINT) AS uses FROM pairs GROUP BY 1 ORDER BY users DESC, uses DESC, file LIMIT 10"),
}
