"""Queries of text functions, byte decoding and of what findings, files and methods pass on."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.functions import chunking
from korpusgraf.functions import text as T
from korpusgraf.operators import change, groups, search, structure, vectors
from korpusgraf.operators.lineage import stored
from korpusgraf.plans.graph_queries import HITS, hunks
from korpusgraf.plans.structure_queries import O
from korpusgraf.plans.structure_queries import _files as by_customer
from korpusgraf.plans.text_queries import file_graph
from korpusgraf.sources import readers
from korpusgraf.sources.adapter import PART, edges, entities, table, with_relations

QUESTION = "concat('Where does OrderForm', event_id % 9, '.save call x_', event_id % 7, ' or OrderForm', event_id % 9, ' in PAY-ROLL-', event_id % 5, ' of src/a', event_id % 3, '.java and ./SRC/A', event_id % 3, '.java? `Db.load` token t', event_id)"


def joined(c):
    return F.array_join(c, "|")


def symbols(s, d):
    q = table(s, d, "events").selectExpr("event_id", "user_id", "event_type", f"{QUESTION} as q")
    c = F.col
    return q.select(
        "event_id", joined(T.question_symbols(c("q"))).alias("symbols"), joined(T.explicit_files(c("q"))).alias("files"), joined(T.identifiers(c("q"))).alias("names"),
        joined(T.split_parameters(F.concat(F.lit("int a, Map<String, List<X"), "user_id", F.lit(">> b,, f(c, d)")))).alias("parameters"),
        joined(T.concept_terms(c("q"), ["where", "does", "call"], 3)).alias("terms"), joined(T.symbol_mentions(F.concat(F.lit("the aB"), "user_id", F.lit(" of p.q")))).alias("mentions"),
        T.redacted(F.concat(F.lit("pw12 and pw1, t"), "event_id"), ["pw1", "pw12"]).alias("redacted"),
        T.repo_fingerprint(F.concat(F.lit("https://u@h.example/R"), "user_id", F.lit(".git/"))).alias("repository"),
        T.bundle_stem(F.concat(F.lit("i18n/m"), "user_id", F.lit("_de_CH.properties"))).alias("stem"), T.bundle_locale(F.concat(F.lit("i18n/m"), "user_id", F.lit("_de_CH.properties"))).alias("locale"),
        T.is_documentation(F.when(c("user_id") % 3 == 0, "wiki").otherwise("git"), F.when(c("user_id") % 2 == 0, "markdown")).alias("is_doc"),
        T.analysis_fingerprint({"size": c("user_id"), "kind": c("event_type"), "none": F.lit(None).cast("string")}).alias("inputs"),
        T.language_by_content(F.concat(F.lit("x"), c("event_id").cast("string"), F.when(c("event_id") % 5 == 0, ".java").otherwise("")), F.when(c("event_id") % 5 == 1, "#!/usr/bin/env bash\nls").when(c("event_id") % 5 == 2, "       IDENTIFICATION DIVISION.\n").when(c("event_id") % 5 == 3, "//J1 JOB (1)\n").otherwise("text")).alias("language"),
    )


def sections(s, d):
    """Each order's line in its customer's manual: a chapter for every fourth order, sections for the others."""
    f = by_customer(s, d, "'intro\\n'", "concat(case when x.o_orderkey % 4 = 0 then '# C' else '## S' end, x.o_orderkey, '\\nbody')")
    lines = structure.lines(f).join(f.withColumn("outline", chunking.outline(F.col("content"))).select("path", "outline"), "path")
    return lines.select("path", "line", T.section_path(F.col("outline"), F.col("line")).alias("section")).where("line % 2 = 1")


def data(s, d):
    """A file for each order: its number in EBCDIC digits, UTF-8, or UTF-8 with a broken byte."""
    hexed = "case o_orderkey % 3 when 0 then concat('C1C2C3', regexp_replace(cast(o_orderkey as string), '(.)', 'F$1'), '15') when 1 then concat('C3A4', hex(encode(cast(o_orderkey as string), 'UTF-8'))) else concat(hex(encode(cast(o_orderkey as string), 'UTF-8')), 'FF41') end"
    return table(s, d, "orders").selectExpr("o_orderkey as path", f"unhex({hexed}) as content")


def findings(s, d):
    f = table(s, d, "part").selectExpr("p_partkey as id", "case when p_partkey % 5 = 0 then 'draft' else 'verified' end as state", "array(cast(p_size as string), concat('f', p_partkey % 30)) as files")
    return change.outdated(f, s.createDataFrame([("7",), ("f3",)], "path string"), table(s, d, "part").selectExpr("p_partkey as id", "p_partkey div 2 as other"))


def implementations(s, d):
    calls = table(s, d, "events").selectExpr("event_id as call_id", "concat('T', event_id % 20) as type", "concat('m', user_id % 100) as name", "cast(event_id % 3 as int) as arity")
    methods = table(s, d, "part").selectExpr("p_partkey as id", "concat('T', p_partkey % 20) as type", "concat('m', p_partkey div 20) as name", "cast(p_size % 3 as int) as arity")
    return change.implementations(calls, methods, s.range(20).selectExpr("concat('T', id) as sub", "concat('T', id div 2) as super").where("sub <> super"), 2)


def expanded(s, d):
    h = hunks(s, d).selectExpr("hunk_id as chunk_id", "file_path", "start_line", "end_line", "40 + hunk_id % 60 as size")
    pairs = table(s, d, "part").selectExpr(f"{PART} + p_partkey as src_id", f"{PART} + 1 + p_partkey * 7 % 150 as dst_id", "'resolved' as resolution")
    return change.expanded_chunks(h.where("chunk_id % 5 = 0"), h, entities(s, d).where("type = 'part'"), pairs, 150)


def fingerprints(s, d):
    f = table(s, d, "part").selectExpr("p_partkey as path", "sha2(p_name, 256) as hash")
    return change.dependency_fingerprints(f, table(s, d, "part").selectExpr("p_partkey as path", "p_partkey div 8 as needs").where("needs > 0"), 64)


def in_space(s, d):
    v = table(s, d, "embeddings").selectExpr("vec_id", "case when vec_id % 3 = 0 then slice(embedding, 1, 32) else embedding end as v", "case when vec_id % 4 > 0 then concat('m', vec_id % 2) end as model")
    return vectors.in_space(v, "v", 64, "m1", "m1").select("vec_id")


QUERIES = {
    "text_symbols": symbols,
    "section_paths": sections,
    "decoded_bytes": lambda s, d: readers.strictly_decoded(data(s, d)),
    "outdated_findings": findings,
    "implementations": implementations,
    "expanded_chunks": expanded,
    "dependency_fingerprints": fingerprints,
    "model_space": in_space,
    "short_query": lambda s, d: search.bounded(entities(s, d), ["a", "ou"], ["id"], 500).select("id"),
    "group_labels": lambda s, d: groups.labels(graph := stored(file_graph(s, d)), fixed_groups(graph)),
    "group_edges": lambda s, d: groups.group_edges(graph := stored(file_graph(s, d)), fixed_groups(graph)),
    "byte_parts": lambda s, d: readers.byte_parts(table(s, d, "documents"), "doc_id", "text", 700).select("id", "nr", F.octet_length("part").alias("bytes"), F.sha2("part", 256).alias("hash")),
}


def fixed_groups(graph):
    """Files grouped by the length of their names."""
    return graph.select(F.col("a").alias("node"), F.length("a").cast("string").alias("community")).distinct()


FILES = """met AS (SELECT e.type, s.source_id || ':' || s.file_path AS a, t.source_id || ':' || t.file_path AS b FROM edges e JOIN entities s ON s.id = src_id JOIN entities t ON t.id = dst_id WHERE (s.source_id, s.file_path) <> (t.source_id, t.file_path)),
p AS (SELECT a, b, count(*) * (1 + max(CASE WHEN type = 'IMPORTS' THEN 0 WHEN type IN ('CALL', 'COPY') THEN 3 WHEN type = 'READS' THEN 2 ELSE 1 END)) AS w FROM met GROUP BY 1, 2), w AS (SELECT a, b, sum(w) AS w FROM (SELECT * FROM p UNION ALL SELECT b, a, w FROM p) GROUP BY 1, 2)"""
SQL = {
    "text_symbols": """SELECT event_id, 'OrderForm' || event_id % 9 || '.save|PAY-ROLL-' || event_id % 5 || '|a' || event_id % 3 || '.java|Db.load' AS symbols, 'src/a' || event_id % 3 || '.java' AS files,
'java|load|orderform' || event_id % 9 || '|save' AS names, 'int a|Map<String, List<X' || user_id || '>> b|f(c, d)' AS parameters, 'orderform' || event_id % 9 || '|save|roll' AS terms, 'aB' || user_id || '|p.q' AS mentions,
'*** and ***, t' || event_id AS redacted, sha1('h.example/r' || user_id) AS repository, 'm' || user_id AS stem, 'de_CH' AS locale, user_id % 3 = 0 OR user_id % 2 = 0 AS is_doc,
sha256('{"kind":"' || event_type || '","none":null,"size":' || user_id || '}') AS inputs, CASE event_id % 5 WHEN 0 THEN 'java' WHEN 1 THEN 'shell' WHEN 2 THEN 'cobol' WHEN 3 THEN 'jcl' END AS language FROM events""",
    "section_paths": f"""WITH {O}, l AS (SELECT *, last_value(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY n) AS h FROM o)
SELECT 'src/' || o_custkey AS path, CAST(2 * n + 1 AS INT) AS line, CASE WHEN o_orderkey % 4 = 0 THEN 'C' || h WHEN h IS NULL THEN 'S' || o_orderkey ELSE 'C' || h || ' > S' || o_orderkey END AS section FROM l UNION ALL SELECT 'src/' || o_custkey, 1, NULL FROM o WHERE n = 1""",
    "decoded_bytes": """SELECT o_orderkey AS path, CASE o_orderkey % 3 WHEN 0 THEN 'cp037' ELSE 'utf-8' END AS charset, CASE o_orderkey % 3 WHEN 0 THEN 'ABC' || o_orderkey || chr(133) WHEN 1 THEN 'ä' || o_orderkey END AS text, CASE WHEN o_orderkey % 3 = 2 THEN length(CAST(o_orderkey AS VARCHAR)) END AS error_at FROM orders""",
    "outdated_findings": """WITH RECURSIVE v AS (SELECT p_partkey AS id, p_size = 7 OR p_partkey % 30 = 3 AS hit FROM part WHERE p_partkey % 5 > 0), w AS (SELECT id, 0 AS n FROM v WHERE hit UNION SELECT v.id, n + 1 FROM w JOIN v ON v.id // 2 = w.id WHERE n < 4)
SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT id FROM w) THEN 'outdated' WHEN p_partkey % 5 = 0 THEN 'draft' ELSE 'verified' END AS state FROM part""",
    "implementations": """WITH r AS (SELECT i AS sub, i // 2 AS super FROM range(1, 20) t(i)), z AS (SELECT * FROM r UNION SELECT a.sub, b.super FROM r a JOIN r b ON a.super = b.sub)
SELECT event_id AS call_id, min(p_partkey) AS id FROM events JOIN z ON super = event_id % 20 AND sub <> super JOIN part ON p_partkey % 20 = sub AND p_partkey // 20 = user_id % 100 AND p_size % 3 = event_id % 3 GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1""",
    "expanded_chunks": with_relations("entities", f"""{HITS}, st AS (SELECT {PART} + p_partkey AS x, {PART} + 1 + p_partkey * 7 % 150 AS y FROM part UNION SELECT {PART} + 1 + p_partkey * 7 % 150, {PART} + p_partkey FROM part),
n AS (SELECT DISTINCT hunk_id AS hit_id, y AS id FROM hits JOIN st ON x = id WHERE hunk_id % 5 = 0), m AS (SELECT DISTINCT hit_id, hunk_id AS chunk_id FROM n JOIN hits USING (id) WHERE hunk_id <> hit_id)
SELECT hit_id, chunk_id FROM m QUALIFY sum(40 + chunk_id % 60) OVER (PARTITION BY hit_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) <= 150"""),
    "dependency_fingerprints": """WITH RECURSIVE f AS (SELECT p_partkey AS path, sha256(p_name) AS hash FROM part), w AS (SELECT path, hash AS fingerprint FROM f WHERE path < 8 UNION ALL SELECT f.path, sha256(f.hash || '|' || w.path || '=' || w.fingerprint) FROM w JOIN f ON f.path // 8 = w.path AND w.path > 0)
SELECT path, fingerprint FROM w""",
    "model_space": "SELECT vec_id FROM embeddings WHERE vec_id % 3 > 0 AND (vec_id % 4 = 0 OR vec_id % 2 = 1)",
    "short_query": with_relations("entities", "SELECT id FROM entities ORDER BY id LIMIT 500"),
    "group_labels": with_relations("entities edges", f"""{FILES}, k AS (SELECT a, sum(w) AS k FROM w GROUP BY 1) SELECT CAST(length(a) AS VARCHAR) AS community, arg_min(a, (-k, a)) AS label, count(*) AS files FROM k GROUP BY 1"""),
    "group_edges": with_relations("entities edges", f"{FILES} SELECT CAST(length(a) AS VARCHAR) AS src_group, CAST(length(b) AS VARCHAR) AS dst_group, CAST(sum(w) AS DOUBLE) AS weight FROM w WHERE length(a) <> length(b) GROUP BY 1, 2"),
}
