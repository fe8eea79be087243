"""Queries of chunks, pages, groups and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.functions import chunking
from korpusgraf.functions.text import codeowners_pattern
from korpusgraf.operators import evidence, groups, rollup
from korpusgraf.plans.rollup_queries import pairs
from korpusgraf.plans.structure_queries import O
from korpusgraf.plans.structure_queries import _files as by_customer
from korpusgraf.sources import readers
from korpusgraf.sources.adapter import chunks, entities, table, targeted_edges, with_relations

RULES = [("*", "all"), ("/orders/", "sales"), ("EUROPE/*", "europe"), ("**/GERMANY", "berlin")]


def directories(s, d):
    return rollup.degrees(pairs(s, d))


def file_graph(s, d):
    """All files, weighted by their edges."""
    return groups.weighted(pairs(s, d))


def numbered_graph(s, d):
    """All files by number, weighted by their edges, and the files' names."""
    names = groups.numbered(entities(s, d).select(rollup.file_key(entities(s, d))))
    return groups.weighted(rollup.file_pairs(targeted_edges(s, d), entities(s, d), numbers=names)), names


def file_groups(s, d):
    graph, names = numbered_graph(s, d)
    return groups.communities(graph, names=names)


def group_tree(s, d):
    """Each file with its finest group and that group's level and size."""
    graph, names = numbered_graph(s, d)
    held, leaves = groups.file_tree(graph, names=names)
    return leaves.join(held.select("key", "parent_key", "level", "files").hint("merge"), "key")


def answers(s, d):
    """An answer for each event, citing files by its numbers."""
    return table(s, d, "events").selectExpr("event_id as answer_id", "concat('see orders/', user_id, '.sql:', event_id % 90 + 1, ' and x', event_id % 7, '/unit.java:', event_id % 50) as text")


def cited_files(s, d):
    return table(s, d, "customer").selectExpr("concat('orders/', c_custkey, '.sql') as path", "60 as lines").union(s.createDataFrame([("x1/unit.java", 30), ("x2/unit.java", 30)], "path string, lines int"))


def names(s, d):
    """Entities named by the words of documents: those of an id divisible by seven name each of their longer words, so that rare and shared names come about."""
    c = table(s, d, "documents").where("doc_id % 7 = 0")
    return c.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_.#]{9,})"), F.lit(1)))).alias("token"))


def settings(s, d):
    """A properties file for each customer, a key for each order."""
    return by_customer(s, d, "'# note\\n\\n'", "concat('key.', x.o_orderkey, ' = v', x.o_orderkey % 7, '\\nlong', x.o_orderkey, ': a\\\\\\n   b\\n! x')")


def with_lang(s, d):
    return table(s, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("text").alias("content"))


QUERIES = {
    "chunk_lines": lambda s, d: chunking.chunked(table(s, d, "documents"), "doc_id", "text"),
    "markdown_outline": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(chunking.outline(F.regexp_replace("text", r"(?m)^([A-Z][a-z]+)\.$", "# $1"))).alias("h")).select("doc_id", "h.line", "h.level", "h.title"),
    "page_lines": lambda s, d: readers.page_lines(table(s, d, "pages")),
    "property_rows": lambda s, d: readers.property_rows(settings(s, d)),
    "repo_statistics": lambda s, d: readers.repo_statistics(with_lang(s, d)),
    "mentions": lambda s, d: evidence.mentions(chunks(s, d), names(s, d)),
    "citations": lambda s, d: evidence.citations(answers(s, d)),
    "citation_reconcile": lambda s, d: evidence.reconciled_citations(evidence.citations(answers(s, d)), cited_files(s, d)),
    "ownership": lambda s, d: evidence.owners(entities(s, d).select(F.col("file_path").alias("path")).distinct(), [(codeowners_pattern(p), o) for p, o in RULES]),
    "evidence_budget": lambda s, d: evidence.within_budget(chunks(s, d), "source", ["chunk_id"], "content", 20_000).select("source", "chunk_id", "used"),
    "fall_through": lambda s, d: evidence.fall_through(entities(s, d).where("type = 'part'").withColumn("ends", F.col("id") % 4 == 0)),
    "file_groups": file_groups,
    "file_group_tree": group_tree,
}
SQL = {
    "repo_statistics": "SELECT lang AS language, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang",
    "markdown_outline": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS line, unnest(l) AS t FROM l)
SELECT doc_id, CAST(line AS INT) AS line, 1 AS level, t[1:-2] AS title FROM x WHERE regexp_full_match(t, '[A-Z][a-z]+\.')""",
    "mentions": with_relations("chunks", """words AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_.#]{4,}')) AS token FROM chunks),
long AS (SELECT DISTINCT chunk_id AS id, unnest(regexp_extract_all(lower(content), '[a-z0-9_.#]{9,}')) AS token FROM chunks WHERE chunk_id % 7 = 0), rare AS (SELECT * FROM long QUALIFY count(*) OVER (PARTITION BY token) <= 3)
SELECT chunk_id, id, count(*) AS uses FROM words JOIN rare USING (token) GROUP BY 1, 2"""),
    "property_rows": f"""WITH {O} SELECT 'src/' || o_custkey AS path, CAST(3 * n AS INT) AS line, 'key.' || o_orderkey AS key, 'v' || o_orderkey % 7 AS value FROM o UNION ALL SELECT 'src/' || o_custkey, CAST(3 * n + 1 AS INT), 'long' || o_orderkey, 'ab' FROM o""",
    "citations": "SELECT event_id AS answer_id, 'orders/' || user_id || '.sql' AS path, CAST(event_id % 90 + 1 AS INT) AS line FROM events UNION ALL SELECT event_id, 'x' || event_id % 7 || '/unit.java', CAST(event_id % 50 AS INT) FROM events",
    "citation_reconcile": """SELECT event_id AS answer_id, 'orders/' || user_id || '.sql' AS path, CAST(event_id % 90 + 1 AS INT) AS line, CASE WHEN user_id IN (SELECT c_custkey FROM customer) AND event_id % 90 + 1 <= 60 THEN 'kept' ELSE 'removed' END AS state FROM events
UNION ALL SELECT event_id, 'x' || event_id % 7 || '/unit.java', CAST(event_id % 50 AS INT), CASE WHEN event_id % 7 IN (1, 2) AND event_id % 50 <= 30 THEN 'kept' ELSE 'ambiguous' END FROM events""",
    "ownership": with_relations("entities", "SELECT DISTINCT file_path AS path, CASE WHEN file_path LIKE '%/GERMANY' THEN 'berlin' WHEN file_path LIKE 'EUROPE/%' THEN 'europe' WHEN file_path LIKE 'orders/%' THEN 'sales' ELSE 'all' END AS owner FROM entities"),
    "evidence_budget": "SELECT source, doc_id AS chunk_id, CAST(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents QUALIFY used <= 20000",
    "fall_through": with_relations("entities", "SELECT file_path, id, next_id FROM (SELECT *, lead(id) OVER (PARTITION BY file_path ORDER BY start_line, id) AS next_id FROM entities WHERE type = 'part') WHERE id % 4 <> 0 AND next_id IS NOT NULL"),
}
