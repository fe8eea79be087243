"""Queries of linking and incremental processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.functions import text as T
from korpusgraf.operators import incremental as inc
from korpusgraf.operators import linking, vectors
from korpusgraf.plans.search_queries import COS, UNIT, asked, unit
from korpusgraf.sources.adapter import chunks, entities, table, with_relations


def named(s, d):
    """Suppliers with the words that documents use, as keywords."""
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.lit("the"), F.concat(F.lit("th"), F.substring(F.lit("ereatinonndha"), (F.col("s_suppkey") % 12 + 1).cast("int"), F.lit(2))), F.lit("license")).alias("keywords"))


def keyword(s, d):
    return linking.keyword_pass(named(s, d), chunks(s, d), 0.5, 10)


def old_links(found):
    """Every third pair of the keyword pass, decided by its ids."""
    return found.where("(id + chunk_id) % 3 = 0").select("id", "chunk_id", F.when(F.col("chunk_id") % 2 == 0, "approved").otherwise("pending").alias("status"), F.lit(0.1).alias("score"))


def files(s, d, new):
    c = table(s, d, "documents")
    if not new:
        return c.where("doc_id % 7 <> 1").select(F.col("doc_id").alias("path"), F.sha2(F.col("text"), 256).alias("hash"))
    return c.where("doc_id % 7 <> 2").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))


def fingerprints(s, d, offset, skip):
    return table(s, d, "documents").where(f"doc_id % 7 <> {skip}").select((F.col("doc_id") + offset).alias("chunk_id"), T.content_fingerprint(F.col("text")).alias("fingerprint"))


def doc_links(s, d):
    return table(s, d, "documents").select((F.col("doc_id") * 10).alias("link_id"), F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 3 == 0, "approved").when(F.col("doc_id") % 3 == 1, "rejected").otherwise("pending").alias("status"))


def queue(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("id"), "ts")


def attempts(s, d):
    return table(s, d, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 17).alias("attempt"))


def runs(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("scope"), F.when(F.col("event_id") % 3 == 0, "active").otherwise("done").alias("state"))


def due_sources(s, d):
    """Users as sources, last synced at their last event."""
    e = table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_sync"), F.max("event_id").alias("m"))
    e = e.select("id", "last_sync", (F.col("id") % 5 * 3600).alias("interval_s"), (F.col("m") % 4).alias("failures"), (F.col("id") % 11 == 0).alias("paused"))
    top = table(s, d, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
    return inc.due(e, top).select("id", "interval_s", "failures")


NOW = "2024-02-15"


def titled(s, d):
    return table(s, d, "documents").selectExpr("doc_id as chunk_id", "concat(source, ' ', doc_id % 50) as title", "doc_id % 3 = 0 as is_local")


def semantic(s, d):
    """Vectors as entities and chunks: the nearest of each asked vector are its chunks."""
    near = vectors.nearest(asked(s, d), unit(s, d), 30).select(F.col("query_id").alias("id"), F.col("id").alias("chunk_id"), F.round(1 - F.col("score"), 4).alias("distance"))
    keys = linking.candidate_keys(table(s, d, "embeddings").selectExpr("vec_id as chunk_id", "concat('t', vec_id % 40) as title", "vec_id % 3 = 0 as is_local"))
    return linking.semantic_pass(near, keys, 0.2, 20)


def votes(s, d):
    return table(s, d, "events").select("ts", (F.col("event_id") % 300 * 10).alias("link_id"), F.col("user_id").alias("session_id"), (F.col("event_id") % 4 == 0).alias("revoked"))


def bindings(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("source_id"), F.col("o_orderstatus").alias("version"))


def sources(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 2 == 0, "F").otherwise("O").alias("version"), (F.col("s_suppkey") % 7 != 0).alias("indexed"))


def deps(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("path"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("needs"))


QUERIES = {
    "keyword_pass": keyword,
    "merge_passes": lambda s, d: linking.merged([found := keyword(s, d), found.withColumn("score", F.lit(0.9))], 0.95),
    "undecided_pairs": lambda s, d: linking.undecided(found := keyword(s, d), old_links(found)),
    "store_links": lambda s, d: linking.stored_links(old_links(found := keyword(s, d)), found.where("id % 2 = 0")),
    "link_status_counts": lambda s, d: linking.status_counts(old_links(keyword(s, d)), F.col("id") > 3),
    "feedback_escalation": lambda s, d: linking.escalated(doc_links(s, d), votes(s, d), NOW),
    "semantic_pass": semantic,
    "candidate_keys": lambda s, d: linking.candidate_keys(titled(s, d)),
    "without_own_source": lambda s, d: linking.without_own_source(keyword(s, d).select("id", "chunk_id"), table(s, d, "supplier").selectExpr("s_suppkey as id", "s_nationkey % 3 as source_id", "cast(s_suppkey % 4 as string) as file_path"), table(s, d, "documents").selectExpr("doc_id as chunk_id", "doc_id % 3 as source_id", "cast(doc_id % 4 as string) as file_path")),
    "set_pairings": lambda s, d: linking.pairings(table(s, d, "events").selectExpr("user_id % 20 as run", "case when event_id % 2 = 0 then 'a' else 'b' end as side", "case when event_id % 5 < 2 then 'code' else 'doc' end as kind", "event_id % 60 as item")),
    "run_parameters": lambda s, d: linking.run_parameters(table(s, d, "customer").selectExpr("c_custkey as run", "c_mktsegment as profile", "case when c_custkey % 3 = 0 then c_acctbal / 1000 end as threshold", "case when c_custkey % 4 = 0 then double(c_custkey) end as best"), s.createDataFrame([("BUILDING", 0.5, None), ("MACHINERY", None, 30.0)], "profile string, threshold double, best double"), {"threshold": (0.0, 1.0, 0.45), "best": (1.0, 50.0, 20.0)}),
    "run_selection": lambda s, d: linking.run_selection(entities(s, d).where("type = 'supplier'").select("id"), table(s, d, "events").select(F.lit("entity").alias("kind"), (F.col("user_id") + 1_000_000).alias("id")), False),
    "file_delta": lambda s, d: inc.delta(files(s, d, False), files(s, d, True)),
    "orphan_removal": lambda s, d: inc.orphans(files(s, d, False), files(s, d, True)).select("path"),
    "reindex_links": lambda s, d: inc.reindexed(fingerprints(s, d, 0, 1), fingerprints(s, d, 1_000_000, 2), doc_links(s, d)),
    "dirty_queue": lambda s, d: inc.coalesced(queue(s, d)),
    "due_sources": due_sources,
    "latest_attempts": lambda s, d: inc.latest_attempts(attempts(s, d), ["user_id", "event_type"]),
    "run_reconciliation": lambda s, d: inc.reconciled(runs(s, d)),
    "version_state": lambda s, d: inc.version_state(bindings(s, d), sources(s, d)),
    "last_question": lambda s, d: inc.last_before(table(s, d, "conversations")),
    "dependency_closure": lambda s, d: inc.dependency_closure(deps(s, d), 3),
    "dependency_closure_whole": lambda s, d: inc.dependency_closure(deps(s, d)),
    "pending_vectors": lambda s, d: inc.pending_vectors(table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("embedding_model"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("embedding_next_model")), "en").select("doc_id"),
    "reused_vectors": lambda s, d: inc.reused_vectors(files(s, d, True).select(F.col("path").alias("chunk_id"), "hash", F.lit("m").alias("model")), files(s, d, False).select(F.col("path").alias("vec_id"), "hash", F.lit("m").alias("model"))).select("chunk_id", "vec_id"),
}
KW = """keys AS (SELECT s_suppkey AS id, unnest(list_distinct(['the', 'th' || substr('ereatinonndha', CAST(s_suppkey % 12 + 1 AS INT), 2), 'license'])) AS k FROM supplier),
kw AS (SELECT id, chunk_id, round(count(*) / any_value(n), 4) AS score FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM keys) JOIN chunks ON contains(lower(content), k)
  GROUP BY 1, 2 HAVING round(count(*) / any_value(n), 4) >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(count(*) / any_value(n), 4) DESC, chunk_id) <= 10),
links AS (SELECT id, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'approved' ELSE 'pending' END AS status, 0.1 AS score FROM kw WHERE (id + chunk_id) % 3 = 0)"""
_k = lambda body: with_relations("chunks", f"{KW} {body}")
FILES = """old AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 1),
new AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 3 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 2)"""
DOC_LINKS = "links AS (SELECT doc_id * 10 AS link_id, doc_id AS chunk_id, CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM documents)"
SQL = {
    "keyword_pass": _k("SELECT * FROM kw"),
    "merge_passes": _k("SELECT id, chunk_id, greatest(score, 0.9) AS score FROM kw WHERE score > 0.95"),
    "undecided_pairs": _k("SELECT * FROM kw WHERE (id, chunk_id) NOT IN (SELECT id, chunk_id FROM links WHERE status IN ('approved', 'rejected'))"),
    "store_links": _k("SELECT coalesce(l.id, f.id) AS id, coalesce(l.chunk_id, f.chunk_id) AS chunk_id, coalesce(l.status, 'pending') AS status, CASE WHEN l.status = 'approved' THEN CAST(l.score AS DOUBLE) ELSE round(coalesce(f.score, l.score), 4) END AS score FROM links l FULL JOIN (SELECT * FROM kw WHERE id % 2 = 0) f ON l.id = f.id AND l.chunk_id = f.chunk_id"),
    "link_status_counts": _k("SELECT status, count(*) AS links FROM links WHERE id > 3 GROUP BY 1"),
    "feedback_escalation": f"WITH {DOC_LINKS}, hot AS (SELECT event_id % 300 * 10 AS link_id FROM events WHERE event_id % 4 <> 0 AND ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1 HAVING count(DISTINCT user_id) >= 2) SELECT link_id, chunk_id, CASE WHEN status = 'approved' AND link_id IN (SELECT link_id FROM hot) THEN 'pending' ELSE status END AS status FROM links",
    "semantic_pass": f"""WITH {UNIT}, s AS (SELECT a.id, b.id AS chunk_id, round(1 - round({COS}, 4), 4) AS distance FROM n a JOIN n b ON a.id % 50 = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({COS}, 4) DESC, b.id) <= 30),
f AS (SELECT *, round(greatest(0, 1 - distance), 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, chunk_id) <= 20)
SELECT id, chunk_id, score FROM f WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY id, 't' || chunk_id % 40 || CASE WHEN chunk_id % 3 = 0 THEN '#' || chunk_id ELSE '' END ORDER BY distance, chunk_id) = 1""",
    "candidate_keys": "SELECT doc_id AS chunk_id, source || ' ' || doc_id % 50 || CASE WHEN doc_id % 3 = 0 THEN '#' || doc_id ELSE '' END AS key FROM documents",
    "without_own_source": _k("SELECT id, chunk_id FROM kw JOIN supplier ON s_suppkey = id WHERE NOT (s_nationkey % 3 = chunk_id % 3 AND id % 4 = chunk_id % 4)"),
    "set_pairings": """WITH s AS (SELECT DISTINCT user_id % 20 AS run, event_id % 2 AS side, CASE WHEN event_id % 5 < 2 THEN 'code' ELSE 'doc' END AS kind, event_id % 60 AS item FROM events)
SELECT a.run, a.kind AS a_kind, b.kind AS b_kind, count(*) FILTER (a.kind <> b.kind OR a.item <> b.item) AS pairs FROM s a JOIN s b ON a.run = b.run AND a.side = 0 AND b.side = 1 AND NOT (a.kind = 'code' AND b.kind = 'code') GROUP BY ALL""",
    "run_parameters": """SELECT c_custkey AS run, greatest(0, least(1, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 1000 END, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 END, 0.45))) AS threshold,
greatest(1, least(50, coalesce(CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS DOUBLE) END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 30 END, 20))) AS best FROM customer""",
    "run_selection": "SELECT 1000000 + s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT user_id FROM events)",
    "file_delta": f"WITH {FILES} SELECT * FROM (SELECT path, CASE WHEN old.hash IS NULL THEN 'added' WHEN new.hash IS NULL THEN 'deleted' WHEN old.hash <> new.hash THEN 'modified' END AS change FROM old FULL JOIN new USING (path)) WHERE change IS NOT NULL",
    "orphan_removal": f"WITH {FILES} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)",
    "reindex_links": rf"""WITH {DOC_LINKS}, fp AS (SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS f FROM documents),
o AS (SELECT f, min(doc_id) AS a FROM fp WHERE doc_id % 7 <> 1 GROUP BY f HAVING count(*) = 1), n AS (SELECT f, min(doc_id) + 1000000 AS b FROM fp WHERE doc_id % 7 <> 2 GROUP BY f HAVING count(*) = 1), m AS (SELECT a, b FROM o JOIN n USING (f))
SELECT link_id, b AS chunk_id, CASE WHEN b IS NULL AND status = 'approved' THEN 'pending' ELSE status END AS status FROM links LEFT JOIN m ON a = chunk_id WHERE b IS NOT NULL OR status <> 'pending'""",
    "dirty_queue": "SELECT event_type AS kind, user_id AS id, min(ts) AS first_ts, count(*) AS items FROM events GROUP BY 1, 2",
    "due_sources": "WITH e AS (SELECT user_id AS id, max(ts) AS l, user_id % 5 * 3600 AS interval_s, max(event_id) % 4 AS failures FROM events GROUP BY 1) SELECT id, interval_s, failures FROM e WHERE interval_s > 0 AND id % 11 <> 0 AND floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(l)) >= interval_s * 2 ** failures",
    "latest_attempts": "SELECT event_id, user_id, event_type, event_id % 17 AS attempt FROM events QUALIFY attempt = max(event_id % 17) OVER (PARTITION BY user_id, event_type)",
    "run_reconciliation": "SELECT event_id AS id, user_id AS scope, CASE WHEN event_id % 3 <> 0 THEN 'done' WHEN row_number() OVER (PARTITION BY user_id, event_id % 3 = 0 ORDER BY event_id) = 1 THEN 'active' ELSE 'ended' END AS state FROM events",
    "version_state": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'O' END AS v FROM supplier)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'unbound' WHEN k IS NULL THEN 'other_source' WHEN k % 7 = 0 THEN 'index_unavailable' WHEN o_orderstatus = v THEN 'current' ELSE 'different_version' END AS state FROM orders LEFT JOIN s ON k = o_custkey""",
    "last_question": "SELECT conv_id, turn, question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations) WHERE role = 'assistant'",
    "dependency_closure": """WITH RECURSIVE step AS (SELECT DISTINCT path, needs FROM (SELECT p_partkey AS path, unnest([p_partkey // 2, p_partkey // 3]) AS needs FROM part) WHERE path <> needs),
walk AS (SELECT path, needs, 1 AS n FROM step UNION SELECT walk.path, step.needs, n + 1 FROM walk JOIN step ON step.path = walk.needs WHERE n < 3) SELECT DISTINCT path, needs FROM walk WHERE path <> needs""",
    "dependency_closure_whole": """WITH RECURSIVE step AS (SELECT DISTINCT path, needs FROM (SELECT p_partkey AS path, unnest([p_partkey // 2, p_partkey // 3]) AS needs FROM part) WHERE path <> needs),
walk AS (SELECT path, needs FROM step UNION SELECT walk.path, step.needs FROM walk JOIN step ON step.path = walk.needs) SELECT path, needs FROM walk WHERE path <> needs""",
    "pending_vectors": "SELECT doc_id FROM documents WHERE (CASE WHEN doc_id % 2 = 0 THEN lang END) IS DISTINCT FROM 'en' AND (CASE WHEN doc_id % 3 = 0 THEN lang END) IS DISTINCT FROM 'en'",
    "reused_vectors": f"WITH {FILES}, h AS (SELECT hash, min(path) AS vec_id FROM old GROUP BY hash) SELECT path AS chunk_id, vec_id FROM new LEFT JOIN h USING (hash)",
}
