"""Queries of search, vectors and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.functions import text as T
from korpusgraf.operators import resolution, search, vectors
from korpusgraf.sources.adapter import ORDER, PART, chunks, edges, entities, table, with_relations

UNIT = """unit AS (SELECT CAST(vec_id AS BIGINT) AS id, label AS source, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings),
n AS (SELECT id, source, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS norm FROM unit)"""
COS = "list_sum(list_transform(generate_series(1, len(a.d)), lambda i: a.d[i] * b.d[i])) / a.norm / b.norm"


def unit(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source"), vectors.unit(F.col("embedding")).alias("v"))


def asked(s, d):
    return unit(s, d).where("id % 50 = 0")


def one_query(s, d):
    return [float(x) for x in table(s, d, "embeddings").where("vec_id = 7").first()["embedding"]]


def text_functions(s, d):
    e = entities(s, d).where("type in ('part', 'nation')")
    c = F.col
    return e.select(
        "id", T.path_tail(c("file_path")).alias("tail"), F.array_join(T.search_tokens(c("qualified_name")), " ").alias("tokens"), F.array_join(T.entity_keywords(c("name"), c("file_path")), " ").alias("keywords"),
        F.array_join(T.query_variants(F.regexp_replace(c("qualified_name"), "#", ".")), " ").alias("variants"), T.is_test_path(F.concat(c("name"), F.lit("Test.java"))).alias("is_test"), T.language_of(F.concat(c("file_path"), F.lit(".sql"))).alias("lang"),
        F.array_join(T.question_stems(c("name")), " ").alias("stems"),
    )


def tiers(s, d):
    refs = edges(s, d).where("resolution = 'unresolved'").select(F.col("edge_id").alias("ref_id"), F.col("dst_name").alias("name"))
    held = entities(s, d).where("type = 'part'").select("name", F.when(F.col("source_id") == 0, 0).otherwise(1).alias("tier"), F.col("id").alias("target_id"))
    return resolution.resolve_tiers(refs, held, "name")


def qualified_refs(s, d):
    """Unresolved references by the unique qualified name, one per line item of an open part."""
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    refs = li.selectExpr(f"{ORDER} + l_orderkey as src_id", "case when l_linenumber % 2 = 0 then concat(p_name, '#', p_partkey) else p_name end as dst_name", "'unresolved' as resolution", "cast(null as bigint) as dst_id", "l_linenumber as line")
    e = entities(s, d).where("type = 'part'")
    held = e.select(F.upper("name").alias("key"), F.col("id").alias("target_id")).union(e.select(F.upper("qualified_name"), "id"))
    done = resolution.resolve_unique(refs.withColumn("key", F.upper("dst_name")), held, ["key"])
    return done.groupBy("src_id", "resolution").agg(F.count("*").alias("edges"), F.sum("dst_id").alias("sum_dst"))


def external_name():
    """A target's name behind a prefix chosen by the edge's line, some of which are of systems."""
    return F.concat(F.get(F.array(*[F.lit(p) for p in ("CEE", "DFH", "dsn", "IGZ", "MQ", "XX", "A")]), F.col("line") - 1), F.col("dst_name"))


def external(name):
    return F.startswith(F.upper(name), F.lit("A")) | F.startswith(F.upper(name), F.lit("B"))


def fusion(s, d):
    a = search.term_score(chunks(s, d), ["the", "tion"]).select(F.col("chunk_id").alias("id"), "score")
    b = vectors.cosine_top_k(unit(s, d), one_query(s, d), 40).select("id", (1 - F.col("distance")).alias("score"))
    return vectors.rank_fusion([a, b])


def hybrid(s, d):
    c = chunks(s, d)
    page = c.where(T.contains_ci(F.col("content"), F.lit("license"))).select(F.col("chunk_id").alias("id"), F.lit(0.0).alias("pos"))
    near = vectors.cosine_top_k(unit(s, d), one_query(s, d), 10).select("id", F.col("distance").alias("pos"))
    return vectors.ordered_union([page, near], 20)


def quotas(s, d):
    near = vectors.cosine_top_k(unit(s, d), one_query(s, d), 200)
    hits = near.select("id", F.concat(F.lit("f"), F.col("id") % 60).alias("file"), F.when(F.col("id") % 3 == 0, "code").when(F.col("id") % 3 == 1, "test").otherwise("other").alias("kind"), (1 - F.col("distance")).alias("score"))
    return vectors.quota_rerank(hits, {"test": 2, "other": 2}, 12).select("id", "file", "kind", F.round("score", 4).alias("score"))


QUERIES = {
    "search_tiered": lambda s, d: search.search_entities(entities(s, d), "BRAZIL", ["b", "a"], 60, {"nation": 0, "part": 1}),
    "search_documents": lambda s, d: search.search_documents(chunks(s, d), ["license", "the"]),
    "name_hits": lambda s, d: search.name_hits(entities(s, d), ["supp", "cust", "00"], 30),
    "lexical_fallback": lambda s, d: search.lexical_fallback(chunks(s, d), ["license", "token", "password", "released"]),
    "symbol_matches": lambda s, d: search.symbol_matches(entities(s, d), entities(s, d).where("type = 'supplier'").select(F.col("qualified_name").alias("query"), T.query_variants(F.col("qualified_name")).alias("variants"))),
    "first_chunk_per_source": lambda s, d: search.first_per_file(chunks(s, d).select(F.col("source").alias("file_path"), "chunk_id"), 20),
    "term_score": lambda s, d: search.term_score(chunks(s, d), ["the", "tion"]),
    "text_functions": text_functions,
    "content_fingerprint": lambda s, d: chunks(s, d).select("chunk_id", T.content_fingerprint(F.col("content")).alias("fingerprint")),
    "cosine_top_k": lambda s, d: vectors.cosine_top_k(unit(s, d), one_query(s, d), 20),
    "nearest_join": lambda s, d: vectors.nearest(asked(s, d), unit(s, d), 5),
    "document_links": lambda s, d: vectors.undirected(vectors.nearest(unit(s, d), unit(s, d), 5, same_source=False), 0.2),
    "rank_fusion": fusion,
    "hybrid_search": hybrid,
    "quota_rerank": quotas,
    "resolve_unique_names": qualified_refs,
    "resolve_tiers": tiers,
    "edges_by_resolution": lambda s, d: resolution.edges_by_resolution(edges(s, d), external("dst_name")),
    "resolution_preflight": lambda s, d: resolution.preflight(edges(s, d), entities(s, d).where("type = 'part'")),
    "multiset_difference": lambda s, d: resolution.multiset_difference(edges(s, d).select("type", "dst_name"), edges(s, d).where("line <= 2").select("type", "dst_name")).groupBy("type", "dst_name").agg(F.count("*").alias("n")),
    "unresolved_by_name": lambda s, d: resolution.unresolved_by_name(edges(s, d), entities(s, d).where("type = 'part'").select("name").distinct()),
    "external_targets": lambda s, d: edges(s, d).select("edge_id", resolution.external_category(external_name()).alias("category")),
}
OPEN = "open_ AS (SELECT * FROM edges WHERE resolution = 'unresolved')"
SQL = {
    "search_tiered": with_relations("entities", """SELECT id, name, tier FROM (SELECT *, CASE WHEN lower(name) = 'brazil' THEN 0 WHEN starts_with(lower(name), 'brazil') THEN 1 WHEN contains(lower(name), 'b') AND contains(lower(name), 'a') THEN 2
  WHEN contains(lower(qualified_name), 'b') AND contains(lower(qualified_name), 'a') THEN 3 ELSE 4 END AS tier FROM entities
  WHERE contains(lower(name || ' ' || qualified_name || ' ' || file_path), 'b') AND contains(lower(name || ' ' || qualified_name || ' ' || file_path), 'a'))
ORDER BY tier, CASE type WHEN 'nation' THEN 0 WHEN 'part' THEN 1 ELSE 2 END, length(name), name, id LIMIT 60"""),
    "search_documents": with_relations("chunks", "SELECT file_path, min(chunk_id) AS chunk_id, count(*) AS chunks FROM chunks WHERE contains(lower(file_path || ' ' || content), 'license') AND contains(lower(file_path || ' ' || content), 'the') GROUP BY 1"),
    "name_hits": with_relations("entities", """SELECT id, hits FROM (SELECT id, name, CAST(contains(q, 'supp') AS INT) + CAST(contains(q, 'cust') AS INT) + CAST(contains(q, '00') AS INT) AS hits
  FROM (SELECT *, regexp_replace(lower(name), '[-_. ]', '', 'g') AS q FROM entities)) WHERE hits >= 2 ORDER BY hits DESC, length(name), id LIMIT 30"""),
    "lexical_fallback": with_relations("chunks", """SELECT chunk_id, hits FROM (SELECT chunk_id, CAST(contains(lower(content), 'license') AS INT) + CAST(contains(lower(content), 'token') AS INT) + CAST(contains(lower(content), 'password') AS INT) + CAST(contains(lower(content), 'released') AS INT) AS hits FROM chunks)
WHERE hits > 0 ORDER BY hits DESC, chunk_id LIMIT 10"""),
    "symbol_matches": with_relations("entities", """SELECT DISTINCT q.qualified_name AS query, e.id FROM entities q JOIN entities e ON q.type = 'supplier' AND (e.name IN (q.qualified_name, replace(q.qualified_name, '.', '#')) OR e.qualified_name IN (q.qualified_name, replace(q.qualified_name, '.', '#')))"""),
    "first_chunk_per_source": with_relations("chunks", "SELECT source AS file_path, min(chunk_id) AS chunk_id FROM chunks GROUP BY 1 ORDER BY 1 LIMIT 20"),
    "term_score": with_relations("chunks", """SELECT chunk_id, score FROM (SELECT chunk_id, round(((length(l) - length(replace(l, 'the', ''))) / 3 + (length(l) - length(replace(l, 'tion', ''))) / 4) / (1 + ln(length(l) + 1)), 4) AS score
  FROM (SELECT chunk_id, translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM chunks)) WHERE score > 0"""),
    "text_functions": with_relations("entities", r"""e AS (SELECT id, name, qualified_name AS q, regexp_extract(file_path, '[^/]*$') AS tail FROM entities WHERE type IN ('part', 'nation')),
t AS (SELECT *, list_filter(string_split_regex(lower(trim(q)), '[ \t\n\r.#]+|::'), lambda x: x <> '') AS k, string_split_regex(lower(name || '-' || regexp_replace(tail, '\.[^.]*$', '')), '[-_# ]+') AS w, list_transform(regexp_extract_all(lower(name), '[a-zäöüß0-9]{4,}'), lambda x: x[1:5]) AS s FROM e)
SELECT id, tail, array_to_string(CASE WHEN contains(trim(q), ' ') THEN k[1:6] ELSE k[-6:] END, ' ') AS tokens, array_to_string(list_filter(w, lambda x, i: length(x) >= 3 AND list_position(w, x) = i), ' ') AS keywords,
  replace(q, '#', '.') || ' ' || replace(replace(q, '#', '.'), '.', '#') AS variants, true AS is_test, 'sql' AS lang, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ' ') AS stems FROM t"""),
    "content_fingerprint": with_relations("chunks", r"SELECT chunk_id, sha256(trim(regexp_replace(content, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS fingerprint FROM chunks"),
    "cosine_top_k": f"WITH {UNIT} SELECT b.id, round(1 - {COS}, 4) AS distance FROM n a, n b WHERE a.id = 7 ORDER BY distance, b.id LIMIT 20",
    "nearest_join": f"WITH {UNIT}, s AS (SELECT a.id AS query_id, b.id, round({COS}, 4) AS score FROM n a JOIN n b ON a.id % 50 = 0 AND a.id <> b.id) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 5",
    "document_links": f"WITH {UNIT}, s AS (SELECT a.id AS query_id, b.id, round({COS}, 4) AS score FROM n a JOIN n b ON a.source <> b.source), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5) SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS score FROM r WHERE score >= 0.2 GROUP BY 1, 2",
    "rank_fusion": with_relations("chunks", f"""{UNIT}, near AS (SELECT b.id, 1 - round(1 - {COS}, 4) AS score FROM n a, n b WHERE a.id = 7 ORDER BY round(1 - {COS}, 4), b.id LIMIT 40),
t AS (SELECT chunk_id AS id, round(((length(l) - length(replace(l, 'the', ''))) / 3 + (length(l) - length(replace(l, 'tion', ''))) / 4) / (1 + ln(length(l) + 1)), 4) AS score
  FROM (SELECT chunk_id, translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM chunks)),
r AS (SELECT id, 1 / (19 + row_number() OVER (ORDER BY score DESC, id DESC)) AS s FROM (SELECT * FROM t WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 40) UNION ALL SELECT id, 1 / (19 + row_number() OVER (ORDER BY score DESC, id DESC)) FROM near)
SELECT id, round(sum(s), 6) AS score FROM r GROUP BY id ORDER BY score DESC, id DESC LIMIT 20"""),
    "hybrid_search": with_relations("chunks", f"""{UNIT}, near AS (SELECT b.id, 1 AS channel, round(1 - {COS}, 4) AS pos FROM n a, n b WHERE a.id = 7 ORDER BY pos, b.id LIMIT 10),
u AS (SELECT chunk_id AS id, 0 AS channel, CAST(0 AS DOUBLE) AS pos FROM chunks WHERE contains(lower(content), 'license') UNION ALL SELECT * FROM near)
SELECT * FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY channel, pos) = 1) ORDER BY channel, pos, id LIMIT 20"""),
    "quota_rerank": f"""WITH {UNIT}, near AS (SELECT b.id, 'f' || b.id % 60 AS file, ['code', 'test', 'other'][b.id % 3 + 1] AS kind, round(1 - round(1 - {COS}, 4), 4) AS score FROM n a, n b WHERE a.id = 7 ORDER BY round(1 - {COS}, 4), b.id LIMIT 200),
f AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, id) = 1), k AS (SELECT * FROM f QUALIFY kind = 'code' OR row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) <= 2)
SELECT id, file, kind, score FROM k ORDER BY score DESC, id LIMIT 12""",
    "external_targets": with_relations("edges", """n AS (SELECT edge_id, ['CEE', 'DFH', 'dsn', 'IGZ', 'MQ', 'XX', 'A'][line] || dst_name AS name FROM edges)
SELECT edge_id, CASE upper(name[1:3]) WHEN 'CEE' THEN 'runtime' WHEN 'DFH' THEN 'transaction-system' WHEN 'DSN' THEN 'database' WHEN 'IGZ' THEN 'runtime' ELSE CASE WHEN name LIKE 'MQ%' THEN 'messaging' END END AS category FROM n"""),
    "resolve_unique_names": f"""WITH refs AS (SELECT {ORDER} + l_orderkey AS src_id, CASE WHEN l_linenumber % 2 = 0 THEN p_name || '#' || p_partkey ELSE p_name END AS dst_name FROM lineitem JOIN part ON l_partkey = p_partkey),
held AS (SELECT upper(p_name) AS key, {PART} + p_partkey AS t FROM part UNION ALL SELECT upper(p_name || '#' || p_partkey), {PART} + p_partkey FROM part), one AS (SELECT key, min(t) AS t FROM held GROUP BY key HAVING count(DISTINCT t) = 1)
SELECT src_id, CASE WHEN t IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution, count(*) AS edges, CAST(sum(t) AS BIGINT) AS sum_dst FROM refs LEFT JOIN one ON upper(dst_name) = key GROUP BY 1, 2""",
    "resolve_tiers": with_relations("edges entities", """SELECT edge_id AS ref_id, t AS target_id FROM edges LEFT JOIN (SELECT name, CASE WHEN n0 = 1 THEN t0 WHEN n0 = 0 AND n1 = 1 THEN t1 END AS t FROM
  (SELECT name, count(*) FILTER (source_id = 0) AS n0, min(id) FILTER (source_id = 0) AS t0, count(*) FILTER (source_id <> 0) AS n1, min(id) FILTER (source_id <> 0) AS t1 FROM entities WHERE type = 'part' GROUP BY name)) ON name = dst_name WHERE resolution = 'unresolved'"""),
    "edges_by_resolution": with_relations("edges", "SELECT type, count(*) FILTER (resolution = 'resolved') AS resolved, count(*) FILTER (resolution = 'unresolved' AND upper(dst_name)[1] NOT IN ('A', 'B')) AS unresolved, count(*) FILTER (resolution = 'dynamic') AS dynamic, count(*) FILTER (resolution = 'unresolved' AND upper(dst_name)[1] IN ('A', 'B')) AS external FROM edges GROUP BY type"),
    "resolution_preflight": with_relations("edges entities", "SELECT * FROM (SELECT dst_name, count(*) AS uses, min(line) AS first_line, CASE WHEN any_value(n) IS NULL THEN 'missing' WHEN any_value(n) > 1 THEN 'ambiguous' END AS state FROM edges LEFT JOIN (SELECT name, count(*) AS n FROM entities WHERE type = 'part' GROUP BY name) ON name = dst_name WHERE resolution = 'unresolved' GROUP BY dst_name) WHERE state IS NOT NULL"),
    "multiset_difference": with_relations("edges", "SELECT type, dst_name, count(*) AS n FROM (SELECT type, dst_name FROM edges EXCEPT ALL SELECT type, dst_name FROM edges WHERE line <= 2) GROUP BY ALL"),
    "unresolved_by_name": with_relations("edges entities", "SELECT name, count(*) AS open_edges FROM (SELECT DISTINCT name FROM entities WHERE type = 'part') JOIN edges ON lower(dst_name) = lower(name) WHERE resolution = 'unresolved' GROUP BY name"),
}
