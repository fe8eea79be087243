"""Queries of full-text rank by cover density over the documents' texts, and of evidence packs that are made to fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import cover, fitting
from korpusgraf.sources.adapter import chunks, table, with_relations

QUERY = 'the "of the" -erin or le la'


def ranked(s, d):
    return cover.cover_rank(chunks(s, d), QUERY).withColumn("rank", F.round("rank", 6))


def packs(s, d):
    """A pack for each conversation: its turns as call sites, expanded sources and origins, three turns an entry."""
    block = "case role when 'user' then 'call_sites' when 'assistant' then 'expanded' else 'data_origin' end"
    items = table(s, d, "conversations").selectExpr("conv_id as id", f"struct(cast(turn div 3 as int) as entry, {block} as block, cast(turn as int) as nr, coalesce(text, '') as text) as item")
    fit = fitting.fitted(items.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items")), 900)
    shown = F.transform(F.array_sort("items"), lambda x: F.concat_ws(":", x["entry"].cast("string"), x["block"], x["nr"].cast("string"), F.char_length(x["text"]).cast("string")))
    return fit.select("id", F.array_join(shown, ",").alias("items"), "size", "fits")


QUERIES = {"cover_rank": ranked, "evidence_steps": packs}
SQL = {
    # all windows between two hits that hold an alternative, and of these the ones without a smaller one inside
    "cover_rank": with_relations("chunks", r"""t AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\pL\pN]+') AS ws FROM chunks),
u AS (SELECT chunk_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
h AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS r FROM u WHERE word IN ('the', 'of', 'erin', 'le', 'la')),
o AS (SELECT chunk_id, word AS op, r AS s, r AS e FROM h WHERE word IN ('the', 'le', 'la') UNION ALL SELECT a.chunk_id, 'of the', a.r, b.r FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1 AND a.word = 'of' AND b.word = 'the'),
g AS (SELECT chunk_id, list({'op': op, 's': s, 'e': e}) AS os FROM o GROUP BY chunk_id),
f AS (SELECT chunk_id FROM h GROUP BY chunk_id HAVING bool_or(word = 'le') AND bool_or(word = 'la') UNION SELECT chunk_id FROM o WHERE op = 'of the' AND chunk_id NOT IN (SELECT chunk_id FROM h WHERE word = 'erin')),
v AS (SELECT a.chunk_id, a.r AS p, b.r AS q, b.pos - a.pos - (b.r - a.r) AS noise FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND b.r >= a.r JOIN g ON g.chunk_id = a.chunk_id JOIN f ON f.chunk_id = a.chunk_id,
  LATERAL (SELECT list_distinct(list_transform(list_filter(os, lambda x: x.s >= a.r AND x.e <= b.r), lambda x: x.op)) AS held) WHERE list_has_all(held, ['the', 'of the']) OR list_has_all(held, ['le', 'la'])),
m AS (SELECT * FROM v WHERE NOT EXISTS (FROM v x WHERE x.chunk_id = v.chunk_id AND x.p = v.p + 1 AND x.q = v.q) AND NOT EXISTS (FROM v x WHERE x.chunk_id = v.chunk_id AND x.p = v.p AND x.q = v.q - 1))
SELECT f.chunk_id, CAST(count(m.p) AS INT) AS covers, round(coalesce(sum(0.1 / (1 + noise)), 0), 6) AS rank FROM f LEFT JOIN m ON m.chunk_id = f.chunk_id GROUP BY f.chunk_id"""),
}
