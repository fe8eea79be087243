"""The tolerant lookup of symbols."""

from __future__ import annotations

from korpusgraf.operators import lookup
from korpusgraf.sources.adapter import entities, with_relations

LIMIT = 12
TERMS = ["AFRICA.NATION_5", "ORDER-7", "NATION_5 Supplier", "where is ORDER-31 unknownword orders", "ORDER-12.zzz", "qqqq", "EUROPE.zzz unknownword"]

QUERIES = {"symbol_lookup": lambda s, d: lookup.find_symbols(entities(s, d), TERMS, LIMIT)}

PROBES = f"""p AS (SELECT * FROM (VALUES (0, 'name', 0, 'AFRICA.NATION_5', ['africa', 'nation_5'], {LIMIT + 1}), (0, 'name', 1, 'AFRICA#NATION_5', ['africa', 'nation_5'], {LIMIT + 1}), (0, 'head', 0, 'AFRICA', ['africa'], 5), (0, 'head', 1, 'NATION_5', ['nation_5'], 5),
  (1, 'name', 0, 'ORDER-7', ['order-7'], {LIMIT + 1}), (1, 'head', 0, 'ORDER-7', ['order-7'], 5),
  (2, 'name', 0, 'NATION_5 Supplier', ['nation_5', 'supplier'], {LIMIT + 1}), (2, 'anchor', 0, 'NATION_5', ['nation_5'], 80), (2, 'head', 0, 'NATION_5', ['nation_5'], 5), (2, 'head', 1, 'Supplier', ['supplier'], 5),
  (3, 'name', 0, 'where is ORDER-31 unknownword orders', ['where', 'is', 'order-31', 'unknownword', 'orders'], {LIMIT + 1}), (3, 'anchor', 0, 'ORDER-31', ['order-31'], 80), (3, 'head', 0, 'where', ['where'], 5), (3, 'head', 1, 'ORDER-31', ['order-31'], 5),
  (4, 'name', 0, 'ORDER-12.zzz', ['order-12', 'zzz'], {LIMIT + 1}), (4, 'head', 0, 'ORDER-12', ['order-12'], 5), (4, 'head', 1, 'zzz', ['zzz'], 5),
  (5, 'name', 0, 'qqqq', ['qqqq'], {LIMIT + 1}), (5, 'head', 0, 'qqqq', ['qqqq'], 5),
  (6, 'name', 0, 'EUROPE.zzz unknownword', ['europe', 'zzz', 'unknownword'], {LIMIT + 1}), (6, 'anchor', 0, 'EUROPE.zzz', ['europe', 'zzz'], 80), (6, 'anchor', 1, 'EUROPE#zzz', ['europe', 'zzz'], 80), (6, 'head', 0, 'EUROPE', ['europe'], 5), (6, 'head', 1, 'zzz', ['zzz'], 5)
) v(t, role, nr, phrase, tokens, size)),
w AS (SELECT * FROM (VALUES (0, 'AFRICA.NATION_5', false, ['africa.nation_5', 'africa.nation_5'], []), (1, 'ORDER-7', false, ['order-7'], []), (2, 'NATION_5 Supplier', true, ['nation_5supplier'], ['supplier']), (3, 'where is ORDER-31 unknownword orders', true, ['whereisorder-31unknownwordorders'], ['where', 'unknownword', 'orders']),
  (4, 'ORDER-12.zzz', false, ['order-12.zzz'], []), (5, 'qqqq', false, ['qqqq'], []), (6, 'EUROPE.zzz unknownword', true, ['europe.zzzunknownword'], ['unknownword'])) v(t, term, several, keys, rest)),
e AS (SELECT id, name, qualified_name, file_path, start_line, lower(name) AS n, regexp_replace(lower(qualified_name), '^.*/', '') AS q, replace(lower(concat_ws(' ', name, qualified_name, file_path)), '#', '.') AS hay, replace(split_part(lower(name), '(', 1), '#', '.') AS kn, replace(replace(split_part(lower(qualified_name), '(', 1), '#', '.'), ' ', '') AS kq, replace(replace(split_part(lower(file_path), '(', 1), '#', '.'), ' ', '') AS kp FROM entities)"""
SQL = {
    "symbol_lookup": with_relations("entities", f"""{PROBES},
h AS (SELECT p.*, e.*, CASE WHEN n = lower(phrase) THEN 0 WHEN starts_with(n, lower(phrase)) THEN 1 WHEN len(list_filter(tokens, lambda x: NOT contains(n, x))) = 0 THEN 2 ELSE 3 + CAST(len(list_filter(tokens, lambda x: NOT contains(q, x))) > 0 AS INT) END AS tier
  FROM p JOIN e ON len(list_filter(tokens, lambda x: NOT contains(n, x) AND NOT contains(q, x))) = 0),
f AS MATERIALIZED (SELECT h.*, row_number() OVER (PARTITION BY t, role, nr ORDER BY tier, length(name), name, id) AS place, list_transform(keys, lambda k: k IN (replace(kn, ' ', ''), kq, kp) OR ends_with(kq, '.' || k) OR ends_with(kp, '/' || k)) AS same, len(list_filter(rest, lambda r: contains(hay, r))) AS score, len(rest) AS m, several FROM h JOIN w USING (t) QUALIFY place <= size),
s AS (SELECT t, min(pos) AS stop FROM (SELECT t, nr, unnest(same) AS y, generate_subscripts(same, 1) - 1 AS pos FROM f WHERE role = 'name') WHERE y AND pos >= nr GROUP BY t),
a AS (SELECT DISTINCT f.t, CASE WHEN several AND NOT bool_or(list_contains(same, true)) OVER (PARTITION BY f.t) THEN 'tokens' ELSE 'exact' END AS mode, id, same[1] AS own, file_path, start_line FROM f LEFT JOIN s ON s.t = f.t WHERE role = 'name' AND (stop IS NULL OR nr <= stop)),
b AS (SELECT t, id, any_value(same[1]) AS own, any_value(file_path) AS file_path, any_value(start_line) AS start_line, any_value(score) AS score, any_value(m) AS m, min((nr, place)) AS spot FROM f WHERE role = 'anchor' AND t NOT IN (SELECT t FROM a) GROUP BY t, id),
c AS (SELECT * FROM (SELECT *, max(CAST(score = m AS INT)) OVER (PARTITION BY t) AS whole FROM b) WHERE CASE whole WHEN 1 THEN score = m ELSE score > 0 END QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, spot) <= {LIMIT + 1}),
d AS (SELECT t, mode, row_number() OVER (PARTITION BY t ORDER BY own DESC, file_path, start_line, id) AS pos, id FROM (FROM a UNION ALL SELECT t, 'tokens', id, own, file_path, start_line FROM c)),
g AS (SELECT t, 'none', place, id FROM f WHERE role = 'head' AND t NOT IN (SELECT t FROM d) QUALIFY nr = min(nr) OVER (PARTITION BY t))
SELECT term, coalesce(mode, 'none') AS mode, pos, id FROM w LEFT JOIN (FROM d UNION ALL FROM g) x ON x.t = w.t"""),
}
