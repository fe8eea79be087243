"""Queries of effective project models: model n's parent is n div 3, found by coordinates; it manages versions, imports other models' lists and has profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import models
from korpusgraf.sources.adapter import table


def _models(s, d):
    n = table(s, d, "part").select(F.col("p_partkey").alias("n"), "p_size", "p_type")
    return n, n.selectExpr("n as model", "concat('g:m', n, ':1') as coordinates", "case when n > 0 then concat('g:m', n div 3, ':1') end as parent")


def settings(s, d):
    n, m = _models(s, d)
    profiles = n.selectExpr("n as model", "inline(array(struct('dev' as profile, true as by_default, 'env' as property, 'dev' as value), struct('size' as profile, false as by_default, concat('size', p_size) as property, cast(null as string) as value)))")
    switched = s.createDataFrame([("env", "test"), ("size3", "x"), ("size4", "y")], "property string, value string")
    active = models.active_profiles(profiles, switched)
    entries = n.selectExpr("n as model", "inline(array(struct(cast(null as string) as profile, concat('k', n % 7) as key, concat('v', n) as value), struct('dev' as profile, concat('k', n % 5) as key, concat('dev', n) as value), struct('size' as profile, concat('k', n % 5) as key, concat('size', n) as value)))")
    return models.effective(entries, models.parents(m), active)


def managed(s, d):
    n, m = _models(s, d)
    row = lambda place, key="null", value="null", imports="null": f"struct({place} as place, cast({key} as string) as key, cast({value} as string) as value, cast({imports} as string) as imports)"
    rows = [row(0, "concat('d', n % 11)", "concat('v', n)"), row(1, imports="concat('g:m', n div 2 + 1, ':1')"), row(2, imports="concat('g:m', n div 5, ':1')")]
    lists = n.selectExpr("n as model", f"inline(array({', '.join(rows)}))")
    return models.managed_versions(lists, models.parents(m), m)


QUERIES = {"effective_model": settings, "managed_versions": managed}
CHAIN = "c AS (SELECT p_partkey AS model, p_partkey AS a, 0 AS depth FROM part UNION ALL SELECT model, a // 3, depth + 1 FROM c WHERE a > 0)"
SQL = {
    "effective_model": f"""WITH RECURSIVE {CHAIN},
e AS (SELECT p_partkey AS n, 'k' || p_partkey % 7 AS key, 'v' || p_partkey AS value, 0 AS own FROM part UNION ALL SELECT p_partkey, 'k' || p_partkey % 5, CASE WHEN p_size IN (3, 4) THEN 'size' ELSE 'dev' END || p_partkey, 1 FROM part)
SELECT model, key, first(value ORDER BY depth, own DESC) AS value, first(a ORDER BY depth, own DESC) AS origin, CAST(min(depth) AS INT) AS depth FROM c JOIN e ON e.n = a GROUP BY model, key""",
    # walks all import paths without a repeated model, and takes the least
    "managed_versions": f"""WITH RECURSIVE {CHAIN}, i AS (SELECT model, depth, unnest([1, 2]) AS place, unnest([a // 2 + 1, a // 5]) AS target FROM c),
j AS (SELECT model, target, min((depth, place)) AS at FROM i WHERE target IN (SELECT p_partkey FROM part) GROUP BY model, target),
best AS (SELECT p_partkey AS model, p_partkey AS target, CAST([] AS STRUCT(d INT, p INT)[]) AS path, true AS fresh, 0 AS turn FROM part
  UNION ALL (WITH last AS (SELECT * FROM best), step AS (SELECT l.model, j.target, min(list_append(l.path, j.at)) AS path FROM last l JOIN j ON j.model = l.target WHERE l.fresh GROUP BY ALL),
  met AS (SELECT coalesce(l.model, s.model) AS model, coalesce(l.target, s.target) AS target, CASE WHEN l.path IS NULL OR s.path < l.path THEN s.path ELSE l.path END AS path, s.path IS NOT NULL AND (l.path IS NULL OR s.path < l.path) AS fresh, (SELECT max(turn) FROM last) + 1 AS turn FROM last l FULL JOIN step s ON s.model = l.model AND s.target = l.target)
  SELECT * FROM met WHERE (SELECT bool_or(fresh) FROM met))),
r AS (SELECT model, target, arg_max(path, turn) AS path FROM best GROUP BY ALL),
e AS (SELECT c.model, 'd' || a % 11 AS key, 'v' || a AS value, a, (depth, 0) AS at FROM c)
SELECT r.model, key, arg_min(value, (path, e.at)) AS value, arg_min(a, (path, e.at)) AS origin, CAST(arg_min(len(path), (path, e.at)) AS INT) AS hops FROM r JOIN e ON e.model = r.target GROUP BY r.model, key""",
}
