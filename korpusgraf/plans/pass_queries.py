"""Queries of the resolution passes: references from events, candidates from parts, so that some are unique, some ambiguous and some missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import passes
from korpusgraf.sources.adapter import table

EVENTS, PARTS = "events", "part"


def ev(s, d, *cols):
    return table(s, d, EVENTS).selectExpr("event_id as ref_id", *cols)


def pt(s, d, *cols, where="true"):
    return table(s, d, PARTS).where(where).selectExpr("p_partkey as target_id", *cols)


def links(s, d):
    link = "case event_id % 4 when 0 then concat('../d', user_id % 3, '/p', event_id % 90, '.jsp') when 1 then concat('./p', event_id % 70, '.jsp') when 2 then concat('/web/d1/p', event_id % 50, '.jsp') else concat('$', '{x}/p.jsp') end"
    return passes.markup_links(ev(s, d, "event_id % 2 as source_id", "concat('web/d', user_id % 5, '/a.jsp') as path", f"{link} as link"), pt(s, d, "p_partkey % 2 as source_id", "concat('web/d', p_size % 5, '/p', p_partkey, '.jsp') as path")).select("ref_id", "path", "target_id")


def shell(s, d):
    name = "case event_id % 3 when 0 then concat('./s', event_id % 40, '.sh') when 1 then concat('/opt/s', event_id % 60, '.sh') else concat('app.Main', event_id % 80) end"
    refs = ev(s, d, "user_id % 3 as source_id", "concat('v', user_id % 2) as variant", "concat('lib/r', user_id, '.sh') as path", f"{name} as name", "case when event_id % 3 = 2 then 'starts_java' else 'runs' end as kind", "case when event_id % 4 > 0 then case when event_id % 3 = 2 then 'class' else 'script' end end as type")
    held = pt(s, d, "p_size % 3 as source_id", "concat('v', p_partkey % 2) as variant", "concat(case when p_partkey % 5 = 0 then 'opt' else 'lib' end, '/s', p_partkey % 100, '.sh') as path", "concat('app.Main', p_partkey % 300) as qualified_name", "case when p_partkey % 3 = 0 then 'class' else 'script' end as type")
    return passes.shell_targets(refs, held)


def jobs(s, d):
    scope = ["p_size % 2 as source_id", "concat('v', p_partkey % 2) as variant"]
    steps = ev(s, d, "user_id % 2 as source_id", "concat('v', event_id % 3 % 2) as variant", "concat('jobs/j', user_id % 40, case when user_id % 9 = 0 then '.prc' else '.jcl' end) as path", "case when event_id % 4 = 0 then 'PGM' else 'PROC' end as kind", "concat('x', event_id % 400) as name")
    path = "concat(case when p_partkey % 3 = 0 then 'jobs/j' else 'procs/X' end, p_partkey % 40, case when p_partkey % 6 = 0 then '.jcl' else '.prc' end) as path"
    procs = pt(s, d, *scope, path, "concat('X', p_partkey % 300) as name")
    files = pt(s, d, *scope, "concat('lib/x', p_partkey % 500, case when p_partkey % 5 = 0 then '.txt' else '.PROC' end) as path")
    return passes.job_targets(steps, pt(s, d, *scope, "concat('X', p_partkey div 2) as name"), procs, files)


def projects(s, d):
    refs = ev(s, d, "concat('m', user_id % 30, '/pom') as path", "concat('g:a', event_id % 60) as coordinates", "concat('m', event_id % 45) as module_path")
    declared = pt(s, d, "concat('m', p_size % 30, '/pom') as path", "concat('g:a', p_partkey % 60) as coordinates")
    held = table(s, d, "supplier").selectExpr("s_suppkey as project", "concat('g:a', s_suppkey % 50) as coordinates", "concat('m', s_suppkey % 40) as path")
    return passes.project_targets(refs, declared, held)


def documentation(s, d):
    token = "case event_id % 4 when 0 then concat('pkg.C', event_id % 70) when 1 then concat('C', event_id % 300) when 2 then concat('src/f', event_id % 60, '.java') else concat('f', event_id % 80, '.java') end"
    objects = pt(s, d, "concat('pkg.C', p_partkey div 2) as qualified_name", "concat('C', p_partkey) as name")
    return passes.documentation_targets(ev(s, d, f"{token} as token"), objects, pt(s, d, "concat(case when p_partkey % 2 = 0 then 'src' else 'gen' end, '/f', p_partkey % 90, '.java') as path"))


def schemas(s, d):
    refs = ev(s, d, "concat('v', user_id % 2) as variant", "case when event_id % 2 = 0 then 'element' else 'type' end as kind", "case event_id % 3 when 0 then 'a' when 1 then 'b' end as prefix", "concat('L', event_id % 60) as local", "map('a', 'urn:one', '', 'urn:two') as namespaces")
    return passes.schema_targets(refs, pt(s, d, "concat('v', p_size % 2) as variant", "case when p_partkey % 2 = 0 then 'element' else 'type' end as kind", "case when p_size % 3 = 0 then 'urn:two' else 'urn:one' end as namespace", "concat('L', p_partkey % 70) as local"))


def screens(s, d):
    refs = ev(s, d, "concat('v', user_id % 3) as variant", "concat('m', event_id % 50) as map", "case when event_id % 2 = 0 then concat('s', user_id % 3) end as mapset")
    return passes.map_targets(refs, pt(s, d, "case when p_size % 3 = 0 then '' else concat('v', p_size % 3) end as variant", "concat('S', p_partkey % 3) as mapset", "concat('M', p_partkey % 60) as map"))


def stylesheets(s, d):
    refs = ev(s, d, "concat('v', user_id % 2) as variant", "case when event_id % 5 = 0 then concat('q', event_id % 60) end as qualified_name", "case when event_id % 3 = 0 then concat('x/', event_id % 50) end as path", "case when event_id % 2 = 0 then concat('t', event_id % 90) end as name", "concat('n', event_id % 40) as match", "case when event_id % 7 = 0 then 'm' else '' end as mode")
    templates = pt(s, d, "concat('v', p_size % 2) as variant", "concat('q', p_partkey % 100) as qualified_name", "concat('t', p_partkey % 120) as name", "concat('n', p_partkey % 150) as match", "case when p_size % 5 = 0 then 'm' else '' end as mode")
    return passes.stylesheet_targets(refs, templates, pt(s, d, "concat('v', p_size % 2) as variant", "concat('x/', p_partkey % 55) as path"))


def programs(s, d):
    refs = ev(s, d, "concat('v', user_id % 2) as variant", "case when event_id % 2 = 0 then 'COPY' else 'CALL' end as type", "concat('n', event_id % 50, case when event_id % 4 = 0 then '.cpy' else '' end) as name", "case when event_id % 3 = 0 then concat('d', user_id % 4) end as path")
    return passes.program_targets(refs, pt(s, d, "concat('v', p_size % 2) as variant", "case when p_size % 3 = 0 then 'program' else 'copybook' end as kind", "concat('N', p_partkey % 60) as name", "concat('d', p_partkey % 4) as path"))


def resources(s, d):
    refs = ev(s, d, "concat('m', user_id % 4) as module", "case event_id % 4 when 0 then concat('/r', event_id % 70) when 3 then null else concat('r', event_id % 70) end as name")
    return passes.resource_targets(refs, pt(s, d, "concat('m', p_size % 4) as module", "concat('r', p_partkey % 90) as path"))


def properties(s, d):
    refs = ev(s, d, "concat('m', user_id % 3) as module", "concat('c', event_id % 2) as component", "concat('k', event_id % 60) as key")
    return passes.property_targets(refs, pt(s, d, "concat('m', p_size % 5) as module", "concat('c', p_partkey % 2) as component", "case p_size % 4 when 0 then 'dev' when 1 then 'prod' end as profile", "concat('k', p_partkey % 80) as key"), ["dev"])


def injections(s, d):
    points = ev(s, d, "concat('T', event_id % 60) as type", "case when event_id % 3 = 0 then concat('Q', user_id % 3) end as qualifier", "concat('b', event_id % 50) as name")
    beans = pt(s, d, "concat('T', p_partkey % 70) as type", "case when p_size % 2 = 0 then concat('Q', p_size % 3) end as qualifier", "concat('b', p_partkey % 90) as name")
    return passes.injection_targets(points, beans, s.range(0, 70, 7).selectExpr("concat('T', id) as sub", "concat('T', id + 1) as super"))


def receivers(s, d):
    calls = table(s, d, EVENTS).selectExpr("event_id as call_id", "concat('m', user_id % 50) as method", "concat('K', user_id % 10) as class", "concat('x', event_id % 40, case when event_id % 3 = 0 then '()' else '' end) as receiver")
    some = lambda key, where: table(s, d, PARTS).where(where).selectExpr(*key, "concat('x', p_partkey % 40) as name", "concat('Type', p_size % 2, '<String>') as type")
    cls = "concat('K', p_partkey % 10) as class"
    return passes.receiver_types(calls, some(["concat('m', p_partkey % 50) as method"], "p_size < 10"), some([cls], "p_size between 10 and 30"), some([cls], "p_size > 30"))


def lambdas(s, d):
    calls = table(s, d, EVENTS).selectExpr("event_id as call_id", "user_id % 40 as method", "event_id % 5 as name", "event_id % 60 as line")
    return passes.lambda_targets(calls, table(s, d, PARTS).selectExpr("p_partkey % 90 as method", "p_size % 5 as name", "p_partkey % 50 as line", "case when p_size % 7 > 0 then p_partkey end as lambda_id"))


def bindings(s, d):
    classes = ev(s, d, "concat('urn:', user_id % 2) as namespace", "concat('L', event_id % 60) as name", "event_id % 2 = 0 as is_root")
    return passes.binding_targets(classes, pt(s, d, "concat('urn:', p_size % 2) as namespace", "concat('L', p_partkey % 70) as name", "case when p_partkey % 3 = 0 then 'element' else 'type' end as kind"))


def rederived(s, d):
    old = table(s, d, "lineitem").selectExpr("l_orderkey as src_id", "l_partkey as dst_id", "case l_linenumber when 1 then 'INJECTS' when 2 then 'DISPATCHES_TO' else 'CALL' end as type")
    return passes.rederived(old, table(s, d, PARTS).selectExpr("p_size as src_id", "p_partkey div 2 as dst_id", "case when p_partkey % 2 = 0 then 'INJECTS' else 'CALL' end as type"), ["INJECTS", "DISPATCHES_TO"])


def upserts(s, d):
    old = table(s, d, "orders").selectExpr("o_custkey % 100 as path", "concat('k', o_orderkey % 40) as key").distinct().withColumn("id", F.concat_ws("-", "path", "key"))
    parsed = table(s, d, "lineitem").where("l_suppkey % 3 > 0").selectExpr("l_suppkey % 50 as path", "concat('k', l_partkey % 45) as key", "l_linenumber as line")
    return passes.upserted(old, parsed)


QUERIES = {
    "markup_links": links, "shell_targets": shell, "job_targets": jobs, "project_targets": projects, "documentation_targets": documentation, "schema_targets": schemas,
    "map_targets": screens, "stylesheet_targets": stylesheets, "program_targets": programs, "resource_targets": resources, "property_targets": properties,
    "binding_targets": bindings, "framework_edges": rederived, "injection_targets": injections, "receiver_types": receivers, "lambda_targets": lambdas, "persist_upsert": upserts,
}


def staged(refs: str, stages: list[tuple[str, str]], out: str = "ref_id, target_id, stage") -> str:
    """refs and stages (candidates with target_id, keys) as SQL: the first stage with a candidate decides."""
    parts = [f"refs AS ({refs})"] + [f"c{i} AS (SELECT {k}, min(target_id) AS a{i}, max(target_id) AS b{i} FROM ({c}) GROUP BY {k})" for i, (c, k) in enumerate(stages)]
    target = " ".join(f"WHEN a{i} IS NOT NULL THEN CASE WHEN a{i} = b{i} THEN a{i} END" for i in range(len(stages)))
    stage = " ".join(f"WHEN a{i} IS NOT NULL THEN {i}" for i in range(len(stages)))
    joins = " ".join(f"LEFT JOIN c{i} USING ({k})" for i, (_, k) in enumerate(stages))
    return f"WITH {', '.join(parts)}, met AS (SELECT refs.*, CASE {target} END AS target_id, CASE {stage} END AS stage FROM refs {joins}) SELECT {out} FROM met"


E, P = "event_id AS ref_id", "p_partkey AS target_id"
SQL = {
    "markup_links": staged(
        f"""SELECT {E}, event_id % 2 AS source_id, CASE event_id % 4 WHEN 0 THEN 'web/d' || user_id % 3 || '/p' || event_id % 90 || '.jsp' WHEN 1 THEN 'web/d' || user_id % 5 || '/p' || event_id % 70 || '.jsp' WHEN 2 THEN 'web/d1/p' || event_id % 50 || '.jsp' END AS path FROM events""",
        [(f"SELECT {P}, p_partkey % 2 AS source_id, 'web/d' || p_size % 5 || '/p' || p_partkey || '.jsp' AS path FROM part", "source_id, path")], "ref_id, path, target_id"),
    "shell_targets": f"""WITH r AS (SELECT {E}, user_id % 3 AS source, user_id % 2 AS v, CASE event_id % 3 WHEN 0 THEN 'lib/s' || event_id % 40 || '.sh' WHEN 1 THEN 'opt/s' || event_id % 60 || '.sh' END AS file, CASE WHEN event_id % 3 = 2 THEN 'app.Main' || event_id % 80 END AS class,
  CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 3 = 2 THEN 'class' ELSE 'script' END END AS type FROM events),
e AS (SELECT {P}, p_size % 3 AS source, p_partkey % 2 AS v, CASE WHEN p_partkey % 5 = 0 THEN 'opt' ELSE 'lib' END || '/s' || p_partkey % 100 || '.sh' AS file, 'app.Main' || p_partkey % 300 AS class, CASE WHEN p_partkey % 3 = 0 THEN 'class' ELSE 'script' END AS type FROM part),
c AS (SELECT ref_id, list(DISTINCT target_id) AS ids FROM r JOIN e ON e.source = r.source AND e.v = r.v AND (e.file = r.file OR e.class = r.class) AND (r.type IS NULL OR e.type = r.type) GROUP BY ref_id)
SELECT r.ref_id, CASE WHEN len(ids) = 1 THEN ids[1] END AS target_id FROM r LEFT JOIN c ON c.ref_id = r.ref_id""",
    # each step's candidates as a list, narrowed as the rule says
    "job_targets": f"""WITH r AS (SELECT {E}, user_id % 2 AS source, event_id % 3 % 2 AS v, 'jobs/j' || user_id % 40 || CASE WHEN user_id % 9 = 0 THEN '.prc' ELSE '.jcl' END AS path, event_id % 4 = 0 AS pgm, 'X' || event_id % 400 AS name FROM events),
p AS (SELECT {P}, p_size % 2 AS source, p_partkey % 2 AS v, CASE WHEN p_partkey % 3 = 0 THEN 'jobs/j' ELSE 'procs/X' END || p_partkey % 40 || CASE WHEN p_partkey % 6 = 0 THEN '.jcl' ELSE '.prc' END AS path, 'X' || p_partkey % 300 AS label, 'X' || p_partkey // 2 AS program, CASE WHEN p_partkey % 5 > 0 THEN 'X' || p_partkey % 500 END AS member FROM part),
c AS (SELECT ref_id, list(target_id) FILTER (pgm AND program = name) AS programs, list({{'t': target_id, 'p': p.path}}) FILTER (NOT pgm AND label = name) AS labels, list(target_id) FILTER (NOT pgm AND member = name) AS members FROM r JOIN p ON p.source = r.source AND p.v = r.v AND name IN (program, label, member) GROUP BY ref_id),
n AS (SELECT r.*, programs, labels, members, CASE WHEN r.path NOT LIKE '%.prc' THEN list_filter(labels, lambda x: x.p = r.path) END AS own, list_filter(labels, lambda x: upper(regexp_replace(regexp_replace(x.p, '.*/', ''), '[.][^.]*$', '')) = name) AS named FROM r LEFT JOIN c ON c.ref_id = r.ref_id),
k AS (SELECT ref_id, CASE WHEN pgm THEN programs WHEN labels IS NULL THEN members WHEN len(labels) > 1 AND len(own) > 0 THEN list_transform(own, lambda x: x.t) WHEN len(labels) > 1 AND len(named) > 0 THEN list_transform(named, lambda x: x.t) ELSE list_transform(labels, lambda x: x.t) END AS left_over,
  CASE WHEN pgm THEN CASE WHEN programs IS NOT NULL THEN 'program' END WHEN labels IS NULL THEN CASE WHEN members IS NOT NULL THEN 'member_file' END WHEN len(labels) = 1 THEN 'label' WHEN len(own) > 0 THEN 'own_file' WHEN len(named) > 0 THEN 'member' END AS "by" FROM n)
SELECT ref_id, CASE WHEN len(left_over) = 1 THEN left_over[1] END AS target_id, "by" FROM k""",
    "project_targets": """WITH r AS (SELECT event_id AS ref_id, user_id % 30 AS path, event_id % 60 AS c, event_id % 45 AS m FROM events), d AS (SELECT p_size % 30 AS path, p_partkey % 60 AS c, min(p_partkey) AS t, count(*) AS n FROM part GROUP BY 1, 2),
a AS (SELECT s_suppkey % 50 AS c, min(s_suppkey) AS pc, count(*) AS nc FROM supplier GROUP BY 1), b AS (SELECT s_suppkey % 40 AS m, min(s_suppkey) AS pm, count(*) AS nm FROM supplier GROUP BY 1)
SELECT ref_id, CASE WHEN n = 1 THEN t END AS target_id, CASE WHEN nc = 1 THEN pc WHEN nc IS NULL AND nm = 1 THEN pm END AS internal_project FROM r LEFT JOIN d USING (path, c) LEFT JOIN a USING (c) LEFT JOIN b USING (m)""",
    "documentation_targets": staged(
        f"""SELECT *, token AS qualified_name, token AS name, token AS path, CASE WHEN NOT contains(token, '/') THEN token END AS tail FROM (SELECT {E}, CASE event_id % 4 WHEN 0 THEN 'pkg.C' || event_id % 70 WHEN 1 THEN 'C' || event_id % 300 WHEN 2 THEN 'src/f' || event_id % 60 || '.java' ELSE 'f' || event_id % 80 || '.java' END AS token FROM events)""",
        [(f"SELECT {P}, 'pkg.C' || p_partkey // 2 AS qualified_name FROM part", "qualified_name"), (f"SELECT {P}, 'C' || p_partkey AS name FROM part", "name"),
         (f"SELECT {P}, CASE WHEN p_partkey % 2 = 0 THEN 'src' ELSE 'gen' END || '/f' || p_partkey % 90 || '.java' AS path FROM part", "path"), (f"SELECT {P}, 'f' || p_partkey % 90 || '.java' AS tail FROM part", "tail")]),
    "schema_targets": staged(
        f"SELECT {E}, 'v' || user_id % 2 AS variant, CASE WHEN event_id % 2 = 0 THEN 'element' ELSE 'type' END AS kind, CASE event_id % 3 WHEN 0 THEN 'urn:one' WHEN 2 THEN 'urn:two' END AS namespace, 'L' || event_id % 60 AS local FROM events",
        [(f"SELECT {P}, 'v' || p_size % 2 AS variant, CASE WHEN p_partkey % 2 = 0 THEN 'element' ELSE 'type' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'urn:two' ELSE 'urn:one' END AS namespace, 'L' || p_partkey % 70 AS local FROM part", "variant, kind, namespace, local")]),
    "map_targets": staged(
        f"SELECT {E}, 'v' || user_id % 3 AS variant, '' AS fallback, 'M' || event_id % 50 AS map, CASE WHEN event_id % 2 = 0 THEN 'S' || user_id % 3 END AS mapset, CASE WHEN event_id % 2 = 1 THEN 'M' || event_id % 50 END AS bare FROM events",
        [(f"SELECT {P}, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'v' || p_size % 3 END AS variant, 'M' || p_partkey % 60 AS map, 'S' || p_partkey % 3 AS mapset FROM part", "variant, map, mapset"),
         (f"SELECT {P}, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'v' || p_size % 3 END AS variant, 'M' || p_partkey % 60 AS bare FROM part", "variant, bare"),
         (f"SELECT {P}, '' AS fallback, 'M' || p_partkey % 60 AS map, 'S' || p_partkey % 3 AS mapset FROM part WHERE p_size % 3 = 0", "fallback, map, mapset"),
         (f"SELECT {P}, '' AS fallback, 'M' || p_partkey % 60 AS bare FROM part WHERE p_size % 3 = 0", "fallback, bare")]),
    "stylesheet_targets": staged(
        f"SELECT {E}, 'v' || user_id % 2 AS variant, CASE WHEN event_id % 5 = 0 THEN 'q' || event_id % 60 END AS qualified_name, CASE WHEN event_id % 3 = 0 THEN 'x/' || event_id % 50 END AS path, CASE WHEN event_id % 2 = 0 THEN 't' || event_id % 90 END AS name, 'n' || event_id % 40 AS m, CASE WHEN event_id % 7 = 0 THEN 'm' ELSE '' END AS mode FROM events",
        [(f"SELECT {P}, 'v' || p_size % 2 AS variant, 'q' || p_partkey % 100 AS qualified_name FROM part", "variant, qualified_name"), (f"SELECT {P}, 'v' || p_size % 2 AS variant, 'x/' || p_partkey % 55 AS path FROM part", "variant, path"),
         (f"SELECT {P}, 'v' || p_size % 2 AS variant, 't' || p_partkey % 120 AS name FROM part", "variant, name"), (f"SELECT {P}, 'v' || p_size % 2 AS variant, 'n' || p_partkey % 150 AS m, CASE WHEN p_size % 5 = 0 THEN 'm' ELSE '' END AS mode FROM part", "variant, m, mode")]),
    "program_targets": staged(
        f"SELECT {E}, 'v' || user_id % 2 AS variant, CASE WHEN event_id % 2 = 0 THEN 'copybook' ELSE 'program' END AS kind, 'N' || event_id % 50 AS key, CASE WHEN event_id % 6 = 0 THEN 'd' || user_id % 4 END AS path FROM events",
        [(f"SELECT {P}, 'v' || p_size % 2 AS variant, CASE WHEN p_size % 3 = 0 THEN 'program' ELSE 'copybook' END AS kind, 'N' || p_partkey % 60 AS key, 'd' || p_partkey % 4 AS path FROM part", k) for k in ("variant, kind, key, path", "variant, kind, key")]),
    "resource_targets": staged(
        f"SELECT {E}, 'm' || user_id % 4 AS module, CASE WHEN event_id % 4 < 3 THEN 'r' || event_id % 70 END AS path FROM events",
        [(f"SELECT {P}, 'm' || p_size % 4 AS module, 'r' || p_partkey % 90 AS path FROM part", "module, path")],
        "ref_id, target_id, CASE WHEN path IS NULL THEN 'dynamic_resource_expression' WHEN target_id IS NOT NULL THEN 'exact_resource_target' WHEN stage IS NOT NULL THEN 'ambiguous_resource_target' ELSE 'resource_target_not_found' END AS reason"),
    "property_targets": """WITH r AS (SELECT event_id AS ref_id, user_id % 3 AS m, event_id % 2 AS c, event_id % 60 AS k FROM events), p AS (SELECT p_partkey AS t, p_size % 5 AS m, p_partkey % 2 AS c, p_size % 4 = 0 AS special, p_partkey % 80 AS k FROM part WHERE p_size % 4 <> 1),
j AS (SELECT ref_id, r.c AS rc, p.c AS pc, t, special, p.m = r.m AS own FROM r JOIN p ON p.k = r.k), a AS (SELECT * FROM j QUALIFY own = bool_or(own) OVER (PARTITION BY ref_id)), b AS (SELECT * FROM a QUALIFY special = bool_or(special) OVER (PARTITION BY ref_id)),
g AS (SELECT ref_id, CASE WHEN count(*) = 1 THEN min(t) WHEN count(*) FILTER (pc = rc) = 1 THEN min(t) FILTER (pc = rc) END AS target_id FROM b GROUP BY 1) SELECT ref_id, target_id FROM r LEFT JOIN g USING (ref_id)""",
    "injection_targets": """WITH r AS (SELECT event_id AS ref_id, event_id % 60 AS type, CASE WHEN event_id % 3 = 0 THEN user_id % 3 END AS q, event_id % 50 AS name FROM events), b AS (SELECT p_partkey % 70 AS type, CASE WHEN p_size % 2 = 0 THEN p_size % 3 END AS q, p_partkey % 90 AS name, p_partkey AS t FROM part),
h AS (SELECT * FROM b UNION SELECT type + 1, q, name, t FROM b WHERE type % 7 = 0),
j AS (SELECT r.ref_id, count(t) AS n, min(t) AS a, count(t) FILTER (h.name = r.name) AS nn, min(t) FILTER (h.name = r.name) AS an, any_value(r.q) AS q FROM r LEFT JOIN h ON h.type = r.type AND (r.q IS NULL OR h.q = r.q) GROUP BY 1)
SELECT ref_id, CASE WHEN n = 1 THEN a WHEN q IS NULL AND nn = 1 THEN an END AS target_id FROM j""",
    "receiver_types": staged(
        "SELECT event_id AS ref_id, user_id % 50 AS method, user_id % 10 AS class, 'x' || event_id % 40 || CASE WHEN event_id % 3 = 0 THEN '()' ELSE '' END AS name, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id % 40 END AS called FROM events",
        [("SELECT p_partkey % 50 AS method, 'x' || p_partkey % 40 AS name, 'Type' || p_size % 2 AS target_id FROM part WHERE p_size < 10", "method, name"), ("SELECT p_partkey % 10 AS class, 'x' || p_partkey % 40 AS name, 'Type' || p_size % 2 AS target_id FROM part WHERE p_size BETWEEN 10 AND 30", "class, name"),
         ("SELECT p_partkey % 10 AS class, 'x' || p_partkey % 40 AS called, 'Type' || p_size % 2 AS target_id FROM part WHERE p_size > 30", "class, called")], "ref_id AS call_id, target_id AS type"),
    "binding_targets": staged(
        f"SELECT {E}, 'urn:' || user_id % 2 AS namespace, CASE WHEN event_id % 2 = 0 THEN 'L' || event_id % 60 END AS element, 'L' || event_id % 60 AS t FROM events",
        [(f"SELECT {P}, 'urn:' || p_size % 2 AS namespace, 'L' || p_partkey % 70 AS element FROM part WHERE p_partkey % 3 = 0", "namespace, element"), (f"SELECT {P}, 'urn:' || p_size % 2 AS namespace, 'L' || p_partkey % 70 AS t FROM part WHERE p_partkey % 3 > 0", "namespace, t")]),
    "framework_edges": "SELECT l_orderkey AS src_id, l_partkey AS dst_id, 'CALL' AS type FROM lineitem WHERE l_linenumber > 2 UNION ALL SELECT DISTINCT p_size, p_partkey // 2, 'INJECTS' FROM part WHERE p_partkey % 2 = 0",
    "lambda_targets": """WITH a AS (SELECT p_partkey % 90 AS method, p_size % 5 AS name, min(p_partkey % 50) AS line, min(CASE WHEN p_size % 7 > 0 THEN p_partkey END) AS target_id FROM part GROUP BY 1, 2 HAVING count(*) = 1)
SELECT event_id AS call_id, target_id FROM events JOIN a ON method = user_id % 40 AND name = event_id % 5 WHERE target_id IS NOT NULL AND event_id % 60 > line""",
    "persist_upsert": """WITH o AS (SELECT DISTINCT o_custkey % 100 AS path, 'k' || o_orderkey % 40 AS key FROM orders), p AS (SELECT DISTINCT l_suppkey % 50 AS path, 'k' || l_partkey % 45 AS key FROM lineitem WHERE l_suppkey % 3 > 0)
SELECT path, key, CASE WHEN o.key IS NULL THEN sha1(path || chr(10) || key) ELSE path || '-' || key END AS id, CASE WHEN o.key IS NULL THEN 'insert' WHEN p.key IS NULL THEN 'delete' ELSE 'update' END AS action
FROM (SELECT *, key AS k FROM o WHERE path IN (SELECT path FROM p)) o FULL JOIN p USING (path, key)""",
}
