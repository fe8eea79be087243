"""Queries of the passes over host programs, screens and configuration files, on a file for each customer with some lines for each of their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import source_passes as P
from korpusgraf.operators import structure
from korpusgraf.plans.structure_queries import O
from korpusgraf.plans.structure_queries import _files as by_customer
from korpusgraf.sources.adapter import table

K, C = "x.o_orderkey", "o_custkey"


def text(s, d, *rows, head="''"):
    """Files of rows: SQL expressions of the lines of one order."""
    return by_customer(s, d, head, f"concat_ws('\\n', {', '.join(rows)})")


def plain(files):
    return structure.lines(structure.dealt(files))


def formats(s, d):
    mark = "case o_custkey % 3 when 0 then '      * note' when 1 then 'move a to b *> note' else '      * note' end"
    return P.source_format(by_customer(s, d, "case when o_custkey % 3 = 2 then '\\n       >>SOURCE FORMAT IS FREE\\n' else '\\n' end", f"concat({mark}, case when x.o_orderkey < 0 then '' else '' end)"))


def programs(s, d):
    return text(s, d, f"concat('       MOVE A', {K}, ' TO ')", f"concat('      -      B', {K}, '.')", "'      * note'")


def conditional(s, d):
    rows = [f"concat('>>IF 1 = ', 1 + {K} % 2)", f"concat('A', {K})", "'>>IF DEFINED(X)'", f"concat('C', {K})", "'>>ELSE'", f"concat('D', {K})", "'>>END-IF'", "'>>ELSE'", f"concat('B', {K})", "'>>END-IF'", "'>>IF DEFINED(Y)'", f"concat('E', {K})", "'>>END-IF'"]
    return P.active_lines(plain(text(s, d, *rows)), {"X": "1"}).select("path", "line", "text")


def substituted(s, d):
    return P.replaced(plain(text(s, d, f"concat('REPLACE ==AA== BY ==X', {K}, '== ==:P:== BY ==Q==.')", "'MOVE AA TO AAB :P:.'", "'REPLACE OFF.'", "'MOVE AA.'"))).select("path", "line", "text")


def described(s, d):
    return text(s, d, f"concat('       01  REC-', {K}, '.')", f"concat('           05  F-', {K}, ' PIC X(', 1 + {K} % 9, ') OCCURS ', {K} % 5 + 1, ' TIMES.')", f'''concat("           88  OK-", {K}, " VALUE 'Y'.")''', f"concat('           05  G REDEFINES F-', {K}, ' PIC 9.')")


def copies(s, d):
    c = table(s, d, "orders").selectExpr("o_custkey as program", "concat('B', o_orderkey % 60) as copybook", "case when o_orderkey % 2 = 0 then 'F' end as old", "case when o_orderkey % 4 = 0 then 'NEW' end as new")
    return P.inherited_fields(c, table(s, d, "part").selectExpr("concat('B', p_partkey % 70) as copybook", "concat('d', p_partkey % 70 % 7 * (p_size % 2)) as path", "concat('F', p_size) as name", "p_size % 5 as level"))


def moves(s, d):
    return text(s, d, f"concat('       01  F-', {K}, '.')", f"concat('           MOVE F-', {K}, ' TO OUT-A, F-', {K}, '.')", f"concat('           COMPUTE OUT-A = F-', {K}, ' + 2.')", f'''concat("           DISPLAY 'F-", {K}, "' OUT-A.")''')


def references(s, d):
    code = P.logical_lines(moves(s, d))
    fields = P.data_items(code).select("path", "name").union(code.select("path", F.lit("OUT-A")).distinct())
    return P.data_references(code, fields)


def accesses(s, d):
    rows = [f'''concat("       SELECT F", {K}, " ASSIGN TO 'DD", {K} % 9, "'.")''', f"concat('           OPEN INPUT F', {K}, ' G OUTPUT H.')", f"concat('           READ F', {K}, ' AT END CLOSE G.')"]
    return P.file_access(P.logical_lines(text(s, d, *rows)))


def blocks(s, d):
    rows = [f'''concat("EXEC CICS SEND MAP('M", {K} % 9, "')")''', "\"  MAPSET('S1') END-EXEC.\"", "'MOVE A TO B.'", f"concat('EXEC SQL SELECT A INTO :WS-', {K} % 5, ' FROM T', {K} % 7, ' JOIN U END-EXEC.')"]
    return P.exec_blocks(text(s, d, *rows)).select("path", "nr", "line", "kind", "operation", F.col("options")["MAP"].alias("map"), F.col("options")["MAPSET"].alias("mapset"), "tables", "variables")


def dynamic(s, d):
    rows = [f'''concat("       01  W", {K} % 3, " PIC X(8) VALUE 'INIT", {K} % 2, "'.")''', f'''concat("           MOVE 'P", {K} % 4, "' TO W", {K} % 5, ".")''', f"concat('           CALL W', {K} % 5, '.')"]
    return P.dynamic_candidates(P.logical_lines(text(s, d, *rows)))


def chunked(s, d):
    code = plain(text(s, d, "repeat('x', cast(x.o_orderkey % 40 as int))", "repeat('y', 9)"))
    units = code.where("line % 2 = 1").select("path", ((F.col("line") - 1) / 2 % 7 < 3).cast("string").alias("section"), F.col("line").alias("start_line"), (F.col("line") + 1).alias("end_line"))
    return P.paragraph_chunks(units, code, 45, 30)


def routines(s, d):
    code = plain(text(s, d, f"concat('a', {K})", f"concat('b', {K})", "'c'"))
    ranges = code.where("line % 3 = 1 and line % 2 = 1").select(F.concat_ws(":", "path", "line").alias("id"), "path", F.col("line").alias("start_line"), (F.col("line") + 3).alias("end_line"))
    return P.range_chunks(code, ranges, 4)


def screens(s, d):
    rows = [f'''concat("        DFHMDF POS=(", {K}, ",1),LENGTH=5,INITIAL='Name", {K}, "'")''', f"concat('F', {K}, '  DFHMDF POS=(', {K}, ',10),LENGTH=', {K} % 20)", f"concat('E', {K}, '  DFHMDF POS=(', {K} + 1, ',10),LENGTH=1')"]
    return P.screen_fields(text(s, d, *rows, head="concat('SET', o_custkey, '  DFHMSD TYPE=MAP\\nMAP', o_custkey, '  DFHMDI SIZE=(24,80)\\n')"))


def yaml(s, d):
    return P.yaml_keys(text(s, d, f"concat('k', {K}, ':')", f'''concat("  name: '", {K} % 10, "'")''', "'  list:'", "'    - one'", f"concat('    deep: ', {K})", head="'# note\\nroot: 1\\n'"))


def ini(s, d):
    return P.ini_keys(text(s, d, f"concat('[s', {K}, ']')", "'; note = 1'", f"concat('key = v', {K} % 7)", head="'top=0\\n'"))


def broken(well, bad):
    """A file's text, malformed for every fifth customer."""
    return f"case when o_custkey % 5 = 0 then {bad} else {well} end"


def grouped(s, d, item, head, tail):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("os"))
    return o.selectExpr("concat('src/', o_custkey) as path", f"concat({head}, array_join(transform(os, x -> {item}), ''), {tail}) as content")


def schemas(s, d):
    item = '''concat('<xsd:element name="e', x, '"><xsd:element name="inner"/></xsd:element>', case when x % 3 = 0 then concat('<xsd:complexType name="t', x, '"/>') else '' end)'''
    return P.schema_names(grouped(s, d, item, '''concat('<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:', o_custkey % 9, '">')''', broken("'</xsd:schema>'", "'</xsd:schem'")))


def elements(s, d):
    item = '''concat('<o:order id="', x, '"><!-- <no/> --><line nr="1" text="a>b"/><line nr=\\'2\\'/></o:order>')'''
    return P.xml_elements(grouped(s, d, item, "'<?xml version=\"1.0\"?><all xmlns:o=\"urn:o\">'", broken("'</all>'", "'<all>'"))).where("element <> 'all'").select("path", "nr", "element", F.coalesce(F.col("attributes")["id"], F.col("attributes")["nr"]).alias("value"))


def beans(s, d):
    return P.spring_beans(grouped(s, d, '''concat('<bean id="b', x, '" class="app.C', x % 9, '"/>')''', "'<beans xmlns=\"urn:x\">'", broken("'</beans>'", "'<beans>'")))


def routes(s, d):
    return P.endpoints(text(s, d, f'''concat('  @GetMapping("/o', {K}, '")')''', "'  void a() {}'", f'''concat('  @Path("p', {K}, '/")')''', head='''concat('@RequestMapping("/c', o_custkey, '/")\\npublic class K {\\n')'''))


def manuals(s, d):
    return P.asciidoc_facts(text(s, d, f"concat('== Part ', {K})", f"concat('include::d/', {K} % 5, '.adoc[tag=a]')", f"concat('see `C', {K} % 9, '` and `x.y`')", head="'= Title\\n'"))


def composed(s, d):
    """A file for each part that includes the part before it at every third one, and itself at every tenth."""
    f = table(s, d, "part").selectExpr("concat('m', p_partkey) as path", "concat('text ', p_partkey, case when p_partkey % 3 > 0 then concat('\\ninclude::m', p_partkey - 1, '[]') else '' end, case when p_partkey % 10 = 0 then concat('\\ninclude::m', p_partkey, '[]') else '' end) as content")
    return P.composed_lines(f).select("path", F.array_join("position", ".").alias("position"), "source", "line", "text")


def results(s, d):
    return P.completeness(table(s, d, "events").selectExpr("event_id as path", "case when event_id % 3 = 0 then event_id % 2 end as errors", "event_id % 7 = 0 as fallback", "case when event_id % 5 > 0 then event_id % 4 / 3 end as covered"))


def profiles(s, d):
    f = table(s, d, "customer").selectExpr("concat('src/', c_custkey % 4, '/', c_custkey) as path", "c_custkey % 2 as source", "concat('v', c_custkey % 3) as variant")
    fragments = s.createDataFrame([(None, None, None, "fixed", "37"), (1, None, None, None, "1140"), (None, "src/2", None, "free", None), (None, "src/2", "v1", None, "273"), (0, "src/2/1", None, "tab", None)], "source long, prefix string, variant string, format string, page string")
    return P.build_profile(f, fragments, ["format", "page"])


def csd(s, d):
    return structure.csd_files(text(s, d, f"concat('DEFINE FILE(F', {K}, ') GROUP(G)')", f"concat('       DSNAME(DATA.F', {K} % 7, ')')", f"concat('DEFINE PROGRAM(P', {K}, ')')"))


def scripts(s, d):
    return structure.shell_facts(text(s, d, f"concat('f', {K}, '() {{')", f"concat('  . lib/s', {K} % 5, '.sh')", "'# source no.sh'", f"concat('  java -cp a.jar app.Main', {K} % 9)", "'}'"))


def poms(s, d):
    item = "concat('<dependency><groupId>g', x % 5, '</groupId><artifactId>a', x, '</artifactId></dependency>')"
    return structure.poms(grouped(s, d, item, "concat('<project><parent><groupId>top</groupId></parent><artifactId>p', o_custkey, '</artifactId><dependencies>')", "'</dependencies></project>'"))


def datasets(s, d):
    steps = table(s, d, "orders").selectExpr("concat('j', o_custkey) as path", "o_orderkey as step", "concat('P', o_orderkey % 50) as program")
    dds = table(s, d, "lineitem").join(table(s, d, "orders"), F.expr("l_orderkey = o_orderkey")).selectExpr("concat('j', o_custkey) as path", "l_orderkey as step", "concat('D', l_linenumber) as dd", "concat('DATA.', case when l_orderkey % 50 < 25 then l_orderkey % 50 else l_partkey % 2 end) as dataset").distinct()
    return structure.dataset_assignments(steps, dds, s.range(50).selectExpr("concat('P', id) as program", "concat('F', id) as file", "concat('D', 1 + id % 3) as dd"))


QUERIES = {
    "source_format": formats, "logical_lines": lambda s, d: P.logical_lines(programs(s, d)), "conditional_lines": conditional, "replaced_lines": substituted,
    "data_items": lambda s, d: P.data_items(P.logical_lines(described(s, d))), "inherited_fields": copies, "data_references": references, "file_access": accesses, "exec_blocks": blocks,
    "dynamic_candidates": dynamic, "paragraph_chunks": chunked, "routine_chunks": routines, "screen_fields": screens, "yaml_keys": yaml, "ini_keys": ini, "schema_names": schemas, "spring_beans": beans,
    "endpoints": routes, "asciidoc_facts": manuals, "composed_lines": composed, "completeness": results, "build_profile": profiles,
    "xml_elements": elements, "csd_files": csd, "shell_facts": scripts, "pom_dependencies": poms, "dataset_assignments": datasets,
}


def rows(*parts, lines, head=0):
    """UNION ALL of (line of an order's lines from 1, columns, condition) over o."""
    return f"WITH {O} " + " UNION ALL ".join(f"SELECT 'src/' || o_custkey AS path, CAST({head} + {lines} * (n - 1) + {at} AS INT) AS line, {cols} FROM o WHERE {where}" for at, cols, where in parts)


k = "o_orderkey"
SQL = {
    "source_format": "SELECT DISTINCT 'src/' || o_custkey AS path, CASE o_custkey % 3 WHEN 0 THEN 'fixed' ELSE 'free' END AS format FROM orders",
    "logical_lines": rows((1, f"CAST(3 * n - 1 AS INT) AS end_line, 'MOVE A' || {k} || ' TO B' || {k} || '.' AS text", "true"), lines=3),
    "conditional_lines": rows((2, f"'A' || {k} AS text", f"{k} % 2 = 0"), (4, f"'C' || {k}", f"{k} % 2 = 0"), (9, f"'B' || {k}", f"{k} % 2 = 1"), (12, f"'E' || {k}", "true"), lines=13),
    "replaced_lines": rows((2, f"'MOVE X' || {k} || ' TO AAB Q.' AS text", "true"), (4, "'MOVE AA.'", "true"), lines=4),
    "data_items": rows((1, f"1 AS level, 'REC-' || {k} AS name, NULL AS pic, NULL AS occurs, NULL AS value, NULL AS redefines", "true"), (2, f"5, 'F-' || {k}, 'X(' || (1 + {k} % 9) || ')', {k} % 5 + 1, NULL, NULL", "true"),
        (3, f"88, 'OK-' || {k}, NULL, NULL, '''Y''', NULL", "true"), (4, f"5, 'G', '9', NULL, NULL, 'F-' || {k}", "true"), lines=4),
    "inherited_fields": """WITH f AS (SELECT 'B' || p_partkey % 70 AS b, 'F' || p_size AS name, p_size % 5 AS level, p_partkey % 70 % 7 * (p_size % 2) AS path FROM part), one AS (SELECT b FROM f GROUP BY b HAVING count(DISTINCT path) = 1)
SELECT DISTINCT o_custkey AS program, CASE WHEN o_orderkey % 2 = 0 THEN replace(name, 'F', CASE WHEN o_orderkey % 4 = 0 THEN 'NEW' ELSE '' END) ELSE name END AS name, level FROM orders JOIN f ON b = 'B' || o_orderkey % 60 WHERE b IN (SELECT b FROM one)""",
    "data_references": rows((2, f"'READS' AS access, 'F-' || {k} AS name", "true"), (2, f"'WRITES', 'F-' || {k}", "true"), (2, "'WRITES', 'OUT-A'", "true"), (3, "'WRITES', 'OUT-A'", "true"), (3, f"'READS', 'F-' || {k}", "true"), lines=4),
    "file_access": rows((1, f"'ASSIGN' AS operation, 'F' || {k} AS file, 'DD' || {k} % 9 AS target", "true"), (2, f"'OPEN-INPUT', 'F' || {k}, NULL", "true"), (2, "'OPEN-INPUT', 'G', NULL", "true"), (2, "'OPEN-OUTPUT', 'H', NULL", "true"),
        (3, f"'READ', 'F' || {k}, NULL", "true"), (3, "'CLOSE', 'G', NULL", "true"), lines=3),
    "exec_blocks": rows((1, f"CAST(2 * n - 2 AS INT) AS nr, 'CICS' AS kind, 'SEND MAP' AS operation, 'M' || {k} % 9 AS map, 'S1' AS mapset, NULL AS tables, NULL AS variables", "true"),
        (4, f"CAST(2 * n - 1 AS INT), 'SQL', 'SELECT', NULL, NULL, 'T' || {k} % 7 || ',U', 'WS-' || {k} % 5", "true"), lines=4),
    "dynamic_candidates": f"""WITH {O}, g AS (SELECT o_custkey, 'W' || {k} % 5 AS field, 'P' || {k} % 4 AS v FROM o UNION SELECT o_custkey, 'W' || {k} % 3, 'INIT' || {k} % 2 FROM o), l AS (SELECT o_custkey, field, string_agg(v, ',' ORDER BY v) AS candidates FROM g GROUP BY 1, 2)
SELECT 'src/' || o.o_custkey AS path, CAST(3 * n AS INT) AS line, field, candidates FROM o JOIN l ON l.o_custkey = o.o_custkey AND field = 'W' || {k} % 5""",
    "routine_chunks": f"""WITH {O}, l AS (SELECT o_custkey, 3 * n - 2 AS line, 'a' || {k} AS t FROM o UNION ALL SELECT o_custkey, 3 * n - 1, 'b' || {k} FROM o UNION ALL SELECT o_custkey, 3 * n, 'c' FROM o)
SELECT 'src/' || o.o_custkey || ':' || (3 * n - 2) AS id, string_agg(t, chr(10) ORDER BY line) AS text FROM o JOIN l ON l.o_custkey = o.o_custkey AND line BETWEEN 3 * n - 2 AND 3 * n + 1 WHERE n % 2 = 1 GROUP BY o.o_custkey, n""",
    "screen_fields": rows((2, f"'SET' || o_custkey AS mapset, 'MAP' || o_custkey AS map, 'F' || {k} AS name, CAST({k} AS INT) AS row, 10 AS col, CAST({k} % 20 AS INT) AS length, 'Name' || {k} AS label", "true"),
        (3, f"'SET' || o_custkey, 'MAP' || o_custkey, 'E' || {k}, CAST({k} + 1 AS INT), 10, 1, CASE WHEN EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey = o.o_orderkey + 1) THEN 'Name' || ({k} + 1) END", "true"), lines=3, head=2),
    "yaml_keys": rows((1, f"'k' || {k} AS key, '' AS value", "true"), (2, f"'k' || {k} || '.name', CAST({k} % 10 AS VARCHAR)", "true"), (3, f"'k' || {k} || '.list', ''", "true"), (5, f"'k' || {k} || '.list.deep', CAST({k} AS VARCHAR)", "true"), (0, "'root', '1'", "n = 1"), lines=5, head=2),
    "ini_keys": rows((3, f"'s' || {k} || '.key' AS key, 'v' || {k} % 7 AS value", "true"), (0, "'top', '0'", "n = 1"), lines=3, head=1),
    "schema_names": f"SELECT 'src/' || o_custkey AS path, 'urn:' || o_custkey % 9 AS namespace, 'element' AS kind, 'e' || {k} AS name FROM orders WHERE o_custkey % 5 > 0 UNION ALL SELECT 'src/' || o_custkey, 'urn:' || o_custkey % 9, 'complexType', 't' || {k} FROM orders WHERE o_custkey % 5 > 0 AND {k} % 3 = 0",
    "xml_elements": f"""WITH {O}, f AS (SELECT * FROM o WHERE o_custkey % 5 > 0) SELECT 'src/' || o_custkey AS path, CAST(3 * n - 2 AS INT) AS nr, 'all/order' AS element, CAST({k} AS VARCHAR) AS value FROM f
UNION ALL SELECT 'src/' || o_custkey, CAST(3 * n - 1 AS INT), 'all/order/line', '1' FROM f UNION ALL SELECT 'src/' || o_custkey, CAST(3 * n AS INT), 'all/order/line', '2' FROM f""",
    "spring_beans": f"WITH {O} SELECT 'src/' || o_custkey AS path, CAST(n - 1 AS INT) AS nr, 'b' || {k} AS id, 'app.C' || {k} % 9 AS class FROM o WHERE o_custkey % 5 > 0",
    "endpoints": rows((1, f"'GET' AS verb, '/c' || o_custkey || '/o' || {k} AS route", "true"), (3, f"'ANY', '/c' || o_custkey || '/p' || {k}", "true"), lines=3, head=2),
    "asciidoc_facts": rows((0, "'heading' AS type, 1 AS level, 'Title' AS name", "n = 1"), (1, f"'heading', 2, 'Part ' || {k}", "true"), (2, f"'include', NULL, 'd/' || {k} % 5 || '.adoc'", "true"), (3, f"'mention', NULL, 'C' || {k} % 9", "true"), (3, "'mention', NULL, 'x.y'", "true"), lines=3, head=1),
    "composed_lines": """WITH RECURSIVE f AS (SELECT p_partkey AS p, 1 AS line, 'text ' || p_partkey AS text, NULL AS inc FROM part UNION ALL SELECT p_partkey, 2, 'include::m' || (p_partkey - 1) || '[]', p_partkey - 1 FROM part WHERE p_partkey % 3 > 0
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 3 ELSE 2 END, 'include::m' || p_partkey || '[]', p_partkey FROM part WHERE p_partkey % 10 = 0),
w AS (SELECT p AS root, CAST(line AS VARCHAR) AS position, p, line, text, inc FROM f UNION ALL SELECT root, position || '.' || f.line, f.p, f.line, f.text, f.inc FROM w JOIN f ON f.p = w.inc AND w.inc < w.p)
SELECT 'm' || root AS path, position, 'm' || p AS source, line, text FROM w WHERE inc IS NULL OR inc >= p OR inc NOT IN (SELECT p_partkey FROM part)""",
    "completeness": "SELECT event_id AS path, CASE WHEN event_id % 7 = 0 THEN 'fallback' WHEN event_id % 3 = 0 AND event_id % 2 = 1 OR event_id % 5 > 0 AND event_id % 4 < 3 THEN 'partial' ELSE 'complete' END AS state FROM events",
    "build_profile": """SELECT 'src/' || c_custkey % 4 || '/' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 AND starts_with('src/' || c_custkey % 4 || '/' || c_custkey, 'src/2/1') THEN 'tab' WHEN c_custkey % 4 = 2 THEN 'free' ELSE 'fixed' END AS format,
CASE WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 1 THEN '273' WHEN c_custkey % 2 = 1 THEN '1140' ELSE '37' END AS page FROM customer""",
    "csd_files": f"SELECT 'src/' || o_custkey AS path, 'F' || {k} AS name, 'DATA.F' || {k} % 7 AS dataset FROM orders",
    "shell_facts": rows((1, f"'function' AS type, 'f' || {k} AS name", "true"), (2, f"'sources', 'lib/s' || {k} % 5 || '.sh'", "true"), (4, f"'starts_java', 'app.Main' || {k} % 9", "true"), lines=5),
    "pom_dependencies": f"""SELECT 'src/' || o_custkey AS path, 'p' || o_custkey AS artifact, 'top' AS "group", 'g' || {k} % 5 || ':a' || {k} AS dependency FROM orders""",
    "dataset_assignments": """WITH x AS (SELECT o_orderkey % 50 AS p, l_linenumber AS dd, CASE WHEN l_orderkey % 50 < 25 THEN l_orderkey % 50 ELSE l_partkey % 2 END AS ds FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'P' || p AS program, 'F' || p AS file, 'DATA.' || min(ds) AS dataset FROM x WHERE dd = 1 + p % 3 GROUP BY p HAVING count(DISTINCT ds) = 1""",
}
