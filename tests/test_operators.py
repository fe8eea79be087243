"""Operators on small hand-made graphs and texts: cycles, ties, null keys, limits."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korpusgraf.functions import chunking, text
from korpusgraf.operators import choices, evidence, graph, groups, incremental, intervals, resolution, rollup
from korpusgraf.sources import readers
from korpusgraf.streaming import queue

EDGE = "edge_id string, src_id long, dst_id long, dst_name string, type string, resolution string, line int"


def cycle(spark):
    """A three-cycle with a self-loop, parallel edges and an open end."""
    rows = [("a", 1, 2, "n2", "CALL", "resolved", 1), ("b", 2, 3, "n3", "CALL", "resolved", 1), ("c", 3, 1, "n1", "CALL", "resolved", 1), ("d", 1, 1, "n1", "CALL", "resolved", 2), ("e", 1, 2, "n2", "READS", "resolved", 3), ("f", 3, None, "N1", "CALL", "unresolved", 4), ("g", 3, 4, "n4", "COPY", "resolved", 5)]
    return spark.createDataFrame(rows, EDGE)


def ids(df):
    return {tuple(r) for r in df.collect()}


def test_reach_ends_in_cycles(spark):
    start = spark.createDataFrame([(1,)], "id long")
    assert ids(graph.reach(cycle(spark), start, 5, "out")) == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert ids(graph.reach(cycle(spark), start, 5, "both")) == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert ids(graph.reach(cycle(spark), start, 5, "both", limit=1)) == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_paths_and_impact(spark):
    start = spark.createDataFrame([(1,)], "id long")
    assert {r["id"]: r["path"] for r in graph.shortest_paths(cycle(spark), start, 4).collect()} == {1: [], 2: ["a"], 3: ["a", "b"], 4: ["a", "b", "g"]}
    entities = spark.createDataFrame([(1, "n1", 9), (9, "top", None)], "id long, name string, parent_id long")
    assert ids(graph.impact(cycle(spark), entities, start, 1)) == {(3, "edge", 1), (3, "name", 1)}
    assert ids(graph.with_ancestors(start, entities)) == {(1,), (9,)}


def test_backbone_keeps_all_of_few_pairs_and_null_paths_are_one_file(spark):
    entities = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "y")], "id long, file_path string")
    pairs = rollup.file_pairs(cycle(spark), entities)
    assert ids(pairs.select("src_file", "dst_file", "edge_count", "priority")) == {("x", "", 2, 3), ("", "x", 1, 3), ("", "y", 1, 3)}
    assert rollup.backbone(pairs).count() == 3
    assert rollup.backbone(pairs, k=1, always=0).count() < 3 + 1


def test_two_cliques_are_two_groups(spark):
    rows = [(f"{c}{i}", f"{c}{j}", 1, 1) for c in "ab" for i in range(6) for j in range(6) if i < j] + [("a0", "b0", 1, 0)]
    edges = groups.weighted(spark.createDataFrame(rows, "src_file string, dst_file string, edge_count long, priority int"))
    found = groups.communities(edges, 16)
    of = {r["node"]: r["community"] for r in found.collect()}
    assert len(set(of.values())) == 2 and len({of[f"a{i}"] for i in range(6)}) == 1
    assert groups.modularity(edges, found) > 0.4
    assert groups.labels(edges, found).count() == 2 and groups.group_edges(edges, found).count() == 2


def test_file_groups_hold_every_file(spark, data):
    from korpusgraf.plans import text_queries
    from korpusgraf.plans.rollup_queries import pairs

    met = pairs(spark, data)
    files = {r[0] for c in ("src_file", "dst_file") for r in met.select(c).distinct().collect()}
    found = text_queries.QUERIES["file_groups"](spark, data)
    assert sorted(r["node"] for r in found.collect()) == sorted(files)
    assert groups.modularity(groups.weighted(met), found) > 0.05


def test_intervals(spark):
    entities = spark.createDataFrame([(1, "f", 1, 300), (2, "f", 10, 90), (3, "f", 20, 30), (4, "f", 20, 30), (5, "g", 1, 9)], "id long, file_path string, start_line int, end_line int")
    hunks = spark.createDataFrame([(1, "f", 25, 25), (2, "f", 200, 280), (3, "f", 50, 120)], "hunk_id long, file_path string, start_line int, end_line int")
    hits = intervals.overlapping(hunks, entities, 16)
    assert ids(intervals.innermost(hits)) == {(1, 3), (1, 4), (2, 1), (3, 2)}
    assert ids(intervals.smallest_unique(hits)) == {(2, 1), (3, 2)}


def test_exactly_one_candidate(spark):
    held = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3), ("C", 4), ("C", 4)], "key string, target_id long")
    edges = spark.createDataFrame([("A", None, "unresolved"), ("B", None, "unresolved"), ("C", None, "unresolved"), ("A", 9, "resolved"), ("Z", None, "unresolved")], "key string, dst_id long, resolution string")
    assert ids(resolution.resolve_unique(edges, held, ["key"])) == {("A", 1, "resolved"), ("B", None, "unresolved"), ("C", 4, "resolved"), ("A", 9, "resolved"), ("Z", None, "unresolved")}


def test_reindex_moves_only_unique_texts(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "z")], "chunk_id long, fingerprint string")
    new = spark.createDataFrame([(11, "x"), (12, "y")], "chunk_id long, fingerprint string")
    links = spark.createDataFrame([(1, 1, "approved"), (2, 2, "approved"), (3, 3, "pending"), (4, 4, "rejected")], "link_id long, chunk_id long, status string")
    assert ids(incremental.reindexed(old, new, links)) == {(1, 11, "approved"), (2, None, "pending"), (4, None, "rejected")}


def test_orphans_stay_after_an_empty_or_broken_crawl(spark):
    stored = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert incremental.orphans(stored, stored.limit(0)).count() == 0
    assert incremental.orphans(stored, spark.createDataFrame([("a",)], "path string")).count() == 0
    assert ids(incremental.orphans(stored, spark.createDataFrame([("a",), ("b",)], "path string"))) == {("c",)}


def test_codeowners_patterns():
    hit = lambda rule, path: re.search(text.codeowners_pattern(rule), path) is not None
    assert hit("*.py", "a/b.py") and not hit("*.py", "a/b.pyc")
    assert hit("/docs/", "docs/a/b") and not hit("/docs/", "x/docs/a")
    assert hit("docs/*", "docs/a") and hit("**/test", "x/y/test/z") and hit("a?c", "z/abc")


def test_search_tokens(spark):
    one = spark.createDataFrame([("a.b.c.d.e.f.g",), ("Find The x::y thing now please ok",), (None,)], "q string").select(text.search_tokens(F.col("q")).alias("t"))
    got = [r["t"] for r in one.collect()]
    assert got == [["b", "c", "d", "e", "f", "g"], ["find", "the", "x", "y", "thing", "now"], None]


def test_decode():
    assert readers.decode_text("﻿ä".encode()) == "ä" and readers.decode_text("ä".encode("utf-16")) == "ä"
    assert readers.decode_text(b"\x80") == "€" and readers.decode_text(b"\x81\x80") == "\x81\x80"


def test_html_lines():
    got = readers.html_lines("<h1>Top</h1><p>a <b>b</b></p><script>no</script><h2>Sub</h2>x<br>y")
    assert got == [("Top", "Top"), ("Top", "a b"), ("Sub", "Sub"), ("Sub", "x"), ("Sub", "y")]
    assert readers.html_lines(None) == []


def test_folder_and_properties(spark, tmp_path):
    (tmp_path / "a.properties").write_text("# note\nk=v\nlong=a\\\n  b\n\n!x\n")
    (tmp_path / "b.bin").write_bytes(b"\xe4")
    files = readers.read_folder(spark, str(tmp_path))
    assert {r["content"] for r in files.collect()} >= {"ä"}
    assert ids(readers.property_rows(files.where("path like '%properties'")).select("key", "value")) == {("k", "v"), ("long", "ab")}


def test_outline_skips_fences(spark):
    df = spark.createDataFrame([("# A\n```\n# no\n```\n## B #\ntext",)], "t string").select(chunking.outline(F.col("t")).alias("h"))
    assert [(h["line"], h["level"], h["title"]) for h in df.first()["h"]] == [(1, 1, "A"), (5, 2, "B")]


def test_budget_and_fall_through(spark):
    rows = spark.createDataFrame([("g", 1, "aaaa"), ("g", 2, "bbb"), ("g", 3, "c")], "g string, n int, t string")
    assert ids(evidence.within_budget(rows, "g", ["n"], "t", 7).select("n")) == {(1,), (2,)}


def test_queue_stream(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("a", 1, t(0)), ("a", 1, t(5)), ("b", 1, t(6))], "kind string, id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        queue.run_once(queue.coalesced(queue.stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert ids(spark.read.parquet(str(tmp_path / "out")).select("kind", "id")) == {("a", 1), ("b", 1)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. ä\n€", max_size=300), st.integers(5, 60))
def test_chunks_lose_nothing(t, size):
    assert all("".join(chunking.split_line(x, size)) == x for x in t.split("\n"))
    assert "".join(chunking.fit_bytes(t, 7)) == t and all(len(p.encode()) <= 7 for p in chunking.fit_bytes(t, 7))
    got = chunking.chunk_lines(t, size, 3)
    assert all(len(c) <= size for _, _, c in got)
    lines = {n for a, b, _ in got for n in range(a, b + 1)}
    assert lines >= {n for n, x in enumerate(t.split("\n"), 1) if x.strip()}


def test_structure_of_small_files(spark):
    from korpusgraf.operators import structure

    f = lambda p, c: spark.createDataFrame([(p, c)], "path string, content string")
    shell = f("a.sh", "# x() {\nrun() {\n  java -Xmx1g -cp . org.App arg\n}\n. ./lib.sh\n")
    assert ids(structure.shell_facts(shell).select("type", "name")) == {("function", "run"), ("starts_java", "org.App"), ("sources", "./lib.sh")}
    csd = f("a.csd", "DEFINE FILE(ACCT) GROUP(G)\n DSNAME(PROD.ACCT)\nDEFINE TRANSACTION(T1)\nDEFINE FILE(CUST)")
    assert ids(structure.csd_files(csd).select("name", "dataset")) == {("ACCT", "PROD.ACCT"), ("CUST", None)}
    pom = f("pom.xml", "<project><parent><groupId>g</groupId></parent><artifactId>a</artifactId><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId></dependency></dependencies></project>")
    assert ids(structure.poms(pom).select("artifact", "group", "dependency")) == {("a", "g", "x:y")}
    steps = spark.createDataFrame([("j", "S1", "P"), ("j", "S2", "P")], "path string, step string, program string")
    dds = spark.createDataFrame([("j", "S1", "IN", "A"), ("j", "S2", "IN", "A"), ("j", "S1", "OUT", "B"), ("j", "S2", "OUT", "C")], "path string, step string, dd string, dataset string")
    fds = spark.createDataFrame([("P", "F1", "IN"), ("P", "F2", "OUT")], "program string, file string, dd string")
    assert ids(structure.dataset_assignments(steps, dds, fds)) == {("P", "F1", "A")}


def test_one_implementation_within_three_levels(spark):
    from korpusgraf.operators import change

    calls = spark.createDataFrame([(1, "I", "run", 0), (2, "I", "stop", 1)], "call_id long, type string, name string, arity int")
    methods = spark.createDataFrame([(10, "C", "run", 0), (11, "B", "stop", 1), (12, "C", "stop", 1), (13, "C", "run", 2)], "id long, type string, name string, arity int")
    realises = spark.createDataFrame([("B", "I"), ("C", "B"), ("I", "C")], "sub string, super string")  # with a cycle
    assert ids(change.implementations(calls, methods, realises)) == {(1, 10)}


def test_chunks_one_step_away(spark):
    from korpusgraf.operators import change

    entities = spark.createDataFrame([(1, "f", 1, 9), (2, "g", 1, 5), (3, "g", 6, 9)], "id long, file_path string, start_line int, end_line int")
    chunks = spark.createDataFrame([(1, "f", 1, 3, 10), (2, "g", 1, 5, 10), (3, "g", 5, 9, 10)], "chunk_id long, file_path string, start_line int, end_line int, size int")
    edges = spark.createDataFrame([("a", 1, 2, "n", "CALL", "resolved", 1), ("b", 1, 3, "n", "CALL", "unresolved", 1)], EDGE)
    assert ids(change.expanded_chunks(chunks.where("chunk_id = 1").drop("size"), chunks, entities, edges)) == {(1, 2), (1, 3)}
    assert ids(change.expanded_chunks(chunks.where("chunk_id = 1").drop("size"), chunks, entities, edges, budget=10)) == {(1, 2)}


def test_fingerprints_follow_dependencies_and_end_in_cycles(spark):
    from korpusgraf.operators import change

    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "path string, needs string")
    made = lambda c: {r["path"]: r["fingerprint"] for r in change.dependency_fingerprints(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", c), ("x", "4"), ("y", "5")], "path string, hash string"), deps, 3).collect()}
    one, two = made("3"), made("9")
    assert {p for p in one if one[p] != two[p]} == {"a", "b", "c"}


def test_dependencies_are_followed_to_the_end(spark):
    from korpusgraf.operators import change

    steps = [(i, i + 1) for i in range(11)] + [(20, 21), (21, 22), (22, 20)]
    deps = spark.createDataFrame(steps, "path long, needs long")
    want = {(i, j) for i in range(12) for j in range(i + 1, 12)} | {(i, j) for i in (20, 21, 22) for j in (20, 21, 22) if i != j}
    assert ids(incremental.dependency_closure(deps)) == want
    chain = deps.where("path < 20").selectExpr("string(path) as path", "string(needs) as needs")
    made = lambda last: {r["path"]: r["fingerprint"] for r in change.dependency_fingerprints(spark.createDataFrame([(str(i), last if i == 11 else "h") for i in range(12)], "path string, hash string"), chain).collect()}
    one, two = made("h"), made("x")
    assert all(one[p] != two[p] for p in one) and len(one) == 12


def test_findings_go_out_of_date_through_citations(spark):
    from korpusgraf.operators import change

    findings = spark.createDataFrame([(1, "verified", ["f"]), (2, "verified", ["g"]), (3, "verified", ["g"]), (4, "draft", ["f"])], "id long, state string, files array<string>")
    cites = spark.createDataFrame([(2, 1), (3, 4), (1, 2)], "id long, other long")
    got = change.outdated(findings, spark.createDataFrame([("f",)], "path string"), cites)
    assert ids(got) == {(1, "outdated"), (2, "outdated"), (3, "verified"), (4, "draft")}


def test_layers_collapse_and_end_in_cycles(spark):
    from korpusgraf.operators import context

    root = spark.createDataFrame([(1,)], "id long")
    shown, summary = context.drop_layers(cycle(spark), root, 6)
    assert ids(shown) == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert ids(summary) == {(1, 1, 0, False), (2, 1, 0, False), (3, 1, 1, False), (4, 0, 0, False)}
    shown, summary = context.drop_layers(cycle(spark), root, 6, collapse_above=0)
    assert ids(shown) == {(1, 0)} and ids(summary) == {(1, 1, 0, True)}


def test_only_the_best_are_blended(spark):
    from korpusgraf.operators import context

    hits = spark.createDataFrame([(1, 3.0, -1.0), (2, 2.0, 0.5), (3, 1.0, 1.0), (4, 1.0, 0.0)], "id long, score double, cosine double")
    assert ids(context.blend_rerank(hits, top=2)) == {(2, 1), (1, 2), (3, 3), (4, 4)}


def test_control_flow_goes_two_hops(spark):
    from korpusgraf.operators import context

    entities = spark.createDataFrame([(1, "f", 5), (2, "g", 1), (3, "g", 9)], "id long, file_path string, start_line int")
    assert ids(context.control_flow(cycle(spark), entities, "f").select("hop", "src_id", "dst_id")) == {(1, 1, 2), (1, 1, 1), (2, 2, 3)}


def test_settings_are_inherited_and_cycles_end(spark):
    models = spark.createDataFrame(
        [("a", None, {"v": "1", "full": "${g}:${v}"}), ("b", "a", {"v": "2", "g": "x"}), ("c", "d", {"k": "c"}), ("d", "c", {"k": "d", "only": "${missing}"}), ("e", "gone", {})], "path string, parent string, props map<string,string>"
    )
    got = {(r["path"], r["key"]): (r["value"], r["level"]) for r in choices.effective_settings(models).collect()}
    assert got == {("a", "v"): ("1", 0), ("a", "full"): ("${g}:1", 0), ("b", "v"): ("2", 0), ("b", "g"): ("x", 0), ("b", "full"): ("x:2", 1), ("c", "k"): ("c", 0), ("c", "only"): ("${missing}", 1), ("d", "k"): ("d", 0), ("d", "only"): ("${missing}", 0)}


def test_items_nest_by_level(spark):
    rows = [("p", n, level) for n, level in enumerate([1, 5, 10, 88, 88, 10, 5, 77, 1, 66], 1)]
    got = {r["line"]: r["parent_line"] for r in choices.nested_items(spark.createDataFrame(rows, "path string, line int, level int")).collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 3, 5: 3, 6: 2, 7: 1, 8: None, 9: None, 10: 9}


def test_overloads_stay_open_unless_one_is_left(spark):
    methods = spark.createDataFrame([(1, "f", ["int"]), (2, "f", ["java.lang.Integer"]), (3, "f", ["int", "int"]), (4, "g", [])], "method_id long, name string, param_types array<string>")
    calls = spark.createDataFrame(
        [(1, "f", 2, None), (2, "f", 1, ["int"]), (3, "f", 1, ["Integer"]), (4, "f", 1, [None]), (5, "g", 0, []), (6, "f", 1, ["Long"]), (7, "none", 0, []), (8, "f", None, ["a.b.Integer<T>"])], "call_id long, name string, n_args int, arg_types array<string>"
    )
    got = {r["call_id"]: r["method_id"] for r in choices.chosen_overloads(calls, methods).collect()}
    assert got == {1: 3, 2: 1, 3: 2, 4: None, 5: 4, 6: None, 7: None, 8: 2}


def test_suites_without_cases_count_by_their_attributes(spark):
    files = spark.createDataFrame([("a", '<testsuites><testsuite tests="9"><testsuite tests="2" failures="3"/></testsuite></testsuites>'), ("b", '<n:testsuite xmlns:n="u"><n:testcase name="x"><n:failure/></n:testcase></n:testsuite>')], "path string, content string")
    got = {r["path"]: (r["tests"], r["failures"], r["consistent"]) for r in choices.test_reports(files).collect()}
    assert got == {"a": (2, 3, False), "b": (1, 1, True)}
