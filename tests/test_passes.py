"""Resolution, source passes, assembled results and the mended operators on small inputs, against plain Python where a rule is sequential."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from korpusgraf.functions import chunking, text
from korpusgraf.operators import assembly, choices, graph, linking, passes, reports, rollup, search, structure
from korpusgraf.operators import source_passes as P
from korpusgraf.sources import readers
from korpusgraf.streaming import queue


def ids(df):
    return {tuple(r) for r in df.collect()}


def test_files_of_one_path_in_two_sources_are_two_files(spark):
    entities = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 1, "b"), (4, None, None)], "id long, source_id int, file_path string")
    edges = spark.createDataFrame([("e1", 1, 2, "CALL"), ("e2", 1, 2, "READS"), ("e3", 3, 1, "COPY"), ("e4", 4, 3, "CALL"), ("e5", 1, 1, "CALL")], "edge_id string, src_id long, dst_id long, type string")
    got = rollup.file_pairs(edges, entities, samples=1)
    assert {(r["src_file"], r["dst_file"], r["edge_count"], tuple(r["sample_ids"])) for r in got.collect()} == {("1:a", "2:a", 2, ("e1",)), ("1:b", "1:a", 1, ("e3",)), (":", "1:b", 1, ("e4",))}


def test_keywords_are_found_within_words_whatever_their_frequency(spark):
    rng = random.Random(4)
    words = ["the", "there", "order", "reorder", "xyz", "abcxyz", "zz9", "orders,", "(the)"]
    texts = [(i, " ".join(rng.choices(words, k=5)) if i else None) for i in range(40)]
    keys = [(k, rng.sample(["the", "order", "xyz", "zz9", "abc", "nothing", "re", "a b"], k=rng.randrange(1, 6))) for k in range(20)]
    chunks = spark.createDataFrame(texts, "chunk_id long, content string")
    for least in (0.25, 0.5, 1.0):
        want = set()
        for k, ks in keys:
            ks = {w for w in ks if len(w) >= 3 and " " not in w}
            scores = sorted(((-round(sum(w in (t or "").lower() for w in ks) / len(ks), 4), i) for i, t in texts), key=lambda x: x) if ks else []
            want |= {(k, i, -s) for s, i in [x for x in scores if -x[0] >= least][:7]}
        assert ids(linking.keyword_pass(spark.createDataFrame(keys, "id long, keywords array<string>"), chunks, least, 7)) == want


def test_malformed_reports_have_no_numbers(spark):
    files = spark.createDataFrame([("good", '<testsuite tests="1"><testcase name="a"/></testsuite>'), ("bad", "<testsuite><testcase>"), ("none", None)], "path string, content string")
    assert ids(choices.test_reports(files).select("path", "tests", "consistent")) == {("good", 1, True), ("bad", None, False), ("none", None, False)}


def test_semicolons_and_dashes_in_literals_cut_no_statement(spark):
    sql = "insert into A values ('x;y--z', 'it''s; ok'); -- don't; stop\n/* a ; 'b */ select * from B;"
    got = structure.sql_statements(spark.createDataFrame([("f", sql)], "path string, content string"))
    assert ids(got.select("verb", "tables")) == {("INSERT", "A"), ("SELECT", "B")}


def test_exports_are_whole_and_escaped(spark):
    nodes = spark.createDataFrame([(1, 'a <&> "b"\x01'), (2, "it's\nnew\\"), (3, None)], "id long, name string")
    edges = spark.createDataFrame([(1, 2, "CALL"), (1, 9, "CALL")], "src_id long, dst_id long, type string")
    lines = [r["line"] for r in graph.to_graphml(nodes, edges).orderBy("nr", "id").collect()]
    tree = ET.fromstring("\n".join(lines))
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert [n.find(f"{space}data").text for n in tree.iter(f"{space}node")] == ['a <&> "b" ', "it's\nnew\\", None]
    assert [(e.get("source"), e.get("target")) for e in tree.iter(f"{space}edge")] == [("n1", "n2")]
    cypher = [r["line"] for r in graph.to_cypher(nodes, edges).orderBy("nr", "line").collect()]
    assert "MERGE (n:Entity {id: 2}) SET n.name = 'it\\'s\\nnew\\\\';" in cypher and cypher[-1].startswith("MATCH (a:Entity {id: 1}), (b:Entity {id: 2})") and len(cypher) == 4
    rows = spark.createDataFrame([('a,"b', 1), ("plain", None)], "x string, y int")
    assert {r["line"] for r in graph.to_csv_lines(rows, ["x", "y"]).collect()} == {'"a,""b",1', "plain,"}


def test_identities_do_not_run_into_each_other(spark):
    held = spark.createDataFrame([("a|b", "c", "p"), (None, "x", "p")], "run string, job string, payload string")
    new = spark.createDataFrame([("a", "b|c", "q"), ("", "x", "q")], "run string, job string, payload string")
    assert {r["state"] for r in reports.new_reports(held, new, ["run", "job"]).collect()} == {"new"}


def test_unknown_kinds_are_documents(spark):
    chunks = spark.createDataFrame([(1, None, None), (2, True, None), (3, True, 5), (4, False, 6)], "id long, is_code boolean, project_id long")
    assert {r["id"] for r in reports.gated(chunks, spark.createDataFrame([], "project_id long"), 5).collect()} == {1, 3, 4}


def test_an_ambiguous_stage_is_never_narrowed(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "y"), (4, "c", None)], "ref_id long, k string, l string")
    first = spark.createDataFrame([("a", 10), ("a", 11), ("b", 12), ("b", 12)], "k string, target_id long")
    second = spark.createDataFrame([("x", 20), ("y", 21)], "l string, target_id long")
    got = passes.resolve_staged(refs, [(first, ["k"]), (second, ["l"])])
    assert ids(got.select("ref_id", "target_id", "stage")) == {(1, None, 0), (2, 12, 0), (3, 21, 1), (4, None, None)}


@pytest.mark.parametrize("base, link, want", [("a/b/c.jsp", "../d.jsp", "a/d.jsp"), ("c.jsp", "../d.jsp", None), ("a/c.jsp", "/x/./y.jsp", "x/y.jsp"), ("a/c.jsp", "x//y.jsp", "a/x/y.jsp"), ("a/c.jsp", "${p}.jsp", None), ("a/c.jsp", "http://x", None)])
def test_links_are_walked(spark, base, link, want):
    assert spark.createDataFrame([(base, link)], "b string, l string").select(passes.normal_path(F.col("b"), F.col("l"))).first()[0] == want


def test_continued_literals_and_regions(spark):
    code = "       MOVE 'AB\n      -    'CD' TO X.\n      * note\n       CALL 'P1'. CALL 'P2'.\n"
    files = spark.createDataFrame([("f", code)], "path string, content string")
    assert [(r["line"], r["end_line"], r["text"]) for r in P.logical_lines(files).orderBy("line").collect()][0] == (1, 2, "MOVE 'ABCD' TO X.")
    assert {r["dst_name"] for r in structure.cobol_edges(files).where("type = 'CALL'").collect()} == {"P1", "P2"}
    nested = ">>IF 1 = 2\na\n>>IF DEFINED(Q)\nb\n>>END-IF\n>>ELSE\nc\n>>IF FOO\nd\n>>ELSE\ne\n>>END-IF\n>>END-IF\nf\n>>IF 2 = 2\ng\n"
    kept = P.active_lines(structure.lines(spark.createDataFrame([("f", nested)], "path string, content string")), {}).where("text <> ''")
    assert [r["text"] for r in kept.orderBy("line").collect()] == ["c", "d", "e", "f", "g"]


def brute_chunks(units, size, least):
    """units: (section, lines as (number, characters))."""
    out, held = [], []

    def close():
        if held:
            out.append((held[0][1][0][0], held[-1][1][-1][0], sum(c for _, ls in held for _, c in ls)))
            held.clear()

    for section, lines in units:
        n = sum(c for _, c in lines)
        if n > size:
            close()
            part = []
            for line in lines:
                if part and sum(c for _, c in part) + line[1] > size:
                    out.append((part[0][0], part[-1][0], sum(c for _, c in part)))
                    part = []
                part.append(line)
            out.append((part[0][0], part[-1][0], sum(c for _, c in part)))
        elif n < least:
            if held and held[-1][0] != section:
                close()
            held.append((section, lines))
            if sum(c for _, ls in held for _, c in ls) >= least:
                close()
        else:
            close()
            out.append((lines[0][0], lines[-1][0], n))
    close()
    return out


def test_paragraphs_are_gathered_and_cut(spark):
    rng = random.Random(9)
    files, want, units = [], set(), []
    for f in range(6):
        lines = ["z" * rng.choice([0, 3, 9, 30, 70]) for _ in range(60)]
        files.append((f"f{f}", "\n".join(lines)))
        at, mine = 0, []
        while at < 60:
            n = min(rng.randrange(1, 5), 60 - at)
            section = str(at // 20)
            units.append((f"f{f}", section, at + 1, at + n))
            mine.append((section, [(k + 1, len(lines[k]) + 1) for k in range(at, at + n)]))
            at += n
        want |= {(f"f{f}", k, *c) for k, c in enumerate(brute_chunks(mine, 80, 40))}
    code = structure.lines(spark.createDataFrame(files, "path string, content string"))
    got = P.paragraph_chunks(spark.createDataFrame(units, "path string, section string, start_line int, end_line int"), code, 80, 40)
    assert ids(got) == want


def test_greedy_cover_takes_what_adds_most(spark):
    rng = random.Random(2)
    items = {i: set(rng.sample(range(30), rng.randrange(1, 12))) for i in range(15)}
    rows = [(i, w, 1.0, 0.25) for i, ws in items.items() for w in ws]
    got = [tuple(r) for r in assembly.greedy_cover(spark.createDataFrame(rows, "item long, word long, weight double, base double"), 5).orderBy("pos").collect()]
    covered, want, left = set(), [], dict(items)
    for pos in range(1, 6):
        best = min(left, key=lambda i: (-len(left[i] - covered), i))
        want.append((pos, best, len(left[best] - covered) + 0.25))
        covered |= left.pop(best)
    assert got == want


def test_vectors_are_swapped_in_all_rows_or_none(spark):
    rows = spark.createDataFrame([(1, 1, "old", 2, "new"), (2, 1, "old", None, None)], "id long, embedding int, embedding_model string, embedding_next int, embedding_next_model string")
    assert ids(assembly.swapped_vectors(rows, "new")) == ids(rows)
    assert ids(assembly.swapped_vectors(rows.where("id = 1"), "new")) == {(1, 2, "new", 1, "old")}


def test_derived_tables_are_rebuilt_by_partition(spark, tmp_path):
    path = f"{tmp_path}/t"
    assembly.rebuilt(spark.createDataFrame([(1, "a"), (2, "b")], "x int, project string"), path, "project")
    assembly.rebuilt(spark.createDataFrame([(9, "a")], "x int, project string"), path, "project")
    assert ids(spark.read.parquet(path).select("x", "project")) == {(9, "a"), (2, "b")}


def test_bytes_are_decoded_strictly(spark):
    page = "MOVE A TO B. ÄÖ".encode("cp273")
    rows = [("e", bytearray(page)), ("u", bytearray("äé".encode())), ("x", bytearray(b"ab\xff")), ("n", None)]
    got = {r["path"]: (r["charset"], r["text"], r["error_at"]) for r in readers.strictly_decoded(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["u"] == ("utf-8", "äé", None) and got["x"] == ("utf-8", None, 2) and got["n"] == ("utf-8", "", None) and got["e"][0].startswith("cp") and got["e"][1].startswith("MOVE A TO B.")
    assert readers.strictly_decoded(spark.createDataFrame(rows[2:3], "path string, content binary"), "ascii").first()["error_at"] == 2


def test_small_chunks_are_gathered_until_they_hold_enough():
    chunks = [(i, i, "x" * n) for i, n in enumerate([50, 60, 300, 40, 170, 30])]
    assert [(a, b) for a, b, _ in chunking.merge_small(chunks, 200)] == [(0, 1), (2, 2), (3, 4), (5, 5)]


def test_spellings_leave_the_bare_name_out(spark):
    one = lambda s: spark.range(1).select(text.query_variants(F.lit(s))).first()[0]
    assert one("a.b.c(int)") == ["a.b.c(int)", "a.b#c", "b#c", "b.c"] and one("a.b") == ["a.b", "a#b"] and one("a") == ["a"]
    assert text.codeowners_pattern("!a") == text.codeowners_pattern("[ab]c") == r"(?!)"


def test_short_queries_are_bounded(spark):
    assert search.bounded(spark.range(50), ["ab", "c"], ["id"], 7).count() == 7 and search.bounded(spark.range(50), ["abc"], ["id"], 7).count() == 50


def test_backlog_counts_windows(spark, tmp_path):
    spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 4000)], "kind string, id long, s long").select("kind", "id", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    query = queue.backlog(queue.stream(spark, f"{tmp_path}/in", schema)).writeStream.format("memory").queryName("backlog").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert ids(spark.table("backlog").select("kind", "items")) == {("a", 2), ("b", 1)}


def test_process_and_pages(spark):
    edges = spark.createDataFrame([("a", 1, None, "X", "CALL", 1, False), ("b", 1, 2, "Y", "PERFORM", 2, True), ("c", 1, 3, "F", "READS", 3, False), ("d", 1, 3, "Z", "IMPORTS", 4, False)], "edge_id string, src_id long, dst_id long, dst_name string, type string, line int, loop boolean")
    got = assembly.process_steps(edges, spark.createDataFrame([(1,)], "id long"), 2)
    assert ids(got.select("pos", "kind", "cut")) == {(1, "external_call", "step_limit"), (2, "iteration", "step_limit")}
    page = assembly.offset_page(spark.range(10), ["id"], 8, 5)
    assert ids(page.select("id", "has_more", "next_cursor")) == {(8, False, None), (9, False, None)}
