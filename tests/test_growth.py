"""Work that must not grow with the square of a group: the most rows that any step of a run makes, and results where a large group is cut."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from korpusgraf.operators import assembly, change, evidence, graph, groups, incremental, intervals, linking, models, partials, process, rollup, slices, source_passes, structure, vectors


def most_rows(spark, run, metric="number of output rows", of=max):
    """The greatest number of rows that a node of run's plans gave, or another metric of theirs, or their sum."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    held = store.executionsList()
    last = max((held.apply(i).executionId() for i in range(held.size())), default=-1)
    run()
    bus.waitUntilEmpty()
    held, most = store.executionsList(), 0
    for e in (held.apply(i).executionId() for i in range(held.size())):
        if e <= last:
            continue
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                v = values.get(m.accumulatorId())
                if m.name() == metric and v.isDefined():
                    most = of((most, int(v.get().replace(",", ""))))
    return most


def total(spark, run, metric):
    return most_rows(spark, run, metric, sum)


def ids(df):
    return {tuple(r) for r in df.collect()}


def test_a_text_above_the_budget_ends_its_group(spark):
    rows = spark.range(60).select(F.lit("g").alias("g"), F.col("id").alias("n"), F.when(F.col("id") == 3, F.repeat(F.lit("x"), F.lit(100))).otherwise("ab").alias("t"))
    assert ids(evidence.within_budget(rows, "g", ["n"], "t", 20).select("n", "used")) == {(0, 2), (1, 4), (2, 6)}


def test_keywords_that_many_entities_and_chunks_share(spark):
    entities = spark.range(400).selectExpr("id", "array('the', case when id % 2 = 0 then 'then' else 'there' end) as keywords")
    chunks = spark.range(400).selectExpr("id as chunk_id", "case when id % 4 = 0 then 'the end' else 'then' end as content")
    got = []
    assert most_rows(spark, lambda: got.extend(linking.keyword_pass(entities, chunks, 0.3, 3).collect())) < 5_000
    want = {(i, c, 1.0 if i % 2 == 0 else 0.5) for i in range(400) for c in ((1, 2, 3) if i % 2 == 0 else (0, 1, 2))}
    assert {tuple(r) for r in got} == want


def test_equal_ranges_meet_once(spark):
    hunks = spark.range(300).selectExpr("id as hunk_id", "'f' as file_path", "case when id % 2 = 0 then 5 else 8 end as start_line", "9 as end_line")
    entities = spark.range(300).selectExpr("id", "'f' as file_path", "1 as start_line", "20 as end_line").union(spark.createDataFrame([(300, "f", 4, 9), (301, "f", 4, 9), (302, "f", 7, 8)], "id long, file_path string, start_line int, end_line int"))
    for of, want in (
        (intervals.innermost_of, {(i, 302) for i in range(300)}), (intervals.smallest_unique_of, {(i, 302) for i in range(300)}), (assembly.covering_entity, {(i, 0) for i in range(300)}),
        (lambda h, e: assembly.units_of(h.withColumnRenamed("hunk_id", "chunk_id"), e), {(i, 300 if i % 2 == 0 else 302) for i in range(300)}),
    ):
        got = []
        assert most_rows(spark, lambda: got.extend(of(hunks, entities).collect())) < 5_000
        assert {tuple(r) for r in got} == want


def test_ranges_that_overlap_without_holding_each_other(spark):
    rng = random.Random(3)
    spans = lambda n: [(i, f"f{rng.randrange(2)}", a := rng.randrange(1, 60), a + rng.randrange(0, 12)) for i in range(n)]
    schema = "id long, file_path string, start_line int, end_line int"
    h, e = spans(40), spans(60)
    hunks, entities = spark.createDataFrame(h, schema).withColumnRenamed("id", "hunk_id"), spark.createDataFrame(e, schema)
    hit = {i: [x for x in e if x[1] == f and x[2] <= b and x[3] >= a] for i, f, a, b in h}
    inner = {(i, x[0]) for i, xs in hit.items() for x in xs if not any(y[2] >= x[2] and y[3] <= x[3] and y[2:] != x[2:] for y in xs)}
    assert ids(intervals.innermost_of(hunks, entities)) == ids(intervals.innermost(intervals.overlapping(hunks, entities, 16))) == inner
    least = {i: [x[0] for x in xs if x[3] - x[2] == min(y[3] - y[2] for y in xs)] for i, xs in hit.items() if xs}
    assert ids(intervals.smallest_unique_of(hunks, entities)) == {(i, x[0]) for i, x in least.items() if len(x) == 1}


def test_programs_and_paragraphs_of_one_file(spark):
    at = "0 as source_id", "'v' as variant", "'f' as file_path"
    programs, paragraphs = spark.range(300).selectExpr("id", *at, "10 as start_line", "40 as end_line"), spark.range(300).selectExpr("id", *at, "cast(id % 3 * 10 as int) as start_line", "cast(id % 3 * 10 + 5 as int) as end_line")
    got = []
    assert most_rows(spark, lambda: got.extend(assembly.entry_paragraphs(programs, paragraphs).collect())) < 5_000
    assert {tuple(r) for r in got} == {(i, 1) for i in range(300)}


def test_parameters_of_one_routine_share_its_call_sites(spark):
    parameters = spark.range(300).selectExpr("concat('F', id) as field", "'r' as routine", "0 as position")
    calls = spark.range(300).selectExpr("id as call_id", "'r' as routine", "'c' as caller", "1 as line", "id % 3 = 0 as test", "array(concat('x', id)) as arguments", "array(concat('F', id)) as refs")
    got = []
    assert most_rows(spark, lambda: got.extend(slices.argument_steps(parameters, calls).select("field", "at.nr", "reads").collect())) < 5_000
    assert {(f, nr, r[0]) for f, nr, r in got} == {(f"F{i}", nr, f"x{x}") for i in range(300) for nr, x in enumerate((1, 2, 4, 5), 1)}


def test_chunks_beyond_the_budget_never_meet(spark):
    entities = spark.range(200).selectExpr("id", "'f' as file_path", "1 as start_line", "9 as end_line")
    chunks = spark.range(300).selectExpr("id as chunk_id", "'f' as file_path", "1 as start_line", "3 as end_line", "cast(40 + id % 60 as int) as size")
    edges = spark.range(200).selectExpr("cast(id as string) as edge_id", "id as src_id", "(id + 1) % 5 as dst_id", "'n' as dst_name", "'CALL' as type", "'resolved' as resolution", "1 as line")
    got = []
    assert most_rows(spark, lambda: got.extend(change.expanded_chunks(chunks, chunks, entities, edges, 150).collect())) < 10_000
    want = set()
    for h in range(300):
        used = 0
        for c in (c for c in range(6) if c != h):
            used += 40 + c % 60
            want |= {(h, c)} if used <= 150 else set()
    assert {tuple(r) for r in got} == want


def test_managed_versions_hold_no_pairs_of_models(spark):
    """Six layers of 40 models, each importing five of the next; two models on a cycle, and two imports at one place, end in the last layer too."""
    m = spark.range(240).selectExpr("cast(id as string) as model", "cast(id as string) as coordinates", "cast(null as string) as parent")
    m = m.union(spark.createDataFrame([("x", "x", None), ("y", "y", None), ("z", "z", None)], "model string, coordinates string, parent string"))
    rows = spark.range(200).selectExpr("cast(id as string) as model", "posexplode(array(0, 1, 2, 5, 13)) as (place, by)", "id").selectExpr("model", "place", "cast(null as string) as key", "cast(null as string) as value", "cast((id div 40 + 1) * 40 + (id + by) % 40 as string) as imports")
    rows = rows.union(spark.range(200, 240).selectExpr("cast(id as string)", "9", "'k'", "concat('v', id)", "null"))
    more = [("x", 0, "y"), ("x", 1, "200"), ("y", 0, "x"), ("y", 1, "207"), ("z", 0, "202"), ("z", 0, "201")]
    rows = rows.union(spark.createDataFrame(more, "model string, place int, imports string").selectExpr("model", "place", "null", "null", "imports"))
    got = []
    assert most_rows(spark, lambda: got.extend(models.managed_versions(rows, models.parents(m), m).collect())) < 4_000
    want = {(str(i), "k", f"v{200 + i % 40}", str(200 + i % 40), 5 - i // 40) for i in range(240)} | {("x", "k", "v207", "207", 2), ("y", "k", "v200", "200", 2), ("z", "k", "v201", "201", 1)}
    assert {tuple(r) for r in got} == want


def test_equal_fields_of_a_copybook_meet_once(spark):
    copies = spark.range(300).selectExpr("id % 100 as program", "'B' as copybook", "'F' as old", "'N' as new")
    fields = spark.range(300).selectExpr("'B' as copybook", "'d' as path", "concat('F', id % 3) as name", "id % 3 as level")
    got = []
    assert most_rows(spark, lambda: got.extend(source_passes.inherited_fields(copies, fields).collect())) < 5_000
    assert {tuple(r) for r in got} == {(p, f"N{n}", n) for p in range(100) for n in range(3)} and len(got) == 300


def test_paths_move_only_edges_at_the_frontier(spark):
    edges = spark.range(3000).selectExpr("concat('e', id) as edge_id", "id as src_id", "id + 1 as dst_id").union(spark.createDataFrame([("a", 0, 2), ("b", 0, 2), ("d", 1, 5)], "edge_id string, src_id long, dst_id long"))
    got = []
    start = spark.range(1)
    assert most_rows(spark, lambda: got.extend(graph.shortest_paths(edges, start, 2).collect()), "shuffle records written") < 100
    assert {r["id"]: r["path"] for r in got} == {0: [], 1: ["e0"], 2: ["a"], 3: ["a", "e2"], 5: ["e0", "d"]}


def test_pairs_and_their_samples_come_from_one_pass(spark):
    edges = spark.range(600).selectExpr("concat('e', id) as edge_id", "id % 30 as src_id", "30 + id % 2 as dst_id", "'CALL' as type")
    entities = spark.range(32).selectExpr("id", "concat('f', id div 15) as file_path")
    made = rollup.file_pairs(edges, entities, samples=2)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    of = lambda a: sorted(f"e{i}" for i in range(600) if i % 30 // 15 == a)[:2]
    assert {(r["src_file"], r["dst_file"], r["edge_count"], tuple(r["sample_ids"])) for r in made.collect()} == {(f"f{a}", "f2", 300, tuple(of(a))) for a in (0, 1)}


def test_group_edges_are_summed_before_their_second_group_is_looked_up(spark):
    edges = spark.range(4000).selectExpr("concat('a', id % 200) as a", "concat('b', id % 20) as b", "1.0D as w")
    found = edges.select("a").union(edges.select("b")).distinct().selectExpr("a as node", "substr(a, 1, 1) as community")
    got = groups.group_edges(edges, found)
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert ids(got) == {("a", "b", 4000.0)}


def test_a_project_file_is_parsed_before_its_rows_are_made(spark):
    item = "<dependency><groupId>g</groupId><artifactId>a{}</artifactId></dependency>"
    files = spark.createDataFrame([("p", f"<project><artifactId>x</artifactId><groupId>t</groupId><dependencies>{item.format(1)}{item.format(2)}</dependencies></project>"), ("q", "<project><artifactId>y</artifactId></project>")], "path string, content string")
    made = structure.poms(files)
    above = made._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "xpath" not in above.lower()
    assert ids(made) == {("p", "x", "t", "g:a1"), ("p", "x", "t", "g:a2"), ("q", "y", "", "")}


def test_a_query_with_a_known_score_leaves_worse_candidates_unsorted():
    """Of 3000 candidates none but those that reach the query's k-th score come back, ties and its own source apart."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    x[7] = x[11]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = pd.DataFrame({"id": np.arange(3000), "source": np.arange(3000) % 3, "v": list(x)})
    q = pd.DataFrame({"id": [7, 7000], "source": [1, 2], "v": [x[7], x[5]], "kth": [0.95, np.nan]})
    got = vectors._meet(5, False)(q, c)
    of = lambda i, s: [(-v, n) for v, n in sorted((-v, n) for n, v in enumerate(np.round(x @ x[i], 4)) if n != i * (i == 7) and n % 3 != s)]
    assert [tuple(r) for r in got[got.query_id == 7][["score", "id"]].values] == [r for r in of(7, 1) if r[0] >= 0.95][:5]
    assert [tuple(r) for r in got[got.query_id == 7000][["score", "id"]].values] == of(5, 2)[:5]


def test_lines_of_programs_move_with_their_file(spark, monkeypatch):
    """Regions and calls are found where a file's lines are, in as many tasks as there are files for."""
    monkeypatch.setattr(structure, "FILES_A_TASK", 10)
    files = spark.range(300).selectExpr("concat('f', id) as path", "concat('>>IF 1 = ', id % 2, '\\na', id, '\\n>>ELSE\\nb', id, '\\n>>END-IF\\n') as content")
    kept = source_passes.active_lines(structure.lines(structure.dealt(files)), {})
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1 and structure.dealt(files).rdd.getNumPartitions() == 30
    assert ids(kept.where("text <> ''")) == {(f"f{i}", 4 - i % 2 * 2, f"{'ba'[i % 2]}{i}") for i in range(300)}
    calls = files.select("path", F.concat(F.lit("       01  W PIC X VALUE 'I'.\n           MOVE 'P' TO W.\n           CALL W.\n           CALL V.\n")).alias("content"))
    found = source_passes.dynamic_candidates(structure.logical_lines(calls))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert ids(found) == {x for i in range(300) for x in ((f"f{i}", 3, "W", "I,P"), (f"f{i}", 4, "V", ""))}


def test_a_closure_moves_no_pair_twice(spark):
    """A chain of 21 has 210 pairs, found in 20 steps; moved are each step's own and the direct ones, not those held."""
    deps, got = spark.range(20).selectExpr("id as path", "id + 1 as needs"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = total(spark, lambda: got.extend(incremental.dependency_closure(deps).collect()), "shuffle records written")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved < 1500
    assert sorted(tuple(r) for r in got) == [(a, b) for a in range(21) for b in range(a + 1, 21)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("buckets_")]


def test_a_root_that_has_spent_its_edges_moves_no_others(spark):
    """The second hop would touch 2000 edges, but the first has spent the budget."""
    edges = spark.range(2005).selectExpr("lpad(id, 5, '0') as edge_id", "case when id < 5 then 1 else 10 + id % 5 end as src_id", "case when id < 5 then 10 + id else 100 + id end as dst_id", "'CALL' as type", "'resolved' as resolution", "false as loop", "false as guarded")
    entities = spark.range(3000).selectExpr("id", "'paragraph' as type", "cast(null as string) as operation")
    got = []
    assert total(spark, lambda: got.extend(process.walk(edges, entities, spark.range(1, 2), "outgoing", 3, 100, 5)[1].collect()), "shuffle records written") < 1500
    assert [tuple(r) for r in got] == [(1, 6, 5, 0, 0, "edge_limit")]


def test_edges_meet_parts_and_files_of_parts_in_one_place(spark, data):
    from korpusgraf.plans.rollup_queries import QUERIES
    from korpusgraf.sources.adapter import edges

    met, held = edges(spark, data).where("dst_id is not null"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables meet
    try:
        got = []
        assert total(spark, lambda: got.extend(QUERIES["file_pair_evidence"](spark, data).select("edge_id").collect()), "shuffle records written") < 4.3 * met.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert {r[0] for r in got} <= {r[0] for r in met.select("edge_id").collect()}


def test_rounds_of_moves_move_links_once(spark):
    """Two planted groups: 780 links both ways, and at most 28 turns on three levels; each turn moves half of the links once, and a level all of them a few times."""
    rows = [(f"{c}{i}", f"{c}{j}", 1, 0) for c in "ab" for i in range(28) for j in range(i)] + [("a0", "b0", 1, 0)]
    edges, got, held = groups.weighted(spark.createDataFrame(rows, "src_file string, dst_file string, edge_count long, priority int")).cache(), [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges.count()
        moved = total(spark, lambda: got.extend(groups.communities(edges).collect()), "shuffle records written")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert moved < 20_000
    assert {r["node"][0] for r in got if r["community"] == got[0]["community"]} == {got[0]["node"][0]} and len({r["community"] for r in got}) == 2


def test_the_driver_gathers_no_nodes(spark):
    """What a tree of groups broadcasts is a row for each split group, not for each file."""
    rows = [(f"s:{c}/f{i}", f"s:{c}/f{j}", 1, 0) for c in range(4) for i in range(14) for j in range(i)] + [(f"s:{c}/f0", f"s:{c + 1}/f0", 1, 0) for c in range(3)]
    edges = groups.weighted(spark.createDataFrame(rows, "src_file string, dst_file string, edge_count long, priority int"))
    store, bus, got = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus(), []
    bus.waitUntilEmpty()
    last = max((x.executionId() for x in map(store.executionsList().apply, range(store.executionsList().size()))), default=-1)
    got.extend(groups.file_tree(edges, most=10)[1].collect())
    bus.waitUntilEmpty()
    runs, sent = store.executionsList(), 0
    for e in (x.executionId() for x in map(runs.apply, range(runs.size())) if x.executionId() > last):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in filter(lambda x: x.name() == "BroadcastExchange", map(nodes.apply, range(nodes.size()))):
            for m in map(node.metrics().apply, range(node.metrics().size())):
                if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    sent += int(values.get(m.accumulatorId()).get().replace(",", ""))
    assert len(got) == 56 and sent < 56


def test_a_kept_roll_up_takes_files_by_number(spark, tmp_path):
    base, edges = str(tmp_path), [(2, 10, "CALL"), (2, 9, "CALL"), (10, 9, "CALL"), (11, 9, "READS"), (11, 2, "CALL"), (9, 100, "CALL")]
    of = lambda rows: spark.createDataFrame(rows, "src_file long, dst_file long, type string, sign int")
    partials.apply(spark, base, of([(*e, 1) for e in edges[:4]]), k=1, buckets=2)
    partials.apply(spark, base, of([(*e, 1) for e in edges[4:]] + [(*edges[3], -1)]), k=1, buckets=2)
    found = partials.current_backbone(spark, base, 1, always=1)
    assert found.schema["src_file"].dataType.simpleString() == "bigint"
    pairs = partials.pairs_of(of([(*e, 1) for e in edges if e != edges[3]]).withColumnRenamed("sign", "n"))
    want = rollup.backbone(pairs, 1, always=1)
    plain = lambda df: {str(r) for r in df.select(found.columns).collect()}
    assert plain(found) == plain(want)


def test_deltas_of_the_kept_roll_up_hold_numbers(spark, data, monkeypatch):
    from korpusgraf.plans import save_queries

    deltas = []
    monkeypatch.setattr(save_queries.partials, "apply", lambda s, base, delta, **_: deltas.append(delta))
    monkeypatch.setattr(save_queries.partials, "current_backbone", lambda s, base: deltas[0].withColumn("edge_types", F.array("type")))
    save_queries.kept(spark, data)
    assert len(deltas) == 3 and all(d.schema[c].dataType.simpleString() == "bigint" for d in deltas for c in ("src_file", "dst_file"))
    assert all("lineitem" not in d._jdf.queryExecution().optimizedPlan().toString() and not d.inputFiles()[0].endswith("lineitem.parquet") for d in deltas)


def test_a_diff_takes_all_hunks(spark, data):
    from korpusgraf.plans.assembly_queries import QUERIES, of
    from korpusgraf.plans.graph_queries import hunks

    want = ids(intervals.innermost_of(hunks(spark, data), of(spark, data, "part")).select("id"))
    assert ids(QUERIES["diff_impact"](spark, data).where("hop = 0").select("id")) == want


def test_a_round_of_moves_takes_few_jobs_and_tasks(spark):
    """Four planted groups, split once more by a tree of files: a round takes four jobs, and links that fit in one bucket are dealt to no more."""
    rows = [(f"s:{c}/f{i}", f"s:{c}/f{j}", 1, 0) for c in range(4) for i in range(14) for j in range(i)] + [(f"s:{c}/f0", f"s:{c + 1}/f0", 1, 0) for c in range(3)]
    edges = groups.weighted(spark.createDataFrame(rows, "src_file string, dst_file string, edge_count long, priority int")).cache()
    edges.count()
    scheduler, held, turns, got = spark.sparkContext._jsc.sc().dagScheduler(), spark.conf.get("spark.sql.shuffle.partitions"), 0, []
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        names = groups.numbered(edges.select("a"))
        first = scheduler.nextJobId()
        got.extend(groups.communities(groups._to_numbers(edges, names), names=names).collect())
        jobs = scheduler.nextJobId() - first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        edges.unpersist()
    assert len({(r["node"][2], r["community"]) for r in got}) == 4 and len(got) == 56
    assert jobs < 150


def test_pairs_of_a_cell_lie_together(spark, monkeypatch):
    """A cell's pairs come together, hunk by hunk, and hunks of equal ranges have the same entities in the same order."""
    from korpusgraf.plans import graph_queries

    hunks = spark.range(300).selectExpr("id as hunk_id", "concat('f', id % 2) as file_path", "cast(id % 5 * 10 as int) as start_line", "cast(id % 5 * 10 + 3 as int) as end_line")
    parts = spark.range(80).selectExpr("id", "concat('f', id % 2) as file_path", "cast(id * 7 % 40 as int) as start_line", "cast(id * 7 % 40 + id % 9 as int) as end_line", "'part' as type")
    monkeypatch.setattr(graph_queries, "hunks", lambda s, d: hunks)
    monkeypatch.setattr(graph_queries, "entities", lambda s, d: parts)
    got = [tuple(r) for r in graph_queries.QUERIES["overlapping_entities"](spark, "").collect()]
    at, of = {r[0]: tuple(r)[1:] for r in hunks.collect()}, parts.collect()
    assert sorted(got) == sorted((h, p["id"], p["end_line"] - p["start_line"]) for h, (f, a, b) in at.items() for p in of if p["file_path"] == f and p["start_line"] <= b and p["end_line"] >= a)
    cell = lambda h, i: (at[h][0], max(at[h][1], i * 7 % 40) // 16)
    runs = []
    for h, i, _ in got:
        if not runs or runs[-1][:2] != (cell(h, i), h):
            runs.append((cell(h, i), h, []))
        runs[-1][2].append(i)
    assert sum(a[0] != b[0] for a, b in zip(runs, runs[1:], strict=False)) < len({r[0] for r in runs})
    assert len(runs) == len({r[:2] for r in runs}) and len({(r[0], at[r[1]], tuple(r[2])) for r in runs}) == len({(r[0], at[r[1]]) for r in runs})


def test_a_delta_that_touches_all_pairs_moves_them_three_times(spark, tmp_path):
    """500 pairs of 60 files get an edge each: held and new ones meet once, and pairs move twice from both ends."""
    pairs, got = spark.range(500).selectExpr("id % 50 as src_file", "50 + id div 50 as dst_file"), []
    of = lambda kind: pairs.selectExpr("src_file", "dst_file", f"'{kind}' as type", "1 as sign")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    partials.apply(spark, str(tmp_path), of("READS"), buckets=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables meet
    try:
        moved = total(spark, lambda: partials.apply(spark, str(tmp_path), of("CALL"), buckets=2), "shuffle records written")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    got.extend(partials.current_pairs(spark, str(tmp_path)).collect())
    assert len(got) == 500 and all(r["edge_count"] == 2 and r["edge_types"] == ["CALL", "READS"] for r in got)
    assert moved < 6_000


def test_wide_and_narrow_deltas_give_the_same(spark, tmp_path):
    rng, held = random.Random(11), []
    for turn in range(4):
        gone = rng.sample(held, len(held) // 3)
        new = [(f"f{rng.randrange(9)}", f"f{rng.randrange(9)}", rng.choice(["CALL", "READS", "IMPORTS"])) for _ in range(25)]
        held = [*held, *new]
        delta = spark.createDataFrame([(*e, 1) for e in new] + [(*e, -1) for e in gone], "src_file string, dst_file string, type string, sign int")
        for name in (True, False):
            partials.apply(spark, str(tmp_path / str(name)), delta, k=2, buckets=3, wide=name)
        a, b = ({str(r) for r in partials.current_backbone(spark, str(tmp_path / str(name)), 2, always=1).collect()} for name in (True, False))
        assert a == b and a


def test_the_driver_gathers_no_models(spark):
    """Chains, imports and lists of 300 models meet where they lie; none of them is broadcast."""
    m = spark.range(300).selectExpr("id as model", "concat('m', id) as coordinates", "case when id > 0 then concat('m', id div 3) end as parent")
    rows = spark.range(300).selectExpr("id as model", "0 as place", "concat('k', id % 7) as key", "concat('v', id) as value", "cast(null as string) as imports").union(spark.range(300).selectExpr("id", "1", "null", "null", "concat('m', id div 2 + 1)"))
    store, bus, got = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus(), []
    bus.waitUntilEmpty()
    last = max((x.executionId() for x in map(store.executionsList().apply, range(store.executionsList().size()))), default=-1)
    got.extend(models.managed_versions(rows, models.parents(m), m).where("model = 299 and key = 'k5'").collect())
    bus.waitUntilEmpty()
    runs, names = store.executionsList(), []
    for e in (x.executionId() for x in map(runs.apply, range(runs.size())) if x.executionId() > last):
        nodes = store.planGraph(e).allNodes()
        names += [x.name() for x in map(nodes.apply, range(nodes.size()))]
    assert names.count("BroadcastExchange") == 0 and [tuple(r) for r in got] == [(299, "k5", "v299", 299, 0)]
