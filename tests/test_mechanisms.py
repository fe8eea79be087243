"""Walks, fixpoints, ranks and saves against plain Python, on hand-written rows."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from korpusgraf.functions.text import question_stems
from korpusgraf.operators import cover, cycles, groups, layers, lookup, models, partials, passes, process, receivers, rollup, slices, vectors
from korpusgraf.operators.lineage import fresh_folder
from korpusgraf.sources import commits


def ids(df):
    return {tuple(r) for r in df.collect()}


# rank by cover density
def plain_rank(text, query):
    """All windows between two known words, from the shortest; a window counts if it holds an alternative and no counted one lies inside."""
    words = re.findall(r"[^\W_]+", text.lower())
    alternatives = cover.parsed(query)
    phrases = {p for a in alternatives for p in (*a.needs, *a.excludes)}
    known = [(i, w) for i, w in enumerate(words) if any(w in p for p in phrases)]
    holds = lambda lo, hi, p: any(tuple(words[i : i + len(p)]) == p for i in range(lo, hi + 2 - len(p)))
    last = len(words) - 1
    if not any(all(holds(0, last, p) for p in a.needs) and not any(holds(0, last, p) for p in a.excludes) for a in alternatives):
        return None
    found = []
    for n, a in sorted((b - a, a) for a in range(len(known)) for b in range(a, len(known))):
        b = a + n
        if any(a.needs and all(holds(known[x][0], known[y][0], p) for p in a.needs) for x, y in [(a, b)] for a in alternatives) and not any(a <= x and y <= b for x, y in found):
            found.append((a, b))
    return len(found), round(sum(0.1 / (1 + (known[b][0] - known[a][0]) - (b - a)) for a, b in found), 9)


@pytest.mark.parametrize("query", ["a b", '"a b" c', "a b or c d -e", '-"a b"', "a-b", '"a b a" or d', "zzz", "", "or"])
def test_cover_rank(spark, query):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdex") for _ in range(rng.randrange(0, 25)))) for i in range(60)] + [(99, None), (100, "A, b! B a_c")]
    got = {r["chunk_id"]: (r["covers"], round(r["rank"], 9)) for r in cover.cover_rank(spark.createDataFrame(texts, "chunk_id int, content string"), query).collect()}
    want = {i: plain_rank(t or "", query) for i, t in texts}
    assert got == {i: w for i, w in want.items() if w is not None}


def test_rank_needs_no_shuffle(spark):
    plan = cover.cover_rank(spark.createDataFrame([(1, "a b")], "chunk_id int, content string"), "a b")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


# receiver types
def test_chain_types(spark):
    types = spark.createDataFrame([("Repo", ["T"]), ("List", ["E"]), ("Iter", ["X"]), ("Order", []), ("Item", []), ("OrderRepo", []), ("Svc", []), ("Base", []), ("L1", []), ("L2", [])], "type string, params array<string>")
    supers = spark.createDataFrame([("OrderRepo", "Repo<Order>"), ("List", "Iter<E>"), ("Svc", "Base"), ("L1", "L2"), ("L2", "L1")], "type string, parent string")
    members = [("Repo", "all", 0, "List<T>"), ("Repo", "one", 1, "T"), ("Iter", "next", 0, "X"), ("Order", "items", 0, "List<Item>"), ("Order", "rows", None, "Item[][]"), ("Base", "repo", None, "OrderRepo"), ("Item", "order", 0, "Order"), ("Item", "two", 0, "Order"), ("Item", "two", 0, "Item"),
               ("Svc", "make", 2, "Order"), ("Svc", "ext", 0, "java.util.Date"), ("L1", "x", 0, "Order"), ("Repo", "raw", 0, "List"), ("List", "sub", 0, "List<? extends E>")]
    calls = {
        "repo.all().next()": "Order", "this.repo.one(f(1, 2))": "Order", "repo.all().next().items().next().order()": "Order", "o.rows[0][i + 1].order()": "Order", "o.rows[0].order()": None, "make(a(b, c(d)), x).items()": "List<Item>", "make(a).items()": None,
        "super.repo": "OrderRepo", "i.two()": None, "i.two().order()": None, "ext()": None, "new List<Item>(f()).next()": "Item", "unknown.x()": None, "Order": "Order", "repo.raw().next()": None, "l.x().items()": "List<Item>", "repo.all().sub().next().items()": "List<Item>", "v": None, "": None, "o.rows": "Item[][]", "repo": "OrderRepo",
    }
    variables = spark.createDataFrame([("u", "o", "Order"), ("u", "i", "Item"), ("u", "v", "Item"), ("u", "v", "Order"), ("u", "l", "L2"), ("other", "repo", "Item")], "unit string, name string, type string")
    asked = spark.createDataFrame([(c, "u", "Svc", c) for c in calls], "call_id string, unit string, owner string, receiver string")
    got = receivers.chain_types(asked, variables, types, supers, spark.createDataFrame(members, "type string, name string, arity int, result string"))
    assert {r["call_id"]: r["type"] for r in got.collect()} == calls


# components
def plain_components(edges):
    reach = defaultdict(set)
    for a, b in edges:
        reach[a].add(b)
    nodes = {x for e in edges for x in e}
    for k, a in itertools.product(nodes, nodes):
        if k in reach[a]:
            reach[a] |= reach[k]
    return {(a, min(b for b in nodes if b == a or b in reach[a] and a in reach[b])) for a in nodes if any(b != a and b in reach[a] and a in reach[b] for b in nodes)}


def test_strong_components(spark):
    ring = [(i, (i + 1) % 20) for i in range(20)] + [(i, i + 1) for i in range(30, 45)] + [(3, 30), (45, 50), (50, 51), (51, 50), (60, 60)]
    assert ids(cycles.strong_components(spark.createDataFrame(ring, "src int, dst int"))) == {(i, 0) for i in range(20)} | {(50, 50), (51, 50)}
    rng = random.Random(4)
    some = [(rng.randrange(24), rng.randrange(24)) for _ in range(34)]
    assert ids(cycles.strong_components(spark.createDataFrame(some, "src int, dst int"))) == plain_components(some)
    assert cycles.strong_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_long_cycles_are_seen(spark):
    jumps = [("u", i, i, (i + 1) % 20) for i in range(20)] + [("u", 5, 5, 99), ("w", 1, 1, 2), ("w", 7, 1, 7)]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in cycles.branches_and_cycles(spark.createDataFrame(jumps, "unit string, src int, line int, dst int")).collect()}
    assert got["u", 5, 5, 99] == (True, False) and got["u", 5, 5, 6] == (True, True) and got["u", 19, 19, 0] == (False, True) and got["w", 1, 1, 2] == (False, False) and got["w", 7, 1, 7] == (False, True)


# process walk
def plain_walk(edges, kinds_of, root, direction, hops, node_limit, edge_limit, kinds):
    """One edge after the other, as a reader would follow them."""
    base = {e[0]: "external_call" if e[4] != "resolved" and e[3] in process.CALLING else process.EDGE_KIND.get(e[3]) for e in edges}
    kind = {e[0]: "iteration" if base[e[0]] == "call" and e[5] else base[e[0]] for e in edges}
    types = {t for t, k in process.EDGE_KIND.items() if k in kinds | ({"call"} if "iteration" in kinds else set())} | (set(process.CALLING) if "external_call" in kinds else set())
    nodes, frontier, steps, seen, reasons, lost_nodes, lost_steps = [root], {root}, [], set(), set(), 0, 0
    for hop in range(1, hops + 1):
        if not frontier:
            break
        if len(steps) >= edge_limit:
            reasons.add("edge_limit")
            break
        rows = sorted(e for e in edges if e[3] in types and (direction != "incoming" and e[1] in frontier or direction != "outgoing" and e[2] in frontier))
        room = edge_limit - len(steps)
        if len(rows) > room:
            reasons.add("edge_limit")
            lost_steps += len(rows) - room
        todo = []
        for e in rows[:room]:
            block = e[3] == "CONTAINS" and e[1] in frontier and direction != "incoming" and kinds_of.get(e[2], ("", ""))[0] in process.BLOCK_TYPES
            calls = sorted(c for c in edges if c[1] == e[2] and c[3] == "CALL") if block else []
            todo += [(c, e[1], False) for c in calls] or [(e, e[1], block)]
        following = set()
        for e, src, bare in todo:
            if e[0] in seen or not ({base[e[0]], kind[e[0]]} & kinds) or src not in kinds_of or kinds_of[src][0] in process.BLOCK_TYPES and e[3] == "EXECUTES" or e[2] is not None and e[2] not in kinds_of:
                continue
            full = False
            for n in [src, *([e[2]] if e[2] is not None else [])]:
                if n not in nodes and not full:
                    full = len(nodes) >= node_limit
                    nodes += [] if full else [n]
            full = full or e[2] is None and len(nodes) + sum(s[3] is None for s in steps) >= node_limit
            if full:
                reasons.add("node_limit")
                lost_nodes += 1
                lost_steps += 1
                continue
            if e[2] is not None:
                following |= ({e[2]} if direction != "incoming" else set()) | ({src} if direction != "outgoing" else set())
            steps.append((hop, e[0], src, e[2], ("exit" if kinds_of[e[2]][1] in process.EXIT_OPERATIONS else "step") if bare else kind[e[0]]))
            seen.add(e[0])
        frontier = following - frontier
    return steps, (len(nodes), len(steps), lost_nodes, lost_steps, ",".join(sorted(reasons)))


@pytest.mark.parametrize("direction,limits", [("both", (100, 200)), ("outgoing", (9, 200)), ("incoming", (100, 7)), ("both", (6, 14))])
def test_process_walk(spark, direction, limits):
    rng = random.Random(sum(limits))
    kinds_of = {i: ("exec_block", rng.choice(["RETURN", "LINK"])) if i % 5 == 0 else ("paragraph", None) for i in range(1, 26)}
    types = ["CALL", "PERFORM", "READS", "GOTO", "CONTAINS", "CONTAINS", "IMPORTS", "EXECUTES"]
    edges = []
    for n in range(90):
        t = rng.choice(types)
        dst = rng.choice([5, 10, 15, 20, 25]) if t == "CONTAINS" else rng.choice([None, *range(1, 26)])
        edges.append((f"e{n:03d}", rng.randrange(1, 27), dst, t, "resolved" if dst else "unresolved", rng.random() < 0.3, False))
    df = spark.createDataFrame(edges, "edge_id string, src_id int, dst_id int, type string, resolution string, loop boolean, guarded boolean")
    entities = spark.createDataFrame([(i, *k) for i, k in kinds_of.items()], "id int, type string, operation string")
    roots = [1, 2, 3]
    for kinds in (None, ["call", "iteration"]):
        steps, sums = process.walk(df, entities, spark.createDataFrame([(r,) for r in roots], "id int"), direction, 3, *limits, kinds)
        got = defaultdict(list)
        for r in sorted(steps.collect(), key=lambda r: (r["root"], r["pos"])):
            got[r["root"]].append((r["hop"], r["edge_id"], r["src_id"], r["dst_id"], r["kind"]))
        totals = {r["root"]: tuple(r)[1:] for r in sums.collect()}
        for root in roots:
            want, total = plain_walk(edges, kinds_of, root, direction, 3, *limits, set(kinds or process.KINDS))
            assert got[root] == want and totals[root] == total


# slices
def test_backward_slice(spark):
    writes = [("w1", "u", "MOVE", 10, "A"), ("w2", "u", "COMPUTE", 20, "B"), ("w3", "u", "STRING", 40, "C"), ("w4", "t", "MOVE", 5, "A"), *[(f"x{i}", "u", "MOVE", 100 + i, "M") for i in range(6)]]
    reads = [("u", "MOVE", 10, "B", False), ("u", "MOVE", 11, "Z", True), ("u", "COMPUTE", 22, "C", True), ("u", "COMPUTE", 23, "Z", True), ("u", "COMPUTE", 21, "Z", False), ("u", "STRING", 16, "D", True), ("u", "STRING", 14, "Z", True), ("u", "STRING", 41, "Z", True), ("u", "STRING", 40, "C", True)]
    flows = [("r1", "t", 7, "assign", "D", ["P", "A"])]
    parameters, calls = [("P", "f", 1)], [(1, "f", "test_main", 3, True, ["x", "y"], [None, "T"]), (2, "f", "main", 4, False, ["x", "z"], [None, "Q"]), (3, "f", "short", 4, False, ["x"], [None])]
    S = lambda rows, schema: spark.createDataFrame(rows, schema)
    steps = slices.statement_steps(S(writes, "write_id string, unit string, operation string, line int, field string"), S(reads, "unit string, operation string, line int, field string, source boolean"))
    steps = steps.unionByName(slices.table_steps(S(flows, "row_id string, unit string, line int, operation string, field string, sources array<string>")))
    steps = steps.unionByName(slices.argument_steps(S(parameters, "field string, routine string, position int"), S(calls, "call_id int, routine string, caller string, line int, test boolean, arguments array<string>, refs array<string>")))
    got = ids(slices.backward_slice(S([("A",), ("M",)], "field string"), steps, S([("t",)], "unit string")))
    assert {r for r in got if r[0] == "A"} == {
        ("A", 1, 1, "A", "u", 10, "MOVE", "B"), ("A", 2, 2, "B", "u", 20, "COMPUTE", "C"), ("A", 3, 3, "C", "u", 40, "STRING", "D"), ("A", 4, 4, "D", "t", 7, "assign", "P,A"), ("A", 5, 5, "P", "main", 4, "argument", "z"), ("A", 6, 5, "P", "test_main", 3, "argument", "y"),
    }
    assert sorted(r[1] for r in got if r[0] == "M") == [1, 2, 3, 4]
    assert max(r[1] for r in ids(slices.backward_slice(S([("A",)], "field string"), steps, most=3))) == 3


# project models
def test_profiles_and_parents(spark):
    profiles = [("m", "a", False, "env", "dev"), ("m", "b", True, "x", None), ("n", "c", True, "x", None), ("n", "d", False, "env", "test"), ("o", "e", False, "env", None)]
    active = models.active_profiles(spark.createDataFrame(profiles, "model string, profile string, by_default boolean, property string, value string"), spark.createDataFrame([("env", "dev")], "property string, value string"))
    assert ids(active) == {("m", "a"), ("n", "c"), ("o", "e")}
    held = [("m", "m:1", "p:1"), ("p", "p:1", "q:1"), ("q", "q:1", "p:1"), ("r", "r:1", "dup:1"), ("s", "dup:1", None), ("t", "dup:1", None)]
    chains = models.parents(spark.createDataFrame(held, "model string, coordinates string, parent string"))
    assert {r for r in ids(chains) if r[0] in "mqr"} == {("m", "m", 0), ("m", "p", 1), ("m", "q", 2), ("q", "q", 0), ("q", "p", 1), ("r", "r", 0)}
    entries = [("p", None, "k", "1"), ("q", None, "k", "2"), ("m", "a", "l", "3"), ("m", None, "l", "4"), ("m", "b", "l", "5"), ("q", None, "z", "6")]
    got = models.effective(spark.createDataFrame(entries, "model string, profile string, key string, value string"), chains, active)
    assert {r for r in ids(got) if r[0] == "m"} == {("m", "k", "1", "p", 1), ("m", "l", "3", "m", 0), ("m", "z", "6", "q", 2)}


def test_imports_in_order(spark):
    """An import inside an earlier import comes before a later one, whichever is found first; a cycle of imports ends."""
    m = spark.createDataFrame([(x, x, None) for x in "abcd"], "model string, coordinates string, parent string")
    rows = [("a", 0, None, None, "b"), ("a", 1, None, None, "c"), ("b", 0, None, None, "d"), ("c", 0, "k", "of c", None), ("d", 0, "k", "of d", None), ("d", 1, None, None, "a"), ("a", 2, "own", "1", None), ("b", 5, "own", "2", None), ("c", 1, None, None, "missing")]
    got = ids(models.managed_versions(spark.createDataFrame(rows, "model string, place int, key string, value string, imports string"), models.parents(m), m))
    assert {r for r in got if r[0] == "a"} == {("a", "k", "of d", "d", 2), ("a", "own", "1", "a", 0)} and ("d", "own", "1", "a", 1) in got


def test_values_are_put_in(spark):
    df = spark.createDataFrame([("${a}-${b}x$", {"a": "1${b}", "b": "2"}), ("${c}", {"a": "1"}), ("${a}", {"a": "${a}"})], "v string, p map<string,string>")
    assert [r[0] for r in df.select(models.with_properties(F.col("v"), F.col("p"))).collect()] == ["12-2x$", "${c}", "${a}"]


# groups as a tree
def test_file_tree(spark):
    cliques = [(f"s:c{c}/f{i}", f"s:c{c}/f{j}", 1, 1) for c in range(6) for i in range(12) for j in range(i)]
    bridges = [(f"s:c{c}/f0", f"s:c{c + 1}/f0", 1, 0) for c in range(5)]
    big = [(f"s:big/a{i}", f"s:big/a{j}", 1, 1) for i in range(40) for j in range(i)]
    pairs = spark.createDataFrame(cliques + bridges + big, "src_file string, dst_file string, edge_count long, priority int")
    topics = spark.createDataFrame([(1, f"s:c0/f{i}") for i in range(4)] + [(2, f"s:c0/f{i}") for i in range(3)] + [(3, "s:c0/f0"), (4, "s:c0/f0")], "topic int, node string")
    held, leaves = groups.file_tree(groups.weighted(pairs), topics, most=20, depth=3)
    held, of = held.collect(), {r["node"]: r["key"] for r in leaves.collect()}
    by = {r["key"]: r for r in held}
    assert len(of) == leaves.count() == 112 and len(by) == len(held)
    assert of["s:c0/f0"] == "t3" and of["s:c0/f1"] == of["s:c0/f2"] == "t2" and of["s:c0/f3"] == "t1" and by["t4"]["files"] == 0
    assert len({of[f"s:c3/f{i}"] for i in range(12)}) == 1 and of["s:c3/f1"] != of["s:c4/f1"]
    count = defaultdict(int)
    for k in of.values():
        count[k] += 1
    for r in held:
        parts = [x for x in held if x["parent_key"] == r["key"]]
        assert sum(x["files"] for x in parts) == r["files"] if parts else count[r["key"]] == r["files"]
        assert r["files"] <= 20 or parts or r["level"] == 3 or r["key"] == of["s:big/a0"]  # a clique gives one part and stays whole
    top = sorted((r for r in held if r["level"] == 0 and r["kind"] == "community"), key=lambda r: int(r["key"][1:]))
    assert [r["files"] for r in top] == sorted((r["files"] for r in top), reverse=True) and by["c0"]["files"] == 40
    text = {r["key"]: r for r in groups.described(pairs, leaves).collect()}
    assert text["c0"]["path_prefix"] == "big" and text["c0"]["label"] == "big · a9" and text["c0"]["central_file"] == "big/a9"  # all weigh the same; a0 refers to none


def test_groups_are_as_good_as_one_after_the_other(spark):
    """Planted groups are found whole, which no sequence of single moves betters."""
    rng = random.Random(8)
    edges = [(f"{c}-{i}", f"{c}-{j}", 1, 0) for c in range(5) for i in range(16) for j in range(i) if rng.random() < 0.6] + [(f"{rng.randrange(5)}-{rng.randrange(16)}", f"{rng.randrange(5)}-{rng.randrange(16)}", 1, 0) for _ in range(20)]
    w = groups.weighted(spark.createDataFrame(edges, "src_file string, dst_file string, edge_count long, priority int"))
    planted = spark.createDataFrame([(f"{c}-{i}", str(c)) for c in range(5) for i in range(16)], "node string, community string")
    assert groups.modularity(w, groups.communities(w)) >= groups.modularity(w, planted) - 1e-9


# saves
FILES, ROWS = "source string, path string, hash string, deleted boolean", "source string, path string, x int"


def saved(spark, base, files, rows, edges=None):
    tables = {"chunks": spark.createDataFrame(rows, ROWS), "edges": spark.createDataFrame(rows, ROWS) if edges is None else edges}
    return commits.save(spark, base, spark.createDataFrame(files, FILES), tables)


def test_a_save_replaces_files_and_leaves_others(spark):
    base = fresh_folder(spark)
    assert commits.read(spark, base, "chunks") is None and commits.manifest(spark, base)["version"] == 0
    saved(spark, base, [("s", "a", "1", False), ("s", "b", "1", False)], [("s", "a", 1), ("s", "a", 2), ("s", "b", 3)])
    saved(spark, base, [("s", "a", "2", False), ("s", "b", None, True), ("s", "c", "1", False)], [("s", "a", 9)])
    want = {("s", "a", 9)}
    assert ids(commits.read(spark, base, "chunks")) == ids(commits.read(spark, base, "edges")) == want
    found = spark.createDataFrame([("s", "a", "2"), ("s", "d", "5"), ("t", "a", "1")], "source string, path string, hash string")
    assert ids(commits.changed(spark, base, found)) == {("s", "c", "1", True), ("s", "d", "5", False), ("t", "a", "1", False)}
    assert commits.compact(spark, base) == 3 and len(commits.manifest(spark, base)["commits"]) == 1
    assert ids(commits.read(spark, base, "chunks")) == want and ids(commits.journal(spark, base).select("path", "hash")) == {("a", "2"), ("c", "1")}


def test_a_failed_save_leaves_the_old_state(spark):
    """The second table fails when it is written, after the first was."""
    base = fresh_folder(spark)
    saved(spark, base, [("s", "a", "1", False)], [("s", "a", 1)])
    broken = spark.createDataFrame([("s", "a", 2)], ROWS).withColumn("x", F.when(F.col("x") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        saved(spark, base, [("s", "a", "2", False)], [("s", "a", 2)], broken)
    assert ids(commits.read(spark, base, "chunks")) == {("s", "a", 1)} and commits.manifest(spark, base)["version"] == 1
    saved(spark, base, [("s", "a", "3", False)], [("s", "a", 3)])
    assert ids(commits.read(spark, base, "edges")) == {("s", "a", 3)}


def test_two_writers_do_not_mix(spark):
    base = fresh_folder(spark)
    seen = commits.manifest(spark, base)
    saved(spark, base, [("s", "a", "1", False)], [("s", "a", 1)])
    with pytest.raises(RuntimeError):
        commits.save(spark, base, spark.createDataFrame([("s", "b", "1", False)], FILES), {"chunks": spark.createDataFrame([("s", "b", 2)], ROWS)}, seen)
    assert ids(commits.read(spark, base, "chunks")) == {("s", "a", 1)}


def test_roll_up_after_ten_deltas(spark):
    rng = random.Random(11)
    base, held = fresh_folder(spark), []
    for turn in range(10):
        gone = rng.sample(held, min(len(held), 6)) if turn else []
        new = [(f"f{rng.randrange(14)}", f"f{rng.randrange(14)}", rng.choice(["CALL", "READS", "IMPORTS", "X"])) for _ in range(12)]
        for g in gone:
            held.remove(g)
        held += new
        partials.apply(spark, base, spark.createDataFrame([(*e, 1) for e in new] + [(*e, -1) for e in gone], "src_file string, dst_file string, type string, sign int"), k=2, buckets=5)
        if turn in (4, 9):
            counts = spark.createDataFrame([e for e in held if e[0] != e[1]], "src_file string, dst_file string, type string").groupBy("src_file", "dst_file", "type").agg(F.count("*").alias("n"))
            flat = lambda df: ids(df.withColumn("edge_types", F.array_join("edge_types", ",")).select(*sorted(df.columns)))
            full = partials.pairs_of(counts)
            assert flat(partials.current_pairs(spark, base)) == flat(full)
            assert flat(partials.current_backbone(spark, base, 2, always=3)) == flat(rollup.backbone(full, 2, always=3))


# resolution within source and variant
def test_procedures_by_label_then_member(spark):
    procs = [(1, "v", "lib/FOO.prc", "X", 1), (1, "v", "lib/A.prc", "Y", 2), (1, "v", "jobs/j.jcl", "Y", 3), (1, "v", "lib/Y.prc", "Q", 4), (1, "v", "lib/B.prc", "Z", 5), (1, "v", "lib/Z.prc", "Z", 6), (2, "v", "lib/X.prc", "X", 7), (1, "w", "lib/X.prc", "X", 8), (1, "v", "lib/C.prc", "T", 9), (1, "v", "lib/D.prc", "T", 10)]
    files = [(1, "v", "lib/X.prc", 20), (1, "v", "lib/M.PROC", 21), (1, "v", "lib/N.txt", 22), (1, "v", "lib/K.prc", 23), (1, "v", "old/K.prc", 24)]
    steps = {"x": (20 - 19, "label"), "y": (3, "own_file"), "z": (6, "member"), "m": (21, "member_file"), "n": (None, None), "k": (None, "member_file"), "t": (None, None)}
    programs = [(1, "v", "P", 30), (2, "v", "P", 31), (1, "v", "R", 32), (1, "v", "R", 33)]
    asked = [(n, 1, "v", "jobs/j.jcl", "PROC", n) for n in steps] + [("pgm", 1, "v", "jobs/j.jcl", "PGM", "p"), ("two", 1, "v", "jobs/j.jcl", "PGM", "r"), ("lib", 1, "v", "lib/A.prc", "PROC", "y")]
    S = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = passes.job_targets(S(asked, "ref_id string, source_id int, variant string, path string, kind string, name string"), S(programs, "source_id int, variant string, name string, target_id int"), S(procs, "source_id int, variant string, path string, name string, target_id int"), S(files, "source_id int, variant string, path string, target_id int"))
    assert {r["ref_id"]: (r["target_id"], r["by"]) for r in got.collect()} == steps | {"pgm": (30, "program"), "two": (None, "program"), "lib": (None, None)}


def test_shell_targets_stay_in_their_source(spark):
    held = [(1, "v", "lib/zz/a.sh", "q.A", "script", 1), (1, "v", "lib/zz/a.sh", None, "function", 2), (2, "v", "other/c.sh", "q.C", "script", 3), (1, "w", "lib/zz/b.sh", "q.B", "class", 4), (1, "v", "x/d.sh", "q.D", "class", 5), (1, "v", "y/d.sh", "q.D", "class", 6)]
    asked = [("a", 1, "v", "lib/zz/r.sh", "./a.sh", "runs", "script"), ("any", 1, "v", "lib/zz/r.sh", "a.sh", "runs", None), ("c", 1, "v", "lib/zz/r.sh", "c.sh", "runs", "script"), ("C", 1, "v", "r.sh", "q.C", "starts_java", None), ("A", 1, "v", "r.sh", "q.A", "starts_java", None), ("D", 1, "v", "r.sh", "q.D", "starts_java", "class"), ("up", 1, "v", "r.sh", "../a.sh", "runs", None)]
    got = passes.shell_targets(spark.createDataFrame(asked, "ref_id string, source_id int, variant string, path string, name string, kind string, type string"), spark.createDataFrame(held, "source_id int, variant string, path string, qualified_name string, type string, target_id int"))
    assert ids(got) == {("a", 1), ("any", None), ("c", None), ("C", None), ("A", 1), ("D", None), ("up", None)}


# nearest join
@pytest.mark.parametrize("same_source", [True, False])
def test_nearest_by_cells(spark, same_source):
    """Clusters, copies that tie, and blocks so small that a cell has several: as by comparing all with all."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([centres[i % 6] + 0.05 * rng.normal(size=8) for i in range(150)]).reshape(150, 8)
    x[100:110] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "id long, source int, v array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vectors.nearest(df.where("id % 3 = 0"), df, 5, block=16, same_source=same_source).collect()}
    for q in range(0, 150, 3):
        scores = np.round(x @ x[q], 4)
        order = sorted((-s, i) for i, s in enumerate(scores) if i != q and (same_source or i % 4 != q % 4))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in order]
    assert vectors.nearest(df, df.limit(0), 5).count() == 0 and vectors.nearest(df.limit(0), df, 5).count() == 0


def test_question_stems(spark):
    df = spark.createDataFrame([("Wie läuft die Größe2 der ABC1 Buchung über Buchungen?",)], "q string")
    stems = lambda *a: df.select(question_stems(F.col("q"), *a)).first()[0]
    assert stems() == ["läuft", "größe", "abc1", "buchu", "über"]
    assert stems(["läuft"], {"buchung": "posting entry"}) == ["größe", "abc1", "buchu", "über", "posti", "entry"]


def test_emptied_files_lose_their_entities(spark):
    S = spark.createDataFrame
    old, parsed = S([("a", "k", "1"), ("b", "k", "2"), ("c", "k", "3")], "path string, key string, id string"), S([("a", "k", 5)], "path string, key string, line int")
    assert {tuple(r)[:2] + (r["action"],) for r in passes.upserted(old, parsed, S([("a",), ("b",)], "path string")).collect()} == {("a", "k", "update"), ("b", "k", "delete")}


# layers
def plain_layers(edges, entities, root, direction, depth, kinds, collapse_above, expand, frontier_limit, tests):
    """One root's layers, edge by edge."""
    types = {t for k in kinds for t in layers.KINDS[k]}
    near, far = (1, 2) if direction == "down" else (2, 1)
    is_test = lambda i: not tests and bool(re.search(r"(^|/)(src/test|tests?)/|(Test|Tests|IT|ITCase)\.java$", entities[i][1] or ""))
    known = sorted(e for e in edges if e[4] in types)
    imported = {(entities[e[1]][1], e[3].rsplit(".", 1)[-1]) for e in edges if e[4] in ("IMPORTS", "IMPORTS_MODULE") and e[5] == "unresolved" and e[1] in entities and e[3]}
    own, last = [root], [root] if entities.get(root, (0, 0, 0))[2] == "class" else []
    for _ in range(3):
        last = [i for i, e in entities.items() if e[0] in last]
        own += [i for i in last if i not in own]
    own, seen, frontier = set(own), set(own), set(own)
    anchor = lambda i: root if i in own else i
    nodes, shown, back, rows = [], [], {}, []

    def note(e, layer):
        if e[1] in own and e[2] in own and not e[1] == e[2] == root:
            return
        key = (anchor(e[1]), anchor(e[2]), e[4])
        if key not in back and len(back) < 4 * collapse_above:
            back[key] = (layer, len(back) + 1, e[0], *key)

    for layer in range(1, depth + 1):
        met = [e for e in known if e[near] in frontier]
        open_ = [e for e in met if e[2] is None]
        external = sum((entities.get(e[1], (0, None))[1], (e[3] or "").split(".", 1)[0]) in imported for e in open_)
        found, first, hidden = {}, [], set()
        for e in met:
            if e[far] in seen:
                note(e, layer)
            elif e[far] in entities and is_test(e[far]):
                hidden.add(e[far])
            elif e[far] in entities:
                found.setdefault(e[far], len(found) + 1)
                first.append((layer, len(first) + 1, e[0], anchor(e[1]), anchor(e[2]), e[4]))
        collapsed = len(found) > collapse_above and layer not in expand
        truncated = not collapsed and len(found) > frontier_limit
        rows.append((layer, len(found), len(hidden), len(open_), external, collapsed, truncated, "collapsed" if collapsed else None if found else "end"))
        if collapsed or not found:
            break
        nodes += [(layer, nr, i) for i, nr in found.items()]
        shown += first[: 4 * collapse_above]
        seen |= found.keys()
        frontier = set(list(found)[:frontier_limit])
    else:
        for e in known:
            if e[near] in frontier and e[far] in seen:
                note(e, depth + 1)
    return set(nodes), set(shown), set(back.values()), set(rows)


@pytest.mark.parametrize("direction,kinds,expanded,tests", [("down", ("control",), (), False), ("up", ("control", "data"), (2,), False), ("down", ("includes", "control"), (1, 2, 3), True)])
def test_layers(spark, direction, kinds, expanded, tests):
    rng = random.Random(11)
    entities = {i: (rng.choice([None, rng.randrange(30)]), rng.choice(["a/x", "b/y", "src/test/z", "q/FooTest.java", None]), rng.choice(["class", "method"])) for i in range(45)}
    entities[0], entities[1], entities[2] = (None, "a/x", "class"), (0, "a/x", "method"), (1, "a/x", "method")
    edges = [(f"e{n:03}", rng.randrange(50), rng.choice([None, *range(50)]), rng.choice(["A.b", "A", "q.A", "B", None]), rng.choice(["CALL", "CALLS", "READS", "IMPORTS", "OTHER"]), rng.choice(["resolved", "unresolved"])) for n in range(150)]
    edges += [("z1", 0, 0, "x", "CALL", "resolved"), ("z2", 0, 2, "x", "CALL", "resolved"), ("z3", 1, 40, "x", "CALL", "resolved"), ("z4", 40, 2, "x", "CALL", "resolved"), ("z5", None, 1, "x", "CALL", "resolved")]
    roots = [0, 7, 12, 44, 999]
    frame = spark.createDataFrame(edges, "edge_id string, src_id long, dst_id long, dst_name string, type string, resolution string")
    known = spark.createDataFrame([(i, *e) for i, e in entities.items()], "id long, parent_id long, file_path string, type string")
    expand = spark.createDataFrame([(r, h) for r in roots for h in expanded] * 2, "root long, layer int")
    got = layers.layers(frame, known, spark.createDataFrame([(r,) for r in roots] * 2, "id long"), direction, 4, kinds, 5, expand, 4, tests)
    every = {r: plain_layers(edges, entities, r, direction, 4, kinds, 5, expanded, 4, tests) for r in roots}
    for part in range(4):
        assert ids(got[part]) == {(r, *w) for r, plain in every.items() for w in plain[part]}


def test_layers_of_nothing(spark):
    edges = spark.createDataFrame([], "edge_id string, src_id long, dst_id long, dst_name string, type string, resolution string")
    entities = spark.createDataFrame([], "id long, parent_id long, file_path string, type string")
    got = layers.layers(edges, entities, spark.createDataFrame([(1,), (None,)], "id long"))
    assert [len(ids(p)) for p in got[:3]] == [0, 0, 0] and (1, 1, 0, 0, 0, 0, False, False, "end") in ids(got.summary)
    with pytest.raises(ValueError):
        layers.layers(edges, entities, entities.select("id"), kinds=("other",))


def test_layer_alternatives(spark):
    edges = spark.createDataFrame([("a", 1, 5, "READS"), ("b", 2, 5, "READS"), ("c", 2, 6, "CALL"), ("d", 6, 1, "CALL"), ("e", 7, 2, "CALL"), ("f", 1, 2, "READS"), ("g", 1, None, "READS"), ("h", 8, 1, "COPY"), ("i", 9, 1, "COPY")], "edge_id string, src_id long, dst_id long, type string")
    entities = spark.createDataFrame([(i, "tests/a" if i == 8 else "a") for i in (1, 2, 5, 6, 7, 8)], "id long, file_path string")
    own = spark.createDataFrame([(1, 1), (1, 2)], "root long, id long")
    assert ids(layers.alternatives(edges, entities, own, "down")) == {(1, "down", "data", 1), (1, "up", "control", 2)}
    assert (1, "up", "includes", 1) in ids(layers.alternatives(edges, entities, own, "down", tests=True))


# lookup of symbols
def plain_lookup(entities, term, limit):
    """The rule, one search after the other. entities: id, name, qualified_name, file_path, type, start_line."""
    def search(phrase, size):
        parts = [p for p in re.split(r"[\s.#]+|::", phrase.lower()) if p]
        parts = parts[:6] if " " in phrase else parts[-6:]
        rows = []
        for e in entities:
            n, q, f = (e[1] or "").lower(), (e[2] or "").lower().rsplit("/", 1)[-1], (e[3] or "").lower().rsplit("/", 1)[-1] if e[4] in lookup.FILE_TYPES else ""
            if parts and all(p in n or p in q or p in f for p in parts):
                tier = 0 if n == phrase.lower() else 1 if n.startswith(phrase.lower()) else 2 if all(p in n for p in parts) else 3 if all(p in q for p in parts) else 4
                rows.append((tier, lookup.SEARCH_RANK.get(e[4], 2), len(e[1] or ""), e[1] or "", e[0], e))
        return [r[-1] for r in sorted(rows)[:size]]

    key = lambda v: re.sub(r"\s+", "", (v or "").replace("\\", "/").lower().split("(")[0].replace("#", ".")).strip(".")
    types = lambda listed: [re.sub(r"\s", "", re.sub(r"^(.*[>\w])\s+\w+$", r"\1", p.replace("final ", "").strip())).lower() for p in re.findall(r"(?:<[^>]*>|[^,<])+", listed)]

    def same(e, spelling):
        if spelling.endswith(")"):
            own = re.search(r"#[^#@()]*\((.*)\)$", e[2] or "")
            if not own or types(own[1]) != types(spelling[spelling.index("(") + 1 : -1]):
                return False
        k = key(spelling)
        return k in (key(e[1]), key(e[2]), key(e[3])) or bool(k) and (key(e[2]).endswith("." + k) or key(e[3]).endswith("/" + k))

    ways, found, mode = lookup.spellings(term), {}, "exact"
    for way in ways:
        found |= {e[0]: e for e in search(way, limit + 1)}
        if any(same(e, way) for e in found.values()):
            break
    if len(term.split()) > 1 and not any(same(e, w) for e in found.values() for w in ways):
        mode = "tokens"
    tokens = [w for w in re.split(r"[\s,;|]+", term) if len(w) > 2 and w.lower() not in lookup.STOP_WORDS]
    if not found and len(tokens) > 1:
        anchor = lookup.anchor_of(tokens)
        rest = [t.lower() for t in tokens if t != anchor]
        pool = {e[0]: e for w in lookup.spellings(anchor) for e in search(w, 80)}
        score = {i: sum(t in " ".join([e[1] or "", (e[2] or "").replace("#", "."), e[3] or ""]).lower() for t in rest) for i, e in pool.items()}
        kept = [i for i in pool if score[i] == len(rest)] or [i for i in pool if score[i]]
        found = {i: pool[i] for i in sorted(kept, key=lambda i: -score[i])[: limit + 1]}
        mode = "tokens"
    if found:
        best = sorted(found.values(), key=lambda e: (not same(e, term), lookup.RESULT_RANK.get(e[4], 4), e[3] or "", e[5] or 0, e[0]))
        return [(term, mode, i, e[0]) for i, e in enumerate(best, 1)]
    for head in [h for h in re.split(r"[.#\s(|]+", term) if len(h) > 2][:2]:
        if hits := search(head, 5):
            return [(term, "none", i, e[0]) for i, e in enumerate(hits, 1)]
    return [(term, "none", None, None)]


def test_spellings():
    assert lookup.spellings("a.B.c(X)") == ["a.B.c(X)", "a.B#c", "B#c", "B.c"]
    assert lookup.spellings("A.b") == ["A.b", "A#b"] and lookup.spellings("A#b") == ["A#b"] and lookup.spellings("PAY-ROLL") == ["PAY-ROLL"]
    assert lookup.anchor_of(["longestword", "a.b", "PAY-ROLL"]) == "PAY-ROLL"


def test_symbol_lookup(spark):
    rng = random.Random(3)
    parts = ["Pay", "Roll", "Calc", "Order", "Item", "Svc"]
    entities = [
        (1, "save", "app.OrderSvc#save(List<A, B>,final int n)", "src/app/OrderSvc.java", "method", 5), (2, "save", "app.OrderSvc#save(int)", "src/app/OrderSvc.java", "method", 9), (3, "OrderSvc", "app.OrderSvc", "src/app/OrderSvc.java", "class", 1),
        (4, "PAY-ROLL", "PAY-ROLL", "cobol\\PAY-ROLL.cbl", "program", 1), (5, None, None, None, None, None), (6, "", "", "", "field", 0), (7, "PAY-ROLL", "X.PAY-ROLL", "b.cbl", "paragraph", None), (8, "run.sh", "bin/run.sh", "bin/run.sh", "shell_script", 1),
    ]
    for i in range(10, 90):
        name, owner = "".join(rng.choices(parts, k=2)), rng.choice(parts)
        entities.append((i, name, rng.choice([f"app.{owner}#{name}(int)", f"lib/{owner}.{name}", name]), rng.choice(["src/a.java", "src/b.java", "calc/Pay.java"]), rng.choice(["method", "class", "field", "compilation_unit"]), rng.choice([1, 2, None])))
    terms = ["OrderSvc.save", "app.OrderSvc.save(List<A, B> x, int y)", "OrderSvc#save(int)", "PAY-ROLL", "where is PAY-ROLL in cobol", "how does PayRoll calc the Zzzz", "Pay Roll", "Order", "run.sh", "PayRoll.nothing", "zzzz", "zz", "calc/Pay.java", "A.b.C", "Item nope nope", "  ", "Order"]
    frame = spark.createDataFrame(entities, "id long, name string, qualified_name string, file_path string, type string, start_line int").withColumn("nr", F.lit(1)).withColumn("size", F.lit("x"))
    got = ids(lookup.find_symbols(frame, terms, 6))
    assert got == {row for t in terms if t.strip() for row in plain_lookup(entities, t, 6)}
    assert ids(lookup.find_symbols(frame.where("false"), ["a.b"])) == {("a.b", "none", None, None)} and not ids(lookup.find_symbols(frame, [" "]))
    with pytest.raises(ValueError):
        lookup.find_symbols(frame, [f"t{i}" for i in range(17)])
