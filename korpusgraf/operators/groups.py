"""Files grouped by modularity, as rounds of local moves over the whole edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import Buckets, stored


def weighted(pairs: DataFrame) -> DataFrame:
    """a, b, w: both directions of each pair, weighted by count and priority."""
    one = pairs.select(F.col("src_file").alias("a"), F.col("dst_file").alias("b"), (F.col("edge_count") * (1 + F.col("priority"))).cast("double").alias("w")).where("a <> b")
    both = one.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


TURNS = 16


def numbered(names: DataFrame) -> DataFrame:
    """no, name: each of the names (one column) once, by a number that is in the order of names. Its lowest `TURNS` bits say (by 0) in which turns the name is due to move, so that
    edges between numbers need not carry it."""
    one = names.toDF("name").where("name is not null").distinct()
    bits = F.lit(0).cast("long")
    for turn in range(TURNS):
        bits = bits + F.pmod(F.xxhash64("name", F.lit(turn)), F.lit(2)) * (1 << turn)
    return stored(one.orderBy("name").select((F.shiftleft(F.monotonically_increasing_id(), TURNS) + bits).alias("no"), "name"))


def local_moves(links: Buckets, scopes: DataFrame | None = None, rounds: int = 12, least_moves: float = 0.002) -> DataFrame:
    """node, community, stored: from groups of one, each round lets the nodes whose hash is due move to the neighbouring group of greatest modularity gain,
    ties to the least name; nodes move half at a time, so that neighbours don't swap. Only nodes one of whose neighbours moved since they last looked move; rounds end when three in
    turn move at most `least_moves` of all nodes, or at `rounds`. links: a, b, w between numbers (`numbered`), in buckets by b, so that they learn their neighbours' groups where they
    are and move once a round, to a; each node has a link of no weight to itself, by which what it is moves along with what its neighbours are. Nodes of different scopes (no, scope)
    share no edge, and each scope counts by its own weight. No graph or list of nodes is gathered in one place."""
    degree = links.rows().groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    held = degree.withColumn("scope", F.lit(0).cast("long")) if scopes is None else degree.join(scopes.withColumnRenamed("no", "node").hint("merge"), "node")
    held = stored(held)
    totals = held.groupBy("scope").agg(F.sum("k").alias("total"))
    now = stored(held.join(F.broadcast(totals), "scope").select("node", F.col("node").alias("community"), "k", "total", F.lit(-1).alias("looked"), F.lit(-1).alias("moved")))
    n, still, met = now.count(), 0, links.rows()
    most = lambda *cols: [F.max(c).alias(c) for c in cols]
    # few steps, as each costs the driver more than a round of a small level takes
    for turn in range(rounds if n else 0):
        due = f"shiftright(a, {turn % TURNS}) & 1 = 0"
        at = now.selectExpr("node as b", "community", "sum(k) over (partition by community) as tot", "k", "total", "looked", "moved")
        near = met.where(f"(a = b and w = 0) or (a <> b and {due})").join(at.repartition(links.buckets, "b").hint("shuffle_hash"), "b")  # dealt as the links are, which therefore stay
        # what a node itself is, is null where the row is of a neighbour
        rows = near.selectExpr("a", "community", "w", "tot", "moved", "case when a = b then struct(k, total, looked) end as own").repartition(links.buckets, "a")
        one = rows.selectExpr("a", "community", "w", "tot", "case when own is null then moved end as woken", "case when own is not null then moved end as moved", "own.k", "own.total", "own.looked")
        options = one.groupBy("a", "community").agg(F.sum("w").alias("w_in"), *most("tot", "woken", "moved", "k", "total", "looked"))
        of = [f"max({c}) over (partition by a) as {n}" for c, n in (("k", "k"), ("total", "total"), ("case when k is not null then community end", "own"))]
        gain = "round(w_in - k * (tot - case when community = own then k else 0.0D end) / total, 9)"
        best = options.selectExpr("a", "community", "w_in", "tot", "woken", "moved", "looked", *of).groupBy("a").agg(F.expr(f"min(struct(-{gain} as loss, community <> own as moves, community)) as x"), *most("own", "k", "total", "woken", "looked", "moved"))
        seen, gone = f"{due} and coalesce(woken, -1) >= looked", Observation()
        then = best.selectExpr("a as node", f"case when {seen} then x.community else own end as community", "k", "total", f"case when {seen} then {turn} else looked end as looked", f"case when {seen} and x.moves then {turn} else moved end as moved")
        then = stored(then.observe(gone, F.count_if(F.col("moved") == turn).alias("n")))
        still = still + 1 if gone.get["n"] <= n * least_moves else 0
        if still == 3:  # three draws of movers in turn found next to none that gains
            break
        now = then
    return now.select("node", "community")


#: So many links lie in a bucket, about 1 MB; a level of fewer makes no more tasks than it can fill.
LINKS_A_BUCKET = 50_000


def number_communities(edges: DataFrame, scopes: DataFrame | None = None, rounds: int = 12, levels: int = 3) -> DataFrame:
    """node, community, stored: local moves, then the same on the graph of the groups found, until a level joins none. edges: a, b, w between numbers, stored; scopes: no, scope."""
    found, level = None, edges.select("a", "b", "w")
    for _ in range(levels):
        itself = level.select("a", F.col("a").alias("b"), F.lit(0.0).alias("w")).distinct()
        with Buckets(level.union(itself), "b", most=1 + level.count() // LINKS_A_BUCKET) as links:
            step = local_moves(links, scopes, rounds)
            found = step if found is None else stored(found.join(step.select(F.col("node").alias("community"), F.col("community").alias("up")).hint("merge"), "community").select("node", F.col("up").alias("community")))
            if step.where("node <> community").isEmpty():
                break
            g = lambda x, y: step.select(F.col("node").alias(x), F.col("community").alias(y)).hint("shuffle_hash")  # noqa: B023, E731
            one = links.rows().where("w <> 0").join(g("b", "cb").repartition(links.buckets, "b"), "b").groupBy("a", "cb").agg(F.sum("w").alias("w"))
            level = stored(one.join(g("a", "ca"), "a").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    return found


def _to_numbers(edges: DataFrame, names: DataFrame) -> DataFrame:
    of = lambda x: names.select(F.col("name").alias(x), F.col("no").alias(f"{x}_no")).hint("merge")
    return edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_no").alias("a"), F.col("b_no").alias("b"), "w")


def to_names(found: DataFrame, names: DataFrame, *cols: str) -> DataFrame:
    """found with the names of the numbers in its columns `cols`."""
    for c in cols:
        found = found.join(names.select(F.col("no").alias(c), F.col("name").alias(f"_{c}")).hint("merge"), c).withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return found


def communities(edges: DataFrame, rounds: int = 12, levels: int = 3, names: DataFrame | None = None) -> DataFrame:
    """node, community: local moves on several levels. edges: a, b, w; if names (no, name, of `numbered`) are given, a and b are numbers."""
    if names is None:
        edges = stored(edges.select("a", "b", "w"))
        names = numbered(edges.select("a"))
        edges = _to_numbers(edges, names)
    return to_names(number_communities(stored(edges.select("a", "b", "w")), None, rounds, levels), names, "node", "community").select("node", "community")


def _numbered(groups: DataFrame, buckets: int = 64) -> DataFrame:
    """groups (parent, community, files) with nr: from 0 within each parent, the largest first. Sizes and hash buckets are counted, so that no parent's groups are ranked in one task."""
    by = groups.withColumn("bucket", F.pmod(F.xxhash64("community"), F.lit(buckets)))
    counts = by.groupBy("parent", "files", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("parent").orderBy(F.desc("files"), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("parent", "files", "bucket").orderBy("community")) - 1
    return by.withColumn("own", own).join(counts.withColumn("before", before).drop("n").hint("merge"), ["parent", "files", "bucket"]).select("parent", "community", "files", (F.col("before") + F.col("own")).cast("long").alias("nr"))


def file_tree(edges: DataFrame, topics: DataFrame | None = None, most: int = 150, depth: int = 3, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups (key, parent_key, level, kind, files) and leaves (node, key): every file of edges (a, b, w) in its finest group.

    A file of topics (topic, node) belongs to the smallest of its topics, by members and then by number; such groups are `t<topic>` and are not split. The others are grouped by modularity;
    a group of more than `most` files is split by its inner edges alone, `depth` times at most, and stays whole if that gives one part. All groups of a level are split together, each being a
    scope of its own, with the inner edges of the level before. Keys number the parts by size: c0, c0.1, c0.1.0. If names (no, name) are given, a and b are numbers; nodes, parts and
    their edges meet where they lie, so that none of them is gathered by the driver."""
    edges = stored(edges.select("a", "b", "w"))
    if names is None:
        names = numbered(edges.select("a").union(edges.select("b")))
        edges = stored(_to_numbers(edges, names))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    groups, leaves = None, None
    if topics is not None:
        sizes = topics.distinct().groupBy("topic").agg(F.count("*").alias("size"))
        of = stored(topics.distinct().join(sizes, "topic").groupBy("node").agg(F.min(F.struct("size", "topic")).alias("x")).select("node", F.concat(F.lit("t"), F.col("x.topic").cast("string")).alias("key")))
        held = of.groupBy("key").agg(F.count("*").alias("files"))
        named = sizes.select(F.concat(F.lit("t"), F.col("topic").cast("string")).alias("key")).join(held, "key", "left")
        groups = named.select("key", F.lit(None).cast("string").alias("parent_key"), F.lit(0).alias("level"), F.lit("topic").alias("kind"), F.coalesce("files", F.lit(0)).cast("long").alias("files"))
        leaves = of
        nodes = nodes.join(of.join(names.hint("merge"), F.col("node") == F.col("name")).select(F.col("no").alias("node")), "node", "left_anti")
    now, places = stored(nodes.select("node", F.lit("").alias("parent"), F.lit(0).cast("long").alias("scope"))), []
    for level in range(depth + 1):
        if now.isEmpty():
            break
        if level or topics is not None:
            at = lambda c, p: now.select(F.col("node").alias(c), F.col("scope").alias(p)).hint("merge")  # noqa: B023, E731
            edges = stored(edges.join(at("a", "scope"), "a").join(at("b", "other"), "b").where("scope = other").select("a", "b", "w"))
        found = number_communities(edges, now.select(F.col("node").alias("no"), "scope"))
        met = now.join(found.hint("merge"), "node", "left").select("node", "parent", F.coalesce("community", "node").alias("scope"))
        part = stored(met.join(names.select(F.col("no").alias("scope"), F.col("name").alias("community")).hint("merge"), "scope").select("node", "parent", "community", "scope"))
        sized = part.groupBy("parent", "community").agg(F.count("*").alias("files"))
        parts = sized.groupBy("parent").agg(F.count("*").alias("parts"))
        key = F.when(F.col("parent") == "", F.concat(F.lit("c"), F.col("nr").cast("string"))).otherwise(F.concat("parent", F.lit("."), F.col("nr").cast("string")))
        made = stored(_numbered(sized).withColumn("key", key).join(F.broadcast(parts), "parent"))
        # a group whose inner edges give one part stays as it is
        split = made.where("parts > 1") if level else made
        rows = split.select("key", F.when(F.col("parent") != "", F.col("parent")).alias("parent_key"), F.lit(level).alias("level"), F.lit("community").alias("kind"), "files")
        groups = rows if groups is None else groups.unionByName(rows)
        placed = stored(part.join(made.select("parent", "community", "key", "parts", F.col("files").alias("size")).hint("merge"), ["parent", "community"]).select("node", "scope", F.when((F.col("parts") == 1) & F.lit(level > 0), F.col("parent")).otherwise(F.col("key")).alias("key"), ((F.col("size") > most) & ((F.col("parts") > 1) | F.lit(level == 0)) & F.lit(level < depth)).alias("again")))
        places.append(placed.where("not again").select("node", "key"))
        now = placed.where("again").select("node", F.col("key").alias("parent"), "scope")
    if places:
        done = to_names(reduce(DataFrame.unionByName, places), names, "node").select("node", "key")
        leaves = done if leaves is None else leaves.unionByName(done)
    empty = edges.sparkSession.createDataFrame([], "key string, parent_key string, level int, kind string, files long")
    return (empty if groups is None else groups), (names.select(F.col("name").alias("node"), F.lit("").alias("key")).where(F.lit(False)) if leaves is None else leaves)


def described(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """key, label, path_prefix, central_file of groups, members being their files (key, node = source:path). The central file weighs most among those that refer to others, or among
    all if none does, ties to the greatest path; the prefix is the directory that all files share, of which the label shows the last two parts."""
    weight = weighted(pairs).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    users = pairs.select(F.col("src_file").alias("node")).distinct().withColumn("uses", F.lit(True))
    met = members.join(weight, "node", "left").join(users, "node", "left").withColumn("path", F.regexp_replace("node", "^[^:]*:", ""))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    best = F.max_by("path", F.struct(F.coalesce("uses", F.lit(False)), F.coalesce("k", F.lit(0.0)), "path"))
    one = met.withColumn("folder", folder).groupBy("key").agg(best.alias("central_file"), F.min(F.split("folder", "/")).alias("lo"), F.max(F.split("folder", "/")).alias("hi"), F.min("folder").alias("least"))
    # what the least and the greatest list of parts share, all share
    shared = F.aggregate(F.arrays_zip("lo", "hi"), F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("parts")), lambda acc, x: F.struct((acc["on"] & F.coalesce(x["lo"] == x["hi"], F.lit(False))).alias("on"), F.when(acc["on"] & F.coalesce(x["lo"] == x["hi"], F.lit(False)), F.concat(acc["parts"], F.array(x["lo"]))).otherwise(acc["parts"]).alias("parts")))["parts"]
    parts = F.when(F.col("least") == "", F.array().cast("array<string>")).otherwise(shared)
    stem = F.regexp_replace(F.regexp_extract("central_file", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    short = F.array_join(F.when(F.size("parts") > 2, F.slice("parts", -2, 2)).otherwise(F.col("parts")), "/")
    return one.withColumn("parts", parts).select("key", F.when(F.size("parts") > 0, F.concat(short, F.lit(" · "), stem)).otherwise(stem).alias("label"), F.array_join("parts", "/").alias("path_prefix"), "central_file")


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    total = edges.agg(F.sum("w")).first()[0]
    g = lambda x, y: groups.select(F.col("node").alias(x), F.col("community").alias(y))
    inside = edges.join(g("a", "ca"), "a").join(g("b", "cb"), "b").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0))).first()[0]
    sums = edges.join(g("a", "ca"), "a").groupBy("ca").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inside / total - sums / total**2


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """src_group, dst_group, weight between different groups."""
    g = lambda x, y: groups.select(F.col("node").alias(x), F.col("community").alias(y))
    # weights are summed by the first group before the second is looked up
    one = edges.join(g("a", "src_group"), "a").groupBy("src_group", "b").agg(F.sum("w").alias("w"))
    met = one.join(g("b", "dst_group"), "b").where("src_group <> dst_group")
    return met.groupBy("src_group", "dst_group").agg(F.sum("w").alias("weight"))


def labels(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """community, label, files: the most weighted file of each group (ties by name) and the group's size."""
    weight = edges.groupBy("a").agg(F.sum("w").alias("k"))
    met = groups.join(weight, groups["node"] == weight["a"])
    return met.groupBy("community").agg(F.min_by("node", F.struct(-F.col("k"), F.col("node"))).alias("label"), F.count("*").alias("files"))
