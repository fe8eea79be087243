"""What a change touches, where data comes from, and how steps follow each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.intervals import RANGE, distinct_ranges, range_hits, to_hunks
from korpusgraf.operators.lineage import stored


def used_by(edges: DataFrame, entities: DataFrame, node: DataFrame, most_lines: int = 3) -> DataFrame:
    """file_path, lines: other files that refer to a node (id) by a resolved edge or, unresolved, by its name; the first lines of each."""
    own = entities.join(node, "id", "left_semi")
    by_id = edges.join(node.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("src_id", "line")
    by_name = edges.where("resolution = 'unresolved'").withColumn("low", F.lower("dst_name")).join(own.select(F.lower("name").alias("low")).distinct(), "low", "left_semi").select("src_id", "line")
    at = by_id.union(by_name).join(entities.select(F.col("id").alias("src_id"), "file_path"), "src_id").join(own.select("file_path").distinct(), "file_path", "left_anti")
    return at.groupBy("file_path").agg(F.array_join(F.slice(F.array_sort(F.collect_set("line")), 1, most_lines), ",").alias("lines"))


def test_evidence(edges: DataFrame, entities: DataFrame, impacted: DataFrame, is_test: Column) -> DataFrame:
    """id, tests: resolved edges from test code into each impacted entity (id)."""
    tests = entities.where(is_test).select(F.col("id").alias("src_id"))
    into = edges.where("resolution = 'resolved'").join(impacted.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return into.join(tests, "src_id", "left_semi").groupBy(F.col("dst_id").alias("id")).agg(F.countDistinct("src_id").alias("tests"))


def includes(edges: DataFrame, external: Column) -> DataFrame:
    """src_id, resolved, external, unresolved: distinct (name, line, type) of what each entity includes."""
    one = edges.where("type in ('COPY', 'IMPORTS')").select("src_id", "dst_name", "line", "type", "resolution").distinct()
    open_ = F.col("resolution") != "resolved"
    return one.groupBy("src_id").agg(F.count_if(~open_).alias("resolved"), F.count_if(open_ & external).alias("external"), F.count_if(open_ & ~external).alias("unresolved"))


def data_origin(writes: DataFrame, reads: DataFrame, start: DataFrame, depth: int = 5, within: int = 2) -> DataFrame:
    """field, origin, hop: fields whose values flow into a start field (field): a write of a field and the reads at most `within` lines after it in the
    same unit. writes, reads: unit, line, field."""
    w, r = writes.select("unit", F.col("line").alias("w_line"), "field"), reads.select("unit", F.col("line").alias("r_line"), F.col("field").alias("origin"))
    w = w.withColumn("k", F.explode(F.sequence(F.col("w_line"), F.col("w_line") + within)))
    step = stored(w.join(r.withColumn("k", F.col("r_line")), ["unit", "k"]).where("field <> origin").select("field", "origin").distinct())
    seen = frontier = start.select("field", F.col("field").alias("origin"), F.lit(0).alias("hop"))
    for hop in range(1, depth + 1):
        new = frontier.select("field", F.col("origin").alias("mid")).join(step.withColumnRenamed("field", "mid"), "mid").select("field", "origin").distinct()
        frontier = stored(new.join(seen, ["field", "origin"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("hop > 0")


def implementations(calls: DataFrame, methods: DataFrame, realises: DataFrame, levels: int = 3) -> DataFrame:
    """call_id, id: the only method that a call of an abstract method can reach: of the types that realise its type, directly or over `levels` levels, those with a method of
    that name and arity. calls: call_id, type, name, arity; methods: id, type, name, arity; realises: sub, super."""
    step = stored(realises.distinct())
    seen = frontier = step
    for _ in range(levels - 1):
        frontier = stored(frontier.select(F.col("sub").alias("m"), "super").join(step.select("sub", F.col("super").alias("m")), "m").select("sub", "super").distinct().join(seen, ["sub", "super"], "left_anti"))
        seen = seen.union(frontier)
    held = calls.join(seen.select(F.col("super").alias("type"), F.col("sub").alias("impl")), "type").join(methods.select("id", F.col("type").alias("impl"), "name", "arity"), ["impl", "name", "arity"])
    return held.groupBy("call_id").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")


def expanded_chunks(hits: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame, budget: int = 7_200) -> DataFrame:
    """hit_id, chunk_id: chunks of the entities one resolved step away from the entities that a hit's lines overlap, in order of chunk, up to `budget` characters
    for each hit. hits and chunks: chunk_id, file_path, start_line, end_line (chunks: size)."""
    known = edges.where("resolution = 'resolved' and dst_id is not null")
    step = known.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other")).union(known.select("dst_id", "src_id")).distinct()
    # chunks of a range, of an entity's range, of an entity's neighbours and of a hit's range: of each the first that the budget can reach
    of_range = _reachable(chunks.select(*RANGE, "chunk_id", "size"), RANGE, budget)
    spans = distinct_ranges(entities)
    met = range_hits(chunks, spans.withColumn("id", F.struct(*RANGE))).select(F.col("id").alias("span"), *[F.col(f"hunk_id.{c}").alias(c) for c in RANGE])
    of_span = _reachable(met.join(of_range, RANGE).select("span", "chunk_id", "size"), ["span"], budget)
    of_entity = entities.select("id", F.struct(*RANGE).alias("span")).join(of_span, "span").select(F.col("id").alias("other"), "chunk_id", "size")
    near = step.join(of_entity, "other").select("id", "chunk_id", "size").distinct().withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(16)))
    near = stored(_reachable(_reachable(near, ["id", "part"], budget), ["id"], budget).drop("part"))
    asked = hits.withColumnRenamed("chunk_id", "hunk_id")
    found = _reachable(range_hits(asked, entities).select("hunk_id", "id").join(near, "id").select("hunk_id", "chunk_id", "size").distinct(), ["hunk_id"], budget)
    w = Window.partitionBy("hit_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    met = to_hunks(found, asked).withColumnRenamed("hunk_id", "hit_id").where("chunk_id <> hit_id")
    return met.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= budget).select("hit_id", "chunk_id")


def _reachable(rows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The rows (keys, chunk_id, size) that can be within the budget of any larger set without one chunk, the hit's own: those before them, without the largest, don't exceed it."""
    before = Window.partitionBy(*keys).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce("size", F.lit(0))
    return rows.withColumn("_used", F.coalesce(F.sum(size).over(before) - F.max(size).over(before), F.lit(0))).where(F.col("_used") <= budget).drop("_used")


def group_paths(groups: DataFrame) -> DataFrame:
    """id, path: names from the root to each group (id, parent_id, name), level by level until one is empty. Groups in a cycle hang on no root
    and have no path."""
    out = now = groups.where("parent_id is null").select("id", F.col("name").alias("path"))
    while True:
        now = stored(groups.select("id", "parent_id", "name").join(now.select(F.col("id").alias("parent_id"), "path"), "parent_id").select("id", F.concat_ws("/", "path", "name").alias("path")))
        if now.isEmpty():
            break
        out = out.union(now)
    return out


def visible_groups(paths: DataFrame, expanded: list[str]) -> DataFrame:
    """id, shown: for each group path the first ancestor that isn't expanded, or itself."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    closed = F.filter(prefixes, lambda p: ~p.isin(expanded))
    return paths.select("id", F.coalesce(F.get(closed, F.lit(0)), F.col("path")).alias("shown"))


def dependency_fingerprints(files: DataFrame, deps: DataFrame, depth: int = 64) -> DataFrame:
    """path, fingerprint: a file's hash folded with its dependencies' fingerprints, `depth` levels deep; after that, and so in cycles, with their hashes.
    files: path, hash; deps: path, needs."""
    now = files.select("path", F.col("hash").alias("fingerprint"))
    step = stored(deps.select("path", "needs").where("path <> needs").distinct())
    for _ in range(depth):
        folded = step.join(now.select(F.col("path").alias("needs"), "fingerprint"), "needs").groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "needs", "fingerprint"))), ";").alias("all"))
        new = stored(files.join(folded, "path", "left").select("path", F.when(F.col("all").isNull(), F.col("hash")).otherwise(F.sha2(F.concat_ws("|", "hash", "all"), 256)).alias("fingerprint")))
        still = new.exceptAll(now).isEmpty()
        now = new
        if still:  # every further level would give the same
            break
    return now


def outdated(findings: DataFrame, changed: DataFrame, cites: DataFrame, levels: int = 4) -> DataFrame:
    """id, state: verified findings (id, state, files) that name a changed file (path) become outdated, and so do verified ones that cite outdated ones, up to `levels` levels.
    cites: id, other."""
    files = findings.where("state = 'verified'").select("id", F.explode("files").alias("path"))
    bad = stored(files.join(changed, "path", "left_semi").select("id").distinct())
    verified = findings.where("state = 'verified'").select("id")
    frontier = bad
    for _ in range(levels):
        frontier = stored(cites.join(frontier.withColumnRenamed("id", "other"), "other", "left_semi").select("id").distinct().join(verified, "id", "left_semi").join(bad, "id", "left_anti"))
        if frontier.isEmpty():
            break
        bad = stored(bad.union(frontier))
    return findings.join(bad.withColumn("hit", F.lit(True)), "id", "left").select("id", F.when(F.col("hit"), "outdated").otherwise(F.col("state")).alias("state"))
