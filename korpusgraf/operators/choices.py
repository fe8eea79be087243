"""Choices that stay open unless one candidate is left, and facts that files pass on: overloads, library paths, data access, dependencies,
inherited settings, nested data items, test reports, interrupted runs and search over several kinds of nodes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.functions.text import contains_ci
from korpusgraf.operators.lineage import stored
from korpusgraf.operators.source_passes import well_formed

#: Primitive types and the classes that box them.
BOXED = {"byte": "Byte", "short": "Short", "int": "Integer", "long": "Long", "float": "Float", "double": "Double", "boolean": "Boolean", "char": "Character"}
#: Kinds of data access in the order shown.
ACCESS = {"WRITES": 0, "USES_DATASET": 1, "ASSIGNED_DATASET": 1, "READS": 2}


def simple_type(t: Column) -> Column:
    """A type's name without its package and type arguments."""
    return F.substring_index(F.regexp_replace(t, r"<.*", ""), ".", -1)


def chosen_overloads(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """call_id, method_id (null: open). calls: call_id, name, n_args, arg_types; methods: method_id, name, param_types. One method of the
    right arity is taken; of several that whose simple types equal the arguments', else that which takes them with boxing. Two
    left, or an argument of unknown type, leave the call open. One join, and counts combined before the shuffle."""
    boxed = F.create_map(*[F.lit(v) for kv in BOXED.items() for v in kv])
    met = calls.join(methods, "name", "left")
    arity = F.col("method_id").isNotNull() & (F.col("n_args").isNull() | (F.size("param_types") == F.col("n_args")))
    known = F.coalesce((F.size("arg_types") > 0) & ~F.exists("arg_types", lambda t: t.isNull()), F.lit(False))
    paired = F.arrays_zip(F.col("param_types").alias("p"), F.col("arg_types").alias("a"))
    same = lambda x: simple_type(x["p"]) == simple_type(x["a"])
    fits = lambda x: same(x) | F.coalesce(boxed[simple_type(x["p"])] == simple_type(x["a"]), F.lit(False))
    of_size = arity & known & (F.size("param_types") == F.size("arg_types"))
    stages = {"arity": arity, "exact": of_size & F.forall(paired, same), "fit": of_size & F.forall(paired, fits)}
    aggs = [a for s, c in stages.items() for a in (F.count_if(c).alias(f"n_{s}"), F.min(F.when(c, F.col("method_id"))).alias(s))]
    out = met.groupBy("call_id").agg(*aggs)
    only = F.when(F.col("n_arity") == 1, F.col("arity")).when(F.col("n_exact") == 1, F.col("exact")).when(F.col("n_fit") == 1, F.col("fit"))
    return out.select("call_id", only.alias("method_id"))


def library_paths(copies: DataFrame, books: DataFrame, search_order: list[str]) -> DataFrame:
    """copy_id, path (null: open). copies: copy_id, name, library; books: name, path. A single candidate is taken; else the only one in the
    directory that the library names; else the first directory of the search order with a hit decides, if it has just one."""
    met = copies.join(books.select(F.upper("name").alias("key"), "path"), F.upper(copies["name"]) == F.col("key"), "left")
    held = F.col("path").isNotNull()
    named = held & F.coalesce(F.upper(F.element_at(F.slice(F.split("path", "/"), -2, 2), 1)) == F.upper("library"), F.lit(False)) & F.contains("path", F.lit("/"))
    tests = [held, named, *[held & F.startswith("path", F.lit(d.rstrip("/") + "/")) for d in search_order]]
    counted = met.groupBy("copy_id").agg(*[a for i, t in enumerate(tests) for a in (F.count_if(t).alias(f"n{i}"), F.min(F.when(t, F.col("path"))).alias(f"p{i}"))])
    choice = F.when(F.col("n0") == 1, F.col("p0")).when(F.col("n1") == 1, F.col("p1"))
    for i in range(2, len(tests)):
        choice = choice.when(F.col(f"n{i}") > 0, F.when(F.col(f"n{i}") == 1, F.col(f"p{i}")))
    return counted.select("copy_id", choice.alias("path"))


GRAIN = 64  # lines of a cell of a file, in joins of lines and ranges


def data_access(edges: DataFrame, entities: DataFrame, asked: DataFrame, per_entity: int = 15, per_group: int = 4) -> DataFrame:
    """id, pos, access, target, lines: what data each asked entity (id) reads and writes on its own lines, grouped by kind and target with the first
    lines, file access first (edges.file_io), then writes. edges: edge_id, src_id, type, dst_name, line, file_io."""
    at = entities.select(F.col("id").alias("src_id"), "source_id", "file_path")
    wanted = entities.join(asked, "id", "left_semi").select("id", "source_id", "file_path", "start_line", "end_line")
    wanted = wanted.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_line") / GRAIN), F.floor(F.col("end_line") / GRAIN))))
    met = edges.where(F.col("type").isin(list(ACCESS))).withColumn("cell", F.floor(F.col("line") / GRAIN)).join(at, "src_id")
    met = met.join(wanted, ["source_id", "file_path", "cell"]).where("line between start_line and end_line")  # a line lies in one cell
    met = stored(met.select("id", "type", "dst_name", "line", "edge_id", "file_io"))
    group = Window.partitionBy("id", "type", "dst_name").orderBy("line", "edge_id")
    flags = met.groupBy("id", "type", "dst_name").agg(F.max("file_io").alias("file_io"))
    first = met.withColumn("nr", F.row_number().over(group)).where(F.col("nr") <= per_group)
    lines = first.groupBy("id", "type", "dst_name").agg(F.min("line").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "line"))), lambda x: x["line"].cast("string")), ",").alias("lines"))
    rank = F.create_map(*[F.lit(v) for kv in ACCESS.items() for v in kv])[F.col("type")]
    shown = Window.partitionBy("id").orderBy(F.desc("file_io"), rank, "first", "type", "dst_name")
    both = lines.withColumnRenamed("dst_name", "target").join(flags.withColumnsRenamed({"dst_name": "_t", "type": "_k", "id": "_i"}), (F.col("id") == F.col("_i")) & (F.col("type") == F.col("_k")) & F.col("target").eqNullSafe(F.col("_t")))
    both = both.withColumnRenamed("_t", "dst_name")
    return both.withColumn("pos", F.row_number().over(shown)).where(F.col("pos") <= per_entity).select("id", "pos", F.col("type").alias("access"), "target", "lines")


def file_dependencies(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """path, needs: other files of the same source that a file's edges lead to, by the target path noted on the edge (edges.target_path), else by the
    file of the target entity."""
    src = entities.select(F.col("id").alias("src_id"), F.col("source_id").alias("src_source"), F.col("file_path").alias("path"))
    dst = entities.select(F.col("id").alias("dst_id"), F.col("source_id").alias("dst_source"), F.col("file_path").alias("dst_path"))
    met = edges.join(src, "src_id").join(dst, "dst_id", "left")
    needs = F.coalesce(F.nullif("target_path", F.lit("")), F.when(F.col("dst_source") == F.col("src_source"), F.col("dst_path")))
    return met.select("path", needs.alias("needs")).where("path <> '' and needs <> '' and path <> needs").distinct()


def interrupted(sources: DataFrame, held: DataFrame, message: str = "interrupted") -> DataFrame:
    """id, status, error of all sources (id, status): what counts as syncing while nobody holds its lock (held: id) has failed."""
    live = held.select("id").distinct().withColumn("live", F.lit(True))
    broken = (F.col("status") == "syncing") & F.col("live").isNull()
    return sources.join(live, "id", "left").select("id", F.when(broken, "error").otherwise(F.col("status")).alias("status"), F.when(broken, F.lit(message)).alias("error"))


def test_reports(files: DataFrame, shown: int = 30) -> DataFrame:
    """path, tests, failures, errors, skipped, failed, consistent of JUnit reports (path, content) by XPath. A case counts once: error before failure before
    skipped; without cases the innermost suites' own numbers count. failed: the first names, comma-joined. A malformed report has null numbers and is not
    consistent."""
    files = files.select("path", well_formed(F.col("content")).alias("content"))
    kind = lambda k: f"*[local-name()='{k}']"
    case, leaf = "//*[local-name()='testcase']", "//*[local-name()='testsuite'][not(*[local-name()='testsuite'])]"
    own = {
        "tests": f"count({case})",
        "failures": f"count({case}[{kind('failure')}][not({kind('error')})])",
        "errors": f"count({case}[{kind('error')}])",
        "skipped": f"count({case}[{kind('skipped')}][not({kind('error')} or {kind('failure')})])",
    }
    listed = lambda qs: F.split(F.xpath_string("content", F.lit("concat(" + ", ',', ".join(qs) + ")")), ",")  # noqa: E731 - one pass for four numbers
    of_cases, of_suites = listed(own.values()), listed([f"sum({leaf}/@{k})" for k in own])
    out = files.select("path", "content", of_cases.alias("_c")).withColumn("_n", F.when(F.col("_c")[0] != "0", F.col("_c")).otherwise(of_suites))
    failed = F.slice(F.xpath("content", F.lit(f"{case}[{kind('error')} or {kind('failure')}]/@name")), 1, shown)
    names = F.when((F.col("_c")[1] != "0") | (F.col("_c")[2] != "0"), F.array_join(failed, ",")).otherwise("")
    out = out.select("path", *[F.col("_n")[i].try_cast("double").cast("long").alias(k) for i, k in enumerate(own)], names.alias("failed"))
    whole = (F.least("tests", "failures", "errors", "skipped") >= 0) & (F.col("failures") + F.col("errors") + F.col("skipped") <= F.col("tests"))
    return out.withColumn("consistent", F.coalesce(whole, F.lit(False))).withColumn("failed", F.when(F.col("tests").isNotNull(), F.col("failed")))


def effective_settings(models: DataFrame, rounds: int = 4) -> DataFrame:
    """path, key, value, level: settings of each model (path, parent, props map) and those inherited from all its ancestors, the nearest winning (level: how far above),
    with ${key} replaced by the effective value, `rounds` deep. A parent that is its own ancestor ends the chain."""
    models = stored(models.select("path", "parent", "props"))
    up = models.select(F.col("path").alias("at"), "parent")
    frontier = chain = stored(models.select("path", F.col("path").alias("at"), F.lit(0).alias("level"), F.array("path").alias("seen")))
    for level in count(1):
        above = frontier.join(up.where("parent is not null"), "at").where(~F.array_contains("seen", F.col("parent")))
        frontier = stored(above.select("path", F.col("parent").alias("at"), F.lit(level).alias("level"), F.concat("seen", F.array("parent")).alias("seen")))
        if frontier.isEmpty():
            break
        chain = chain.union(frontier)
    props = models.select(F.col("path").alias("at"), F.explode("props").alias("key", "value"))
    near = chain.select("path", "at", "level").join(props, "at").groupBy("path", "key").agg(F.min_by(F.struct("value", "level"), "level").alias("v"))
    held = near.groupBy("path").agg(F.collect_list(F.struct("key", "v.value", "v.level")).alias("all"))  # what one file and its ancestors set
    for _ in range(rounds):
        put = lambda acc, e: F.replace(acc, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"])
        held = held.withColumn("all", F.transform("all", lambda x: F.struct(x["key"].alias("key"), F.aggregate("all", x["value"], put).alias("value"), x["level"].alias("level"))))
    return held.select("path", F.explode("all").alias("x")).select("path", "x.key", "x.value", "x.level")


def nested_items(items: DataFrame) -> DataFrame:
    """items (path, line, level, and what else) with parent_line: the nearest item above of a lower level in the same file. 1 and 77 have none, 66 belongs to the
    last 1, 88 to the last item that is no 88."""
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(c, F.col("line")), ignorenulls=True).over(above)
    level = F.col("level")
    by_level = F.array(*[last(level == n) for n in range(1, 50)])
    lower = F.array_max(F.slice("_by", F.lit(1), F.greatest(level - 1, F.lit(0))))
    parent = F.when(level == 88, F.col("_any")).when(level == 66, F.col("_by")[0]).when((level > 1) & (level < 50), lower)
    out = items.withColumns({"_by": by_level, "_any": last(level != 88)}).withColumn("parent_line", parent)
    return out.drop("_by", "_any")


def search_nodes(kinds: dict[str, DataFrame], query: str, limit: int = 10) -> DataFrame:
    """node_type, node_id, label, hits: of each kind (id, label) the first labels that hold the query, and how many do."""
    tagged = [df.select(F.lit(k).alias("node_type"), F.col("id").alias("node_id"), "label") for k, df in kinds.items()]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.union(t)
    hit = both.where(contains_ci(F.col("label"), F.lit(query)))
    counts = hit.groupBy("node_type").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("node_type").orderBy("label", "node_id")
    first = hit.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= limit).drop("nr")
    return first.join(F.broadcast(counts), "node_type").select("node_type", "node_id", "label", "hits")  # a row for each kind
