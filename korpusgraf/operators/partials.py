"""Roll-up that is kept up to date: file pairs, degrees and the strongest pairs of each file, changed by added and removed edges.

Three tables live in one place that is saved as a whole (`sources.commits`), dealt to buckets: counts of edges for each pair and type by source file, degrees by file, and
each file's strongest pairs by file. A delta rewrites only the buckets it touches: its counts are added to the stored ones, pairs that come or go change the degrees of their
ends, and the strongest pairs are ranked anew for files with a changed pair and for the neighbours of files whose degree changed, on which ranks depend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored
from korpusgraf.operators.rollup import CONTROL, priority_of
from korpusgraf.sources import commits

BUCKETS = 64
PAIR = ["src_file", "dst_file"]
#: {0} is the type of what names a file in the first delta.
SCHEMAS = {"counts": "src_file {0}, dst_file {0}, type string, n long", "degrees": "file {0}, degree long", "strong": "node {0}, src_file {0}, dst_file {0}"}


def _path(table: str, file: Column, buckets: int) -> Column:
    return F.concat(F.lit(f"{table}/"), F.pmod(F.xxhash64(file), F.lit(buckets)).cast("string"))


def _state(spark: SparkSession, base: str, table: str, at: dict, kind: str = "string") -> DataFrame:
    """The table's rows with their bucket's path."""
    rows = commits.read(spark, base, table, at)
    return spark.createDataFrame([], f"source string, path string, {SCHEMAS[table].format(kind)}") if rows is None else rows


def pairs_of(counts: DataFrame) -> DataFrame:
    """src_file, dst_file, edge_count, edge_types, priority, is_control of counts (src_file, dst_file, type, n)."""
    return counts.groupBy(*PAIR).agg(
        F.sum("n").alias("edge_count"), F.sort_array(F.collect_set("type")).alias("edge_types"), F.max(priority_of(F.col("type"))).alias("priority"), F.max(F.col("type").isin(CONTROL)).alias("is_control")
    )


def strongest(pairs: DataFrame, degree: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, src_file, dst_file: the k strongest pairs of each of the nodes (node)."""
    ends = F.array(F.struct(F.col("src_file").alias("node"), F.col("dst_file").alias("other")), F.struct(F.col("dst_file").alias("node"), F.col("src_file").alias("other")))
    met = pairs.select("*", F.explode(ends).alias("e")).select(*pairs.columns, "e.node", F.col("e.other").alias("file")).join(nodes, "node", "left_semi").join(degree, "file")
    by_node = Window.partitionBy("node").orderBy(F.desc("priority"), F.desc("is_control"), "degree", F.desc("edge_count"), *PAIR)
    return met.withColumn("nr", F.row_number().over(by_node)).where(F.col("nr") <= k).select("node", *PAIR)


def _merged(old: dict[str, DataFrame], delta: DataFrame, k: int) -> tuple[DataFrame, ...]:
    """Of a delta that touches much of what is held: counts, degree, strong as they are now, and the files whose rows have changed in each of them. Pairs move once to meet
    the delta, and twice more from both ends: to the degree of the other end, and to the end whose strongest pairs are ranked."""
    held = old["counts"].select(*PAIR, "type", F.col("n").alias("was"), F.col("n").alias("now"))
    rows = held.union(delta.where("src_file <> dst_file").select(*PAIR, "type", F.lit(0).cast("long"), F.col("sign").cast("long")))
    one = rows.repartition(*PAIR).groupBy(*PAIR, "type").agg(F.sum("was").alias("was"), F.greatest(F.sum("now"), F.lit(0)).alias("now")).where("was > 0 or now > 0")
    of, alive = F.struct("type", "was", "now"), F.col("now") > 0
    pairs = stored(one.groupBy(*PAIR).agg(
        F.collect_list(of).alias("types"), F.sum("now").alias("edge_count"), F.max(F.when(alive, priority_of(F.col("type")))).alias("priority"), F.max(alive & F.col("type").isin(CONTROL)).alias("is_control"),
        F.max(F.col("was") > 0).alias("had"), F.max(alive).alias("has"), F.max(F.col("was") != F.col("now")).alias("touched"),
    ))
    moved = pairs.where("had <> has").select(F.explode(F.array(*PAIR)).alias("file"), F.when(F.col("has"), 1).otherwise(-1).alias("d"))
    degrees = old["degrees"].select("file", "degree", F.lit(0).cast("long").alias("d")).union(moved.select("file", F.lit(0).cast("long"), F.col("d").cast("long")))
    degrees = stored(degrees.groupBy("file").agg(F.sum(F.col("degree") + F.col("d")).alias("degree"), (F.sum("d") != 0).alias("changed")))
    ends = F.array(F.struct(F.col("src_file").alias("node"), F.col("dst_file").alias("file")), F.struct(F.col("dst_file").alias("node"), F.col("src_file").alias("file")))
    met = pairs.select(*PAIR, "edge_count", "priority", "is_control", "has", "touched", F.explode(ends).alias("e")).select("e.node", "e.file", (F.col("e.node") == F.col("src_file")).alias("out"), "edge_count", "priority", "is_control", "has", "touched")
    met = met.join(degrees, "file").withColumn("src_file", F.when(F.col("out"), F.col("node")).otherwise(F.col("file"))).withColumn("dst_file", F.when(F.col("out"), F.col("file")).otherwise(F.col("node")))
    by_node = Window.partitionBy("node").orderBy(F.desc("has"), F.desc("priority"), F.desc("is_control"), "degree", F.desc("edge_count"), *PAIR)
    due = F.max(F.col("touched") | F.col("changed")).over(Window.partitionBy("node"))
    first = stored(met.withColumn("nr", F.row_number().over(by_node)).withColumn("due", due).where(F.col("due") & (F.col("nr") <= F.greatest(F.lit(k), F.lit(1)))).select("node", *PAIR, "has", "nr"))
    nodes = first.where("nr = 1").select("node")
    strong = old["strong"].select("node", *PAIR).join(nodes, "node", "left_anti").unionByName(first.where(F.col("has") & (F.col("nr") <= k)).select("node", *PAIR))
    counts = pairs.where("has").select(*PAIR, F.explode("types").alias("x")).where("x.now > 0").select(*PAIR, "x.type", F.col("x.now").alias("n"))
    return counts, degrees.where("degree > 0").select("file", "degree"), strong, pairs.where("touched").select("src_file").distinct(), degrees.where("changed").select("file"), nodes


def _looked_up(old: dict[str, DataFrame], delta: DataFrame, k: int) -> tuple[DataFrame, ...]:
    """As `_merged`, of a delta that touches little: its pairs, their files and the neighbours of these are looked up in what is held."""
    change = stored(delta.where("src_file <> dst_file").groupBy(*PAIR, "type").agg(F.sum("sign").alias("n")).where("n <> 0"))
    touched = change.select(*PAIR).distinct()
    before = stored(old["counts"].join(touched, PAIR, "left_semi").select(*PAIR, "type", "n"))
    after = stored(before.unionByName(change).groupBy(*PAIR, "type").agg(F.sum("n").alias("n")).where("n > 0"))
    # pairs that come or go, at both ends
    had, has = before.select(*PAIR, F.lit(-1).alias("d")).distinct(), after.select(*PAIR, F.lit(1).alias("d")).distinct()
    moved = had.union(has).groupBy(*PAIR).agg(F.sum("d").alias("d")).where("d <> 0")
    ends = moved.select(F.explode(F.array(*PAIR)).alias("file"), "d").groupBy("file").agg(F.sum("d").alias("d")).where("d <> 0")
    ends = stored(ends)
    counts = old["counts"].select(*PAIR, "type", "n").join(touched, PAIR, "left_anti").unionByName(after)
    degree = old["degrees"].select("file", "degree").unionByName(ends.select("file", F.col("d").cast("long").alias("degree"))).groupBy("file").agg(F.sum("degree").alias("degree")).where("degree > 0")
    files = touched.select(F.explode(F.array(*PAIR)).alias("node")).distinct()
    pairs = counts.select(*PAIR).distinct()
    both = pairs.select(F.col("src_file").alias("file"), F.col("dst_file").alias("node")).union(pairs.select("dst_file", "src_file"))
    nodes = stored(files.union(both.join(ends.select("file"), "file", "left_semi").select("node")).distinct())
    near = counts.join(nodes.withColumnRenamed("node", "src_file"), "src_file", "left_semi").union(counts.join(nodes.withColumnRenamed("node", "dst_file"), "dst_file", "left_semi").select(*counts.columns)).distinct()
    fresh = strongest(pairs_of(near), degree, nodes, k)
    strong = old["strong"].select("node", *PAIR).join(nodes, "node", "left_anti").unionByName(fresh)
    return counts, degree, strong, touched.select("src_file").distinct(), ends.select("file"), nodes


def apply(spark: SparkSession, base: str, delta: DataFrame, k: int = 3, buckets: int = BUCKETS, wide: bool | None = None) -> int:
    """Changes the roll-up in `base` by a delta (src_file, dst_file, type, sign: 1 for an added edge, -1 for a removed one) and returns its new version. Pairs within a file
    don't count. The number of buckets must stay the same. Files go by names or, which moves less, by numbers; ties end at either. wide: all that is held meets the delta once,
    instead of what it touches being looked up several times; if None, where the delta has at least a quarter as many rows as are held."""
    at = commits.manifest(spark, base)
    old = {t: _state(spark, base, t, at, delta.schema["src_file"].dataType.simpleString()) for t in SCHEMAS}
    if wide is None:
        wide = delta.count() * 4 >= old["counts"].count()
    counts, degree, strong, touched_src, ended, nodes = (_merged if wide else _looked_up)(old, delta, k)

    def rewritten(table: str, rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The buckets that the keys lie in, and all rows of these buckets as they are now."""
        paths = keys.select(_path(table, F.col(key), buckets).alias("path")).distinct()
        return paths, rows.withColumn("path", _path(table, F.col(key), buckets)).join(paths, "path", "left_semi").select(F.lit("rollup").alias("source"), "path", *[c for c in rows.columns])

    count_paths, count_rows = rewritten("counts", counts, "src_file", touched_src)
    degree_paths, degree_rows = rewritten("degrees", degree, "file", ended)
    strong_paths, strong_rows = rewritten("strong", strong, "node", nodes)
    named = count_paths.union(degree_paths).union(strong_paths)
    journal = named.select(F.lit("rollup").alias("source"), "path", F.lit(None).cast("string").alias("hash"), F.lit(False).alias("deleted"))
    return commits.save(spark, base, journal, {"counts": count_rows, "degrees": degree_rows, "strong": strong_rows}, at)


def current_pairs(spark: SparkSession, base: str) -> DataFrame:
    return pairs_of(_state(spark, base, "counts", commits.manifest(spark, base)))


def current_backbone(spark: SparkSession, base: str, k: int = 3, always: int = 1000) -> DataFrame:
    """What rollup.backbone gives for all edges, from the stored tables: only the strongest pairs of each edge type are ranked anew."""
    at = commits.manifest(spark, base)
    pairs, degree = stored(pairs_of(_state(spark, base, "counts", at))), _state(spark, base, "degrees", at).select("file", "degree")
    total = pairs.count()
    if total <= always:
        chosen = pairs
    else:
        by_type = Window.partitionBy("one_type").orderBy(F.desc("priority"), F.desc("edge_count"), *PAIR)
        typed = pairs.select(*PAIR, "priority", "edge_count", F.explode("edge_types").alias("one_type")).withColumn("nr", F.row_number().over(by_type)).where(F.col("nr") <= k)
        chosen = pairs.join(_state(spark, base, "strong", at).select(*PAIR).union(typed.select(*PAIR)).distinct(), PAIR, "left_semi")
    chosen = chosen.join(degree.select(F.col("file").alias("src_file"), F.col("degree").alias("src_degree")), "src_file")
    chosen = chosen.join(degree.select(F.col("file").alias("dst_file"), F.col("degree").alias("dst_degree")), "dst_file")
    return chosen.withColumn("total_pairs", F.lit(total).cast("long"))
