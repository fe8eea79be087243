"""Edges between entities rolled up to files, with degrees and a backbone of the strongest pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored

#: Families of edge types.
CONTROL = ["PERFORM", "CALL", "GOTO", "CALLS", "EXPOSES", "DISPATCHES_TO", "EXECUTES"]
INCLUDE = ["COPY", "INCLUDES", "IMPORTS", "IMPORTS_MODULE", "EXTENDS", "IMPLEMENTS", "INJECTS"]
DATA = ["READS", "WRITES", "USES", "USES_DATASET", "ASSIGNED_DATASET", "USES_TYPE", "INSTANTIATES", "USES_MAP"]
NAMING = ["IMPORTS", "IMPORTS_MODULE"]


def priority_of(edge_type: Column) -> Column:
    """0 for naming, 3 for control and include, 2 for data, 1 for any other type."""
    return F.when(edge_type.isin(NAMING), 0).when(edge_type.isin(CONTROL + INCLUDE), 3).when(edge_type.isin(DATA), 2).otherwise(1)


def file_key(entities: DataFrame, path: Column | None = None) -> Column:
    """What identifies a file: project, source and path, those of them that entities have, joined by `:`. A missing part is empty."""
    scope = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project_id", "source_id") if c in entities.columns]
    return F.concat_ws(":", *scope, F.coalesce(path if path is not None else F.col("file_path"), F.lit("")))


def between_files(edges: DataFrame, entities: DataFrame, path: Column | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """Edges whose ends lie in different files, with src_file and dst_file. The entities' keys are made once and stored; the second end is looked up first,
    so that edges that come dealt by it (`targeted_edges`) stay where they are. numbers: no and name of all files; then edges have the files' numbers."""
    at = entities.select("id", file_key(entities, path).alias("file"))
    at = stored(at if numbers is None else at.join(numbers.hint("merge"), F.col("file") == F.col("name")).select("id", F.col("no").alias("file")))
    src, dst = at.select(F.col("id").alias("src_id"), F.col("file").alias("src_file")), at.select(F.col("id").alias("dst_id"), F.col("file").alias("dst_file"))
    return edges.where(F.col("dst_id").isNotNull()).join(dst, "dst_id").join(src, "src_id").where("src_file <> dst_file")


def file_pairs(edges: DataFrame, entities: DataFrame, path: Column | None = None, samples: int = 0, numbers: DataFrame | None = None) -> DataFrame:
    """src_file, dst_file (file_key), edge_count, edge_types (array), priority, is_control and, if samples are wanted, sample_ids (array of
    the least edge ids); self-pairs are left out. path: from an entity to what counts as its file's path. numbers: as for between_files."""
    met, few = between_files(edges, entities, path, numbers), []
    if samples:  # numbered where the pairs are grouped too, so that the edges move once
        met = met.withColumn("nr", F.row_number().over(Window.partitionBy("src_file", "dst_file").orderBy("edge_id")))
        few = [F.sort_array(F.collect_list(F.when(F.col("nr") <= samples, F.col("edge_id")))).alias("sample_ids")]
    return met.groupBy("src_file", "dst_file").agg(
        F.count("*").alias("edge_count"),
        F.sort_array(F.collect_set("type")).alias("edge_types"),
        F.max(priority_of(F.col("type"))).alias("priority"),
        F.max(F.col("type").isin(CONTROL)).alias("is_control"),
        *few,
    )


def _first_edges(met: DataFrame, per_pair: int) -> DataFrame:
    w = Window.partitionBy("src_file", "dst_file").orderBy("edge_id")
    return met.select("src_file", "dst_file", "edge_id", F.row_number().over(w).alias("nr")).where(F.col("nr") <= per_pair)


def sample_edges(edges: DataFrame, entities: DataFrame, per_pair: int = 5) -> DataFrame:
    """src_file, dst_file, edge_id, nr: the first ids of each pair as evidence."""
    return _first_edges(between_files(edges, entities), per_pair)


def degrees(pairs: DataFrame) -> DataFrame:
    """file, degree: each pair counts at both ends."""
    ends = pairs.select(F.col("src_file").alias("file")).union(pairs.select(F.col("dst_file").alias("file")))
    return ends.groupBy("file").agg(F.count("*").alias("degree"))


def backbone(pairs: DataFrame, k: int = 3, always: int = 1000) -> DataFrame:
    """The k strongest pairs of every file and of every edge type, with both ends' degrees and the number of all pairs; all pairs
    if there are no more than `always`. Ties end at the file names, so results are the same in every run."""
    pairs = stored(pairs)
    degree, total = stored(degrees(pairs)), pairs.count()
    if total <= always:
        chosen = pairs
    else:
        ends = F.array(F.struct(F.col("src_file").alias("node"), F.col("dst_file").alias("other")), F.struct(F.col("dst_file").alias("node"), F.col("src_file").alias("other")))
        met = pairs.select("*", F.explode(ends).alias("e")).select(*pairs.columns, "e.node", F.col("e.other").alias("file")).join(degree, "file")
        by_node = Window.partitionBy("node").orderBy(F.desc("priority"), F.desc("is_control"), "degree", F.desc("edge_count"), "src_file", "dst_file")
        by_type = Window.partitionBy("one_type").orderBy(F.desc("priority"), F.desc("edge_count"), "src_file", "dst_file")
        strong = met.withColumn("nr", F.row_number().over(by_node)).where(F.col("nr") <= k)
        typed = pairs.select("*", F.explode("edge_types").alias("one_type")).withColumn("nr", F.row_number().over(by_type)).where(F.col("nr") <= k)
        chosen = strong.select(pairs.columns).union(typed.select(pairs.columns)).dropDuplicates(["src_file", "dst_file"])  # rows of one pair are equal
    chosen = chosen.join(degree.select(F.col("file").alias("src_file"), F.col("degree").alias("src_degree")), "src_file")
    chosen = chosen.join(degree.select(F.col("file").alias("dst_file"), F.col("degree").alias("dst_degree")), "dst_file")
    return chosen.withColumn("total_pairs", F.lit(total).cast("long"))


def capped(pairs: DataFrame, limit: int) -> DataFrame:
    """The pairs both of whose files are among the `limit` of highest degree (ties by name)."""
    kept = degrees(pairs).orderBy(F.desc("degree"), "file").limit(limit).select("file")
    return pairs.join(kept.withColumnRenamed("file", "src_file"), "src_file", "left_semi").join(kept.withColumnRenamed("file", "dst_file"), "dst_file", "left_semi")


def inventory(entities: DataFrame) -> DataFrame:
    """type, entities, files."""
    return entities.groupBy("type").agg(F.count("*").alias("entities"), F.countDistinct("file_path").alias("files"))


def areas(entities: DataFrame, depth: int = 1, top: int = 10) -> DataFrame:
    """The directory prefixes of at most `depth` names that hold most entities."""
    area = F.array_join(F.slice(F.split("file_path", "/"), 1, depth), "/")
    return entities.groupBy(area.alias("area")).agg(F.count("*").alias("units")).orderBy(F.desc("units"), "area").limit(top)


def entry_points(pairs: DataFrame) -> DataFrame:
    """file, targets: files that control others and are controlled by none."""
    control = pairs.where("is_control")
    called = control.select(F.col("dst_file").alias("src_file")).distinct()
    return control.join(called, "src_file", "left_anti").groupBy(F.col("src_file").alias("file")).agg(F.countDistinct("dst_file").alias("targets"))


def most_used(pairs: DataFrame, top: int = 10) -> DataFrame:
    out = pairs.groupBy(F.col("dst_file").alias("file")).agg(F.countDistinct("src_file").alias("users"), F.sum("edge_count").alias("uses"))
    return out.orderBy(F.desc("users"), F.desc("uses"), "file").limit(top)
