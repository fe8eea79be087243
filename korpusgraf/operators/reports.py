"""Counts, filters and orders of the overview pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_reasons(files: DataFrame, classes: list[tuple[str, str]]) -> DataFrame:
    """reason, files: status messages sorted into classes by the first pattern that matches."""
    out = F.lit("other")
    for pattern, name in reversed(classes):
        out = F.when(F.col("message").rlike(pattern), name).otherwise(out)
    return files.groupBy(out.alias("reason")).agg(F.count("*").alias("files"))


def parser_gaps(errors: DataFrame, top: int = 10) -> DataFrame:
    """pattern, occurrences, files, example: errors (path, message) with their numbers made `#`, the most frequent first."""
    pattern = F.regexp_replace("message", "[0-9]+", "#")
    out = errors.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("occurrences"), F.countDistinct("path").alias("files"), F.min_by("message", F.concat_ws(" ", "path", "message")).alias("example"))
    return out.orderBy(F.desc("occurrences"), "pattern").limit(top)


def source_status(files: DataFrame, most: int) -> DataFrame:
    """status, files, listed: incomplete files of each status with their number and the first `most` paths."""
    w = Window.partitionBy("status").orderBy("path")
    open_ = files.where("status <> 'complete'")
    first = open_.select("status", "path", F.row_number().over(w).alias("nr")).where(F.col("nr") <= most)  # limited before the shuffle
    listed = first.groupBy("status").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("listed"))
    return open_.groupBy("status").agg(F.count("*").alias("files")).join(listed, "status")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: values of each column with their counts, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def set_condition(facet_values: dict[str, list[str]], items: list[tuple[str, str]]) -> Column:
    """Facets are joined by and, explicit (source, path) items by or; an empty set holds nothing."""
    chosen = [F.col(c).isin(v) for c, v in facet_values.items() if v]
    own = [(F.col("source") == s) & (F.col("file_path") == p) for s, p in items]
    parts = ([reduce(lambda a, b: a & b, chosen)] if chosen else []) + own
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def set_size(chunks: DataFrame, condition: Column) -> DataFrame:
    """documents, chunks of a set."""
    return chunks.where(condition).agg(F.countDistinct(F.struct("source", "file_path")).alias("documents"), F.count("*").alias("chunks"))


def gated(chunks: DataFrame, exposed: DataFrame, own_project: int) -> DataFrame:
    """Chunks that a project may see: documents, its own code, and code of exposed projects (project_id). What isn't known to be code is a document; code of no project is
    seen by none."""
    chunks = chunks.withColumn("is_code", F.coalesce("is_code", F.lit(False)))
    code = chunks.where("is_code")
    seen = code.where(F.col("project_id") == own_project).union(code.where(F.col("project_id") != own_project).join(exposed, "project_id", "left_semi").select(code.columns))
    return chunks.where("not is_code").union(seen)


def worklist(items: DataFrame, today: str) -> DataFrame:
    """Items in order of work: overdue first, priority, status, due date (none last), id; with their position. Callers limit it."""
    late = F.coalesce(F.col("due") < F.lit(today).cast("date"), F.lit(False))
    status = F.when(F.col("status") == "open", 0).when(F.col("status") == "review", 1).otherwise(2)
    return items.orderBy(F.desc(late), F.desc("priority"), status, F.asc_nulls_last("due"), "id")


def coverage(chunks: DataFrame, model: str) -> DataFrame:
    """model, chunks, done: vectors of each model and whether it is the wanted one; none is `none`."""
    return chunks.groupBy(F.coalesce("embedding_model", F.lit("none")).alias("model")).agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding_model").eqNullSafe(F.lit(model))).alias("done"))


def restricted(pages: DataFrame) -> DataFrame:
    """Pages (id, ancestors, restricted) that are neither restricted nor below a restricted page."""
    closed = pages.where("restricted").select(F.col("id").alias("up"))
    below = pages.select("id", F.explode("ancestors").alias("up")).join(closed, "up", "left_semi").select("id").distinct()
    return pages.where("not restricted").join(below, "id", "left_anti")


def new_reports(stored_runs: DataFrame, uploads: DataFrame, keys: list[str]) -> DataFrame:
    """identity, payload, state of uploads: new, known, or conflict where the identity is held with another payload; equal uploads count once."""
    identity = F.sha2(F.to_json(F.array(*[F.col(k).cast("string") for k in keys])), 256)  # parts in quotes, so that none runs into the next
    one = uploads.select(identity.alias("identity"), "payload").distinct()
    held = stored_runs.select(identity.alias("identity"), F.col("payload").alias("was")).distinct()
    state = F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("payload"), "known").otherwise("conflict")
    return one.join(held, "identity", "left").select("identity", "payload", state.alias("state"))


def spread_selection(nodes: DataFrame, limit: int, share: float = 0.7) -> DataFrame:
    """id: at most `limit` nodes (id, kind, source, degree, in_focus): the best of each kind and source first, then focus nodes up to a share, then by degree."""
    rank = F.struct(-F.col("degree"), F.col("id"))
    best = lambda c: nodes.groupBy(c).agg(F.min_by("id", rank).alias("id")).select("id").distinct()  # noqa: E731 - a row for each kind or source
    of_kind, of_source = best("kind").withColumn("k", F.lit(True)), best("source").withColumn("s", F.lit(True))
    tier = F.when(F.col("k"), 0).when(F.col("s"), 1).otherwise(2)
    first = nodes.join(of_kind, "id", "left").join(of_source, "id", "left").withColumn("tier", tier)
    focus = first.where("tier = 2 and in_focus").orderBy(F.desc("degree"), "id").limit(int(limit * share)).select("id", F.lit(2).alias("tier"), "degree")
    rest = first.join(focus.select("id"), "id", "left_anti").select("id", F.when(F.col("tier") == 2, 3).otherwise(F.col("tier")).alias("tier"), "degree")
    return focus.union(rest).orderBy("tier", F.desc("degree"), "id").limit(limit).select("id")
