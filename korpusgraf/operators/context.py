"""What an answer or a reviewer is shown about an entity: layers around it, references, related findings, blended ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored
from korpusgraf.operators.rollup import CONTROL, NAMING


def drop_layers(edges: DataFrame, root: DataFrame, layers: int = 3, collapse_above: int = 40) -> tuple[DataFrame, DataFrame]:
    """(id, layer) of the nodes shown and a summary (layer, nodes, unresolved, collapsed). A layer holds the entities one edge below the one above and
    in none above; one with more than `collapse_above` is counted only and ends the walk. unresolved: open edges out of the layer above."""
    step = stored(edges.select("src_id", "dst_id"))
    frontier = seen = stored(root.select("id").distinct())
    shown, rows = seen.withColumn("layer", F.lit(0)), []
    for layer in range(1, layers + 1):
        out = step.join(frontier.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
        nodes = stored(out.where("dst_id is not null").select(F.col("dst_id").alias("id")).distinct().join(seen, "id", "left_anti"))
        n = nodes.count()
        rows.append((layer, n, out.where("dst_id is null").count(), n > collapse_above))  # a row for each layer
        if n > collapse_above or not n:
            break
        shown, seen, frontier = shown.union(nodes.withColumn("layer", F.lit(layer))), seen.union(nodes), nodes
    return shown, edges.sparkSession.createDataFrame(rows, "layer int, nodes long, unresolved long, collapsed boolean")


def outside_index(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """file_path, open_edges: open edges whose name is also an open import of the same file, so that its target lies outside the index."""
    at = entities.select(F.col("id").alias("src_id"), "file_path")
    open_ = edges.where("dst_id is null").join(at, "src_id").select("file_path", "dst_name", "type")
    imported = open_.where(F.col("type").isin(NAMING)).select("file_path", F.substring_index("dst_name", ".", -1).alias("name")).distinct()
    return open_.withColumn("name", F.substring_index("dst_name", ".", 1)).join(imported, ["file_path", "name"], "left_semi").groupBy("file_path").agg(F.count("*").alias("open_edges"))


def file_references(edges: DataFrame, entities: DataFrame, path: str, limit: int = 200) -> DataFrame:
    """line, edge_id, type, target, target_path: resolved uses in a file by line and id."""
    own = entities.where(F.col("file_path") == path).select(F.col("id").alias("src_id"))
    to = entities.select(F.col("id").alias("dst_id"), F.col("qualified_name").alias("target"), F.col("file_path").alias("target_path"))
    rows = edges.where("resolution = 'resolved'").join(own, "src_id", "left_semi").join(to, "dst_id").select("line", "edge_id", "type", "target", "target_path")
    return rows.orderBy("line", "edge_id").limit(limit)


def control_flow(edges: DataFrame, entities: DataFrame, path: str, hops: int = 2) -> DataFrame:
    """hop, start_line, line, src_id, dst_id: control edges out of a file's routines and out of their targets, in source order when sorted by the first columns."""
    known = stored(edges.where(F.col("type").isin(CONTROL) & F.col("dst_id").isNotNull()).select("src_id", "dst_id", "line"))
    at = entities.select(F.col("id").alias("src_id"), "start_line")
    frontier, out = entities.where(F.col("file_path") == path).select(F.col("id").alias("src_id")), None
    for hop in range(1, hops + 1):
        met = stored(known.join(frontier, "src_id", "left_semi").join(at, "src_id").select(F.lit(hop).alias("hop"), "start_line", "line", "src_id", "dst_id").distinct())
        out = met if out is None else out.union(met)
        frontier = met.select(F.col("dst_id").alias("src_id")).distinct().join(out.select("src_id"), "src_id", "left_anti")
    return out


def blend_rerank(hits: DataFrame, top: int = 12, weight: float = 8.0, most: int = 200) -> DataFrame:
    """id, pos: of hits (id, score, cosine) the best `most` by score; the first `top` of them anew by score + weight * max(0, cosine), the others in their order."""
    by_score = Window.orderBy(F.desc("score"), "id")  # over `most` rows
    first = hits.orderBy(F.desc("score"), "id").limit(most).withColumn("nr", F.row_number().over(by_score))
    blended = F.when(F.col("nr") <= top, F.round(F.col("score") + weight * F.greatest(F.lit(0.0), "cosine"), 4))
    return first.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last(blended), "nr")).alias("pos"))


def semantic_candidates(findings: DataFrame, query: list[float], over: float = 0.55) -> DataFrame:
    """id, distance of findings (id, v: unit vector, hash, current_hash) nearer than `over` whose text hasn't changed since."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(F.col("v"), q, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return findings.where("hash = current_hash").select("id", F.round(1 - dot / norm, 4).alias("distance")).where(F.col("distance") < over)


def related_findings(findings: DataFrame, entity_id: int, limit: int = 40) -> DataFrame:
    """id of the newest findings (id, ts, evidence as JSON list of objects) whose evidence names an entity."""
    held = F.from_json("evidence", "array<struct<entity_id: long>>")
    return findings.where(F.exists(held, lambda e: e["entity_id"] == entity_id)).orderBy(F.desc("ts"), "id").limit(limit).select("id")


def assignment_candidates(users: DataFrame, project_members: DataFrame, team_members: DataFrame) -> DataFrame:
    """project_id, id: users (id) who are members of a project (project_id, user_id) and of some team (user_id)."""
    both = project_members.select("project_id", F.col("user_id").alias("id")).distinct()
    return both.join(users.select("id"), "id", "left_semi").join(team_members.select(F.col("user_id").alias("id")), "id", "left_semi").select("project_id", "id")


def project_pulse(entities: DataFrame, per_type: int = 3) -> DataFrame:
    """type, n, sample: entities of each type with a few of them, the same in every run: those whose ids' digests come first."""
    key = F.struct(F.md5(F.col("id").cast("string")).alias("d"), "id")
    held = entities.select("type", key.alias("k")).withColumn("nr", F.row_number().over(Window.partitionBy("type", F.substring("k.d", 1, 2)).orderBy("k.d")))
    few = held.groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("nr") <= per_type, F.col("k")))).alias("ks"))
    return few.select("type", "n", F.array_join(F.transform(F.slice("ks", 1, per_type), lambda k: k["id"].cast("string")), ",").alias("sample"))
