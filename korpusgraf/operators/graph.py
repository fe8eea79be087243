"""Bounded traversals: each hop is a join of the frontier with the edges; visited nodes are dropped by an anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored

#: Edges to control come first, then jumps and data access, then the rest.
FIRST, SECOND = ["PERFORM", "CALL", "CALLS", "EXECUTES"], ["GOTO", "READS", "WRITES"]


def neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): one step from a leads to b. direction: out, in or both."""
    out = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).where("b is not null and a <> b")
    if direction == "in":
        out = out.select(F.col("b").alias("a"), F.col("a").alias("b"))
    elif direction == "both":
        out = out.union(out.select(F.col("b"), F.col("a")))
    return out.distinct()


def reach(edges: DataFrame, start: DataFrame, hops: int, direction: str = "both", limit: int | None = None) -> DataFrame:
    """id, hop: nodes at most `hops` steps from start (id), with their least number of steps. With a limit, each hop keeps the `limit` least
    new ids. Lineage is cut after each hop."""
    step = stored(neighbours(edges, direction))
    seen = start.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        new = step.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        if limit is not None:
            new = new.orderBy("id").limit(limit)
        frontier = stored(new.withColumn("hop", F.lit(hop)))
        seen = seen.union(frontier)
    return seen


def with_ancestors(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """id: nodes and their ancestors by parent_id; stops at the level that has no new one, so that cycles end too."""
    parents = entities.where("parent_id is not null").select("id", "parent_id")
    seen = frontier = nodes.select("id").distinct()
    while True:
        frontier = stored(frontier.join(parents, "id").select(F.col("parent_id").alias("id")).distinct().join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def contains_edges(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """src_id, dst_id of type CONTAINS from parent to child where both are among nodes."""
    own = entities.where("parent_id is not null").select(F.col("parent_id").alias("src_id"), F.col("id").alias("dst_id"))
    ids = nodes.select("id")
    return own.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("src_id", "dst_id", F.lit("CONTAINS").alias("type"))


def focus(edges: DataFrame, entities: DataFrame, start: DataFrame, types: list[str], hops: int = 2, limit: int = 500) -> DataFrame:
    """src_id, dst_id, type: the subgraph around start over the given edge types, with ancestors and what contains what."""
    of_type = edges.where(F.col("type").isin(types) & F.col("dst_id").isNotNull())
    nodes = stored(reach(of_type, start, hops, "both", limit).select("id"))
    inner = of_type.join(nodes.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(nodes.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("src_id", "dst_id", "type")
    return inner.distinct().union(contains_edges(stored(with_ancestors(nodes, entities)), entities))


def shortest_paths(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, hop, path: to each node reached the edge ids of one shortest path from start; among several, that whose last edge has the least id."""
    step = edges.where("dst_id is not null").select("src_id", "dst_id", "edge_id")
    seen = start.select("id").distinct().select("id", F.lit(0).alias("hop"), F.array().cast("array<string>").alias("path"))
    frontier = seen
    for hop in range(1, hops + 1):
        met = frontier.withColumnRenamed("id", "src_id").join(step, "src_id").join(seen.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")
        # of parallel edges the least is chosen here, among those at the frontier only, so that no hop moves the other edges
        best = met.groupBy("dst_id").agg(F.min_by(F.concat("path", F.array("edge_id")), F.struct("edge_id", "src_id")).alias("path"))
        frontier = stored(best.select(F.col("dst_id").alias("id"), F.lit(hop).alias("hop"), "path"))
        seen = seen.union(frontier)
    return seen


def edge_rank(kind: Column, resolution: Column) -> list[Column]:
    """Order of edges out of one node: by family, resolved ones first."""
    return [F.when(kind.isin(FIRST), 0).when(kind.isin(SECOND), 1).otherwise(2), F.when(resolution == "resolved", 0).otherwise(1)]


def call_flow(edges: DataFrame, start: DataFrame, hops: int = 3, per_node: int = 5) -> DataFrame:
    """edge_id, src_id, dst_id, hop: the first `per_node` edges out of every node reached, hop by hop."""
    order = Window.partitionBy("src_id").orderBy(*edge_rank(F.col("type"), F.col("resolution")), "line", "edge_id")
    best = stored(edges.where("dst_id is not null").withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= per_node).select("edge_id", "src_id", "dst_id"))
    out, frontier, seen = None, start.select("id").distinct(), start.select("id").distinct()
    for hop in range(1, hops + 1):
        met = stored(best.join(frontier.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select("edge_id", "src_id", "dst_id", F.lit(hop).alias("hop")))
        out = met if out is None else out.union(met)
        frontier = stored(met.select(F.col("dst_id").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.union(frontier)
    return out


def impact(edges: DataFrame, entities: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """id, via, hop: what depends on start: backward over resolved edges, and edges that name a start entity without being resolved."""
    direct = reach(edges.where("resolution = 'resolved'"), start, hops, "in").where("hop > 0").select("id", F.lit("edge").alias("via"), "hop")
    names = entities.join(start, "id", "left_semi").select(F.lower("name").alias("low")).distinct()
    named = edges.where("resolution = 'unresolved'").withColumn("low", F.lower("dst_name")).join(names, "low", "left_semi").select(F.col("src_id").alias("id"), F.lit("name").alias("via"), F.lit(1).alias("hop")).distinct()
    return direct.union(named)


def grouped_neighbours(edges: DataFrame, entities: DataFrame, node: int) -> DataFrame:
    """direction, type, neighbours, edges of one node; a self-loop counts as out."""
    out = edges.where(F.col("src_id") == node).select(F.lit("out").alias("direction"), "type", F.col("dst_id").alias("other"))
    into = edges.where((F.col("dst_id") == node) & (F.col("src_id") != node)).select(F.lit("in").alias("direction"), "type", F.col("src_id").alias("other"))
    held = entities.where(F.col("parent_id") == node).select(F.lit("out").alias("direction"), F.lit("CONTAINS").alias("type"), F.col("id").alias("other"))
    return out.union(into).union(held).groupBy("direction", "type").agg(F.countDistinct("other").alias("neighbours"), F.count("*").alias("edges"))


def page(rows: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """The next `size` rows after a key, and has_more, by reading one row beyond."""
    got = rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size + 1)
    w = Window.orderBy(key)  # over size + 1 rows
    return got.withColumn("nr", F.row_number().over(w)).withColumn("has_more", F.max("nr").over(Window.partitionBy(F.lit(0))) > size).where(F.col("nr") <= size).drop("nr")


def shared_targets(edges: DataFrame, focus_ids: DataFrame) -> DataFrame:
    """dst_id, users, kinds: targets that a focus entity uses together with others."""
    keys = edges.join(focus_ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select("dst_id").distinct()
    per = edges.join(keys, "dst_id", "left_semi").groupBy("dst_id").agg(F.countDistinct("src_id").alias("users"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("kinds"))
    return per.where("users > 1")


def to_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nr, id, line: the lines of a GraphML file of nodes (id, name) and edges (src_id, dst_id, type) between them, in order of nr and
    id: header, nodes, edges, footer. Edges with an end that is no node are left out, characters that XML forbids are blanks."""

    def esc(c: Column) -> Column:
        c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    spark, text = nodes.sparkSession, lambda c: esc(F.coalesce(F.col(c).cast("string"), F.lit("")))
    frame = [(0, 0, HEADER[0]), (0, 1, HEADER[1]), (0, 2, HEADER[2]), (0, 3, HEADER[3]), (3, 0, "</graph>"), (3, 1, "</graphml>")]
    n = nodes.select(F.lit(1).alias("nr"), F.col("id").cast("string").alias("id"), F.format_string('<node id="n%s"><data key="name">%s</data></node>', text("id"), text("name")).alias("line"))
    e = _inside(nodes, edges).select(F.lit(2).alias("nr"), F.concat_ws(":", "src_id", "dst_id", "type").alias("id"), F.format_string('<edge source="n%s" target="n%s"><data key="type">%s</data></edge>', text("src_id"), text("dst_id"), text("type")).alias("line"))
    return n.union(e).union(spark.createDataFrame(frame, "nr int, id int, line string").select("nr", F.col("id").cast("string"), "line"))


#: The first lines of a GraphML file.
HEADER = (
    '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    '<key id="name" for="node" attr.name="name" attr.type="string"/>',
    '<key id="type" for="edge" attr.name="type" attr.type="string"/>',
    '<graph edgedefault="directed">',
)


def _inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")


def to_cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nr, line: a MERGE statement for each node (nr 1) and for each edge between two of them (nr 2), the type as a property."""

    def quoted(c: str) -> Column:
        q = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
            q = F.replace(q, F.lit(a), F.lit(b))
        return F.concat(F.lit("'"), q, F.lit("'"))

    n = nodes.select(F.lit(1).alias("nr"), F.format_string("MERGE (n:Entity {id: %s}) SET n.name = %s;", F.col("id").cast("string"), quoted("name")).alias("line"))
    ends = [F.col(c).cast("string") for c in ("src_id", "dst_id")]
    e = _inside(nodes, edges).select(F.lit(2).alias("nr"), F.format_string("MATCH (a:Entity {id: %s}), (b:Entity {id: %s}) MERGE (a)-[:EDGE {type: %s}]->(b);", *ends, quoted("type")).alias("line"))
    return n.union(e)


def to_csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """line: the rows' columns as CSV, a field with a comma, a quote or a line break in quotes; the header is the columns' names."""
    field = lambda c: F.when(F.col(c).cast("string").rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(F.concat_ws(",", *[field(c) for c in columns]).alias("line"))
