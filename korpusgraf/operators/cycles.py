"""Strongly connected components of a directed edge table, by rounds of labels; no table of pairs is made.

What lies on no cycle is trimmed from both ends. The greatest node that reaches a node spreads forward as its colour; from each node that kept
its own colour one goes back over edges of that colour, and what is met is a component. It goes, and the rest begins anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) left when those from a node without predecessor and those to a node without successor are taken away again and again. edges is
    a stored table."""
    n = edges.count()
    while n:
        reached, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = stored(edges.join(reached, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def colours(edges: DataFrame) -> DataFrame:
    """node, colour: the greatest node from which each node can be reached. Only nodes whose colour changed send it on."""
    now = changed = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    while True:
        sent = edges.join(changed.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
        met = stored(now.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("moved")))
        now, changed = met.select("node", "colour"), met.where("moved")
        if changed.isEmpty():
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of each node that lies on a cycle with others. edges: src, dst; self-loops and repeats don't matter."""
    live = stored(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        live = trimmed(live)
        if live.isEmpty():
            break
        of = colours(live)
        same = live.join(of.select(F.col("node").alias("src"), "colour"), "src").join(of.select(F.col("node").alias("dst"), F.col("colour").alias("c")), "dst").where("colour = c")
        same = stored(same.select("src", "dst", "colour"))
        met = frontier = stored(of.where("node = colour"))
        while True:
            back = same.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = stored(back.join(met, "node", "left_anti"))
            if frontier.isEmpty():
                break
            met = met.union(frontier)
        met = stored(met)
        found = met if found is None else found.union(met)
        live = stored(live.join(met.select(F.col("node").alias("src")), "src", "left_anti").join(met.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where(F.lit(False))
    least = found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return found.join(least, "colour").select("node", "component")


def branches_and_cycles(jumps: DataFrame) -> DataFrame:
    """unit, src, line, dst, is_branch, is_cycle of jumps (unit, src, line, dst): a line with two targets branches; a jump between nodes of one component, or
    to itself, closes a cycle, however long."""
    node = lambda c: F.struct("unit", F.col(c).alias("node"))
    rings = strong_components(jumps.select(node("src").alias("src"), node("dst").alias("dst")))
    ring = lambda c: rings.select("node.unit", F.col("node.node").alias(c), F.col("component").alias(f"{c}_ring"))
    many = jumps.groupBy("unit", "src", "line").agg(F.countDistinct("dst").alias("n"))
    met = jumps.distinct().join(many, ["unit", "src", "line"]).join(ring("src"), ["unit", "src"], "left").join(ring("dst"), ["unit", "dst"], "left")
    return met.select("unit", "src", "line", "dst", (F.col("n") >= 2).alias("is_branch"), (F.coalesce(F.col("src_ring") == F.col("dst_ring"), F.lit(False)) | (F.col("src") == F.col("dst"))).alias("is_cycle"))
