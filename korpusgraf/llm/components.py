"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusgraf.llm.common import stored


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs (x, n): each neighbour n is linked to the least of x and its neighbours. Minima are summed before the shuffle,
    and the rows of a hub stay spread, so that no neighbourhood is gathered."""
    least = pairs.groupBy("x").agg(F.min("n").alias("m")).select("x", F.least("x", "m").alias("m"))
    met = pairs.join(least, "x")
    if larger:
        return met.where("n > x and n <> m").select(F.col("n").alias("u"), F.col("m").alias("v"))
    return met.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v")).union(least.where("x <> m").select(F.col("x"), F.col("m")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """edges (src, dst), any orientation, repeats and self-loops allowed; returns (node, root) for each node that has a link,
    root being the least node reachable. No edges: no rows."""
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = stored(now)
    mark = _mark(now)
    for _ in range(rounds if mark[0] else 0):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("n")).union(now.select(F.col("v").alias("x"), F.col("u").alias("n")))
        large = _stars(both, True).distinct()
        now = stored(_stars(large.select(F.col("u").alias("x"), F.col("v").alias("n")), False).distinct())
        if (new := _mark(now)) == mark:
            break
        mark = new
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
