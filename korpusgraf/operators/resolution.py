"""Names resolved to targets under one rule: exactly one candidate, or the edge stays open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name prefixes of system targets and their category.
EXTERNAL = [("CEE", "runtime"), ("DFH", "transaction-system"), ("DSN", "database"), ("IGZ", "runtime"), ("IEF", "utility"), ("IEB", "utility"), ("MQ", "messaging"), ("SQL", "database")]


def unique_by(candidates: DataFrame, keys: list[str], target: str) -> DataFrame:
    """keys, target: the keys that have exactly one distinct target. Counted before the shuffle, so a frequent name costs one row a task."""
    one = candidates.groupBy(*keys).agg(F.min(target).alias(target), F.max(target).alias("_max"))
    return one.where(F.col(target) == F.col("_max")).drop("_max")


def resolve_unique(edges: DataFrame, candidates: DataFrame, keys: list[str], target: str = "target_id") -> DataFrame:
    """Edges that aren't resolved get the only candidate of their key, the others keep what they have."""
    found = unique_by(candidates, keys, target).withColumnRenamed(target, "_found")
    open_ = F.col("resolution") == "unresolved"
    met = edges.join(found, keys, "left")
    hit = open_ & F.col("_found").isNotNull()
    return met.withColumn("dst_id", F.when(hit, F.col("_found")).otherwise(F.col("dst_id"))).withColumn("resolution", F.when(hit, "resolved").otherwise(F.col("resolution"))).drop("_found")


def resolve_tiers(refs: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """ref_id, target_id: of refs (ref_id, key) the only candidate (key, tier, target_id) of the first tier that has any; a tier with several
    decides too: the reference stays open."""
    per = candidates.groupBy(key, "tier").agg(F.min("target_id").alias("a"), F.max("target_id").alias("b"))
    first = per.groupBy(key).agg(F.min(F.struct("tier", "a", "b")).alias("t")).where("t.a = t.b").select(key, F.col("t.a").alias("target_id"))
    return refs.join(first, key, "left").select("ref_id", "target_id")


def external_category(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, kind in EXTERNAL:
        out = F.when(F.upper(name).startswith(prefix), kind).otherwise(out)
    return out


def edges_by_resolution(edges: DataFrame, external: Column) -> DataFrame:
    """type, resolved, unresolved, dynamic, external: external ones are counted apart from the unresolved."""
    n = lambda c: F.count_if(c)
    return edges.groupBy("type").agg(
        n(F.col("resolution") == "resolved").alias("resolved"),
        n((F.col("resolution") == "unresolved") & ~external).alias("unresolved"),
        n(F.col("resolution") == "dynamic").alias("dynamic"),
        n((F.col("resolution") == "unresolved") & external).alias("external"),
    )


def preflight(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """dst_name, uses, first_line, state: open names that are ambiguous (several candidates by name) or missing."""
    open_ = edges.where("resolution = 'unresolved'").groupBy("dst_name").agg(F.count("*").alias("uses"), F.min("line").alias("first_line"))
    held = candidates.groupBy(F.col("name").alias("dst_name")).agg(F.countDistinct("id").alias("n"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "ambiguous")
    return open_.join(held, "dst_name", "left").withColumn("state", state).where("state is not null").drop("n")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a less those of b, one for one."""
    return a.exceptAll(b)


def unresolved_by_name(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, open_edges for each of names (name), compared in lower case."""
    held = edges.where("resolution = 'unresolved'").groupBy(F.lower("dst_name").alias("low")).agg(F.count("*").alias("open_edges"))
    return names.withColumn("low", F.lower("name")).join(held, "low").select("name", "open_edges")
