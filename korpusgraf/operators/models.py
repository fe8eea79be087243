"""Effective project models: parents found by coordinates, imported dependency lists, and profiles.

A model knows its parent by group, name and version. Chains of parents and of imports are followed for all models at once, level by level, until a level is empty; a model on a cycle
is left at its first visit. Nearest wins: a model's own entry before its parent's, entries of lists before those of imports, and imports in the order in which they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored


def active_profiles(profiles: DataFrame, switched: DataFrame) -> DataFrame:
    """model, profile: the profiles (model, profile, by_default, property, value) that hold: those whose property is switched on (property, value; a profile without a value asks for any),
    and where none of a model's profiles is, its default ones."""
    on = profiles.join(switched.select("property", F.col("value").alias("given")), "property", "left")
    on = on.groupBy("model", "profile", "by_default").agg(F.max(F.col("given").isNotNull() & F.coalesce(F.col("value") == F.col("given"), F.col("value").isNull())).alias("on"))
    some = F.max("on").over(Window.partitionBy("model"))
    return on.withColumn("some", some).where(F.col("on") | (~F.col("some") & F.col("by_default"))).select("model", "profile")


def parents(models: DataFrame, most: int = 64) -> DataFrame:
    """model, ancestor, depth (0: itself) of each model, up its parents. models: model, coordinates, parent (coordinates or null). Coordinates that several models share are no
    parent: such a chain ends there."""
    named = models.groupBy("coordinates").agg(F.min("model").alias("ancestor"), F.count("*").alias("n")).where("n = 1 and coordinates is not null").drop("n")
    up = stored(models.join(named.withColumnRenamed("coordinates", "parent").hint("merge"), "parent").select("model", F.col("ancestor").alias("next")))
    out = now = models.select("model", F.col("model").alias("ancestor"), F.lit(0).alias("depth"))
    for depth in range(1, most + 1):
        step = now.join(up.select(F.col("model").alias("ancestor"), "next").hint("merge"), "ancestor").select("model", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"))
        now = stored(step.join(out.select("model", "ancestor").hint("merge"), ["model", "ancestor"], "left_anti"))
        if now.isEmpty():
            break
        out = out.union(now)
    return stored(out)


def effective(entries: DataFrame, chains: DataFrame, active: DataFrame) -> DataFrame:
    """model, key, value, origin, depth: of each key the nearest entry up the chain; within a model the last active profile by name before the model itself. entries: model, profile (null: none), key, value."""
    held = entries.join(active.withColumn("on", F.lit(True)), ["model", "profile"], "left").where("profile is null or on")
    met = chains.join(held.select(F.col("model").alias("ancestor"), "profile", "key", "value"), "ancestor")
    best = F.max_by(F.struct("value", F.col("ancestor").alias("origin"), "depth"), F.struct((-F.col("depth")).alias("near"), F.col("profile").isNotNull().alias("own"), F.coalesce("profile", F.lit("")).alias("profile"), "value"))
    return met.groupBy("model", "key").agg(best.alias("x")).select("model", "key", "x.value", "x.origin", "x.depth")


def with_properties(value: Column, properties: Column, rounds: int = 8) -> Column:
    """value with each ${name} replaced by the map's entry, again within what was put in, `rounds` deep; unknown names stay."""

    def once(v: Column) -> Column:
        # text and names alternate: name, text, name, ...
        parts = F.regexp_extract_all(v, F.lit(r"\$\{[^${}]+\}|\$|[^$]+"), F.lit(0))
        return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(properties, F.regexp_extract(p, r"^\$\{([^}]+)\}$", 1)), p)), "")

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), value, lambda v, _: F.when(F.contains(v, F.lit("${")), once(v)).otherwise(v))


def managed_versions(lists: DataFrame, chains: DataFrame, models: DataFrame) -> DataFrame:
    """model, key, value, origin, hops: the version that holds for each managed key. lists: model, place, key, value, imports (coordinates of an imported list, or null; such a row has no key).

    A model's lists are its own and its ancestors', nearest first; after them the imported models' effective lists, in order of place, their own imports after them.

    Rows are held for each model and key only, never for each model and list that it reaches: what a model doesn't list itself, it has from the first of its imports that has it, else from what
    its parent imports. Models are taken from the far end, so that all that one refers to is known before it. Models on a cycle, those with two imports at one place, and what these lead to
    can't be put in such an order; for them all least paths are followed. What has a row for each model meets by merges, so that the driver gathers none of it to send it round."""
    named = models.groupBy("coordinates").agg(F.min("model").alias("to"), F.count("*").alias("n")).where("n = 1 and coordinates is not null").drop("n")
    direct = stored(lists.where("imports is not null").join(named.withColumnRenamed("coordinates", "imports").hint("merge"), "imports").groupBy("model", "to").agg(F.min("place").alias("place")).where("model <> to"))
    up = chains.where("depth = 1").select("model", F.col("ancestor").alias("to"), F.lit(None).cast(direct.schema["place"].dataType).alias("place"))
    tied = direct.groupBy("model", "place").agg(F.count("*").alias("n")).where("n > 1").select("model", F.col("model").alias("to"), "place").dropDuplicates(["model"])
    # round by round, models to which none of the rest refers are set aside
    left, aside = stored(direct.union(up).union(tied)), []
    while not left.isEmpty():
        referred = left.select(F.col("to").alias("model"), F.lit(True).alias("referred")).distinct()
        marked = stored(left.join(referred.hint("merge"), "model", "left"))
        gone = marked.where("referred is null").drop("referred")
        if gone.isEmpty():
            break
        aside.append(gone)
        left = marked.where("referred").drop("referred")
    turns = None
    for turn, gone in enumerate(aside):
        one = gone.select("model", F.lit(turn).alias("turn")).distinct()
        turns = one if turns is None else turns.union(one)
    entry = F.min_by(F.struct("value", F.col("ancestor").alias("origin")), F.struct("depth", "place", "value")).alias("x")
    own = chains.join(lists.where("key is not null").withColumnRenamed("model", "ancestor").hint("merge"), "ancestor").groupBy("model", "key").agg(entry).select("model", "key", "x.value", "x.origin", F.lit(0).alias("hops"))
    if turns is None:
        own = own.withColumn("turn", F.lit(0))
    else:
        own = own.join(stored(turns).hint("merge"), "model", "left").withColumn("turn", F.coalesce("turn", F.lit(len(aside))))
    own = stored(own.select("model", "key", "value", "origin", "hops", "turn"), "turn")
    found = [own.drop("turn")]
    if not left.isEmpty():
        rest = stored(left.select("model").union(left.select("to")).distinct())
        found.append(stored(_along_paths(rest, lists, chains, named).where("hops > 0")))
    for turn in range(len(aside) - 1, -1, -1):
        known = own.where(F.col("turn") > turn).drop("turn")
        for f in found[1:]:
            known = known.union(f)
        met = aside[turn].join(known.withColumnRenamed("model", "to").hint("merge"), "to").where("place is not null or hops > 0")
        first = F.min_by(F.struct("value", "origin", (F.col("hops") + F.col("place").isNotNull().cast("int")).alias("hops")), F.struct(F.col("place").isNull(), "place")).alias("x")
        made = met.groupBy("model", "key").agg(first).join(own.where(F.col("turn") == turn).select("model", "key").hint("merge"), ["model", "key"], "left_anti")
        found.append(stored(made.select("model", "key", "x.value", "x.origin", "x.hops")))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _along_paths(some: DataFrame, lists: DataFrame, chains: DataFrame, named: DataFrame) -> DataFrame:
    """model, key, value, origin, hops of some models (model), which hold all that they lead to: each list is reached by its least path."""
    own = chains.join(some.hint("merge"), "model").join(lists.withColumnRenamed("model", "ancestor").hint("merge"), "ancestor").select("model", F.struct(F.col("depth"), "place").alias("at"), "ancestor", "key", "value", "imports")
    own = stored(own)
    imports = stored(own.where("imports is not null").join(named.withColumnRenamed("coordinates", "imports").hint("merge"), "imports").groupBy("model", "to").agg(F.min("at").alias("at")))
    # path: the places of the imports that lead to a list, compared as a whole, so earlier imports and what they import come first
    # a list that a later round reaches by a smaller path moves forward; round a cycle paths only get longer, so rounds end
    at = own.schema["at"].dataType.simpleString()
    reach = now = stored(some.select("model", F.col("model").alias("to"), F.array().cast(f"array<{at}>").alias("path")))
    while not now.isEmpty():
        step = now.join(imports.select(F.col("model").alias("to"), F.col("to").alias("next"), "at").hint("merge"), "to")
        step = step.select("model", F.col("next").alias("to"), F.concat("path", F.array("at")).alias("path")).groupBy("model", "to").agg(F.min("path").alias("path"))
        now = stored(step.join(reach.withColumnRenamed("path", "old").hint("merge"), ["model", "to"], "left").where("old is null or path < old").select("model", "to", "path"))
        reach = stored(reach.union(now).groupBy("model", "to").agg(F.min("path").alias("path")))
    entries = own.where("key is not null").select(F.col("model").alias("to"), "at", F.col("ancestor").alias("origin"), "key", "value")
    met = reach.join(entries.hint("merge"), "to").withColumn("hops", F.size("path"))
    first = F.min_by(F.struct("value", "origin", "hops"), F.struct("path", "at", "value"))
    # the own lists' path is empty and therefore least
    return met.groupBy("model", "key").agg(first.alias("x")).select("model", "key", "x.value", "x.origin", "x.hops")
