"""Backward slice: where a data field's value comes from, step by step.

All starts walk together. At each field a level takes up to four writing statements, each with the operands that its kind of statement reads, then the rows of the routine's
data-flow table that set the field, and for a parameter its call sites. Steps come in order of level, of the field's discovery, and of the three kinds; a start ends after
`most` steps or `depth` levels. A field is followed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored

PER_FIELD = 4
STEP = "field, at, unit, line, operation, reads, follows"


def _numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("nr", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def statement_steps(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Steps of writing statements: the first four writes of a field by line. Operands have the same unit and operation: for MOVE those of its line, for STRING and UNSTRING the sources of up
    to 25 lines before, else the sources of its line and the two after. writes: write_id, unit, operation, line, field; reads: unit, operation, line, field, source."""
    first = _numbered(writes, "field", "line", "write_id").where(F.col("nr") <= PER_FIELD)
    w = first.select("write_id", "unit", "operation", F.col("line").alias("w"), F.col("field").alias("target"), "nr")
    joined = F.col("operation").isin("STRING", "UNSTRING")
    spread = w.withColumn("line", F.explode(F.sequence(F.when(joined, F.col("w") - 25).otherwise(F.col("w")), F.when(joined | (F.col("operation") == "MOVE"), F.col("w")).otherwise(F.col("w") + 2))))
    met = spread.join(reads, ["unit", "operation", "line"]).where((F.col("field") != F.col("target")) & ((F.col("operation") == "MOVE") | F.col("source")))
    operands = met.groupBy("write_id").agg(F.array_sort(F.collect_set("field")).alias("reads"))
    out = w.join(operands, "write_id", "left").withColumn("reads", F.coalesce("reads", F.array().cast("array<string>")))
    return out.select(F.col("target").alias("field"), F.struct(F.lit(0).alias("kind"), "nr").alias("at"), "unit", F.col("w").alias("line"), "operation", "reads", F.col("reads").alias("follows"))


def table_steps(flows: DataFrame) -> DataFrame:
    """Steps of data-flow rows (row_id, unit, line, operation, field, sources: array of fields): the first four of a field by unit and line."""
    first = _numbered(flows, "field", "unit", "line", "row_id").where(F.col("nr") <= PER_FIELD)
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    return first.select("field", F.struct(F.lit(1).alias("kind"), "nr").alias("at"), "unit", "line", "operation", sources.alias("reads"), F.filter(F.array_distinct(sources), lambda x: x != F.col("field")).alias("follows"))


def argument_steps(parameters: DataFrame, calls: DataFrame) -> DataFrame:
    """Steps from a parameter (field, routine, position) to what its callers give: four call sites (call_id, routine, caller, line, test, arguments, refs), those of production code first. A ref that
    is null is not followed."""
    asked = parameters.select("routine", "position").distinct()
    # a routine's parameters of one position share their call sites
    of = calls.join(asked, "routine").where(F.col("position") < F.size("arguments")).withColumn("at", F.struct("routine", "position"))
    sites = _numbered(of, "at", "test", "call_id").where(F.col("nr") <= PER_FIELD).drop("at")
    first = _numbered(parameters.join(sites.withColumnRenamed("nr", "site"), ["routine", "position"]), "field", "test", "call_id").where(F.col("nr") <= PER_FIELD)
    ref = F.get("refs", F.col("position"))
    follows = F.when(ref.isNull(), F.array().cast("array<string>")).otherwise(F.array(ref))
    return first.select("field", F.struct(F.lit(2).alias("kind"), "nr").alias("at"), F.col("caller").alias("unit"), "line", F.lit("argument").alias("operation"), F.array(F.get("arguments", F.col("position"))).alias("reads"), follows.alias("follows"))


def backward_slice(starts: DataFrame, steps: DataFrame, tables: DataFrame | None = None, depth: int = 5, most: int = 10) -> DataFrame:
    """start, nr, level, field, unit, line, operation, reads (comma-joined): the steps behind each start (field). steps: those of the functions above, together; tables: units that have a
    data-flow table (unit), whose statements are read from it alone."""
    if tables is not None:
        plain = steps.where("at.kind = 0").join(tables.select("unit").distinct(), "unit", "left_anti").select(*steps.columns)
        steps = plain.unionByName(steps.where("at.kind <> 0"))
    steps = stored(steps)
    seen = stored(starts.select(F.col("field").alias("start"), "field").distinct())
    frontier = seen.withColumn("place", F.lit(1))
    out, done = None, seen.select("start").distinct().withColumn("n", F.lit(0).cast("long"))
    for level in range(1, depth + 1):
        met = frontier.join(steps, "field").join(done, "start")
        order = Window.partitionBy("start").orderBy("place", "at")
        now = stored(met.withColumn("nr", F.col("n") + F.row_number().over(order)).where(F.col("nr") <= most).select("start", "nr", F.lit(level).alias("level"), "field", "unit", "line", "operation", "reads", "follows"))
        out = now if out is None else out.unionByName(now)
        done = stored(done.join(now.groupBy("start").agg(F.count("*").alias("m")), "start", "left").select("start", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))
        found = now.select("start", "nr", F.posexplode("follows").alias("p", "next")).groupBy("start", F.col("next").alias("field")).agg(F.min(F.struct("nr", "p")).alias("first"))
        found = found.join(seen, ["start", "field"], "left_anti").join(done.where(F.col("n") < most), "start", "left_semi")
        frontier = stored(found.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy("first"))).select("start", "field", "place"))
        if frontier.isEmpty():
            break
        seen = stored(seen.union(frontier.select("start", "field")))
    return out.select("start", "nr", "level", "field", "unit", "line", "operation", F.array_join("reads", ",").alias("reads"))
