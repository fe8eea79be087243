"""Process projection: a walk from each root over its steps, both ways and within budgets, that says what it left out.

All roots walk together, one hop a round. A hop takes the edges at the frontier in order of their ids, as many as the root's edge budget still allows; a block that
a paragraph contains gives way to its calls, which begin at the paragraph and cost no hop; and new nodes enter in the order in which the steps name them, until the
node budget is spent. What doesn't enter is counted, with the reason."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored

#: How a step of a process counts by its edge's type.
EDGE_KIND = {
    "CALL": "call", "CALLS": "call", "PERFORM": "call", "INSTANTIATES": "call", "EXECUTES": "call", "CONTAINS": "call", "EXECUTES_SCRIPT": "call", "STARTS_JAVA": "call", "GOTO": "jump",
    "USES": "data_access", "READS": "data_access", "WRITES": "data_access", "USES_DATASET": "data_access", "ASSIGNED_DATASET": "data_access", "USES_RESOURCE": "data_access", "TRANSFORMS_WITH": "data_access",
}
KINDS = {*EDGE_KIND.values(), "external_call", "iteration", "exit"}
BLOCK_TYPES = ["exec_block", "sql_block"]
EXIT_OPERATIONS = ["RETURN", "ABEND"]
CALLING = ["CALL", "CALLS", "PERFORM"]


def step_kinds(edges: DataFrame) -> DataFrame:
    """edges with base (kind by type; an unresolved call is external) and kind (a call with a loop is an iteration); other edges are left out."""
    base = F.lit(None).cast("string")
    for t, k in EDGE_KIND.items():
        base = F.when(F.col("type") == t, k).otherwise(base)
    base = F.when((F.col("resolution") != "resolved") & F.col("type").isin(CALLING), "external_call").otherwise(base)
    known = edges.withColumn("base", base).where("base is not null")
    return known.withColumn("kind", F.when((F.col("base") == "call") & F.coalesce("loop", F.lit(False)), "iteration").otherwise(F.col("base")))


def certainty(resolution: Column, guarded: Column) -> Column:
    """certain for a resolved edge, possible for a dynamic one and one in a handler (guarded), else unresolved."""
    return F.when(resolution == "dynamic", "possible").when(resolution != "resolved", "unresolved").when(F.coalesce(guarded, F.lit(False)), "possible").otherwise("certain")


#: What a step's edge says, and the values that it can have; a walk moves them as one number.
SAID = {"type": sorted(EDGE_KIND), "base": sorted(KINDS), "kind": sorted(KINDS), "certainty": ["certain", "possible", "unresolved"]}


def packed() -> Column:
    code = F.lit(0)
    for c, values in SAID.items():
        code = code * len(values) + (F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1).cast("int")
    return code


def unpacked(c: str) -> Column:
    after = list(SAID.values())[list(SAID).index(c) + 1 :]
    return F.get(F.array(*map(F.lit, SAID[c])), F.floor(F.col("code") / math.prod(map(len, after))).cast("int") % len(SAID[c]))


def walk(edges: DataFrame, entities: DataFrame, roots: DataFrame, direction: str = "outgoing", hops: int = 3, node_limit: int = 100, edge_limit: int = 200, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Steps (root, hop, pos, edge_id, src_id, dst_id, kind, certainty) and sums (root, nodes, steps, omitted_nodes, omitted_steps, reasons) of the walks from roots (id).

    edges: edge_id, src_id, dst_id (null: external), type, resolution, loop, guarded; entities: id, type, operation. direction: outgoing, incoming or both. dst_id is null for a step
    to a target outside, which counts as a node of its own. A root's edges at one hop beyond its budget count as omitted steps, and end the walk there (edge_limit); a step
    whose node no longer fits counts as an omitted node and step (node_limit)."""
    wanted = set(kinds or KINDS)
    if wanted - KINDS or direction not in ("outgoing", "incoming", "both"):
        raise ValueError("unknown kind or direction")
    loaded = wanted | ({"call"} if "iteration" in wanted else set())
    types = [t for t, k in EDGE_KIND.items() if k in loaded] + (CALLING if "external_call" in wanted else [])
    known = step_kinds(edges).withColumn("certainty", certainty(F.col("resolution"), F.col("guarded"))).select("edge_id", "src_id", "dst_id", packed().alias("code"))
    known = stored(known)
    at_frontier = known.where(unpacked("type").isin(types))
    kind_of = entities.select(F.col("id").alias("dst_id"), F.col("type").isin(BLOCK_TYPES).alias("dst_block"), "operation")
    src_of = entities.select(F.col("id").alias("src_id"), F.col("type").isin(BLOCK_TYPES).alias("src_block"))
    # of a block within a paragraph: the calls in it, edge by edge
    blocks = entities.where(F.col("type").isin(BLOCK_TYPES)).select(F.col("id").alias("block"))
    inner = stored(known.where(unpacked("type") == "CALL").select(F.col("src_id").alias("block"), F.col("edge_id").alias("in_edge_id"), F.col("dst_id").alias("in_dst_id"), *[unpacked(c).alias(f"in_{c}") for c in SAID]).join(blocks, "block", "left_semi"))

    nodes = stored(roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct())
    frontier = nodes
    steps, left_out = None, None
    for hop in range(1, hops + 1):
        used = nodes.groupBy("root").agg(F.count("*").alias("n_nodes"))
        if steps is not None:
            of = steps.groupBy("root").agg(F.count("*").alias("n_steps"), F.count_if(F.col("dst_id").isNull()).alias("n_outside"))
            used = used.join(of, "root", "left")
        else:
            used = used.withColumn("n_steps", F.lit(0)).withColumn("n_outside", F.lit(0))
        used = stored(used.select("root", "n_nodes", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("n_outside", F.lit(0)).alias("n_outside")))
        ends = {"outgoing": ["src_id"], "incoming": ["dst_id"], "both": ["src_id", "dst_id"]}[direction]
        touched = None
        # a root that has spent its budget takes no edges, so none are looked up for it
        going_on = frontier.join(used.where(F.col("n_steps") < edge_limit).select("root"), "root", "left_semi") if steps is not None else frontier
        for end in ends:
            one = at_frontier.join(going_on.withColumnRenamed("node", end), end).select("root", "edge_id", "src_id", "dst_id", "code")
            touched = one if touched is None else touched.union(one)
        # the edges touched are found once, for those taken and for the count of those beyond
        touched = stored(touched.distinct())
        open_ = touched.join(used.where(F.col("n_steps") < edge_limit), "root")
        first = open_.withColumn("nr", F.row_number().over(Window.partitionBy("root").orderBy("edge_id"))).where(F.col("nr") <= edge_limit).where(F.col("nr") <= edge_limit - F.col("n_steps"))
        beyond = open_.groupBy("root").agg((F.count("*") - edge_limit + F.first("n_steps")).alias("omitted")).where("omitted > 0")
        spent = frontier.select("root").distinct().join(used, "root").where(F.col("n_steps") >= edge_limit).select("root", F.lit(0).cast("long").alias("omitted"))

        here = frontier.select("root", F.col("node").alias("src_id"), F.lit(True).alias("from_here"))
        first = first.select("*", *[unpacked(c).alias(c) for c in SAID]).drop("code")
        met = first.join(here, ["root", "src_id"], "left").join(kind_of, "dst_id", "left")
        contained = (F.col("type") == "CONTAINS") & F.coalesce("dst_block", F.lit(False)) & F.coalesce("from_here", F.lit(False)) & F.lit(direction != "incoming")
        met = met.withColumn("block", F.when(contained, F.col("dst_id"))).join(inner, "block", "left")
        inlined = F.col("in_edge_id").isNotNull()
        own = {c: F.when(inlined, F.col(f"in_{c}")).otherwise(F.col(c)).alias(c) for c in ("edge_id", "dst_id", "type", "base", "kind", "certainty")}
        step = met.select("root", "src_id", *own.values(), F.struct("nr", F.when(inlined, F.col("in_edge_id")).alias("inner")).alias("at"), "n_nodes", "n_steps", "n_outside", (contained & ~inlined).alias("bare"), "operation")
        if steps is not None:
            step = step.join(steps.select("root", "edge_id"), ["root", "edge_id"], "left_anti")
        step = step.where(F.col("base").isin(sorted(wanted)) | F.col("kind").isin(sorted(wanted)))
        step = step.withColumn("kind", F.when(F.col("bare"), F.when(F.col("operation").isin(EXIT_OPERATIONS), "exit").otherwise("step")).otherwise(F.col("kind")))
        step = step.join(src_of, "src_id").where(~(F.col("src_block") & (F.col("type") == "EXECUTES")))
        step = step.join(entities.select(F.col("id").alias("dst_id"), F.lit(True).alias("dst_known")), "dst_id", "left").where("dst_id is null or dst_known")
        # an edge that several blocks or both ends name is a step once, at its first place
        once = Window.partitionBy("root", "edge_id").orderBy("at")
        step = stored(step.withColumn("n", F.row_number().over(once)).where("n = 1").select("root", "at", "edge_id", "src_id", "dst_id", "kind", "certainty", "n_nodes", "n_steps", "n_outside"))

        named = step.select("root", "n_nodes", F.inline(F.array(F.struct(F.struct("at", F.lit(0).alias("end")).alias("when"), F.col("src_id").alias("node")), F.struct(F.struct("at", F.lit(1).alias("end")).alias("when"), F.col("dst_id").alias("node"))))).where("node is not null")
        new = named.groupBy("root", "node").agg(F.min("when").alias("when"), F.first("n_nodes").alias("n_nodes")).join(nodes, ["root", "node"], "left_anti")
        new = new.withColumn("nr", F.row_number().over(Window.partitionBy("root").orderBy("when")))
        entered = stored(new.where(F.col("nr") <= node_limit - F.col("n_nodes")).select("root", "node", "when"))
        inside = nodes.union(entered.select("root", "node"))
        # outside targets have room while the nodes named before and those outside leave some
        by_place = Window.partitionBy("root").orderBy("when").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marks = entered.select("root", "when", F.lit(1).alias("entity"), F.lit(0).alias("outside"), F.lit(None).cast(known.schema["edge_id"].dataType).alias("edge_id"))
        outside = step.where("dst_id is null").join(inside.select("root", F.col("node").alias("src_id")), ["root", "src_id"], "left_semi")
        marks = marks.union(outside.select("root", F.struct("at", F.lit(1).alias("end")).alias("when"), F.lit(0), F.lit(1), "edge_id"))
        placed = marks.withColumn("e", F.sum("entity").over(by_place)).withColumn("o", F.sum("outside").over(by_place)).where("outside = 1")
        room = placed.join(used, "root").where(F.col("n_nodes") + F.col("e") + F.col("n_outside") + F.col("o") - 1 < node_limit).select("root", "edge_id", F.lit(True).alias("fits"))
        ok = lambda c: inside.select("root", F.col("node").alias(c), F.lit(True).alias(f"{c}_in"))  # noqa: B023, E731
        judged = step.join(ok("src_id"), ["root", "src_id"], "left").join(ok("dst_id"), ["root", "dst_id"], "left").join(room, ["root", "edge_id"], "left")
        fits = F.coalesce("src_id_in", F.lit(False)) & F.when(F.col("dst_id").isNull(), F.coalesce("fits", F.lit(False))).otherwise(F.coalesce("dst_id_in", F.lit(False)))
        judged = stored(judged.withColumn("ok", fits).select("root", "at", "edge_id", "src_id", "dst_id", "kind", "certainty", "ok", "n_steps"))
        taken = judged.where("ok").withColumn("pos", F.col("n_steps") + F.row_number().over(Window.partitionBy("root").orderBy("at")))
        taken = stored(taken.select("root", F.lit(hop).alias("hop"), "pos", "edge_id", "src_id", "dst_id", "kind", "certainty"))
        lost = judged.where("not ok").groupBy("root").agg(F.count("*").alias("omitted"))
        gone = lost.select("root", F.col("omitted").alias("nodes"), F.col("omitted").alias("steps"), F.lit("node_limit").alias("reason")).union(beyond.union(spent).select("root", F.lit(0), "omitted", F.lit("edge_limit")))
        left_out = stored(gone if left_out is None else left_out.union(gone))
        steps = taken if steps is None else stored(steps.union(taken))

        nodes = stored(nodes.union(entered.select("root", "node")))
        passed = None
        for end in {"outgoing": ["dst_id"], "incoming": ["src_id"], "both": ["src_id", "dst_id"]}[direction]:
            one = judged.where("ok and dst_id is not null").select("root", F.col(end).alias("node"))
            passed = one if passed is None else passed.union(one)
        frontier = stored(passed.distinct().join(nodes, ["root", "node"], "left_semi").join(frontier, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
    count = steps.groupBy("root").agg(F.count("*").alias("steps"))
    omitted = left_out.groupBy("root").agg(F.sum("nodes").alias("omitted_nodes"), F.sum("steps").alias("omitted_steps"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    sums = nodes.groupBy("root").agg(F.count("*").alias("nodes")).join(count, "root", "left").join(omitted, "root", "left")
    return steps, sums.select("root", "nodes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("steps", "omitted_nodes", "omitted_steps")], F.coalesce("reasons", F.lit("")).alias("reasons"))
