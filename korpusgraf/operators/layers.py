"""Layers around start entities, widening hop by hop, with the edges that lead back apart from those that lead on.

All roots walk together, one layer a round. A root stands for what it contains, so edges of its members are its own. A layer holds the entities one edge further that no
earlier layer holds; edges to what is held already are back edges. A layer with too many entities is collapsed: it is counted, and ends its root's walk unless
the caller expands it. Entities of tests are left out and counted."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.functions.text import TEST_PATH
from korpusgraf.operators.lineage import stored
from korpusgraf.operators.rollup import CONTROL, DATA, INCLUDE, NAMING

KINDS = {"control": CONTROL, "data": DATA, "includes": INCLUDE}


class Layers(NamedTuple):
    """nodes: root, layer, pos, id. edges: root, layer, pos, edge_id, src_id, dst_id, type. back: the same, layer being the one in which the edge was met (one more than the depth
    for edges out of the last layer). summary: root, layer, nodes, hidden, unresolved, unresolved_external, collapsed, truncated, stopped."""

    nodes: DataFrame
    edges: DataFrame
    back: DataFrame
    summary: DataFrame


def members(entities: DataFrame, roots: DataFrame, containers: list[str], levels: int = 3) -> DataFrame:
    """root, id: each root (id) and, where it is of a container type, what it contains to the given number of levels. A root that is no entity stands for itself."""
    up = entities.where("parent_id is not null").select("id", "parent_id")
    held = roots.select(F.col("id").alias("root"), "id").distinct()
    last = entities.where(F.col("type").isin(containers)).select("id").join(held, "id", "left_semi").distinct().select(F.col("id").alias("root"), "id")
    for _ in range(levels):
        last = last.join(up.withColumnRenamed("id", "child"), F.col("id") == F.col("parent_id")).select("root", F.col("child").alias("id"))
        held = held.union(last)
    return held.distinct()


def layers(
    edges: DataFrame, entities: DataFrame, roots: DataFrame, direction: str = "down", depth: int = 3, kinds: tuple[str, ...] = ("control",), collapse_above: int = 40,
    expand: DataFrame | None = None, frontier_limit: int = 400, tests: bool = False, containers: tuple[str, ...] = ("program", "cobol_program", "class", "interface", "enum", "record"),
) -> Layers:
    """Layers 1 to depth around each root (id). edges: edge_id, src_id, dst_id (null: open), dst_name, type, resolution; entities: id, parent_id, file_path, type, as far as the
    caller may see them. direction: down follows what a root uses, up who uses it.

    Nodes stand in the order of the first edge that reaches them; of a layer beyond frontier_limit the first are followed (truncated). A layer of more than
    collapse_above nodes is not shown, unless expand (root, layer) names it. Of a layer's edges, and of all of a root's back edges (one for each pair and type), the first
    4 * collapse_above are shown; edges within the root are none. unresolved: open edges of the nodes followed downwards; unresolved_external: those of them whose name, or the part before
    its first dot, is an open import of the same file. stopped: `end` after an empty layer, `collapsed`, or null."""
    if direction not in ("down", "up") or not kinds or set(kinds) - KINDS.keys():
        raise ValueError("unknown kind or direction")
    near, far = ("src_id", "dst_id") if direction == "down" else ("dst_id", "src_id")
    types = sorted({t for k in kinds for t in KINDS[k]})
    path_of = entities.select(F.col("id").alias("src_id"), "file_path")
    imported = edges.where(F.col("type").isin(NAMING) & (F.col("resolution") == "unresolved")).join(path_of, "src_id")
    imported = imported.select("file_path", F.substring_index("dst_name", ".", -1).alias("name"), F.lit(True).alias("external")).distinct()
    used = edges.where(F.col("type").isin(types)).join(path_of, "src_id", "left").withColumn("name", F.substring_index("dst_name", ".", 1))
    used = used.join(imported, ["file_path", "name"], "left")
    known = stored(used.select("edge_id", "src_id", "dst_id", "type", (F.col("dst_id").isNull() & F.coalesce("external", F.lit(False))).alias("external")))
    target = entities.select(F.col("id").alias(far), (F.coalesce(F.col("file_path").rlike(TEST_PATH), F.lit(False)) & F.lit(not tests)).alias("hidden")).distinct()

    own = stored(members(entities, roots, list(containers)))
    frontier, seen = own, own.withColumn("member", F.lit(True))
    at_root, most = Window.partitionBy("root"), 4 * collapse_above
    nodes, shown, back, rows = [], [], [], []
    active = own.select("root").distinct()

    def met(layer: int) -> DataFrame:
        """Edges at the frontier, with both ends drawn to the root where they are members."""
        out = known.join(frontier.withColumnRenamed("id", near), near)
        out = out.join(seen.select("root", F.col("id").alias(far), "member"), ["root", far], "left")
        inner = F.lit(layer == 1) & F.coalesce("member", F.lit(False))
        drawn = {near: F.when(F.lit(layer == 1), F.col("root")).otherwise(F.col(near)), far: F.when(F.col("member"), F.col("root")).otherwise(F.col(far))}
        self_loop = (F.col(near) == F.col("root")) & (F.col(far) == F.col("root"))
        return out.withColumn("leads_back", F.col("member").isNotNull()).withColumn("within", inner & ~self_loop).select("root", "edge_id", far, "type", "external", "leads_back", "within", *[e.alias(f"drawn_{c}") for c, e in drawn.items()])

    def drawn(df: DataFrame, layer: int) -> DataFrame:
        return df.select("root", F.lit(layer).alias("layer"), "edge_id", F.col("drawn_src_id").alias("src_id"), F.col("drawn_dst_id").alias("dst_id"), "type")

    for layer in range(1, depth + 1):
        out = stored(met(layer).join(target, far, "left"))
        new = out.where(~F.col("leads_back") & F.col("hidden").isNotNull())
        found = stored(new.where("not hidden").groupBy("root", F.col(far).alias("id")).agg(F.min("edge_id").alias("first")))
        sums = out.groupBy("root").agg(F.count_if(F.col(far).isNull() & F.lit(direction == "down")).alias("unresolved"), F.count_if("external").alias("unresolved_external"))
        sums = active.join(sums, "root", "left").join(new.where("hidden").groupBy("root").agg(F.countDistinct(far).alias("hidden")), "root", "left").join(found.groupBy("root").agg(F.count("*").alias("nodes")), "root", "left")
        sums = sums.select("root", F.lit(layer).alias("layer"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("nodes", "hidden", "unresolved", "unresolved_external")])
        wide = F.col("nodes") > collapse_above
        if expand is not None:
            sums = sums.join(expand.select("root", "layer", F.lit(True).alias("asked")).distinct(), ["root", "layer"], "left")
            wide = wide & F.col("asked").isNull()
        sums = sums.withColumn("collapsed", wide).withColumn("truncated", ~wide & (F.col("nodes") > frontier_limit)).drop("asked")
        sums = stored(sums.withColumn("stopped", F.when(F.col("nodes") == 0, "end").when(F.col("collapsed"), "collapsed")))
        open_ = sums.where("stopped is null").select("root")
        placed = stored(found.join(open_, "root", "left_semi").withColumn("pos", F.row_number().over(at_root.orderBy("first", "id"))))
        rows.append(sums)
        nodes.append(placed.select("root", F.lit(layer).alias("layer"), "pos", "id"))
        first = new.where("not hidden").withColumn("pos", F.row_number().over(at_root.orderBy("edge_id"))).where(F.col("pos") <= most)
        shown.append(drawn(first.join(open_, "root", "left_semi"), layer).join(first.select("root", "edge_id", "pos"), ["root", "edge_id"]))
        back.append(drawn(out.where("leads_back and not within"), layer))
        frontier, active = placed.where(F.col("pos") <= frontier_limit).select("root", "id"), open_
        seen = seen.union(placed.select("root", "id", F.lit(False)))
        if frontier.isEmpty():
            break
    else:
        back.append(drawn(met(depth + 1).where("leads_back"), depth + 1))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    once = Window.partitionBy("root", "src_id", "dst_id", "type").orderBy("layer", "edge_id")
    leads_back = union(back).withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    leads_back = leads_back.withColumn("pos", F.row_number().over(at_root.orderBy("layer", "edge_id"))).where(F.col("pos") <= most)
    columns = ["root", "layer", "pos", "edge_id", "src_id", "dst_id", "type"]
    return Layers(union(nodes), union(shown).select(columns), leads_back.select(columns), union(rows))


def alternatives(edges: DataFrame, entities: DataFrame, own: DataFrame, direction: str, kinds: tuple[str, ...] = ("control",), tests: bool = False) -> DataFrame:
    """root, direction, kind, n: what there is else around roots (own: root, id, as members gives them): how many entities each direction and kind of edge reaches, other than
    the kinds walked in the direction walked. Asked for roots whose first layer is empty."""
    kind = F.array_compact(F.array(*[F.when(F.col("type").isin(t), F.lit(k)) for k, t in KINDS.items()]))
    e = edges.where("dst_id is not null").select("src_id", "dst_id", F.explode(kind).alias("kind"))
    sides = []
    for way, near, far in (("down", "src_id", "dst_id"), ("up", "dst_id", "src_id")):
        one = e.where(~F.col("kind").isin(list(kinds))) if way == direction else e
        sides.append(one.select(F.col(near).alias("id"), F.col(far).alias("other"), F.lit(way).alias("direction"), "kind"))
    met = sides[0].union(sides[1]).join(own, "id").select("root", "direction", "kind", F.col("other").alias("id")).join(own, ["root", "id"], "left_anti")
    seen = entities if tests else entities.where(~F.coalesce(F.col("file_path").rlike(TEST_PATH), F.lit(False)))
    return met.join(seen.select("id").distinct(), "id", "left_semi").groupBy("root", "direction", "kind").agg(F.countDistinct("id").alias("n"))
