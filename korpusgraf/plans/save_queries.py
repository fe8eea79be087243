"""Queries of tables that are saved together: documents in two saves, and a roll-up that is kept up to date by deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import groups, partials, rollup
from korpusgraf.operators.lineage import fresh_folder, stored
from korpusgraf.plans import rollup_queries
from korpusgraf.sources import commits
from korpusgraf.sources.adapter import chunks, entities, targeted_edges


def saved(s, d):
    """The first save has all documents but every tenth; in what is found then, some have changed, some are gone, and those are new. Only these are saved."""
    base = fresh_folder(s)
    c = chunks(s, d).select("source", F.col("file_path").alias("path"), "chunk_id", F.coalesce("content", F.lit("")).alias("content"))
    states = c.where("chunk_id % 10 <> 3"), c.where("chunk_id % 10 <> 2").withColumn("content", F.when(F.expr("chunk_id % 10 = 1"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    for state in states:
        named = commits.changed(s, base, state.select("source", "path", F.sha2(F.col("content").cast("binary"), 256).alias("hash")), c)
        rows = state.join(named.where("not deleted").select("source", "path"), ["source", "path"], "left_semi")
        commits.save(s, base, named, {"chunks": rows, "sizes": rows.select("source", "path", F.char_length("content").cast("long").alias("chars"))})
    sizes, last = commits.read(s, base, "sizes"), commits.journal(s, base)
    return commits.read(s, base, "chunks").select("source", "path", "chunk_id").join(sizes, ["source", "path"]).join(last.select("source", "path", "commit"), ["source", "path"])


def kept(s, d):
    """All edges of orders, in three deltas: at first without the calls and with each read doubled; then the calls come, and the second reads go. Files go by
    numbers in the order of their names, which are looked up for the result; edges are put between files once."""
    base = fresh_folder(s)
    names = groups.numbered(entities(s, d).select(rollup.file_key(entities(s, d))))
    e = stored(rollup.between_files(targeted_edges(s, d), entities(s, d), numbers=names).select("src_file", "dst_file", "type"))
    reads, calls = e.where("type = 'READS'"), e.where("type = 'CALL'")
    partials.apply(s, base, e.where("type <> 'CALL'").union(reads).withColumn("sign", F.lit(1)))
    partials.apply(s, base, calls.withColumn("sign", F.lit(1)))
    partials.apply(s, base, reads.withColumn("sign", F.lit(-1)))
    found = rollup_queries.flat(partials.current_backbone(s, base))
    return groups.to_names(found, names, "src_file", "dst_file").select(found.columns)


QUERIES = {"saved_chunks": saved, "kept_backbone": kept}
SQL = {
    "saved_chunks": "SELECT source, source || '/' || doc_id AS path, doc_id AS chunk_id, length(coalesce(text, '')) + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS chars, CASE WHEN doc_id % 10 IN (1, 3) THEN 2 ELSE 1 END AS commit FROM documents WHERE doc_id % 10 <> 2",
    "kept_backbone": rollup_queries.SQL["graph_backbone"],
}
