"""What changes between two states: journals, reindexing, queues and schedules."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted): by the files' hashes (path, hash); unchanged files are left out."""
    o, n = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    met = o.join(n, "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return met.select("path", change.alias("change")).where("change is not null")


def orphans(stored: DataFrame, seen: DataFrame, most_share: float = 0.5) -> DataFrame:
    """Rows of stored whose path a complete crawl didn't see; none if the crawl is empty or over `most_share` of the rows would go."""
    gone = stored.join(seen.select("path").distinct(), "path", "left_anti")
    if seen.isEmpty() or gone.count() > most_share * stored.count():
        return stored.limit(0)
    return gone


def reindexed(old: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """link_id, chunk_id, status: links carried to new chunks. A fingerprint that occurs once on both sides moves its links; else approved links
    become pending without a chunk and automatic pending ones go. old and new: chunk_id, fingerprint."""
    once = lambda df, name: df.groupBy("fingerprint").agg(F.min("chunk_id").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    moved = once(old, "was").join(once(new, "now"), "fingerprint").select(F.col("was").alias("chunk_id"), "now")
    met = links.join(moved, "chunk_id", "left")
    status = F.when(F.col("now").isNull() & (F.col("status") == "approved"), "pending").otherwise(F.col("status"))
    return met.where("now is not null or status <> 'pending'").select("link_id", F.col("now").alias("chunk_id"), status.alias("status"))


def coalesced(queue: DataFrame) -> DataFrame:
    """kind, id, first_ts, items: one pending row for each endpoint."""
    return queue.groupBy("kind", "id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("items"))


def due(sources: DataFrame, now: str, most_doublings: int = 6) -> DataFrame:
    """Sources (id, last_sync, interval_s, failures, paused) whose time has come: the interval doubles with each failure; 0 is manual."""
    wait = F.col("interval_s") * F.pow(F.lit(2.0), F.least("failures", F.lit(most_doublings)))
    since = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_sync")
    return sources.where((F.col("interval_s") > 0) & ~F.col("paused") & (F.col("last_sync").isNull() | (since >= wait)))


def latest_attempts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that no higher attempt of the same identity supersedes."""
    best = runs.groupBy(*keys).agg(F.max("attempt").alias("attempt"))
    return runs.join(best, [*keys, "attempt"], "left_semi")


def reconciled(runs: DataFrame) -> DataFrame:
    """id, scope, state: of the active runs of a scope the oldest stays, later ones are ended."""
    w = Window.partitionBy("scope").orderBy("id")
    active = runs.where("state = 'active'").withColumn("state", F.when(F.row_number().over(w) == 1, "active").otherwise("ended"))
    return active.select("id", "scope", "state").union(runs.where("state <> 'active'").select("id", "scope", "state"))


def pending_vectors(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks whose vectors are of another model or none, in both slots."""
    other = lambda c: ~F.col(c).eqNullSafe(F.lit(model))
    return chunks.where(other("embedding_model") & other("embedding_next_model"))


def reused_vectors(new: DataFrame, old: DataFrame) -> DataFrame:
    """new (chunk_id, hash, model) with the vector's id of an equal text of the same model (least), or null."""
    held = old.groupBy("hash", "model").agg(F.min("vec_id").alias("vec_id"))
    return new.join(held, ["hash", "model"], "left")


def version_state(bindings: DataFrame, sources: DataFrame) -> DataFrame:
    """id, state: current, different_version, unbound, project (bound to the project as a whole), other_source or index_unavailable. bindings: id, source_id, version,
    is_project if there are such; sources: source_id, version, indexed."""
    s = sources.select("source_id", F.col("version").alias("now"), "indexed", F.lit(True).alias("known"))
    whole = F.coalesce("is_project", F.lit(False)) if "is_project" in bindings.columns else F.lit(False)
    state = F.when(whole, "project").when(F.col("source_id").isNull(), "unbound").when(F.col("known").isNull(), "other_source").when(~F.col("indexed"), "index_unavailable").when(F.col("version").eqNullSafe(F.col("now")), "current").otherwise("different_version")
    return bindings.join(s, "source_id", "left").select("id", state.alias("state"))


def last_before(messages: DataFrame) -> DataFrame:
    """conv_id, turn, question: for each answer the last user message before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return messages.withColumn("question", asked).where("role = 'assistant'").select("conv_id", "turn", "question")


def dependency_closure(deps: DataFrame, depth: int | None = None) -> DataFrame:
    """path, needs: direct and indirect dependencies, without the file itself, until a step finds no new pair, or up to `depth` steps. Lineage is cut at each step.

    Pairs are kept in buckets by path and needs, to which each step adds what it found: pairs held are neither moved nor written again, and a step moves only its own."""
    from korpusgraf.operators.lineage import Buckets, stored

    step = stored(deps.select("path", "needs").where("path <> needs").distinct())
    with Buckets(step, "path", "needs") as out:
        frontier = step
        for _ in count() if depth is None else range(depth - 1):
            new = frontier.select("path", F.col("needs").alias("mid")).join(step.select(F.col("path").alias("mid"), "needs"), "mid").select("path", "needs").where("path <> needs").distinct()
            frontier = out.add(new.join(out.rows(), ["path", "needs"], "left_anti"))
            if frontier.isEmpty():
                break
    return out.files()
