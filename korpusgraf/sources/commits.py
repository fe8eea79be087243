"""Tables that are saved together: a file's chunks, entities, edges and journal row change at once, or not at all.

A save writes the new rows of each table, then the journal, into a folder of its own, and last a manifest that names all folders in force. Readers follow the newest manifest; of
each file (source, path) they take the rows of the last save that names it, so a save that fails before its manifest leaves everything as it was, and costs no rewriting of
what it doesn't touch. `compact` writes the state anew as one folder. One writer at a time: a save fails if another one was published since its manifest was read. Sources and
paths must not be null."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["source", "path"]
JOURNAL = "journal"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, base: str) -> dict:
    """The newest manifest: version, and commits (id, version, tables) in force."""
    fs, at = _fs(spark, f"{base}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    newest = max((n for n in names if n.endswith(".json")), default=None)
    return json.loads(spark.read.text(f"{base}/manifests/{newest}").first()[0]) if newest else {"version": 0, "commits": []}


def _publish(spark: SparkSession, base: str, content: dict) -> None:
    name = f"{base}/manifests/{content['version']:012d}.json"
    fs, final = _fs(spark, name)
    _, draft = _fs(spark, f"{base}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {content['version']} has been published by another writer")


def save(spark: SparkSession, base: str, files: DataFrame, tables: dict[str, DataFrame], since: dict | None = None) -> int:
    """Replaces all rows of the files (source, path, hash, deleted) in the tables by those given, and returns the new version. Each table has source and path columns; a
    deleted file keeps its journal row only. since: the manifest that the save is based on, the newest unless given."""
    before = manifest(spark, base) if since is None else since
    version, name = before["version"] + 1, uuid.uuid4().hex
    stamp = F.lit(version).alias("_commit")
    for table, rows in tables.items():
        rows.select("*", stamp).write.parquet(f"{base}/data/{name}/{table}")
    files.select(*KEY, "hash", "deleted", stamp).write.parquet(f"{base}/data/{name}/{JOURNAL}")
    _publish(spark, base, {"version": version, "commits": [*before["commits"], {"id": name, "version": version, "tables": sorted(tables)}]})
    return version


def journal(spark: SparkSession, base: str, at: dict | None = None) -> DataFrame:
    """source, path, hash, deleted, commit of each file that was ever saved, by its last save. at: the manifest to follow, the newest unless given."""
    held = (manifest(spark, base) if at is None else at)["commits"]
    schema = "source string, path string, hash string, deleted boolean, _commit int"
    rows = spark.read.schema(schema).parquet(*[f"{base}/data/{c['id']}/{JOURNAL}" for c in held]) if held else spark.createDataFrame([], schema)
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("hash", "deleted"), "_commit").alias("x"), F.max("_commit").alias("commit"))
    return last.select(*KEY, "x.hash", "x.deleted", "commit")


def read(spark: SparkSession, base: str, table: str, at: dict | None = None) -> DataFrame | None:
    """The table's rows in force, or None if no save has written it."""
    at = manifest(spark, base) if at is None else at
    folders = [f"{base}/data/{c['id']}/{table}" for c in at["commits"] if table in c["tables"]]
    if not folders:
        return None
    rows = spark.read.parquet(*folders)
    last = journal(spark, base, at).where("not deleted").select(*KEY, F.col("commit").alias("_commit"))
    return rows.join(last, [*KEY, "_commit"], "left_semi").select([c for c in rows.columns if c != "_commit"])


def changed(spark: SparkSession, base: str, found: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """source, path, hash, deleted of what a save has to name: files found (source, path, hash) that are new or have another hash, and files that are gone from the sources scanned
    (source; those of `found` unless given). Files whose hash is known cost no further reading."""
    known = journal(spark, base).where("not deleted").select(*KEY, F.col("hash").alias("old"))
    of_sources = known.join((found if scanned is None else scanned).select("source").distinct(), "source", "left_semi")
    met = found.join(of_sources, KEY, "full")
    return met.where("hash is null or old is null or hash <> old").select(*KEY, F.coalesce("hash", "old").alias("hash"), F.col("hash").isNull().alias("deleted"))


def compact(spark: SparkSession, base: str) -> int:
    """Writes the rows in force as one save and publishes a manifest that names it alone. Folders that older manifests name stay, for readers that still follow these."""
    before = manifest(spark, base)
    version, name = before["version"] + 1, uuid.uuid4().hex
    stamp = F.lit(version).alias("_commit")
    tables = sorted({t for c in before["commits"] for t in c["tables"]})
    for table in tables:
        read(spark, base, table, before).select("*", stamp).write.parquet(f"{base}/data/{name}/{table}")
    journal(spark, base, before).where("not deleted").select(*KEY, "hash", "deleted", stamp).write.parquet(f"{base}/data/{name}/{JOURNAL}")
    _publish(spark, base, {"version": version, "commits": [{"id": name, "version": version, "tables": tables}]})
    return version
