"""Shared helpers: tables, word pattern, lineage cuts and distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def stored(df: DataFrame) -> DataFrame:
    """Writes df into the shared checkpoint folder and returns a reader of it: lineage is cut there, and a lost executor
    costs no recomputation. The folder is the session's spark.checkpoint.dir; only where that is unset in local mode (tests) is a
    new one made. The table goes when the application ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="korpusgraf-")
        sc.setCheckpointDir(base)
    path = f"{base}/{sc.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(df: DataFrame, rows: int = 1_000) -> Iterator[None]:
    """Bounds what a Python worker holds of whole texts to `rows` rows an Arrow batch, for the jobs run within; the session's setting
    is as before afterwards."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if not 0 < int(before) <= rows:
        conf.set(key, str(rows))
    try:
        yield
    finally:
        conf.set(key, before)


def sealed(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with every column but the needed ones renamed by its place, so that no other column's name can clash."""
    return docs.toDF(*_names(docs.columns, needed))


def unsealed(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The columns of docs again, in their order and under their names."""
    return df.select(*[F.col(x).alias(c) for x, c in zip(_names(columns, needed), columns)])


def _names(columns: list[str], needed: tuple[str, ...]) -> list[str]:
    return [c if c in needed and columns.index(c) == i else f"_col{i}" for i, c in enumerate(columns)]


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    """How many buckets keep a bucket's rows in one task's memory; grows with the rows."""
    return max(64, -(-rows // per_bucket))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], values: list[str]) -> DataFrame:
    """Adds before_<v> for each v of values: the sum of v over the rows of the same group that come earlier by (bucket, order).

    No group is gathered in one task: each (group, bucket) is summed apart, and the totals of the buckets, one row each,
    give the offset at which a bucket begins. Group columns must not be null."""
    local = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    offsets = totals.select(*group, bucket, *[F.coalesce(F.sum(f"_t_{v}").over(over), F.lit(0)).alias(f"_o_{v}") for v in values])
    out = df.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_l_{v}") for v in values]).join(offsets, [*group, bucket])
    for v in values:
        out = out.withColumn(f"before_{v}", F.col(f"_l_{v}") + F.col(f"_o_{v}")).drop(f"_l_{v}", f"_o_{v}")
    return out
