"""Lineage cuts of iterative operators, and folders for tables that a query makes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir; where it names none in local mode, as in tests, in a new folder. It goes when the
    application ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="korpusgraf-")
        sc.setCheckpointDir(base)
    path = f"{base}/{sc.applicationId}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written to a fresh folder, and read again. by: columns, the last of df's, whose values get folders of their own, so that a filter on them reads no others."""
    path = fresh_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """A table that grows by whole additions, dealt to buckets by its key, so that joins on all of the key move and sort only the other side. It has as many buckets as a shuffle has
    partitions, or `most`, if that is less, and lies in a fresh folder; its name is in the catalog while the block runs."""

    def __init__(self, first: DataFrame, *by: str, most: int | None = None):
        self.spark, self.by, self.columns, self.schema = first.sparkSession, by, first.columns, first.schema
        self.path, self.name, self.n = fresh_folder(self.spark), f"buckets_{uuid.uuid4().hex}", 0
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = self.buckets if most is None else min(self.buckets, most)
        self.first = first.repartition(self.buckets, *by)

    def __enter__(self) -> Buckets:
        self.add(self.first)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # the files stay

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds rows, and returns a reader of them alone."""
        self.n += 1
        rows.select(*self.columns, F.lit(self.n).alias("added_")).write.mode("append").partitionBy("added_").bucketBy(self.buckets, *self.by).saveAsTable(self.name, format="parquet", path=self.path)
        return self.spark.table(self.name).where(F.col("added_") == self.n).select(*self.columns)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def files(self) -> DataFrame:
        """All rows, by their files."""
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.columns)
