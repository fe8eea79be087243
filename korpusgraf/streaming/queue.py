"""The dirty queue as a stream: repeated items of one endpoint count once while its watermark lasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: object) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def coalesced(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """kind, id, ts: the first item of each endpoint within the watermark."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["kind", "id"])


def backlog(items: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """start, kind, items in tumbling windows; late items beyond the watermark are dropped."""
    return items.withWatermark("ts", delay).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("items")).select("window.start", "kind", "items")


def run_once(df: DataFrame, out: str, checkpoint: str) -> None:
    """Works off what there is and ends; a restart goes on from the checkpoint."""
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
