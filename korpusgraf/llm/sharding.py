"""Sharding by global byte-size prefix sums, in DataFrame functions only.

Rows are ranged by doc_id; the partitions' totals, one row each, give the offset at which each begins, and a window inside a partition
gives the bytes before each row. The sum is cut at equal targets: a row goes to the shard in which its middle byte lies, so shards are
contiguous in doc_id order and differ by about one row's size. The law is `bytes`; equal texts are not held together.

Cases: null text: no bytes, size 16, crc32 of the empty string. Rows larger than a target leave shards near them empty. Equal ids: ordered by crc32 and
size. Null doc_id: before all ids. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusgraf.llm.common import buckets_for, prefix_sums, stored

OVERHEAD = 16


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sized = stored(sized)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets_for(sized.count()) // 8)
    ranged = sized.withColumn("one", F.lit(1).cast("long")).repartitionByRange(parts, "doc_id", "text_crc32", "size")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()))
    total = ranged.agg(F.sum("size").alias("n")).first()["n"] or 0
    placed = prefix_sums(ranged, [], "part", [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], ["size", "one"])
    middle = F.expr(f"cast(least({shards - 1}, (2 * before_size + size) * {shards} div {2 * max(total, 1)}) as int)")
    cut = placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), middle.alias("shard"), F.col("before_one").alias("row"))
    starts = cut.groupBy("shard").agg(F.min("row").alias("start"))  # a row for each shard
    return cut.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "law", "shard", (F.col("row") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
