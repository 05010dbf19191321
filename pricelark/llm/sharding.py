"""Sharding by global byte-size prefix sums from per-partition totals.

Law `bytes`: documents stay in order of doc_id and are cut where the running
size passes equal targets, so shards are contiguous and differ by at most one
document's size at either end.

1. Sizes and checksums are taken in one scan; texts are never shuffled.
2. The small rows are range-partitioned by (doc_id, checksum, row number).
3. Each partition has a total; the running sum of the totals (one row per
   partition) gives each partition its offset, and a running sum inside the
   partition does the rest. No step puts all rows in one task.

Defined cases: null text has no bytes; null doc_id sorts first; repeated rows
are placed each, next to one another; an empty table gives no rows; if there
are fewer documents than shards, some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelark.llm.common import materialise, shuffle_partitions

SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, start (bytes of all documents before)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(rows.withColumn("row_no", F.monotonically_increasing_id()), "shard-rows")

    order = ["doc_id", "text_crc32", "row_no"]
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "shard-ranges")

    # One row per partition: bounded by the number of partitions, not by the data.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_size").over(Window.partitionBy()).alias("total"))

    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({"size_in": F.coalesce(F.sum("size").over(inside), F.lit(0)), "rows_in": F.count("*").over(inside)})
    placed = placed.join(F.broadcast(offsets), "part")
    placed = placed.withColumns({"start": F.col("size_before") + F.col("size_in"), "row_index": F.col("rows_before") + F.col("rows_in")})
    middle = f"least({n_shards - 1}, (2 * start + size) * {n_shards} div (2 * total))"
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "start", "row_index", F.expr(middle).cast("int").alias("shard")), "shard-placed")

    firsts = placed.groupBy("shard").agg(F.min("row_index").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_index") - F.col("first")).alias("slot"), "start")
