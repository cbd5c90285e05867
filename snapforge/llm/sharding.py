"""Contiguous shards of equal byte size, in DataFrame functions only.

Rows are laid out in id order; prefix sums of their sizes decide the shard. The rows (id, size, text
CRC; no text) are range-partitioned and written once, each partition's total (one row per
partition) is summed up into the bytes before it, and a row's own prefix is that plus the sum
within its partition. Shard ``s`` of ``n`` takes the rows whose middle byte lies in
``[s, s + 1) * total / n``, so shard sizes differ by no more than the rows at the cuts.

A null text has size 1 (no bytes, plus one) and the CRC of no bytes. Null ids come first; rows with
one id are ordered by CRC and size, and rows alike in all three are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import quoted, shuffle_partitions, written

_ORDER = ("doc_id", "text_crc32", "size")


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: slot counts the rows of a shard from 0 in layout order."""
    n = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(quoted("text").cast("string"), F.lit("")).cast("binary")
    sized = docs.select(
        quoted("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = written(
        sized.repartitionByRange(n, *_ORDER).select("*", F.spark_partition_id().alias("part"))
    )
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"))  # a row per partition
    before = totals.select(
        "part",
        F.coalesce(
            F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("bytes_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("bytes_all"),
    )
    inside = Window.partitionBy("part").orderBy(*_ORDER)
    placed = (
        rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(before), "part")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn(
            "shard",
            F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / (2 * F.col("bytes_all"))).cast("int")),
        )
    )
    held = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # partitions + shards rows at most
    first = held.select(
        "shard",
        "part",
        F.coalesce(
            F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("slots_before"),
    )
    return placed.withColumn(
        "row", F.row_number().over(Window.partitionBy("part", "shard").orderBy(*_ORDER))
    ).join(F.broadcast(first), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slots_before") + F.col("row") - 1).alias("slot")
    )
