"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are range-partitioned by (text key, id), so that equal texts lie side by
side and a text with very many copies still spreads over partitions. Each
partition is summed by itself; the running sums of those few totals give every
partition its offset, and a row's global prefix is the offset plus the running
sum inside its partition. Shards are cut where the prefix crosses equal targets.
A cut that would part a group of equal texts moves to the group's nearer end,
if the group is smaller than ``slack`` of a shard; larger groups are cut.

Only key, size and checksum are shuffled, never the texts. What is broadcast is
one row a partition, one row a shard and at most one group a cut.

Edge cases: very long texts are one row as others are. A null text has size 1 and checksum 0, as an empty one. Null ids
sort first. Rows that are equal in id and text are told apart by their place in
the partition and each gets a slot of its own. An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise


def md5_key(text: Column) -> Column:
    """The first 60 bits of a text's MD5: an order that other engines can compute, too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def shard_by_bytes(
    df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.1, key: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """doc_id, size, text_crc32, prefix (bytes before the row), shard, slot (place in the shard).

    ``key`` gives a text the number by which rows are ordered.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key(text).alias("_key"),
    )
    ranged = keyed.repartitionByRange("_key", "doc_id").withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged)

    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everywhere).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"_sum": F.sum("size").over(inside), "_row": F.row_number().over(inside)}).join(F.broadcast(offsets), "_part")
    at = lambda prefix: F.least(F.floor(prefix * n_shards / F.col("_total")), F.lit(n_shards - 1)).cast("int")
    placed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "_key",
        "_total",
        (F.col("_bytes_before") + F.col("_sum") - F.col("size")).alias("prefix"),
        (F.col("_rows_before") + F.col("_row") - 1).alias("_index"),
    ).withColumn("_shard", at(F.col("prefix")))
    placed = materialise(placed)

    # Groups that a cut parts: at most one a cut.
    split = (
        placed.groupBy("_key")
        .agg(F.min("_shard").alias("_lo"), F.max("_shard").alias("_hi"), F.min("prefix").alias("_from"), F.sum("size").alias("_size"), F.max("_total").alias("_total"))
        .where((F.col("_lo") < F.col("_hi")) & (F.col("_size") <= slack * F.col("_total") / n_shards))
        .select("_key", at(F.col("_from") + F.col("_size") / 2).alias("_whole"))
    )
    placed = placed.join(F.broadcast(split), "_key", "left").withColumn("shard", F.coalesce("_whole", "_shard"))
    starts = placed.groupBy("shard").agg(F.min("_index").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "prefix", "shard", (F.col("_index") - F.col("_start")).cast("long").alias("slot")
    )
