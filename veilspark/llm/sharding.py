"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and growth moves only what it must."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key; all keys jump together, those past the last shard rest."""
    key, b, j = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    moving = np.arange(len(keys))
    while len(moving):
        b[moving] = j[moving]
        k = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        key[moving] = k
        j[moving] = np.floor((b[moving] + 1) * (2147483648.0 / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        moving = moving[j[moving] < shards]
    return b


def shard_udf(shards: int):
    """Column function: shard of a long key; a null key is the key 0."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.fillna(0).astype("int64").to_numpy().view(np.uint64), shards).astype("int32"))

    return shard


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Put every document into one of ``shards`` shards by its doc_id alone, and number the rows of a shard from 0.

    Returns per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; the last is the shard among one more. Only
    doc_id and text are read, so other columns cannot clash. A null text has size 1 and the checksum of an empty one; rows
    that repeat a doc_id share its shard and get slots of their own; an empty table gives no rows.

    Slots need no task that sees a whole shard: rows are ranked inside (stored partition, shard), and the ranks are shifted by
    the counts of the partitions before it, so a doc_id that fills a third of the table is spread as its rows are stored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", shard_udf(shards)("doc_id").alias("shard"), shard_udf(shards + 1)("doc_id").alias("grown_shard"))
    rows = durable(rows).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    counts = rows.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select("_part", "shard", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_at")))
    return ranked.join(shift, ["_part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_rank") - 1).alias("slot"), "grown_shard"
    )
