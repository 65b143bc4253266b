"""Sharding by jump consistent hashing: a stable key and the shard count decide, without a ring table.

When shards are appended, a key either stays or moves into a new shard. Slots inside a shard are
counted in two steps, offsets of hash buckets and ranks inside a bucket, so no shard is ordered
in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.llm.session import python_batches, staged

#: Buckets of a shard in which slots are ranked; the table of their offsets has shards * BUCKETS rows and is broadcast.
BUCKETS = 64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach's jump consistent hash)."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard, step = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = step[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step[live] = ((shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[step[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column (any type; null is a key of its own) as int."""

    @F.pandas_udf("int")
    def jump(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashes.to_numpy(), shards), dtype="int32")

    return jump(F.xxhash64(F.lit("shard"), key))


def assign_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, size, text_crc32, shard, slot and grown_shard (the shard with one shard more).

    size is the text's UTF-8 bytes plus 16. A null text counts as empty; a null id is a key of its
    own, so such rows share a shard. Repeated rows share a shard and get slots of their own. Slots
    of a shard run from 0 without gaps. A text of any length counts whole. An empty table gives no rows. Other columns of df are left
    out and may have any name.
    """
    python_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("id"), shards), "grown_shard": shard_of(F.col("id"), shards + 1)})
    rows = staged(rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(BUCKETS)).cast("int")))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "bytes")) - 1
    out = rows.withColumn("rank", rank).join(F.broadcast(counts.select("shard", "bucket", before.alias("offset"))), ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), (F.col("bytes") + 16).alias("size"), "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id") -> None:
    """Write the rows of df with a column `shard` as one folder per shard, several files where it is large.

    A column of df named shard is replaced. Rows with a null id share a shard, repeated rows too;
    texts are written as they are; an empty table writes no shard.
    """
    placed = df.withColumn("shard", shard_of(F.col(id_col), shards))
    placed.repartition(shards * 4, "shard", F.pmod(F.xxhash64(id_col), F.lit(4))).write.partitionBy("shard").parquet(path)
