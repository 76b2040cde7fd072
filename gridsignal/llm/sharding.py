"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide a row's shard: no ring table, no state, no shuffle. When shards are
appended, the expected share 1/(n+1) of the rows moves, and only into the new shard.

Defined results: a null id is hashed as one fixed key; a null text counts as an empty one; repeated rows are kept and
each gets a slot of its own; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one shard are numbered in so many groups at once, then the groups' offsets are added.
SLOT_GROUPS = 256


def jump_buckets(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys in step; about ln(n_shards) rounds."""
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), np.int64)
    at = np.flatnonzero(np.ones(len(key), bool))
    jump = np.zeros(len(key), np.int64)
    while len(at):
        shard[at] = jump[at]
        key[at] = key[at] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[at] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[at] = ((shard[at] + 1).astype(np.float64) * (float(1 << 31) / step)).astype(np.int64)
        at = at[jump[at] < n_shards]
    return shard.astype(np.int32)


def jump_hash(key: Column, n_shards: int) -> Column:
    """Column with the shard (0 to n_shards - 1) of a long key."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(keys.to_numpy(np.int64).view(np.uint64), n_shards))

    return shard(key)


def stable_key(*cols: Column) -> Column:
    """A long that depends on the values only (nulls included)."""
    return F.xxhash64(*[c.cast("string") for c in cols])


def with_slots(df: DataFrame, shard: str, order: list[str], groups: int = SLOT_GROUPS) -> DataFrame:
    """Add ``slot``: a gapless number from 0 within each shard.

    A shard may hold a large part of the table, so no task orders a whole shard: rows are numbered inside ``groups``
    hashed groups of the shard, and each group starts where the counts of the earlier groups end. The table of counts
    has at most shards x groups rows.
    """
    grouped = df.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    counts = grouped.groupBy(shard, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_group").orderBy(*order)
    numbered = grouped.withColumn("_at", F.row_number().over(within) - 1)
    # at most shards x groups rows of three integers: a bound that doesn't depend on the data
    out = numbered.join(F.broadcast(starts), [shard, "_group"])
    return out.withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_group", "_start", "_at")


def shard_rows(df: DataFrame, key_cols: list[str], n_shards: int, shard: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` with the column ``shard`` added. Needs no shuffle."""
    return df.withColumn(shard, jump_hash(stable_key(*[F.col(c) for c in key_cols]), n_shards))


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Write one folder per shard."""
    df.write.partitionBy(shard).mode("overwrite").parquet(path)


def op8_jump_hash_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 8) -> DataFrame:
    """All documents in shards 0 to 7 by the key law, and their shard if there were one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    docs = docs.withColumn("_key", stable_key(F.col("doc_id")))
    docs = docs.withColumn("shard", jump_hash(F.col("_key"), n_shards)).withColumn("grown_shard", jump_hash(F.col("_key"), n_shards + 1))
    out = with_slots(docs.drop("_key"), "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op8_jump_hash_sharding": op8_jump_hash_sharding}
