"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key alone decides a row's shard: no ring table, no state. Appending a shard moves about 1/(n+1) of the rows, all of
them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from .common import quoted, unused, without

#: Bound on (shard, bucket) groups whose start slots are broadcast: 65,536 rows of 16 bytes.
GROUPS = 65_536


def jump_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Jump hash of each 64-bit key into ``n`` buckets; expected ln(n) rounds over the keys still jumping."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    nxt = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while live.size:
        at[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        nxt[live] = ((at[live] + 1) * (2147483648.0 / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[nxt[live] < n]
    return at


def key_hash(key: Column, first: int = 1) -> Column:
    """60 bits of the MD5 of the key as text, from hex digit ``first``; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), first, 15), 16, 10).cast("long")


def jump_shard(hashed: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a hashed key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @pandas_udf("int")
    def jump(h: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(h.to_numpy(np.int64), shards).astype(np.int32))

    return jump(hashed)


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard`` (the shard were there one more). A narrow map: nothing is shuffled.

    Rows with one key share a shard; null keys share one. Input columns of the added names are replaced.
    """
    df = without(df, "shard", "grown_shard")
    h = key_hash(F.col(quoted(key)))
    return df.withColumns({"shard": jump_shard(h, shards), "grown_shard": jump_shard(h, shards + 1)})


def number_slots(df: DataFrame, key: str, shards: int, ties: list[str | Column]) -> DataFrame:
    """``df``, which has ``shard``, with ``slot``: gapless from 0 in each shard, in an order shuffled by a hash of key and ties.

    A shard is cut into buckets of neighbouring hashes; bucket counts (at most ``GROUPS`` rows, broadcast) give each bucket's
    first slot, so rows are ranked within a bucket only and no task holds a shard. ``ties`` (columns, or expressions) tell rows of one
    key apart, so those of a frequent or null key are spread over the buckets too; rows alike in key and ties are interchangeable.
    """
    buckets = max(1, GROUPS // shards)
    df = without(df, "slot")
    order, bucket, start, place = unused(df, "order", "bucket", "start", "place")
    by = [F.col(quoted(key)), *[F.col(quoted(c)) if isinstance(c, str) else c for c in ties]]
    df = df.withColumn(order, key_hash(F.concat_ws("|", *[c.cast("string") for c in by]), 16)).withColumn(bucket, (F.shiftright(order, 30) * buckets / F.lit(1 << 30)).cast("int"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    starts = df.groupBy("shard", bucket).agg(F.count("*").alias("n")).select("shard", bucket, F.coalesce(before, F.lit(0)).alias(start))
    rank = F.row_number().over(W.partitionBy("shard", bucket).orderBy(order, *by))
    ranked = df.withColumn(place, rank.cast("long"))
    return ranked.join(F.broadcast(starts), ["shard", bucket]).withColumn("slot", F.col(start) + F.col(place) - 1).drop(order, bucket, start, place)


def shard_manifest(docs: DataFrame, shards: int) -> DataFrame:
    """One digest row for each document: doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard.

    A null text has size 16 and a null checksum; null ids share a shard; repeated rows each get a slot; an empty table gives an empty
    manifest. Other columns of ``docs`` do not matter, whatever their names.
    """
    digest = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    return number_slots(assign_shards(digest, "doc_id", shards), "doc_id", shards, ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write ``df`` as one Parquet folder for each shard, rows in slot order within each file. Rows of one key are told apart by a hash of
    all their columns, so those of a frequent key are ranked in many tasks; rows alike in all of them are interchangeable."""
    content = F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
    placed = number_slots(assign_shards(df, key, shards), key, shards, [content])
    placed.repartition(F.col("shard"), F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
