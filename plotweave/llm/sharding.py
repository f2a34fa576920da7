"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row follows from its key and the number of shards alone, without a ring table. One more shard
takes about 1/(n+1) of the rows from all others and moves no other row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

OVERHEAD = 16
_STEP = np.uint64(2862933555777941757)  # multiplier of the published generator


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys advance together until each has jumped past ``shards``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state, at = keys.astype(np.uint64).copy(), np.zeros(len(keys), np.int64)
    bucket, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = at[live]
            state[live] = state[live] * _STEP + np.uint64(1)
            at[live] = ((bucket[live] + 1) * (2.0**31 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[at[live] < shards]
    return bucket


def _jump_udf(shards: int):
    @F.pandas_udf(T.IntegerType())
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", blocks: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, by the law ``key``.

    size: UTF-8 bytes of the text plus 16 (a null text has none). text_crc32: of the UTF-8 bytes, null as empty.
    slot numbers the rows of a shard from 0 without gaps, by (block, doc_id), a block being a hash class of ids:
    the counts of (shard, block) cells give each cell its first slot, so no shard is sorted in one task. Rows of
    one id, which are always in one shard and block, are told apart by text_crc32 and size. A null id counts as 0.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce("doc_id", F.lit(0).cast("long"))
    placed = rows.withColumn("shard", _jump_udf(shards)(key)).withColumn("grown_shard", _jump_udf(shards + 1)(key)).withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    cells = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    first = cells.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).select("shard", "block", "first")
    inside = W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(inside)).join(F.broadcast(first), ["shard", "block"])  # at most shards x blocks rows
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
