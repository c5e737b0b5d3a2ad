"""Sharding by jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that share a counter while slots are dealt; a task ranks about so many at a time.
ROWS_PER_COUNTER = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every unsigned 64-bit key (Lamping and Veach, 2014).

    A key jumps from shard to shard as shards are added; the last jump below `shards` is its place.
    With one more shard a key stays, or it jumps into the new one.
    """
    state = keys.astype(np.uint64, copy=True)
    place = np.full(len(state), -1, dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    moving = jump < shards
    while moving.any():
        place[moving] = jump[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        drawn = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[moving] = ((place[moving] + 1) * (float(1 << 31) / drawn)).astype(np.int64)
        moving = jump < shards
    return place.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key in 0 to `shards` - 1; a null key counts as 0."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return place(F.coalesce(key.cast("long"), F.lit(0)))


def with_slots(rows: DataFrame, group: str, order: list[Column], slot: str = "slot") -> DataFrame:
    """Number the rows of every group from 0 without a gap, though a group has many tasks.

    Rows go to counters by the hash of their order columns; every counter ranks its own rows, and the sums of
    the counters before it are added. The counters follow the row count, so the table of sums has one row for each
    `ROWS_PER_COUNTER` rows. The same rows get the same slots in every run; rows equal in all of `order` share theirs
    among themselves in any way.
    """
    total = rows.select(F.count(F.lit(1))).first()[0]
    counters = max(1, -(-total // ROWS_PER_COUNTER))
    dealt = rows.withColumn("_counter", F.pmod(F.xxhash64(*order), F.lit(counters)).cast("int"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_counter").orderBy(*order)))
    sums = dealt.groupBy(F.col(group).alias("_group"), F.col("_counter").alias("_before")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_group").orderBy("_before").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    found = ranked.join(sums, (F.col(group) == F.col("_group")) & (F.col("_counter") == F.col("_before")))
    return found.withColumn(slot, (F.col("_ahead") + F.col("_rank") - 1).cast("long")).drop(
        "_counter", "_rank", "_group", "_before", "_n", "_ahead"
    )


#: Columns that `placed` and `sharded` give beside the key.
PLACE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def placed(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with all its columns, and size, text_crc32, law, shard, slot and grown_shard.

    The key and the shard count alone decide. `size` is the UTF-8 bytes of the text plus 1, a null text has none;
    its checksum is that of no bytes. A null key counts as 0; repeated rows share a shard and have slots of their own,
    so shard and slot name a row. A column of `docs` that is named like one of the six gives way to it. A very long text
    is moved whole, once, with its row.
    """
    body, kept = F.coalesce(F.col(text), F.lit("")), [c for c in docs.columns if c not in PLACE]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(key).cast("long").alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    )
    rows = rows.withColumns({"law": F.lit("key"), "shard": shard_of(F.col("_key"), shards), "grown_shard": shard_of(F.col("_key"), shards + 1)})
    return with_slots(rows, "shard", [F.col("_key"), F.col("size"), F.col("text_crc32")]).select("_row.*", *PLACE)


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    The key and the shard count alone decide. `size` is the UTF-8 bytes of the text plus 1, a null text has none;
    its checksum is that of no bytes. A null key counts as 0, repeated rows share a shard and have slots of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = rows.withColumns({"law": F.lit("key"), "shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    rows = with_slots(rows, "shard", [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return rows.select("doc_id", *PLACE)


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write `docs` below `path`, one folder for each shard; a large shard has many files."""
    placed = docs.withColumn("shard", shard_of(F.col(key), shards))
    placed.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
