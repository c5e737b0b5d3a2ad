"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MAX_BROADCAST_ROWS = 200_000
SALTS = 32


def bounded_rows(frame: DataFrame, most: int = MAX_BROADCAST_ROWS) -> int | None:
    """Row count of a small frame, None if it has more than `most` rows."""
    count = frame.limit(most + 1).count()
    return count if count <= most else None


def bounded_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], rows: int | None, spread_by: Sequence[Column], how: str = "inner"
) -> DataFrame:
    """Join `big` with a side of at most `rows` rows.

    A proven small side is broadcast. Any other side is copied once per salt, and a
    hot key of `big` is spread over the salts by the hash of `spread_by`.
    """
    if rows is not None and rows <= MAX_BROADCAST_ROWS:
        return big.join(F.broadcast(small), list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
