"""Shards by rendezvous hashing: every record picks the shard that wins its own draw.

A record and a shard make one uniform number from their hash; the shard with the smallest
``-ln(u) / weight`` takes the record, so shard ``i`` gets a share ``weight_i / sum(weights)``.
The draws of a shard do not depend on the others: one shard more takes rows into itself and
moves no other row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.scale import running

DRAW_BITS = 53


def _draw(keys: Sequence[Column], shard: int) -> Column:
    """A number in (0, 1) from the keys and the shard number."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 64 - DRAW_BITS)
    return (bits.cast("double") + 0.5) * 2.0**-DRAW_BITS


def rendezvous(keys: Sequence[str], shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard (0-based int) of a record with these key columns.

    ``weights`` defaults to equal shares and needs one positive number per shard. Rows with equal
    keys go to one shard. A null key column takes no part in the hash, so rows whose keys are all
    null share one shard. Equal draws go to the smaller shard number.
    """
    weights = [1.0] * shards if weights is None else [float(w) for w in weights]
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("one positive weight per shard")
    columns = [F.col(k) for k in keys]
    entries = [
        F.struct((-F.log(_draw(columns, s)) / w).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)
    ]
    return F.array_min(F.array(*entries))["shard"]


def assign_shards(
    df: DataFrame, keys: Sequence[str], shards: int, weights: Sequence[float] | None = None, shard: str = "shard"
) -> DataFrame:
    """``df`` with the shard of each row; a projection, so nothing is shuffled."""
    return df.withColumn(shard, rendezvous(keys, shards, weights))


def number_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Gapless 0-based places inside each shard, in ``order``.

    Rows that tie in ``order`` are equal for it and take neighbouring places. A shard of any size
    is numbered over many range partitions.
    """
    return running(df, [shard], list(order), position=slot).withColumn(slot, F.col(slot) - 1)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder of Parquet files per shard."""
    df.write.partitionBy(shard).parquet(path)
