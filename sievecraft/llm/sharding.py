"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; the table's size is fixed, so it is safe to broadcast whatever the data.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the index of its shard.

    Each shard prefers the slots in an order of its own, offset + k * skip modulo the prime
    size; shards take turns, each claiming the next slot of its order that is still free.
    Shards differ by one slot at most, and few slots move if a shard comes or goes.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or not _is_prime(slots):
        raise ValueError("distinct shards, at least one and at most one a slot, and a prime number of slots are needed")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    table = np.full(slots, -1, np.int32)
    left = slots
    while True:
        for i in range(len(shards)):
            k = at[i]
            while table[k] >= 0:
                k = (k + skip[i]) % slots
            table[k] = i
            at[i] = (k + skip[i]) % slots
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot and shard (its name); replaces columns of these names.

    Equal keys meet in one shard and null is a key like others. The table of `slots` rows is
    broadcast: its size is a parameter and doesn't grow with the data. No row is shuffled.
    """
    table = df.sparkSession.createDataFrame(pa.table({"slot": np.arange(slots, dtype=np.int32), "shard": pa.array(shards).take(pa.array(fill(shards, slots)))}))
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot")
