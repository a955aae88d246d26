"""Operator 4: sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table. In turns, each claims the first slot of its order that is still free;
a row's shard is then one look into the table. Adding or losing a shard moves
few rows besides its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime, and the size bound of the broadcast table.
SLOTS = 65_537


def _number(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{text}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot; shares differ by one slot at most."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and no more than there are slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, or a shard's order of preference misses some")
    offset = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    step = [0] * len(shards)
    owner = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for k in range(len(shards)):
            while True:
                slot = (offset[k] + step[k] * skip[k]) % slots
                step[k] += 1
                if owner[slot] < 0:
                    break
            owner[slot] = k
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key from the first 52 bits of its MD5; null has the slot of the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """df with slot and shard of every row; columns of these two names are replaced, all others kept whatever their names.

    The table has `slots` rows whatever the data, so it is broadcast; no row is
    shuffled. Rows with equal keys go to one shard, null keys too.
    """
    owner = fill_table(shards, slots)
    table = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "at int, name string")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (shard_col, slot_col)]
    marked = df.select(F.struct(*kept).alias("row"), slot_of(F.col(key), slots).alias("slot"))
    out = marked.join(F.broadcast(table), F.col("slot") == F.col("at"), "left")
    return out.select("row.*", F.col("slot").alias(slot_col), F.col("name").alias(shard_col))


def write_shards(df: DataFrame, path: str, shards: list[str], key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Writes one directory per shard, in files of bounded size; rows of a shard are dealt to as many tasks as they fill files."""
    placed = place(df, shards, key)
    parts = max(1, -(-placed.count() // (rows_per_file * len(shards))))
    placed = placed.repartition(len(shards) * parts, "shard", F.pmod(F.xxhash64(key), F.lit(parts)))
    placed.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
