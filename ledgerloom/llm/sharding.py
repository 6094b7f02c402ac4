"""Sharding by a permutation-filled lookup table.

Each shard has its own order of all slots of a prime-sized table: slots offset, offset + skip, offset + 2 skip, ... with
offset and skip from the shard's name. Shards take turns, each claiming the first slot of its order that is still free,
until the table is full. So every shard gets the same number of slots give or take one, and a shard that comes or goes
moves few slots of the others. A key's hash picks a slot, and the table, whose size is a parameter and doesn't grow with
the data, is broadcast: placement takes one lookup and no shuffle.

Null keys have slot and shard null. Ties can't occur (a slot is claimed once); repeated keys share their shard; empty
tables give no rows. Columns of df named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried

MOST_SLOTS = 1_000_003


def name_hash(text: str) -> int:
    """60 bits of the text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def slot_owners(shards: list[str], slots: int) -> list[int]:
    """For each slot, the number of the shard that claims it."""
    if len(set(shards)) < len(shards):
        raise ValueError("two shards have one name")
    if not shards or not max(2, len(shards)) <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the table needs a prime number of slots, at least one a shard and {MOST_SLOTS} at most")
    place = [name_hash(f"offset:{s}") % slots for s in shards]
    skip = [name_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for n in range(len(shards)):
            while owner[place[n]] >= 0:
                place[n] = (place[n] + skip[n]) % slots
            owner[place[n]], free = n, free - 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard): the table as rows, `slots` of them."""
    names = F.array(*[F.lit(s) for s in shards])
    filled = F.split(F.lit(",".join(map(str, slot_owners(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(filled).alias("slot", "n")).select("slot", F.element_at(names, F.col("n").cast("int") + 1).alias("shard"))


def assign_shards(df: DataFrame, key_col: str, shards: list[str], slots: int = 65_537) -> DataFrame:
    """df with `slot` and `shard` of key_col."""
    own = Carried(df, ["slot", "shard"])
    rows = df.select(*own.into, F.pmod(key_hash(df[key_col]), F.lit(slots)).cast("int").alias("slot"))
    return rows.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot", "left").select(*own.back, "slot", "shard")
