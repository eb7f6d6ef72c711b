"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. Shards take turns; at its turn
a shard claims the first slot of its order that nobody has. When the table is full, each shard owns an equal share of
slots (to one), and after a shard leaves or joins almost all slots keep their owner. A row goes to the shard that owns
the slot of its key's hash: one lookup, no shuffle.

The table has `slots` rows whatever the data (the bound is checked), so it is broadcast.

Defined results: a row whose key is null in every key column is placed by the hash of its other columns, so that
null keys don't meet in one shard; equal rows go to the same shard; empty and very long keys are hashed like others; an
empty table gives an empty result; a column of the input named like one of the new ones (slot, shard) gives way to it,
but if it is a key it still decides.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.llm.common import at, bare, given

#: Largest table that is broadcast: 4 million rows of two ints.
MOST_SLOTS = 1 << 22


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def claim_slots(shards: list[str], slots: int) -> list[int]:
    """For each slot the position in `shards` of the shard that owns it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    orders = []
    for s in shards:
        h = hashlib.md5(s.encode()).digest()
        orders.append((int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1 if slots > 2 else 1))
    owner, at, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for k, (offset, step) in enumerate(orders):
            while owner[slot := (offset + at[k] * step) % slots] >= 0:
                at[k] += 1
            owner[slot] = k
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot int, shard string). The owners travel in the plan as one string of `slots` numbers."""
    owners = ",".join(map(str, claim_slots(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "k")).select("slot", F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """The key's slot: the first 48 bits of its md5, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, keys: list[str], shards: list[str], slots: int = 65537, out: str = "shard") -> DataFrame:
    """df with `slot` int and `out` string."""
    mine = [at(df, k) for k in keys]
    rows = bare(df)
    others = [F.col(c).cast("string") for c in rows.columns if c not in mine] or [F.lit("")]
    gone = F.lit(True)
    for k in mine:
        gone = gone & F.col(k).isNull()
    key = F.when(gone, F.concat_ws("\x1f", *others)).otherwise(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in mine]))
    table = lookup_table(df.sparkSession, shards, slots)
    return rows.withColumn("slot", slot_of(key, slots)).join(F.broadcast(table), "slot", "left").select(*given(df, ["slot", out]), "slot", F.col("shard").alias(out))
