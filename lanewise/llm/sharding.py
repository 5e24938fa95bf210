"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own.  Shards take turns to claim their next free
slot until none is left, so all get equally many, give or take one, or in proportion to their weights.  A document
belongs to the shard that holds its slot; a shard that comes or goes moves few other slots.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import adding, free_prefix, quoted

#: A prime; the table has as many rows whatever the input, under 1 MB, and is broadcast.  Beyond 1024 shards it grows with
#: them, so that each holds 64 slots or more.
SLOTS, LEAST_EACH = 65_537, 64


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 2 and all(n % k for k in range(2, int(n**0.5) + 1))


def slots_for(shards: int) -> int:
    """SLOTS, or the first prime that gives each shard LEAST_EACH slots."""
    n = max(SLOTS, LEAST_EACH * shards)
    while not _is_prime(n):
        n += 1
    return n


def lookup_table(shards: list[str], weights: list[int] | None = None, slots: int | None = None) -> np.ndarray:
    """The shard's index for each slot.  weights: turns of each shard in a round, 1 or more; all 1 if None.

    The k-th choice of a shard is (offset + k * skip) mod slots, both hashed from its name; slots must be prime, so
    that a shard's choices are a permutation.  Turns go by name, so the list's order doesn't matter.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names, each once")
    slots = slots or slots_for(len(shards))
    if not _is_prime(slots):
        raise ValueError("the number of slots must be a prime over 2")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("each shard needs a weight of 1 or more")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = np.full(slots, -1, np.int32), slots
    while free:
        for i in order:
            for _ in range(turns[i]):
                while free and table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                if free:
                    table[at[i]] = i
                    free -= 1
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: 60 bits of the md5 of its text, modulo the slots; null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], weights: list[int] | None = None) -> DataFrame:
    """(slot, shard), one row for each slot."""
    rows = [(k, shards[i]) for k, i in enumerate(lookup_table(shards, weights).tolist())]
    return spark.createDataFrame(rows, "slot int, shard string")


def assign(docs: DataFrame, shards: list[str], weights: list[int] | None = None, key: str = "doc_id") -> DataFrame:
    """All columns of docs, `slot` and `shard`.  Placement is one look into the broadcast table; nothing is shuffled.

    Rows with equal keys share a shard.  A key that many rows share should be split first; doc_id is not such a key.
    """
    docs, names, _ = adding(docs, slot="int", shard="string")
    placed = docs.withColumn("slot", slot(F.col(quoted(key)), slots_for(len(shards))))
    return placed.join(F.broadcast(table_frame(docs.sparkSession, shards, weights)), "slot").select(*map(quoted, names), "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str], weights: list[int] | None = None, files: int = 4) -> None:
    """Writes docs as Parquet partitioned by shard, about `files` files for each."""
    placed = assign(docs, shards, weights)
    spot = free_prefix(placed, "part")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(files))
    placed.withColumn(spot, part).repartition(len(shards) * files, "shard", spot).drop(spot, "slot").write.partitionBy("shard").parquet(path)
